"""Log analytics on Spark DataFrames."""

from logweir.operators.filters import LogFilter
from logweir.plans.logset import LogSet, logs_of_lines, logs_of_text, open_logs
from logweir.plans.session import configure

__all__ = ["LogFilter", "LogSet", "configure", "logs_of_lines", "logs_of_text", "open_logs"]
