"""Writing logs and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.sources.storage import create_empty, list_children

# Fixed: characters that partition folder names escape.
ESCAPED = "\"#%'*/:=?\\{[]^"


def write_logs(lines: DataFrame, folder: str) -> None:
    """Write ``file, line_number, value`` lines that are range-ordered across tasks.

    Part order is line order. Values go out as raw bytes, carriage returns included.
    The target has to be a new folder; swapping it in is left to the caller, so a lost
    executor or a failed job never leaves a half-written log in place.
    """
    # With the block in the order the sort of a preceding block window is reused.
    order = [c for c in ("file", "block_no", "line_number") if c in lines.columns]
    (
        lines.withColumn("file", F.coalesce("file", F.lit("")))
        .sortWithinPartitions(*order)
        .select("file", "value")
        .write.partitionBy("file")
        .option("lineSep", "\n")
        .text(folder)
    )


def in_line_order(lines: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spread any lines over tasks by file and line for ``write_logs``."""
    keys = ["file", "line_number"]
    if partitions:
        return lines.repartitionByRange(partitions, *keys)
    return lines.repartitionByRange(*keys)


def keep_emptied(spark: SparkSession, names: list[str], folder: str) -> None:
    """Give logs without any written line an empty part, as truncating a file leaves it."""
    written = {c.name for c in list_children(spark, folder) if c.is_folder}
    for name in names:
        own = f"file={folder_name(name)}"
        if own not in written:
            create_empty(spark, f"{folder}/{own}/part-00000-empty.txt")


def folder_name(value: str) -> str:
    """A log name the way partition folders spell it."""
    return "".join(
        f"%{ord(c):02X}" if c in ESCAPED or ord(c) < 32 or ord(c) == 127 else c for c in value
    )


def export_text(texts: DataFrame, folder: str) -> None:
    """Write one text column as plain text."""
    texts.write.option("lineSep", "\n").text(folder)
