"""A verdict on header lines carried to the lines of their entries.

The lines of a split follow each other in a scan task, so inside a split the verdict of a
header is filled forward while the lines stream by, with no shuffle and no window. Only what
the last header before a split said has to come from elsewhere: one row per split.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions.header import clean_line, header_columns, is_header
from logweir.operators.numbering import broadcast_if_small, is_small

if TYPE_CHECKING:
    from logweir.plans.logset import LogSet

LINE_FIELDS = ["file", "block_no", "owner_no", "line_number", "value"]
_SCHEMA = pa.schema([
    ("file", pa.string()), ("block_no", pa.int64()), ("owner_no", pa.int64()),
    ("line_number", pa.int64()), ("value", pa.string()), ("verdict", pa.bool_()),
])
_DDL = "file string, block_no bigint, owner_no bigint, line_number bigint, value string, verdict boolean"


def with_verdict(lines: DataFrame, verdict: Column) -> DataFrame:
    """Adds ``verdict``: true or false on a header line, null on any other line."""
    text = lines.withColumn("_text", clean_line("value"))
    typed = text.select("*", *header_columns("_text"))
    said = F.when(is_header("_text"), F.coalesce(verdict, F.lit(False)))
    return typed.select(*lines.columns, said.alias("verdict"))


def _fill(keep: bool):
    """Fills verdicts forward inside splits; lines that are decided otherwise are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, line = None, None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = batch.column("file"), batch.column("block_no").to_numpy()
            names = files.dictionary_encode()
            codes = names.indices.to_numpy()
            lines = batch.column("line_number").to_numpy()
            new = np.ones(len(blocks), dtype=bool)
            new[1:] = (blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])
            goes_on = key == (files[0].as_py(), blocks[0])
            if (np.diff(lines)[~new[1:]] <= 0).any() or (goes_on and lines[0] <= line):
                raise ValueError("the lines of a split came in another order")
            said = batch.column("verdict")
            known = np.flatnonzero(said.is_valid().to_numpy(zero_copy_only=False))
            values = said.fill_null(False).to_numpy(zero_copy_only=False)
            at = np.full(len(blocks), -1)
            at[known] = known
            at = np.maximum.accumulate(at)
            start = np.maximum.accumulate(np.where(new, np.arange(len(blocks)), 0))
            own = at >= start
            verdict = np.where(own, values[np.maximum(at, 0)], False)
            if goes_on and held is not None:
                first = (start == 0) & ~own
                verdict[first], own = held, own | first
            out = pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(verdict, mask=~own)], schema=_SCHEMA)
            yield out.filter(pa.array(~own | (verdict == keep)))
            key, line = (files[len(files) - 1].as_py(), blocks[-1]), lines[-1]
            held = bool(verdict[-1]) if own[-1] else None

    return run


def decided(log: LogSet, verdict: Column, keep: bool, orphan: Column | None = None) -> DataFrame:
    """Lines whose entry's verdict is ``keep``, straight from the scan; lines before the first
    header of a file go by ``orphan``."""
    lines = log.lines().select(*LINE_FIELDS)
    said = with_verdict(lines, verdict)
    last = said.where(F.col("verdict").isNotNull()).groupBy("file", "block_no").agg(
        F.max_by("verdict", "line_number").alias("last_verdict"))
    before = (
        Window.partitionBy("file").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = log.index.select("file", "block_no").join(last, ["file", "block_no"], "left").select(
        "file", "block_no", F.last("last_verdict", ignorenulls=True).over(before).alias("carry"))
    if not is_small(log.blocks):
        # Numbers came by a shuffled join then, which leaves no order.
        keys = ["file", "block_no"]
        said = said.repartition(*keys).sortWithinPartitions(*keys, "line_number")
    filled = said.mapInArrow(_fill(keep), _DDL)
    side = broadcast_if_small(carried, log.blocks)
    whole = F.coalesce("verdict", "carry", orphan if orphan is not None else F.lit(False))
    return filled.join(side, ["file", "block_no"], "left").where(whole == F.lit(keep)).select(
        *LINE_FIELDS)
