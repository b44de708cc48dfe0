"""Line numbers and entry ownership without one task per file.

A window over a whole file would put the file into one task. Here every file is cut into
blocks (the scan's own splits), one small row per block is made by a map-side aggregate,
and prefix sums run over these rows only. Lines then get their number from

    position in the scan + shift of their block

which is a broadcast join and an addition, no shuffle of text.

Raw lines have the columns ``file, part_no, part, block, pos, value``. ``pos`` counts
lines without a gap inside a block; ``part_no, part, block`` order the blocks of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions.header import clean_line, is_header

BLOCK_KEYS = ["part", "block"]
# A row of the index holds a path and some numbers; it takes well under this much memory in a
# hash relation.
INDEX_ROW_BYTES = 512
BROADCAST_LIMIT_BYTES = 1 << 28


def block_index(raw: DataFrame, numbered: bool = False) -> DataFrame:
    """One row per block: its place in the file, line shift and the header before it.

    ``numbered`` says that ``pos`` already is the line number of the line.
    """
    text = raw.withColumn("text", clean_line("value"))
    head_pos = F.expr("if(is_head, pos, null)")
    blocks = text.withColumn("is_head", is_header("text")).groupBy("file", "part_no", *BLOCK_KEYS).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.octet_length("value") + 1).alias("n_bytes"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.count(head_pos).alias("n_heads"),
        F.min(head_pos).alias("first_head_pos"),
        F.max(head_pos).alias("last_head_pos"),
    )
    in_order = Window.partitionBy("file").orderBy("part_no", *BLOCK_KEYS)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    lines_before = F.coalesce(F.sum("n_lines").over(before), F.lit(0))
    shift = F.lit(0).cast("bigint") if numbered else lines_before + 1 - F.col("first_pos")
    with_head = F.when(F.col("n_heads") > 0, F.col("block_no"))
    return (
        blocks.withColumn("block_no", F.row_number().over(in_order).cast("bigint"))
        .withColumn("shift", shift)
        .withColumn("carry_no", F.max(with_head).over(before))
        .withColumn("carry_line", F.max(F.col("last_head_pos") + F.col("shift")).over(before))
        # The byte at which the block's first line starts, counting from the log's start.
        .withColumn("first_byte", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)))
    )


def text_size(index: DataFrame) -> tuple[int, int]:
    """(blocks, bytes of text) of an index. The number of blocks is the proven size of what
    is broadcast for these lines."""
    row = index.agg(
        F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")
    ).first()
    return row["blocks"], row["bytes"]


def is_small(rows: int, row_bytes: int = INDEX_ROW_BYTES) -> bool:
    return rows * row_bytes <= BROADCAST_LIMIT_BYTES


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int = INDEX_ROW_BYTES) -> DataFrame:
    """Broadcast hint for a side of known size; beyond the bound a shuffled join is used."""
    return F.broadcast(df) if is_small(rows, row_bytes) else df


def number_lines(raw: DataFrame, index: DataFrame, index_rows: int) -> DataFrame:
    """Lines with ``line_number``, ``block_no`` and ``owner_no``.

    ``owner_no`` is the block that holds the header the line belongs to; it is null for
    lines before the first header of a file. The check stops a job whose scan was cut
    differently from the scan that built the index.
    """
    side = index.select(
        *BLOCK_KEYS, "block_no", "shift", "first_pos", "last_pos", "first_head_pos", "carry_no"
    )
    joined = raw.join(broadcast_if_small(side, index_rows), BLOCK_KEYS, "left")
    inside = F.col("pos").between(F.col("first_pos"), F.col("last_pos"))

    def checked(value: Column) -> Column:
        stop = F.raise_error(F.lit("the log was split differently since it was indexed"))
        return F.when(inside, value).otherwise(stop.cast("bigint"))

    number = checked(F.col("pos") + F.col("shift"))
    owner = F.when(F.col("pos") >= F.col("first_head_pos"), F.col("block_no")).otherwise(
        F.col("carry_no")
    )
    return joined.select(
        "file",
        number.alias("line_number"),
        "value",
        checked(F.col("block_no")).alias("block_no"),
        owner.alias("owner_no"),
    )
