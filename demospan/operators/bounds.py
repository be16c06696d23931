"""Episodes laid end to end in one long file: their row ranges, and rows back to episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordered import ordered_by_blocks

ID_BLOCK = 65_536
ROW_BLOCK = 65_536


def episode_bounds(episodes: DataFrame, key: str, length: str) -> DataFrame:
    """Episodes with first_row and end_row (exclusive), in order of the key.

    A running sum over blocks of ids; only a row per block crosses between tasks.
    """
    o = ordered_by_blocks(episodes, [], [key], F.floor(F.col(key) / ID_BLOCK)).scan(sums={"end_row": F.col(length)})
    return o.rows("_all").withColumn("first_row", F.col("end_row") - F.col(length))


def rows_in_episodes(rows: DataFrame, bounds: DataFrame, offset: str, key: str = "episode") -> DataFrame:
    """Each row with the episode whose range holds its offset, and its step there; none where no range does.

    Ranges and offsets meet by block of offsets, so the work of a long episode is shared.
    """
    held = bounds.filter(F.col("end_row") > F.col("first_row"))
    blocks = F.sequence(F.floor(F.col("first_row") / ROW_BLOCK), F.floor((F.col("end_row") - 1) / ROW_BLOCK))
    b = held.select(F.col(key), F.col("first_row").alias("_first"), F.col("end_row").alias("_end"), F.explode(blocks).alias("_b"))
    r = rows.withColumn("_block", F.floor(F.col(offset) / ROW_BLOCK))
    on = (F.col("_block") == F.col("_b")) & (F.col(offset) >= F.col("_first")) & (F.col(offset) < F.col("_end"))
    out = r.join(b, on, "left").withColumn("step", F.col(offset) - F.col("_first"))
    return out.drop("_block", "_b", "_first", "_end")
