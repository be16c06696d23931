"""How the test tables are read as robot-demonstration data, in Spark and, for the oracles, in SQL.

    segments   line items: episode = order, length = quantity, verb from the two flags
    frames     events: episode = user, step = position in time, skill = event type
    episodes   orders
    tasks      priorities of the orders
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from demospan.functions import vocab as V
from demospan.operators.frames import episode_frames
from demospan.operators.ordered import Ordered, ordered
from demospan.operators.segments import from_lengths

SEGMENT_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def verb_of_flags() -> Column:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return (
        F.when((flag == "A") & (status == "F"), "PICKUP_FROM")
        .when((flag == "A") & (status == "O"), "PLACE_ON")
        .when((flag == "R") & (status == "F"), "PLACE_IN")
        .when((flag == "R") & (status == "O"), "OPEN")
        .when((flag == "N") & (status == "F"), "CLOSE")
        .otherwise("TURN_ON")
    )


def near(x: Column | str, digits: int) -> Column:
    """Round for comparison. Ties are moved off the boundary, so both engines agree on them; the
    oracles write it as floor(x * 1eN + 0.5001) / 1eN."""
    scale = float(10**digits)
    return F.floor((F.col(x) if isinstance(x, str) else x) * scale + 0.5001) / scale


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def raw_segments(self) -> DataFrame:
        """Line items as unplaced segments."""
        return self.lineitem.select(
            F.col("l_orderkey").alias("episode"),
            *SEGMENT_ORDER,
            F.col("l_quantity").cast("bigint").alias("length"),
            verb_of_flags().alias("verb"),
        )

    def place(self, df: DataFrame, *values: str) -> Ordered:
        """Segments with seg_index, start_step, end_step; only the named value columns are shuffled."""
        kept = df.select("episode", *SEGMENT_ORDER, "length", *values)
        return from_lengths(ordered(kept, ["episode"], SEGMENT_ORDER, split="l_shipdate"), "length")

    @cached_property
    def segments(self) -> Ordered:
        return self.place(self.raw_segments, "verb")

    @cached_property
    def skill_segments(self) -> Ordered:
        """Segments whose skill text names the part."""
        p = self.part.select("p_partkey", "p_name", "p_type")
        df = self.raw_segments.join(p, F.col("l_partkey") == F.col("p_partkey"))
        two = F.col("verb").isin("PICKUP_FROM", "PLACE_ON", "PLACE_IN")
        second = F.when(two, F.concat(F.lit(", "), F.lower("p_type"))).otherwise("")
        skill = F.concat("verb", F.lit("("), "p_name", second, F.lit(")"))
        return self.place(df.withColumn("skill", skill), "verb", "skill")

    @cached_property
    def frames(self) -> Ordered:
        df = self.events.select(
            F.col("user_id").alias("episode"), "ts", "event_id", F.col("event_type").alias("skill"), "value"
        )
        return episode_frames(df, ["episode"], ["ts", "event_id"], split="ts")

    @cached_property
    def cameras(self) -> DataFrame:
        """One camera per supplier."""
        n, k = F.col("s_nationkey").cast("double"), F.col("s_suppkey")
        row = lambda *v: F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in v])
        return self.supplier.select(
            k.alias("camera"),
            F.array(
                row(200 + n, 0, 128, F.col("s_acctbal") / 100),
                row(0, 200 + n, 128, n),
                row(0, 0, 1, 2),
                row(0, 0, 0, 1),
            ).alias("matrix"),
            F.when(k % 3 == 0, V.NO_TRANSFORM)
            .when(k % 3 == 1, V.HORIZONTAL_FLIP)
            .otherwise(V.ROTATED_180)
            .alias("convention"),
        )

    @cached_property
    def rollouts(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("episode"),
            F.col("o_orderpriority").alias("task"),
            (F.col("o_orderstatus") == "F").alias("success"),
        )


# --- the same readings for the oracles -----------------------------------------------------------

VERB_SQL = """CASE WHEN l_returnflag='A' AND l_linestatus='F' THEN 'PICKUP_FROM'
  WHEN l_returnflag='A' AND l_linestatus='O' THEN 'PLACE_ON'
  WHEN l_returnflag='R' AND l_linestatus='F' THEN 'PLACE_IN'
  WHEN l_returnflag='R' AND l_linestatus='O' THEN 'OPEN'
  WHEN l_returnflag='N' AND l_linestatus='F' THEN 'CLOSE' ELSE 'TURN_ON' END"""
SEGMENT_WINDOW = """(PARTITION BY l_orderkey
  ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)"""
SEGMENTS = f"""segments AS (
  SELECT l_orderkey AS episode, row_number() OVER w - 1 AS seg_index, {VERB_SQL} AS verb,
    CAST(l_quantity AS BIGINT) AS length,
    CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS end_step,
    CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) - CAST(l_quantity AS BIGINT) AS start_step,
    l_partkey, l_suppkey, l_linenumber
  FROM lineitem WINDOW w AS {SEGMENT_WINDOW})"""
SKILL_SEGMENTS = SEGMENTS + """, skill_segments AS (
  SELECT s.*, verb || '(' || p_name ||
    CASE WHEN verb IN ('PICKUP_FROM','PLACE_ON','PLACE_IN') THEN ', ' || lower(p_type) ELSE '' END || ')' AS skill
  FROM segments s JOIN part ON l_partkey = p_partkey)"""
FRAMES = """frames AS (
  SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
    event_type AS skill, value, ts, event_id FROM events)"""
CAMERAS = f"""cameras AS (
  SELECT s_suppkey AS camera, 200.0 + s_nationkey AS f, s_acctbal / 100 AS tx, CAST(s_nationkey AS DOUBLE) AS ty,
    s_suppkey % 3 AS conv FROM supplier)"""
