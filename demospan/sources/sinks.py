"""Writers. Parquet is the primary form; single-document exports are for small results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import TARGET
from ..session import cut_lineage
from .blocks import register

BUCKETS, BUCKET = 1024, 10_000


def _written(spark: SparkSession, path: str, schema: T.StructType, buckets: list[int]) -> DataFrame | None:
    """The rows that lie in some buckets, or None where nothing was written yet."""
    try:
        there = spark.read.schema(T.StructType([*schema.fields, T.StructField("episode_bucket", T.LongType())])).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return there.filter(F.col("episode_bucket").isin(buckets))


def write_annotations(df: DataFrame, path: str, key: str = "episode_index", buckets: int = BUCKETS) -> None:
    """JSON rows in buckets of episodes, a file each; an episode written again replaces its earlier rows.

    Only the buckets that ``df`` touches are read and written anew, with the rows of their other episodes; a commit
    publishes all of a job's files or none. A folder keeps the number of buckets it was begun with, and has one
    writer at a time. Rows without a key replace each other too.
    """
    spark = df.sparkSession
    rows = df.withColumn("episode_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("bigint"))
    touched = [r[0] for r in rows.select("episode_bucket").distinct().collect()]  # at most ``buckets``
    old = _written(spark, path, df.schema, touched)
    if old is not None:
        again = rows.select(F.col(key).alias("_again")).distinct()
        kept = old.join(again, old[key].eqNullSafe(again["_again"]), "left_anti")
        rows = cut_lineage(rows.unionByName(kept))  # read before the files are replaced
    rows.repartition("episode_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("episode_bucket").json(path)


def document_rows(df: DataFrame, key: str = "episode_index") -> DataFrame:
    """(key as text, JSON of the row): the entries of a combined document, one row per episode."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_document(df: DataFrame, header: DataFrame, path: str, key: str = "episode_index") -> None:
    """A combined document as text part files in key order that concatenate to one JSON object.

    Lines are written in parallel by range of the key; no task sees the whole document.
    """
    lines = df.select(
        F.lit(1).alias("_part"),
        F.col(key).cast("bigint").alias("_k"),
        F.concat(F.lit(',"'), F.col(key).cast("string"), F.lit('":'), F.to_json(F.struct(*df.columns))).alias("value"),
    )
    head = header.limit(1).select(
        F.lit(0).alias("_part"),
        F.lit(-1).cast("bigint").alias("_k"),
        F.expr("substring(to_json(struct(*)), 1, length(to_json(struct(*))) - 1)").alias("value"),
    )
    tail = header.limit(1).select(F.lit(2).alias("_part"), F.lit(-1).cast("bigint").alias("_k"), F.lit("}").alias("value"))
    whole = head.unionByName(lines).unionByName(tail)
    whole.orderBy("_part", "_k").select("value").write.mode("overwrite").text(path)


def write_errors(errors: DataFrame, path: str) -> None:
    errors.write.mode("overwrite").parquet(path)


def append_manifest(df: DataFrame, path: str, **fields) -> None:
    """One row about the run."""
    row = df.sparkSession.range(1).select(
        F.current_timestamp().alias("created_at"), *[F.lit(v).alias(k) for k, v in fields.items()]
    )
    row.write.mode("append").parquet(path)


def write_ids(df: DataFrame, path: str, key: str = "episode_index") -> None:
    df.select(key).orderBy(key).select(F.col(key).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_targets(attached: DataFrame, path: str, key: str = "episode") -> None:
    """A gzip list per episode, as ``readers.read_target_lists`` reads it, from (episode, seg_index, target).

    Lists are in the order of seg_index; an episode's list is put together by one task.
    """
    register(attached.sparkSession)
    rows = attached.select(
        F.col(key).cast("bigint").alias("episode"), F.lit(1).cast("bigint").alias("listed"), F.col("seg_index").cast("bigint").alias("position"), F.col("target").cast(TARGET).alias("target")
    )
    rows.repartition("episode").sortWithinPartitions("episode", "position").write.format("target_lists").mode("append").option("path", path).save()


def write_latent_blocks(latents: DataFrame, path: str) -> None:
    """A compressed block and its sidecar per episode, as ``readers.read_latents`` reads them."""
    register(latents.sparkSession)
    rows = latents.select(F.col("episode").cast("bigint"), F.col("step").cast("bigint"), F.col("embedding").cast("array<float>"), F.col("shape").cast("array<int>"))
    rows.repartition("episode").sortWithinPartitions("episode", "step").write.format("latent_blocks").mode("append").option("path", path).save()


def write_latents(latents: DataFrame, path: str) -> None:
    """Parquet float arrays with their shape, zstd, sorted inside each bucket of episodes."""
    df = latents.withColumn("episode_bucket", F.floor(F.col("episode") / BUCKET))
    df.write.mode("overwrite").option("compression", "zstd").partitionBy("episode_bucket").parquet(path)


CARD = """# {name}

- episodes: {episodes}
- tasks: {tasks}
- steps: {steps}
"""


def dataset_card(annotations: DataFrame, name: str) -> str:
    """Card text from three totals: the only values that reach the driver."""
    row = annotations.agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_distinct("task_index").alias("tasks"),
        F.coalesce(F.sum("num_steps"), F.lit(0)).alias("steps"),
    ).first()
    return CARD.format(name=name, **row.asDict())
