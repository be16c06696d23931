"""Targets of segments: attach by position, find the failures, patch and split the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.sampling import block_split


def targets_of_tasks(tasks: DataFrame, targets: DataFrame, task: str = "task") -> DataFrame:
    """Tasks with the target list recorded under their name; of several lists the last by source; null if none."""
    latest = targets.groupBy(task).agg(F.max_by("target_objects", "source").alias("target_objects"))
    return tasks.join(latest, task, "left")


def attach_targets(segments: DataFrame, targets: DataFrame, key: str = "episode") -> DataFrame:
    """Segments with the target at their position and the reason it is unusable.

    ``targets``: (episode, position, target struct, listed = entries the list has). A short list
    gives its reason once, and only on an episode without an earlier failure.
    """
    sizes = targets.groupBy(key).agg(F.max("listed").alias("_listed"))
    t = targets.select(key, F.col("position").alias("seg_index"), "target", F.lit(True).alias("_there"))
    j = segments.join(t, [key, "seg_index"], "left").join(sizes, key, "left")
    there = F.col("seg_index") < F.coalesce("_listed", F.lit(0))
    reason = (
        F.when(~there, "list_too_short")
        .when(F.col("target").isNull(), "no_target")
        .when(F.col("target.image_point").isNull(), "no_grounding_point")
    )
    return j.withColumn("reason", reason).drop("_there", "_listed")


def reasons(attached: DataFrame, key: str = "episode") -> DataFrame:
    """Reported reasons: all entry failures, and the short list once if nothing failed before it."""
    short = F.col("reason") == "list_too_short"
    per_episode = attached.groupBy(key).agg(
        F.min(F.when(short, F.col("seg_index"))).alias("_first_short"),
        F.max((F.col("reason").isNotNull() & ~short).cast("int")).alias("_other"),
    )
    j = attached.filter(F.col("reason").isNotNull()).join(per_episode, key)
    kept = ~short | ((F.col("seg_index") == F.col("_first_short")) & (F.col("_other") == 0))
    return j.filter(kept).select(key, "seg_index", "reason")


def failed_episodes(attached: DataFrame, key: str = "episode") -> DataFrame:
    return attached.filter(F.col("reason").isNotNull()).select(key).distinct()


def patch_targets(attached: DataFrame) -> DataFrame:
    """Fill missing targets and points with the neutral values of training."""
    t = F.col("target")
    pointless = F.col("target.image_point").isNull()
    word = lambda f: F.when(t.isNull(), "NULL").otherwise(t[f])
    return attached.withColumn(
        "target",
        F.struct(
            word("type").alias("type"),
            word("id").alias("id"),
            word("appearance").alias("appearance"),
            F.when(pointless, "NULL").otherwise(t["location"]).alias("location"),
            F.coalesce(t["image_point"], F.array(F.lit(0.0), F.lit(0.0))).alias("image_point"),
        ),
    )


def failed_episode_batches(errors: DataFrame, key: str = "episode", batches: int = 4) -> DataFrame:
    """Distinct failed ids in id order, cut into equal batches."""
    return block_split(errors.select(key).distinct(), [key], key, batches)
