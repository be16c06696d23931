"""Shards of annotations -> canonical, training and trace tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..functions import vocab as V
from ..operators.aggregates import duplicate_sources, first_episode_metadata
from ..operators.joins import compare, missing, present_in_both
from ..operators.segments import boundary_action_split, explode_segments, length_stats

TRACE_HEADER = [
    "image_key",
    "image_width",
    "image_height",
    "query_image_width",
    "query_image_height",
    "model_coordinate_width",
    "model_coordinate_height",
    "trace_frame_count",
    "semantic_target_enabled",
    "contact_prediction_enabled",
    "contact_extraction_enabled",
    "contact_prediction_only_enabled",
    "end_effector_trace_enabled",
]


def combine(shards: DataFrame, requested: DataFrame | None = None, key: str = "episode_index", source: str = "source"):
    """(rows to publish, duplicates, missing): the caller decides whether the last two stop the job."""
    twice = duplicate_sources(shards, [key], source)
    if requested is None:
        return shards, twice, None
    return present_in_both(shards, requested, [key]), twice, missing(requested, shards, [key])


def training_segments(annotations: DataFrame, dataset: str, window: int = V.BOUNDARY_WINDOW) -> DataFrame:
    """Boundary and action rows with their texts, one row per part.

    The plan text stays in the row that already holds it, so nothing is gathered per episode.
    """
    keep = ["episode_index", "instruction", "plan"]
    plan = X.format_plan(X.parse_plan(F.col("plan"), dataset)["skills"])
    base = annotations.withColumn("plan", plan).select(
        *keep, F.posexplode("segments").alias("seg_index", "_s")
    )
    flat = base.select(
        *keep,
        "seg_index",
        F.col("_s.start_step").alias("start_step"),
        F.col("_s.end_step").alias("end_step"),
        X.canonical_skill(F.col("_s.skill"), dataset).alias("skill"),
    )
    parts = boundary_action_split(flat, window)
    return with_texts(parts)


def training(annotations: DataFrame, dataset: str, window: int = V.BOUNDARY_WINDOW) -> tuple[DataFrame, DataFrame]:
    """(training parts, violations): a plan that does not parse has no parts but a row (episode_index, rule)."""
    plan = F.col("plan")
    judged = X.once(annotations, "_rule", F.when(plan.isNull(), "no_plan").otherwise(X.parse_plan(plan, dataset)["reason"]))
    sound = judged.filter(F.col("_rule").isNull()).drop("_rule")
    return training_segments(sound, dataset, window), judged.filter(F.col("_rule").isNotNull()).select("episode_index", F.col("_rule").alias("rule"))


def with_texts(parts: DataFrame) -> DataFrame:
    boundary = F.col("part") == "boundary"
    instruction, plan, skill = F.col("instruction"), F.col("plan"), F.col("skill")
    return parts.select(
        "*",
        F.concat(F.lit("Instruction: "), instruction).alias("instruction_text"),
        F.when(boundary, skill).alias("updated_skill"),
        F.when(boundary, X.skill_context(instruction, plan, None))
        .otherwise(X.skill_context(instruction, plan, skill))
        .alias("content"),
        F.when(boundary, X.skill_context(None, plan, skill)).alias("updated_content"),
        F.when(boundary, X.skill_context(instruction, plan, skill)).alias("updated_content_w_instruction"),
    )


def start_intervals(parts: DataFrame, key: str = "episode_index") -> DataFrame:
    """[0, end of the first part) per episode."""
    return parts.filter((F.col("seg_index") == 0) & (F.col("part") == "boundary")).select(
        key, F.lit(0).cast("bigint").alias("interval_start"), F.col("end_step").alias("interval_end")
    )


def header_row(annotations: DataFrame, schema_version: str, **fields) -> DataFrame:
    """The fixed header fields as a one-row table."""
    values = {"schema_version": schema_version, **fields}
    return annotations.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def alignment_violations(traces: DataFrame, segments: DataFrame, key: str = "episode_index") -> DataFrame:
    """Trace entries against skill segments by position: missing on a side, or another skill or interval."""
    return compare(segments, traces, [key, "seg_index"], ["skill", "start_step", "end_step"])


def explode_traces(annotations: DataFrame, key: str = "episode_index") -> DataFrame:
    entries = annotations.select(key, F.posexplode("target_traces").alias("seg_index", "_t"))
    return entries.select(key, "seg_index", "_t.*")


def strip_for_publication(entries: Column) -> Column:
    """Leave out what follows from the segment or only served the making of the trace."""

    def slim(e: Column) -> Column:
        e = e.withField(
            "end_effector_trace", e["end_effector_trace"].dropFields("frame_indices", "in_bounds", "projection_depth")
        )
        traced = e["prediction_trace"].isNotNull() | e["extraction_trace"].isNotNull()
        return e.withField("sampled_frame_indices", F.when(traced, e["sampled_frame_indices"]))

    return F.transform(entries, slim)


def combine_traces(shards: DataFrame, annotations: DataFrame, requested: DataFrame | None = None):
    """(published rows, header row, length statistics, violations, duplicates, missing)."""
    rows, twice, absent = combine(shards, requested)
    entries = explode_traces(rows)
    wrong = alignment_violations(
        entries.select("episode_index", "seg_index", "skill", "start_step", "end_step"),
        explode_segments(annotations.join(rows.select("episode_index"), "episode_index", "left_semi"), ["episode_index"]).select(
            "episode_index", "seg_index", "skill", "start_step", "end_step"
        ),
    )
    stats = length_stats(entries.withColumn("verb", X.skill_verb(F.col("skill"))))
    header = first_episode_metadata(rows, "episode_index", TRACE_HEADER)
    published = rows.withColumn("target_traces", strip_for_publication(F.col("target_traces")))
    return published, header, stats, wrong, twice, absent
