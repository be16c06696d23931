"""Training frames: each frame with its segment, progress, action chunk and trace positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions import vocab as V
from ..operators.aggregates import element_stats
from ..operators.frames import action_chunks, anchor_step, frames_in_segments, progress, scene_dropout


def training_frames(
    frames: DataFrame,
    segments: DataFrame,
    width: int,
    height: int,
    horizon: int = 16,
    dims: int = V.ACTION_SIZE,
    max_age: int = V.MAX_ANCHOR_AGE,
    seed: int = 42,
) -> DataFrame:
    """One row per frame inside a segment.

    ``frames``: (episode, step, x, y, action), ``segments``: (episode, seg_index, start_step,
    end_step, skill, target_x, target_y). The residual trace of a frame is the pixels of its segment
    from ``step`` on; it is kept as an interval, because writing it out per frame would multiply the
    data by the segment length.
    """
    f = frames_in_segments(frames, segments)
    chunks = action_chunks(
        f.select("episode", "seg_index", "step", "end_step", "action"), ["episode", "seg_index"], horizon, dims
    )
    step, start, end = F.col("step"), F.col("start_step"), F.col("end_step")
    verb = X.skill_verb_lenient(F.col("skill"))
    anchored = anchor_step(step, start, F.col("episode"), max_age, seed)
    return f.join(chunks, ["episode", "seg_index", "step"]).select(
        "episode",
        "seg_index",
        "step",
        "skill",
        verb.alias("skill_name"),
        X.expert_id(verb).alias("skill_id"),
        X.policy_prompt(F.col("skill"), verb, F.lit("")).alias("prompt"),
        progress(step, start, end).alias("progress"),
        anchored.alias("anchor_step"),
        end.alias("trace_end_step"),
        G.normalized_by_size(F.col("x"), width).alias("current_x"),
        G.normalized_by_size(F.col("y"), height).alias("current_y"),
        G.normalized(F.col("target_x"), width).alias("target_x"),
        G.normalized(F.col("target_y"), height).alias("target_y"),
        scene_dropout(F.col("episode"), step, seed=seed, salt="clean").alias("clean_dropped"),
        scene_dropout(F.col("episode"), step, seed=seed, salt="overlay").alias("overlay_dropped"),
        "action_chunk",
        "is_pad",
    )


def normalisation_stats(frames: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, deviation and quantiles per dimension of each array column, stacked."""
    out = None
    for c in columns:
        one = element_stats(frames, c).withColumn("column", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out
