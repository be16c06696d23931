"""Boundary frames of segments and the artifacts that should exist for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.frames import first_step_of_segments
from ..operators.joins import missing, single_complete_root


def transition_frames(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """The frame at which each segment starts."""
    return first_step_of_segments(segments, frames)


def expected_files(segments: DataFrame, key: str = "episode") -> DataFrame:
    """(episode, name) of the image each segment start should have."""
    folder = F.format_string("episode_%06d", F.col(key))
    name = F.format_string("skill_%03d_start_step_%06d.png", F.col("seg_index"), F.col("start_step"))
    return segments.select(key, F.concat(folder, F.lit("/"), name).alias("name"))


def backfill(segments: DataFrame, listing: DataFrame, key: str = "episode") -> DataFrame:
    """Files that are expected and not listed."""
    return missing(expected_files(segments, key), listing, ["name"])


def image_roots(segments: DataFrame, listing: DataFrame, key: str = "episode") -> DataFrame:
    return single_complete_root(expected_files(segments, key), listing, key)
