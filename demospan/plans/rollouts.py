"""Evaluation runs: success tables, resume, verification scores, corrupt runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..operators.aggregates import corrupt_runs, frame_medians, rollout_summary, success_by_task, verifier_confusion
from ..operators.joins import pending
from ..operators.sampling import distinct_in_order


def score(rollouts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary row, per task with a total, failed episodes)."""
    failures = rollouts.filter(~F.col("success")).select("task", "episode")
    return rollout_summary(rollouts), success_by_task(rollouts), failures


def remaining(tasks: DataFrame, trials: int, done: DataFrame) -> DataFrame:
    """(task_id, episode_idx) still to run."""
    grid = tasks.select("task_id", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("episode_idx"))
    return pending(grid, done, ["task_id", "episode_idx"])


def labelled_sample(line: Column) -> Column:
    """struct(text, known_false) of a sample line; the suffix ``, f`` marks it."""

    def parse(s: Column) -> Column:
        marked = s.endswith(", f")
        return F.struct(
            F.when(marked, X.strip(F.substr(s, F.lit(1), F.length(s) - 3))).otherwise(s).alias("text"),
            marked.alias("known_false"),
        )

    return X.let(X.strip(line), parse)


def score_verifier(samples: DataFrame, results: DataFrame) -> DataFrame:
    """Confusion counts of distinct samples (text, known_false, line) against results (text, accepted).

    Samples without a result count as such and as neither accepted nor rejected.
    """
    unique = distinct_in_order(samples, ["text", "known_false"], "line")
    return verifier_confusion(unique.join(results, "text", "left"))


def audit_runs(pixels: DataFrame, run: str = "run", frame: str = "frame", value: str = "value") -> DataFrame:
    """Corruption report from per-frame values (the maximum over the colour channels)."""
    return corrupt_runs(frame_medians(pixels, [run, frame], value), run)
