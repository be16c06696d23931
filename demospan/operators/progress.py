"""Online bookkeeping over ordered step rows: done skills, streaks, freezes, re-planning, timeouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as V
from .ordered import Ordered, islands, streak


def observed_changes(o: Ordered, skill: str, name: str = "changes") -> Ordered:
    """How often the observed skill has changed so far, the first row not counted."""
    o = o.scan(previous={"_was": F.col(skill), "_seen": F.lit(1)})
    changed = F.col("_seen").isNotNull() & ~F.col(skill).eqNullSafe(F.col("_was"))
    o = o.with_df(o.df.withColumn("_changed", changed.cast("bigint")).drop("_was", "_seen"))
    o = o.scan(sums={name: F.col("_changed")})
    return o.with_df(o.df.drop("_changed"))


def done_count(changes: Column, plan_size: Column | int) -> Column:
    return F.least(changes, F.lit(plan_size))


def done_skills(plan: Column, changes: Column) -> Column:
    """First k plan steps after k observed changes."""
    return F.slice(plan, F.lit(1), F.least(changes, F.size(plan)).cast("int"))


def next_target(changes: Column, targets: Column | int) -> Column:
    """Index of the target aimed at: moves on each change and stays on the last."""
    return F.least(changes, F.lit(targets) - 1)


def fixed_progression(step: Column, budgets: list[int]) -> Column:
    """Skill index at a step when each skill gets a fixed number of steps; the last one stays.

    The counter is raised before it is compared, so a skill hands over on the step that fills it.
    """
    upto, index = 0, F.lit(0)
    for n in budgets[:-1]:
        upto += n
        index = index + (step + 1 >= upto).cast("int")
    return index


def advance_on_streak(o: Ordered, value: str, threshold: float, needed: int) -> Ordered:
    """Streak of values at or above ``threshold`` and whether it is long enough to move on."""
    o = streak(o, F.col(value) >= threshold, "streak")
    return o.with_df(o.df.withColumn("advance", F.col("streak") >= needed))


def freeze(o: Ordered, value: str, threshold: float, needed: int) -> Ordered:
    """Flag that turns on once a streak is long enough and stays on."""
    o = streak(o, F.col(value) >= threshold, "freeze_streak")
    o = o.scan(maxima={"_frozen": (F.col("freeze_streak") >= needed).cast("int")})
    return o.with_df(o.df.withColumn("frozen", F.col("_frozen") == 1).drop("_frozen", "freeze_streak"))


def freeze_within(o: Ordered, scope: str, value: str, threshold: float, needed: int) -> Ordered:
    """The same flag for each run of rows with equal ``scope`` (the skill that is carried out): it ends with the run."""
    o = islands(o, scope, name="_run")
    # a row that breaks the streak or starts another run; the streak counts rows since the last of them
    o = o.scan(index="_at", previous={"_run_before": F.col("_run")})
    starts = ~F.col("_run").eqNullSafe(F.col("_run_before"))
    low = ~F.coalesce(F.col(value) >= threshold, F.lit(False))
    o = o.scan(last={"_low": F.when(low, F.col("_at")), "_first": F.when(starts, F.col("_at"))})
    length = F.col("_at") - F.greatest(F.coalesce("_low", F.lit(-1)), F.col("_first") - 1)
    o = o.with_df(o.df.withColumn("_reached", F.when(length >= needed, F.col("_at"))))
    o = o.scan(last={"_frozen_at": F.col("_reached")})
    frozen = F.coalesce(F.col("_frozen_at") >= F.col("_first"), F.lit(False))
    return o.with_df(o.df.withColumn("frozen", frozen).drop("_run", "_at", "_run_before", "_low", "_first", "_reached", "_frozen_at"))


def replans(o: Ordered, every: int) -> Ordered:
    """Re-plan on every ``every``-th row, but not while frozen by an earlier row."""
    o = o.scan(index="_at", previous={"_was_frozen": F.col("frozen")})
    due = F.col("_at") % every == 0
    held = F.coalesce(F.col("_was_frozen"), F.lit(False))
    return o.with_df(
        o.df.withColumn("replan", due & ~held).withColumn("suppressed", due & held).drop("_at", "_was_frozen")
    )


def steps_since_change(o: Ordered, skill: str, step: str = "step") -> Ordered:
    """Steps since the observed skill last changed (since step 0 before any change)."""
    o = o.scan(previous={"_was": F.col(skill), "_seen": F.lit(1)})
    changed = F.col("_seen").isNotNull() & ~F.col(skill).eqNullSafe(F.col("_was"))
    o = o.scan(last={"_changed_at": F.when(changed, F.col(step))})
    since = F.col(step) - F.coalesce(F.col("_changed_at"), F.lit(0))
    return o.with_df(o.df.withColumn("since_change", since).drop("_was", "_seen", "_changed_at"))


def timeouts(o: Ordered, skill: str, step: str = "step", limit: int = V.STEP_TIMEOUT) -> DataFrame:
    """First step of each run that is more than ``limit`` steps past the last change."""
    late = steps_since_change(o, skill, step).rows().filter(F.col("since_change") > limit)
    return late.groupBy(*o.keys).agg(F.min(step).alias("ended_at"))
