"""Segments: half-open step intervals with a skill, one row each, or nested in an annotation row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..functions import vocab as V
from .ordered import Ordered, islands


def from_lengths(o: Ordered, length: str) -> Ordered:
    """Give rows with a length their place: seg_index, start_step, end_step by running sum."""
    o = o.scan(index="seg_index", sums={"end_step": F.col(length)})
    return o.with_df(o.df.withColumn("start_step", F.col("end_step") - F.col(length)))


def from_end_steps(o: Ordered, end: str = "end_step") -> Ordered:
    """Give rows with an end step their start: the end before, or 0."""
    o = o.scan(index="seg_index", previous={"_end": F.col(end)})
    return o.with_df(o.df.withColumn("start_step", F.coalesce(F.col("_end"), F.lit(0))).drop("_end"))


def contiguity_violations(o: Ordered, num_steps: DataFrame | None = None) -> DataFrame:
    """(keys, seg_index, rule) for a late start, gaps, overlaps, empty segments and a wrong last end."""
    keys = list(o.keys)
    o = o.scan(
        index="seg_index",
        previous={"_end": F.col("end_step")},
        following={"_next": F.lit(1)},
    )
    rows = o.rows()
    rules = [
        F.when((F.col("seg_index") == 0) & (F.col("start_step") != 0), "first_start_not_zero"),
        F.when(F.col("start_step") > F.col("_end"), "gap"),
        F.when(F.col("start_step") < F.col("_end"), "overlap"),
        F.when(F.col("end_step") <= F.col("start_step"), "non_positive_length"),
    ]
    if num_steps is not None:
        rows = rows.join(num_steps.select(*keys, "num_steps"), keys, "left")
        rules.append(
            F.when(F.col("_next").isNull() & (F.col("end_step") != F.col("num_steps")), "last_end_not_num_steps")
        )
    return (
        rows.select(*keys, "seg_index", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    )


def compress_runs(o: Ordered, skill: str = "skill") -> DataFrame:
    """One row per run of equal skills: run number, first and last step, number of rows.

    A run may itself be huge, so it is folded by a partial aggregation, never collected.
    """
    keys = list(o.keys)
    runs = islands(o, skill, name="run").rows()
    return runs.groupBy(*keys, "run").agg(
        F.first(skill).alias(skill),
        F.min("start_step").alias("start_step"),
        F.max("end_step").alias("end_step"),
        F.count(F.lit(1)).alias("pieces"),
    )


def transitions(o: Ordered, skill: str = "skill") -> DataFrame:
    """(previous skill, next skill, boundary step, position) for each pair of neighbours."""
    before = o.scan(index="_at", previous={"previous_skill": F.col(skill)})
    kind = F.when(F.col("previous_skill").isNull(), "initial").otherwise("transition")
    return before.df.select(
        *o.keys,
        F.col("_at").alias("position"),
        kind.alias("kind"),
        "previous_skill",
        F.col(skill).alias("next_skill"),
        F.col("start_step").alias("boundary_step"),
    )


def alternation_violations(o: Ordered, verb: str = "verb") -> DataFrame:
    """Neighbours that are both picks or both places; other verbs are not compared."""
    category = X.verb_category(F.col(verb))
    o = o.with_df(o.df.withColumn("category", category))
    o = o.scan(index="position", previous={"previous_category": F.col("category")})
    return o.rows().filter(
        (F.col("category") != "other") & F.col("category").eqNullSafe(F.col("previous_category"))
    )


def gripper_violations(o: Ordered, verb: str = "verb", first_argument: str = "argument") -> DataFrame:
    """Order rules of the richer grammar. Every verb fixes the gripper state it leaves behind, so
    the state before a step is a function of the previous verb alone."""
    v = F.col(verb)
    o = o.scan(
        index="position",
        previous={"_verb": v, "_argument": F.col(first_argument)},
        following={"_next_verb": v},
    )
    places = v.isin(V.PLACE_VERBS)
    first = F.col("_verb").isNull()
    holding = F.when(first, places).otherwise(F.col("_verb").isin(V.PICK_VERBS))
    held = F.when(F.col("_verb").isin(V.PICK_VERBS), F.col("_argument"))
    turn = v == "TURN_OBJECT"
    rules = F.array_compact(
        F.array(
            F.when(places & ~holding, "needs_held_object"),
            F.when(v.isin(V.FREE_GRIPPER_VERBS) & holding, "needs_free_gripper"),
            F.when(places & (held == F.col(first_argument)), "placed_on_itself"),
            F.when(turn & ~first & holding, "turn_while_holding"),
            F.when(turn & F.col("_verb").isin(V.PICK_VERBS), "turn_after_pick"),
            F.when(turn & F.col("_next_verb").isin(V.PLACE_VERBS), "turn_before_place"),
        )
    )
    return o.df.select(*o.keys, "position", verb, F.explode(rules).alias("rule"))


def boundary_action_split(segments: DataFrame, window: int = V.BOUNDARY_WINDOW) -> DataFrame:
    """Each segment's first ``window`` steps (boundary part) and the rest (action part)."""
    if window <= 0:
        raise ValueError(f"window must be positive, got {window}")
    cut = F.least(F.col("end_step"), F.col("start_step") + window)
    parts = F.array(
        F.struct(F.lit("boundary").alias("part"), F.col("start_step").alias("start"), cut.alias("end")),
        F.struct(F.lit("action").alias("part"), cut.alias("start"), F.col("end_step").alias("end")),
    )
    kept = F.filter(parts, lambda p: (p["part"] == "boundary") | (p["start"] < p["end"]))
    rest = [c for c in segments.columns if c not in ("start_step", "end_step")]
    return segments.select(*rest, F.explode(kept).alias("_p")).select(
        *rest, F.col("_p.part").alias("part"), F.col("_p.start").alias("start_step"), F.col("_p.end").alias("end_step")
    )


def even_sample(start: Column, end: Column, count: int) -> Column:
    """At most ``count`` steps of [start, end), evenly spaced, both ends kept, halves to even."""
    if count <= 0:
        raise ValueError(f"count must be positive, got {count}")
    length = end - start
    whole = F.sequence(start, F.greatest(end - 1, start))
    if count == 1:
        few = F.array(start)
    else:
        few = F.transform(
            F.sequence(F.lit(0), F.lit(count - 1)),
            lambda i: start + F.bround(i * (length - 1) / F.lit(count - 1), 0).cast("bigint"),
        )
    return F.when(length <= 0, F.array().cast("array<bigint>")).when(length <= count, whole).otherwise(
        F.array_distinct(few)
    )


def has_both_ends(frames: Column, start: Column, end: Column) -> Column:
    return (F.try_element_at(frames, F.lit(1)) == start) & (F.try_element_at(frames, F.lit(-1)) == end - 1)


def length_stats(segments: DataFrame, verb: str = "verb") -> DataFrame:
    """Count, bounds, mean and population deviation of segment lengths per verb."""
    length = F.col("end_step") - F.col("start_step")
    return (
        segments.withColumn("_length", length)
        .filter((F.col("_length") > 0) & F.col(verb).isNotNull())
        .groupBy(verb)
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min("_length").alias("min"),
            F.max("_length").alias("max"),
            F.avg("_length").alias("mean"),
            F.stddev_pop("_length").alias("std"),
        )
    )


def compare_to_plan(runs: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Positions where the compressed skills and the planned skills differ, either side missing included.

    Both sides are exploded (keys, position, skill), so no list of a whole episode is built.
    """
    left = runs.select(*keys, "position", F.col("skill").alias("segment_skill"))
    right = plan.select(*keys, "position", F.col("skill").alias("plan_skill"))
    both = left.join(right, [*keys, "position"], "full")
    return both.filter(~F.col("segment_skill").eqNullSafe(F.col("plan_skill")))


# --- nested form: one annotation row holds its segments ------------------------------------------


def explode_segments(annotations: DataFrame, keys: list[str], column: str = "segments") -> DataFrame:
    return annotations.select(*keys, F.posexplode(column).alias("seg_index", "_s")).select(*keys, "seg_index", "_s.*")


def nest_segments(segments: DataFrame, keys: list[str], fields: list[str], chunk: int = 4096) -> DataFrame:
    """Segments as arrays, at most ``chunk`` per row; part 0 is the whole episode unless it is longer."""
    return (
        segments.withColumn("part", F.floor(F.col("seg_index") / chunk))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(F.struct("seg_index", *fields))).alias("segments"))
    )


def row_runs(skills: Column) -> Column:
    """Run-length compression of an array inside a row."""
    return F.filter(skills, lambda s, i: (i == 0) | ~s.eqNullSafe(F.get(skills, i - 1)))


def row_contiguity_reason(segments: Column, num_steps: Column) -> Column:
    """First timing rule an annotation row breaks."""

    def rule(s: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get(segments, i - 1)["end_step"])
        return (
            F.when(s["start_step"].isNull() | s["end_step"].isNull(), "missing_steps")
            .when((i == 0) & (s["start_step"] != 0), "first_start_not_zero")
            .when(s["start_step"] != before, "not_contiguous")
            .when(s["end_step"] <= s["start_step"], "non_positive_length")
        )

    first_rule = X.first_of(F.transform(segments, rule), lambda r: r.isNotNull())
    last_end = F.try_element_at(segments, F.lit(-1))["end_step"]
    return (
        F.when(F.coalesce(F.size(segments), F.lit(0)) <= 0, "no_segments")
        .when(first_rule.isNotNull(), first_rule)
        .when(last_end != num_steps, "last_end_not_num_steps")
    )
