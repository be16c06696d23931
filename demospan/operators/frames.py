"""Frame-level joins, chunks and traces. Frames have (episode, step); segments are step intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vocab as V
from ..session import cut_lineage
from .ordered import Ordered, large_groups, ordered, percentiles

# Steps per join bucket. Segments are some tens of steps, so one covers one to three buckets, and
# a bucket holds few segments: the residual comparison stays small for any episode length.
JOIN_BUCKET = 64
# An episode of at most so many segments needs no buckets: a frame is compared with all of them.
FEW_SEGMENTS = 32
CHUNK_RUN = 1024


def frames_in_segments(frames: DataFrame, segments: DataFrame, key: str = "episode", how: str = "inner") -> DataFrame:
    """Each frame with the segment that covers its step.

    The equality on (episode, step bucket) keeps it a hash or merge join whose work spreads over
    buckets, so one very long episode is shared by many tasks.
    """
    last = F.floor((F.col("end_step") - 1) / JOIN_BUCKET)
    covers = (
        segments.filter(F.col("end_step") > F.col("start_step"))
        .withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_step") / JOIN_BUCKET), last)))
        .withColumnRenamed(key, "_key")
        .withColumnRenamed("_bucket", "_b")
    )
    f = frames.withColumn("_bucket", F.floor(F.col("step") / JOIN_BUCKET))
    on = (
        (F.col(key) == F.col("_key"))
        & (F.col("_bucket") == F.col("_b"))
        & (F.col("step") >= F.col("start_step"))
        & (F.col("step") < F.col("end_step"))
    )
    return f.join(covers, on, how).drop("_key", "_b", "_bucket")


def frames_in_segments_to_end(frames: DataFrame, segments: DataFrame, key: str = "episode") -> DataFrame:
    """The same, but a step equal to the end of the episode's last segment still belongs to that segment.

    Episodes of few segments meet on their key alone. Rows that are dealt by it already, as those that a window or
    a grouping of the episode made, are not shuffled again. Only episodes of many segments go by buckets.
    """
    many = large_groups(segments, [key], FEW_SEGMENTS).drop("_large")
    if many.isEmpty():
        return _in_few_to_end(frames, segments, key)
    many = cut_lineage(many)
    few = [x.join(many, key, "left_anti") for x in (frames, segments)]
    rest = [x.join(many, key, "left_semi") for x in (frames, segments)]
    return _in_few_to_end(*few, key).unionByName(_in_many_to_end(*rest, key))


def _to_end(segments: DataFrame, last_end: Column) -> DataFrame:
    """Segments that cover a step, those that end the episode one step longer; ``_end`` is the end they have."""
    longer = segments.withColumns(
        {"_end": F.col("end_step"), "end_step": F.col("end_step") + (F.col("end_step") == last_end).cast("int")}
    )
    return longer.filter(F.col("_end") > F.col("start_step"))


def _in_few_to_end(frames: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    known = segments.select(key, *[c for c in segments.columns if c != key])
    ends = known.withColumn("_last_end", F.max("end_step").over(Window.partitionBy(key)))
    # the frames are many times the segments, which are looked up; the frames need no sort
    covers = _to_end(ends, F.col("_last_end")).drop("_last_end").withColumnRenamed(key, "_key").hint("shuffle_hash")
    on = (F.col(key) == F.col("_key")) & (F.col("step") >= F.col("start_step")) & (F.col("step") < F.col("end_step"))
    return frames.join(covers, on).drop("_key").withColumn("end_step", F.col("_end")).drop("_end")


def _in_many_to_end(frames: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    ends = segments.groupBy(key).agg(F.max("end_step").alias("_last_end"))
    covers = _to_end(segments.join(ends, key), F.col("_last_end")).drop("_last_end").hint("shuffle_hash")
    return frames_in_segments(frames, covers, key).withColumn("end_step", F.col("_end")).drop("_end")


def last_step_of_segments(segments: DataFrame, frames: DataFrame, key: str = "episode") -> DataFrame:
    """Segments with the state and action of their last frame."""
    s = segments.withColumn("step", F.col("end_step") - 1)
    return s.join(frames, [key, "step"], "left").drop("step")


def first_step_of_segments(segments: DataFrame, frames: DataFrame, key: str = "episode") -> DataFrame:
    """Segments with their boundary frame."""
    s = segments.withColumn("step", F.col("start_step"))
    return s.join(frames, [key, "step"], "left").drop("step")


def progress(step: Column, start: Column, end: Column) -> Column:
    return (step - start) / (end - start).cast("double")


def progress_to_last(step: Column, start: Column, end: Column) -> Column:
    """Variant that reaches 1 on the last frame."""
    return (step - start) / F.greatest(F.lit(1), end - start - 1).cast("double")


def action_chunks(
    frames: DataFrame,
    keys: list[str],
    horizon: int,
    dims: int,
    step: str = "step",
    end: str = "end_step",
    action: str = "action",
) -> DataFrame:
    """Next ``horizon`` actions of each frame, cut at the segment end, as (action_chunk, is_pad).

    Frames are grouped in runs of CHUNK_RUN steps; the first horizon - 1 frames of a run are also sent
    to the run before it, which looks ahead into them. So the rows are shuffled once, hardly more than
    once each, and a group never exceeds a run however long the segment is. Past the end the pose
    numbers are zero and the last gripper value is kept.
    """
    run = max(CHUNK_RUN, horizon)
    at = F.floor(F.col(step) / run)
    ahead = F.when((F.col(step) % run < horizon - 1) & (at > 0), at - 1)
    f = frames.filter(F.col(step) < F.col(end)).select(*keys, step, F.col(action).alias("_action"))
    f = f.withColumn("_run", F.explode(F.array_compact(F.array(at, ahead))))
    w = Window.partitionBy(*keys, "_run").orderBy(step).rangeBetween(0, horizon - 1)
    gathered = f.withColumn("_a", F.collect_list("_action").over(w)).filter(at == F.col("_run"))
    have = F.col("_a")
    last = F.element_at(have, -1)
    pad = F.concat(F.array_repeat(F.lit(0.0), dims - 1), F.array(F.element_at(last, dims)))
    missing = F.lit(horizon) - F.size(have)
    return gathered.select(
        *keys,
        step,
        F.concat(have, F.array_repeat(pad, missing)).alias("action_chunk"),
        F.concat(
            F.array_repeat(F.lit(False), F.size(have)), F.array_repeat(F.lit(True), missing)
        ).alias("is_pad"),
    )


def anchor_step(step: Column, start: Column, episode: Column, max_age: int, seed: int = 42) -> Column:
    """Step an overlay is drawn from: up to ``max_age`` - 1 steps old, by a hash so that it repeats."""
    age = F.pmod(F.xxhash64(F.lit(seed), episode, step), F.lit(max_age)) if max_age > 1 else F.lit(0)
    return F.greatest(start, step - age)


def scene_dropout(episode: Column, step: Column, rate: float = V.SCENE_DROPOUT, seed: int = 42, salt: str = "clean"):
    """Whether the scene image of a frame is blanked; independent draws use different salts."""
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), episode, step), F.lit(1_000_000)) / 1_000_000.0
    return draw < rate


def order_problems(o: Ordered, frame: str, contact: Column) -> DataFrame:
    """Rows of a trace whose frame number is not above the one before, or that come first and not at the contact.

    (keys, rule) and all columns of the rows.
    """
    o = o.scan(previous={"_before": F.col(frame), "_seen": F.lit(1)})
    rule = F.when(F.col("_seen").isNull() & ~F.col(frame).eqNullSafe(contact), "first_not_contact").when(F.col(frame) <= F.col("_before"), "not_rising")
    return o.rows().withColumn("rule", rule).drop("_before", "_seen").filter(F.col("rule").isNotNull())


def residual(trace: Column, start: Column, step: Column) -> Column:
    """Part of a segment's trace from ``step`` to its end."""
    at = step - start
    return F.slice(trace, (at + 1).cast("int"), F.greatest(F.size(trace) - at, F.lit(0)).cast("int"))


def step_deltas(o: Ordered, x: str = "x", y: str = "y", name: str = "delta") -> Ordered:
    """Distance to the previous point; null on the first."""
    o = o.scan(previous={"_x": F.col(x), "_y": F.col(y)})
    delta = F.hypot(F.col(x) - F.col("_x"), F.col(y) - F.col("_y"))
    return o.with_df(o.df.withColumn(name, delta).drop("_x", "_y"))


def delta_stats(o: Ordered, x: str = "x", y: str = "y", also: list[Column] | None = None) -> DataFrame:
    """Largest, mean and 95th percentile step distance per group; 0 with fewer than two points.

    ``also`` adds aggregates of the same rows to the same pass.
    """
    deltas = step_deltas(o, x, y).rows()
    if o.cut:
        deltas = cut_lineage(deltas)  # read several times
    out = percentiles(
        deltas,
        list(o.keys),
        "delta",
        {"p95_delta": 0.95},
        sized_by=o.df,
        also=[
            F.count(F.lit(1)).alias("points"),
            F.max("delta").alias("max_delta"),
            F.avg("delta").alias("mean_delta"),
            *(also or []),
        ],
    )
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("max_delta", "mean_delta", "p95_delta")})


def jumps(o: Ordered, limit: float = V.MAX_STEP_DELTA_PIXELS, x: str = "x", y: str = "y") -> DataFrame:
    return step_deltas(o, x, y).rows().filter(F.col("delta") > limit)


def resample_by_length(o: Ordered, points: int, x: str = "x", y: str = "y") -> DataFrame:
    """``points`` places evenly spaced along each trace, linearly interpolated: (keys, k, x, y).

    Each stretch between neighbours computes the places that fall on it, so a trace of any length
    is spread over its rows. A single or unmoving point is repeated.
    """
    keys = list(o.keys)
    o = o.scan(previous={"_x": F.col(x), "_y": F.col(y)}, following={"_more": F.lit(1)})
    step = F.coalesce(F.hypot(F.col(x) - F.col("_x"), F.col(y) - F.col("_y")), F.lit(0.0))
    o = o.with_df(o.df.withColumn("_step", step))
    # a row begins at the very number at which the row before it ends, so no place falls between them
    rows = o.scan(sums={"_to": F.col("_step")}, sums_before={"_from": F.col("_step")}).rows()
    length = rows.filter(F.col("_more").isNull()).select(*keys, F.col("_to").alias("_length"))
    return _interpolate(rows.join(length, keys), keys, points, x, y)


def resample_by_time(o: Ordered, points: int, x: str = "x", y: str = "y") -> DataFrame:
    """``points`` places evenly spaced over the row positions of each trace."""
    keys = list(o.keys)
    o = o.scan(index="_at", previous={"_x": F.col(x), "_y": F.col(y)}, following={"_more": F.lit(1)})
    rows = o.rows()
    length = rows.filter(F.col("_more").isNull()).select(*keys, F.col("_at").cast("double").alias("_length"))
    at = F.col("_at").cast("double")
    rows = rows.withColumns({"_to": at, "_from": F.when(F.col("_at") > 0, at - 1)})
    return _interpolate(rows.join(length, keys), keys, points, x, y)


def _interpolate(rows: DataFrame, keys: list[str], points: int, x: str, y: str) -> DataFrame:
    """Places k/(points-1) of the way: each row emits those in (_from, _to], the first row k = 0.

    Which places these may be follows from the two lengths, so a row looks at its own places and one on either
    side, and all rows together at about as many as there are places.
    """
    length, start, end = F.col("_length"), F.col("_from"), F.col("_to")
    steps = max(points - 1, 1)

    def near(x: Column, off: int) -> Column:
        inside = lambda k: F.least(F.greatest(k, F.lit(0)), F.lit(points - 1))
        return inside(inside(F.floor(F.try_divide(x, length) * steps)) + off).cast("int")

    def place(k: Column) -> Column:
        # the last place is the end itself, so rounding cannot push it past the last row
        return F.when((k == points - 1) & (k > 0), length).otherwise(k * length / F.lit(float(steps)))

    still = length <= 0
    every = F.sequence(F.lit(0), F.lit(points - 1))
    some = F.sequence(near(start, -1), near(end, 1))
    mine = F.filter(
        F.when(F.col("_x").isNull(), F.when(still, every).otherwise(F.array(F.lit(0)))).when(still, F.slice(every, 1, 0)).otherwise(some),
        lambda k: F.when(F.col("_x").isNull(), still | (place(k) <= 0)).otherwise(
            ~still & (place(k) > start) & (place(k) <= end)
        ),
    )
    e = rows.withColumn("k", F.explode(mine))
    w = F.when(end > start, (place(F.col("k")) - start) / (end - start)).otherwise(F.lit(1.0))
    moved = [
        F.when(F.col(p).isNull(), F.col(c)).otherwise(F.col(p) + (F.col(c) - F.col(p)) * w).alias(c)
        for c, p in ((x, "_x"), (y, "_y"))
    ]
    return e.select(*keys, F.col("k").cast("bigint").alias("k"), *moved)


def episode_frames(df: DataFrame, keys: list[str], order: list[str], split: str) -> Ordered:
    """Number the frames of each episode from 0."""
    return ordered(df, keys, order, split).scan(index="step")
