"""Summaries. All are partial aggregations, so a hot key is folded before it is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as V
from .ordered import ordered, percentiles


def duplicates(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose key occurs more than once: (keys, value, occurrences), one row each, not a list."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") > 1)
    return df.select(*keys, value).join(twice, keys)


def duplicate_sources(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    """A row (keys, source, rows) for every source of a key that occurs more than once in all."""
    by_source = df.groupBy(*keys, source).agg(F.count(F.lit(1)).alias("rows"))
    twice = by_source.groupBy(*keys).agg(F.sum("rows").alias("_all")).filter(F.col("_all") > 1)
    return by_source.join(twice.drop("_all"), keys)


def rate(successes: Column, total: Column) -> Column:
    return F.when(total > 0, successes / total).otherwise(F.lit(0.0))


def rollout_summary(rollouts: DataFrame, success: str = "success") -> DataFrame:
    """Total, successes, failures and rate; zeros when there are no rows."""
    done = F.coalesce(F.sum(F.col(success).cast("bigint")), F.lit(0))
    total = F.count(F.lit(1))
    return rollouts.agg(
        total.alias("total"), done.alias("successes"), (total - done).alias("failures"), rate(done, total).alias("rate")
    )


def success_by_task(rollouts: DataFrame, task: str = "task", success: str = "success") -> DataFrame:
    """Per task and, with a null task, overall."""
    done, total = F.sum(F.col(success).cast("bigint")), F.count(F.lit(1))
    return rollouts.rollup(task).agg(total.alias("total"), done.alias("successes"), rate(done, total).alias("rate"))


def verifier_confusion(results: DataFrame, accepted: str = "accepted", known_false: str = "known_false") -> DataFrame:
    """Accepted and rejected counts, and how many known-false samples were caught and missed."""
    a, f = F.col(accepted), F.col(known_false)

    def count(c: Column, name: str) -> Column:
        return F.count_if(c).alias(name)

    return results.agg(
        F.count(F.lit(1)).alias("total"),
        count(a, "accepted"),
        count(~a, "rejected"),
        count(f, "known_false"),
        count(f & ~a, "caught"),
        count(f & a, "missed"),
        count(~f & a, "accepted_unlabelled"),
        count(~f & ~a, "rejected_unlabelled"),
        count(a.isNull(), "without_verdict"),
    )


def violation_summary(violations: DataFrame, stage: str = "rule") -> DataFrame:
    """Failures and distinct episodes per stage, with a null stage for all."""
    return violations.rollup(stage).agg(
        F.count(F.lit(1)).alias("failures"), F.count_distinct("episode").alias("episodes")
    )


def bounds_aggregates(inside: str = "in_bounds") -> list[Column]:
    """Points outside the image: count and share."""
    out = F.count_if(~F.col(inside))
    return [out.alias("out_of_bounds_count"), (out / F.count(F.lit(1))).alias("out_of_bounds_fraction")]


def reprojection_aggregates() -> list[Column]:
    """Largest and mean reprojection error, exact and for rounded points inside the image."""
    rounded = F.when(F.col("in_bounds"), F.col("rounded_error"))
    return [
        F.max("exact_error").alias("exact_max_error"),
        F.avg("exact_error").alias("exact_mean_error"),
        F.coalesce(F.max(rounded), F.lit(0.0)).alias("rounded_max_error"),
        F.coalesce(F.avg(rounded), F.lit(0.0)).alias("rounded_mean_error"),
        F.count_if(F.col("in_bounds")).alias("rounded_count"),
    ]


def element_stats(df: DataFrame, vector: str, points: dict[str, float] | None = None) -> DataFrame:
    """Per dimension of an array column: count, mean, population deviation and exact percentiles."""
    cells = df.select(F.posexplode(vector).alias("dim", "value"))
    base = [F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")]
    return percentiles(cells, ["dim"], "value", points or {"q01": 0.01, "q99": 0.99}, also=base)


def token_mean(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise mean of vectors per key, in long form (keys, dim, mean)."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "value")).groupBy(*keys, "dim").agg(F.avg("value").alias("mean"))


def as_vectors(long: DataFrame, keys: list[str], dim: str = "dim", value: str = "mean") -> DataFrame:
    """Long form back to one array per key; a vector has as many entries as it has dimensions."""
    packed = F.array_sort(F.collect_list(F.struct(dim, value)))
    return long.groupBy(*keys).agg(F.transform(packed, lambda s: s[value]).alias("vector"))


def frame_medians(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    return percentiles(pixels, keys, value, {"median": 0.5})


def corrupt_runs(medians: DataFrame, run: str) -> DataFrame:
    """A run is corrupted when the median of any of its frames is zero."""
    return medians.groupBy(run).agg(
        F.bool_or(F.col("median") == 0).alias("corrupted"), F.count(F.lit(1)).alias("frames")
    )


def timing_report(calls: DataFrame, function: str, thread: str, elapsed: str) -> DataFrame:
    """Calls, total, mean, least and longest time per (function, thread), per function and overall."""
    return calls.rollup(function, thread).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(elapsed).alias("total"),
        F.avg(elapsed).alias("mean"),
        F.min(elapsed).alias("min"),
        F.max(elapsed).alias("max"),
    )


def header_conflicts(headers: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Header keys with more than one value over the shards (null counts as a value)."""
    seen = headers.select(key, value).distinct()
    return seen.groupBy(key).agg(F.count(F.lit(1)).alias("values")).filter(F.col("values") > 1)


def count_mismatches(declared: DataFrame, rows: DataFrame, key: str, size: str) -> DataFrame:
    """Episodes whose declared size differs from the number of rows found."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("counted"))
    both = declared.select(key, size).join(counted, key, "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    return both.filter(~F.col(size).eqNullSafe(F.col("counted")))


def first_episode_metadata(df: DataFrame, order: str, fields: list[str]) -> DataFrame:
    return df.agg(F.min_by(F.struct(*fields), order).alias("_m")).select(*[F.col("_m")[f].alias(f) for f in fields])


def index_gaps(df: DataFrame, index: str, span: int = 1_000_000) -> DataFrame:
    """Missing indices between the least and the greatest, as (gap_start, gap_end) ranges.

    Each index looks at the next one, in blocks of the index range; a gap is one row however wide.
    """
    from .ordered import ordered_by_blocks

    distinct = df.select(F.col(index).cast("bigint").alias("_i")).distinct()
    o = ordered_by_blocks(distinct, [], ["_i"], F.floor(F.col("_i") / span)).scan(following={"_next": F.col("_i")})
    return (
        o.rows("_all")
        .filter(F.col("_next") > F.col("_i") + 1)
        .select((F.col("_i") + 1).alias("gap_start"), (F.col("_next") - 1).alias("gap_end"))
    )


def scene_nodes(facts: DataFrame, keys: list[str]) -> DataFrame:
    """One-argument facts as (keys, object, attribute) rows, each once."""
    return facts.filter(F.col("second").isNull()).select(*keys, F.col("first").alias("object"), F.col("name").alias("attribute")).distinct()


def scene_edges(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Two-argument facts as edges."""
    return facts.filter(F.col("second").isNotNull()).select(
        *keys, F.col("first").alias("from"), F.col("second").alias("to"), F.col("name").alias("relation")
    ).distinct()


def fused_scores(
    detector: DataFrame, text_image: DataFrame, keys: list[str], w_detector=V.DETECTOR_WEIGHT, w_text=V.TEXT_IMAGE_WEIGHT
) -> DataFrame:
    """Weighted score per (track, object); without a text-image score the detector's counts alone."""
    both = detector.join(text_image, keys, "left")
    fused = w_detector * F.col("score") + w_text * F.col("text_score")
    return both.withColumn("fused", F.when(F.col("text_score").isNull(), F.col("score")).otherwise(fused))


def best_track(scores: DataFrame, frame: str, thing: str, track: str) -> DataFrame:
    """Best track per object: the highest fused score, then the smallest track id."""
    return scores.groupBy(frame, thing).agg(
        F.min_by(F.struct(track, "fused"), F.struct((-F.col("fused")).alias("s"), F.col(track))).alias("_b")
    ).select(frame, thing, F.col("_b")[track].alias(track), F.col("_b")["fused"].alias("fused"))


def accelerator_nodes(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accelerator, node) pairs and the last listed partition of each accelerator.

    ``listing``: (line, gres, partition, nodes); lines without an accelerator are skipped.
    """
    rows = listing.filter(F.col("gres").contains(":")).withColumn("accelerator", F.get(F.split("gres", ":"), F.lit(1)))
    nodes = rows.select("accelerator", F.explode(F.split("nodes", ",")).alias("node")).distinct()
    return nodes, rows.groupBy("accelerator").agg(F.max_by("partition", "line").alias("partition"))


def with_rank(df: DataFrame, order: list[str], split: str, name: str = "rank") -> DataFrame:
    """0-based rank of all rows in one order, without putting them into one task."""
    o = ordered(df.withColumn("_one", F.lit(0)), ["_one"], order, split)
    return o.scan(index=name).rows("_one")
