"""Orders, limits, samples and splits that repeat from run to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .aggregates import with_rank


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    if n <= 0:
        raise ValueError(f"limit must be positive, got {n}")
    return df.orderBy(*order).limit(n)


def draw(*columns: Column, seed: int = 42) -> Column:
    """A number per row that depends on the row's identity only."""
    return F.xxhash64(F.lit(seed), *columns)


def sample_rows(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` distinct rows drawn by hash."""
    return df.orderBy(draw(*[F.col(k) for k in key], seed=seed), *key).limit(n)


def flat_vectors(df: DataFrame, chunk: str, keep: int | None = None) -> DataFrame:
    """A chunk of vectors as one ``vector``, or the first ``keep`` numbers of it, beside the other columns."""
    whole = F.flatten(chunk)
    vector = whole if keep is None else F.slice(whole, 1, keep)
    return df.withColumn("vector", vector).drop(chunk)


def one_per_group(df: DataFrame, group: str, key: list[str], seed: int = 42) -> DataFrame:
    """One row per group drawn by hash, folded where the rows lie."""
    d = draw(F.col(group), *[F.col(k) for k in key], seed=seed)
    row = F.struct(*df.columns)
    return df.groupBy(group).agg(F.min_by(row, F.struct(d, *key)).alias("_r")).select("_r.*")


def random_transition(transitions: DataFrame, episode: str = "episode", seed: int = 42) -> DataFrame:
    """A random episode, then a random transition of it."""
    chosen = transitions.select(episode).distinct().orderBy(draw(F.col(episode), seed=seed), episode).limit(1)
    return sample_rows(transitions.join(chosen, episode, "left_semi"), [episode, "position"], 1, seed)


def sample_points(points: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` points per mask by hash rank. A mask's points are ranked in 1,024 shards first, so a
    huge mask is cut to a few rows per shard by many tasks before its last ranking."""
    d = draw(*[F.col(k) for k in keys], F.col("x"), F.col("y"), seed=seed)
    p = points.withColumns({"_d": d, "_shard": F.pmod(F.xxhash64("x", "y"), F.lit(1024))})
    by_shard = Window.partitionBy(*keys, "_shard").orderBy("_d", "x", "y")
    by_key = Window.partitionBy(*keys).orderBy("_d", "x", "y")
    first = p.withColumn("_r", F.row_number().over(by_shard)).filter(F.col("_r") <= n)
    return first.withColumn("_r", F.row_number().over(by_key)).filter(F.col("_r") <= n).select(*keys, "x", "y")


def sample_points_or_centre(boxes: DataFrame, points: DataFrame, keys: list[str], n: int = 4) -> DataFrame:
    """Sampled mask points; the box centre where the mask is empty."""
    chosen = sample_points(points, keys, n)
    joined = boxes.join(chosen, keys, "left")
    return joined.select(
        *keys,
        F.coalesce(F.col("x").cast("double"), (F.col("x1") + F.col("x2")) / 2).alias("x"),
        F.coalesce(F.col("y").cast("double"), (F.col("y1") + F.col("y2")) / 2).alias("y"),
    )


def block_of(rank: Column, total: Column, blocks: int) -> Column:
    """Number of the block when ``total`` ranks are cut into blocks of ceil(total / blocks)."""
    return F.floor(rank / F.ceil(total / F.lit(blocks)))


def block_split(df: DataFrame, order: list[str], split: str, blocks: int) -> DataFrame:
    ranked = with_rank(df, order, split)
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return ranked.crossJoin(F.broadcast(total)).withColumn(
        "block", block_of(F.col("rank"), F.col("_total"), blocks)
    ).drop("_total")


def block_starts(df: DataFrame, order: list[str], split: str, blocks: int) -> DataFrame:
    return block_split(df, order, split, blocks).groupBy("block").agg(F.min("rank").alias("start"))


def train_validation(key: Column, ratio: float = 0.1, seed: int = 42) -> Column:
    """Split name by a hash of the episode: stable when episodes are added."""
    return F.when(F.pmod(draw(key, seed=seed), F.lit(10_000)) < int(ratio * 10_000), "val").otherwise("train")


def distinct_in_order(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """First occurrence of each key. A partial minimum, so a text copied a billion times shrinks first."""
    return df.groupBy(*keys).agg(F.min(line).alias(line))


def mini_batches(df: DataFrame, key: list[str], size: int, epoch: int = 0, seed: int = 42) -> DataFrame:
    """A shuffled order per epoch and the batch each row falls into."""
    d = df.withColumn("_draw", draw(F.lit(epoch), *[F.col(k) for k in key], seed=seed))
    return with_rank(d, ["_draw", *key], "_draw").withColumn("batch", F.floor(F.col("rank") / size)).drop("_draw")


def closest_names(names: DataFrame, wanted: str, n: int = 5, least: float = 0.4) -> DataFrame:
    """Names most like ``wanted`` by edit distance, at least ``least`` alike."""
    a, b = F.lower("name"), F.lit(wanted.lower())
    alike = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.lit(max(len(wanted), 1)))
    return names.select("name").distinct().withColumn("similarity", alike).filter(F.col("similarity") >= least).orderBy(
        F.desc("similarity"), "name"
    ).limit(n)
