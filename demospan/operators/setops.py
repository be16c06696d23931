"""Unions, overlays and partial updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def union_shards(shards: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), shards)


def overlay(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and existing rows whose key is not new."""
    return new.unionByName(existing.join(new.select(*keys).distinct(), keys, "left_anti"))


def latest(df: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """Row of the highest version per key, folded before the shuffle."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(row, version).alias("_r")).select("_r.*")


def update_by_id(base: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(base rows with the given fields replaced where an update has them, updates of unknown ids)."""
    u = updates.select(key, *[F.col(f).alias(f"_u_{f}") for f in fields])
    merged = base.join(u, key, "left").withColumns({f: F.coalesce(f"_u_{f}", f) for f in fields})
    return merged.drop(*[f"_u_{f}" for f in fields]), updates.join(base.select(key), key, "left_anti")


def not_in(items: Column, allowed: Column) -> Column:
    return F.array_except(items, allowed)


def same_keys(a: Column, b: Column) -> Column:
    """Do two maps have the same keys."""
    return F.array_sort(F.map_keys(a)) == F.array_sort(F.map_keys(b))


def unresolved_errors(errors: DataFrame, successes: DataFrame, keys: list[str]) -> DataFrame:
    """Failures that no later success cleared."""
    return errors.join(successes.select(*keys), keys, "left_anti")
