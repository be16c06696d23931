"""Lookups between episodes, tasks, files and roots.

No side is broadcast by hand here: task, root and listing tables grow with the data, so the join
strategy is left to adaptive execution, which broadcasts by measured size and splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..functions import vocab as V


def by_shuffle(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose sides are both sorted and shuffled, so neither passes the driver.

    For sides whose columns are made from a few small ones: files that compress well and made arrays or texts
    are taken for small and broadcast, however large they are in memory.
    """
    return left.hint("merge").join(right, keys, how)


def spread(df: DataFrame, *keys: str, tasks: int = 4) -> DataFrame:
    """The rows dealt by their keys to ``tasks`` tasks a core, before work that is heavy for the few bytes it reads."""
    return df.repartition(tasks * df.sparkSession.sparkContext.defaultParallelism, *keys)


def first_task_per_text(tasks: DataFrame, order: str = "task_index") -> DataFrame:
    """One task index per text: the first listed."""
    return tasks.groupBy("task").agg(F.min_by("task_index", order).alias("task_index"))


def episodes_to_tasks(episodes: DataFrame, tasks: DataFrame, order: str = "task_index") -> tuple[DataFrame, DataFrame]:
    """(episodes with their task index, episodes whose text is in no task row).

    An index given on the episode wins over the one found by text.
    """
    by_text = first_task_per_text(tasks, order).withColumnRenamed("task_index", "_found")
    e = episodes if "task_index" in episodes.columns else episodes.withColumn("task_index", F.lit(None).cast("bigint"))
    joined = e.join(by_text.withColumnRenamed("task", "_task"), e["instruction"] == F.col("_task"), "left")
    known = joined.filter(F.col("_found").isNotNull())
    found = known.withColumn("task_index", F.coalesce("task_index", "_found")).drop("_task", "_found")
    return found, joined.filter(F.col("_found").isNull()).drop("_task", "_found", "task_index")


def missing(requested: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Requested keys that are not present."""
    return requested.join(present.select(*keys), keys, "left_anti")


def missing_sample(requested: DataFrame, present: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The first ``n`` missing keys, for an error message."""
    return missing(requested, present, keys).select(*keys).distinct().orderBy(*keys).limit(n)


def pending(requested: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work left when a run is resumed."""
    return missing(requested, done, keys)


def present_in_both(requested: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return requested.join(present.select(*keys), keys, "left_semi")


def task_files_by_alias(files: DataFrame, suite: str = "suite", stem: str = "stem", path: str = "path") -> DataFrame:
    """alias -> best file: the lowest suite rank, then the smallest path."""
    rank = F.coalesce(V.literal_map(V.SUITE_RANK)[F.col(suite)], F.lit(99))
    aliases = files.withColumn("alias", F.explode(X.language_aliases(X.language_of_stem(F.col(stem)))))
    return best_by(aliases, ["alias"], F.struct(rank.alias("rank"), F.col(path)), [path])


def best_by(df: DataFrame, keys: list[str], rank: Column, values: list[str]) -> DataFrame:
    """The row of lowest rank per key. A partial aggregation, so a hot key is folded where it lies."""
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*values), rank).alias("_best"))
    return picked.select(*keys, *[F.col("_best")[v].alias(v) for v in values])


def resolve_task_files(episodes: DataFrame, files: DataFrame, **columns) -> tuple[DataFrame, DataFrame]:
    """(episodes with a file, episodes without): by lower-cased, collapsed instruction."""
    index = task_files_by_alias(files, **columns)
    wording = X.collapse_whitespace(F.lower(F.col("instruction")))
    joined = episodes.withColumn("alias", wording).join(index, "alias", "left").drop("alias")
    path = columns.get("path", "path")
    return joined.filter(F.col(path).isNotNull()), joined.filter(F.col(path).isNull()).drop(path)


def single_complete_root(expected: DataFrame, listing: DataFrame, key: str = "episode") -> DataFrame:
    """Per episode the number of roots that hold every expected file, and the root when it is one.

    ``expected``: (episode, name), ``listing``: (root, episode, name). Both are one table of files, which is
    dealt by episode and name before its copies are folded: a task holds what it was dealt and not what it
    read. No list of files is built.
    """
    asked = expected.select(key, "name", F.lit(None).cast(listing.schema["root"].dataType).alias("root"), F.lit(True).alias("_asked"))
    lying = listing.filter(F.col(key).isNotNull() & F.col("name").isNotNull()).select(key, "name", "root", F.lit(False).alias("_asked"))
    files = spread(asked.unionByName(lying), key, "name", tasks=16).distinct()
    wanted = files.withColumn("_known", F.max("_asked").over(Window.partitionBy(key, "name"))).filter("_known")
    counts = wanted.groupBy(key, "root", "_asked").agg(F.count("name").alias("_held"))
    all_of = F.max(F.when(F.col("_asked"), F.col("_held"))).over(Window.partitionBy(key))
    complete = ~F.col("_asked") & (F.col("_held") == F.col("_wanted"))
    out = counts.withColumn("_wanted", all_of).groupBy(key).agg(F.count_if(complete).alias("roots"), F.min(F.when(complete, F.col("root"))).alias("_root"))
    n = F.col("roots")
    state = F.when(n == 1, "ok").when(n == 0, "none").otherwise("ambiguous")
    return out.select(key, "roots", F.when(n == 1, F.col("_root")).alias("root"), state.alias("state"))


def match_actions(grounded: DataFrame, available: DataFrame) -> DataFrame:
    """Grounded actions with a flag: is there an available action of that name and parameter list."""
    known = available.select("state_id", "name", "parameters").distinct().withColumn("matched", F.lit(True))
    out = grounded.join(known, ["state_id", "name", "parameters"], "left")
    return out.withColumn("matched", F.coalesce("matched", F.lit(False)))


def compare(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], right_fields: list[str] | None = None) -> DataFrame:
    """Differences of two tables with the same keys: (keys, field, rule).

    rule: missing_right, missing_left, or changed with the field's name.
    """
    rights = right_fields or fields
    l = left.select(*keys, *[F.col(f).alias(f"_l_{f}") for f in fields], F.lit(True).alias("_in_l"))
    r = right.select(*keys, *[F.col(g).alias(f"_r_{f}") for f, g in zip(fields, rights)], F.lit(True).alias("_in_r"))
    both = l.join(r, keys, "full")
    here, there = F.col("_in_l").isNotNull(), F.col("_in_r").isNotNull()
    rows = [
        F.when(here & ~there, F.struct(F.lit("*").alias("field"), F.lit("missing_right").alias("rule"))),
        F.when(~here & there, F.struct(F.lit("*").alias("field"), F.lit("missing_left").alias("rule"))),
    ]
    for f in fields:
        changed = here & there & ~F.col(f"_l_{f}").eqNullSafe(F.col(f"_r_{f}"))
        rows.append(F.when(changed, F.struct(F.lit(f).alias("field"), F.lit("changed").alias("rule"))))
    return both.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("_d")).select(*keys, "_d.field", "_d.rule")


def first_in_priority(keys: DataFrame, candidates: list[tuple[DataFrame, str]], value: str) -> DataFrame:
    """Value from the first candidate table that has it: a chain of left joins and one coalesce.

    Each candidate is (table, name of the column of ``keys`` it is looked up by); tables have (id, value).
    """
    out, found = keys, []
    for i, (table, by) in enumerate(candidates):
        t = table.select(F.col("id").alias(f"_id{i}"), F.col(value).alias(f"_v{i}"))
        out = out.join(t, out[by] == F.col(f"_id{i}"), "left")
        found.append(F.col(f"_v{i}"))
    out = out.withColumn(value, F.coalesce(*found))
    return out.drop(*[f"_id{i}" for i in range(len(found))], *[f"_v{i}" for i in range(len(found))])
