"""Choose episodes by their plan and task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..functions import vocab as V
from ..operators.sampling import top


def in_range(key: Column, start: int, end: int | None, total: int) -> Column:
    """start <= key < end, with the range clamped to [0, total); an empty range is an error."""
    low, high = max(0, start), total if end is None else min(end, total)
    if low >= high:
        raise ValueError(f"empty episode range [{start}, {end}) of {total}")
    return (key >= low) & (key < high)


def skills_of(plan: Column, segments: Column | None = None) -> Column:
    """Raw skills of the plan, or of the segments when there is no plan."""
    listed = X.parse_plan_raw(plan)
    if segments is None:
        return listed
    own = F.filter(F.transform(segments, lambda s: F.trim(s["skill"])), lambda s: s != "")
    return F.when(plan.isNotNull(), listed).otherwise(own)


def has_keyword(task_name: Column, keyword: str) -> Column:
    word = " ".join(keyword.split()).casefold()
    if not word:
        raise ValueError("keyword must not be empty")
    return F.lower(F.coalesce(task_name, F.lit(""))).contains(word)


def has_task(task: Column, wanted: str) -> Column:
    return X.collapse_whitespace(task) == " ".join(wanted.split())


def _known(verb: str, dataset: str) -> str:
    name = verb.strip().upper()
    if name not in V.ARITY[dataset]:
        raise ValueError(f"unknown verb {verb!r}; expected one of {', '.join(sorted(V.ARITY[dataset]))}")
    return name


def has_all_verbs(verbs: Column, required: list[str], dataset: str) -> Column:
    want = V.literal_array(sorted({_known(v, dataset) for v in required}))
    return F.size(F.array_except(want, verbs)) == 0


def verbs_at(verbs: Column, constraints: list[tuple[int, str]], dataset: str) -> Column:
    """Each 1-based position holds the given verb; two verbs for one position are an error."""
    want: dict[int, str] = {}
    for position, verb in constraints:
        name = _known(verb, dataset)
        if position <= 0:
            raise ValueError(f"positions start at 1, got {position}")
        if want.setdefault(position, name) != name:
            raise ValueError(f"conflicting verbs for position {position}: {want[position]} and {name}")
    test = F.lit(True)
    for position, name in want.items():
        test = test & F.coalesce(F.get(verbs, F.lit(position - 1)) == name, F.lit(False))
    return test


def select_episodes(
    annotations: DataFrame,
    dataset: str,
    key: str = "episode_index",
    plan_size: int | None = None,
    keyword: str | None = None,
    must_contain: list[str] | None = None,
    skill_at: list[tuple[int, str]] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filters in one pass over the rows; the limit comes last, in episode order."""
    df = annotations.withColumn("_skills", skills_of(F.col("plan")))
    df = df.withColumn("_verbs", F.transform("_skills", lambda s: X.skill_verb_lenient(s)))
    if plan_size is not None:
        df = df.filter(F.size("_skills") == plan_size)
    if keyword is not None:
        df = df.filter(has_keyword(F.col("task_name"), keyword))
    if must_contain:
        df = df.filter(has_all_verbs(F.col("_verbs"), must_contain, dataset))
    if skill_at:
        df = df.filter(verbs_at(F.col("_verbs"), skill_at, dataset))
    df = df.drop("_skills", "_verbs")
    return df if limit is None else top(df, [F.col(key)], limit)
