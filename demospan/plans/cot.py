"""Structured plan texts: conversion, repair, combination and the checks of a conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..operators.aggregates import duplicate_sources, header_conflicts, index_gaps
from ..operators.joins import by_shuffle, compare
from ..operators.setops import overlay

TEXT_FIELDS = ["content", "updated_content", "updated_content_w_instruction"]
#: what a conversion makes
SKILL_FIELDS = ["skill", "updated_skill", "current_skill"]


def fields_to_convert(segments: DataFrame, keys: list[str]) -> DataFrame:
    """One row per text that has the structure: (keys, field, text)."""
    named = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in TEXT_FIELDS])
    rows = segments.select(*keys, F.explode(named).alias("_f")).select(*keys, "_f.field", "_f.text")
    return rows.filter(F.coalesce(X.has_plan_structure(F.col("text")), F.lit(False)))


def convert(segments: DataFrame, answers: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(converted segments, violations) from answers (keys, field, text).

    The instruction part is kept from the original, items are put into canonical form, and the
    text with instruction is rebuilt from its two parts.
    """
    asked = fields_to_convert(segments, keys)
    a = by_shuffle(asked, answers.withColumnRenamed("text", "answer"), [*keys, "field"], "left")
    before = X.instruction_prefix(F.col("text"))
    tail = F.when(before.isNotNull(), F.concat(before, X.plan_tail(F.col("answer")))).otherwise(F.col("answer"))
    a = a.withColumn("new", X.canonical_structured_text(tail))
    a = a.withColumn(
        "reason",
        F.when(F.col("answer").isNull(), "no_answer").otherwise(X.structured_text_reason(F.col("new"), F.col("text"))),
    )
    wide = a.groupBy(*keys).agg(*[F.max(F.when(F.col("field") == f, F.col("new"))).alias(f"_n_{f}") for f in TEXT_FIELDS])
    j = by_shuffle(segments, wide, keys, "left")
    j = j.withColumns({f: F.coalesce(f"_n_{f}", f) for f in TEXT_FIELDS})
    both = F.concat(X.instruction_prefix(F.col("content")), X.plan_tail(F.col("updated_content")))
    rebuilt = F.col("_n_updated_content_w_instruction").isNotNull() & F.col("_n_updated_content").isNotNull()
    j = j.withColumn(
        "updated_content_w_instruction",
        F.when(rebuilt, F.coalesce(both, "updated_content_w_instruction")).otherwise(F.col("updated_content_w_instruction")),
    )
    j = j.withColumn("current_skill", X.single_now_item(X.active_text(F.col("updated_content"), F.col("content"))))
    return j.drop(*[f"_n_{f}" for f in TEXT_FIELDS]), a.filter(F.col("reason").isNotNull()).select(*keys, "field", "reason")


def repair(segments: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(segments with skill and updated_skill from their texts, violations); current_skill is dropped."""
    now = X.single_now_item(F.col("content"))
    updated = X.single_now_item(F.col("updated_content"))
    whole = X.single_now_item(F.col("updated_content_w_instruction"))
    has_update = F.col("updated_content").isNotNull()
    reason = (
        F.when(F.col("content").isNull(), "no_content")
        .when(now.isNull(), "now_not_single")
        .when(has_update & updated.isNull(), "updated_now_not_single")
        .when(has_update & F.col("updated_content_w_instruction").isNull(), "no_updated_with_instruction")
        .when(has_update & ~updated.eqNullSafe(whole), "updated_texts_disagree")
    )
    j = segments.withColumns({"skill": now, "updated_skill": F.when(has_update, updated), "reason": reason})
    good = j.filter(F.col("reason").isNull()).drop("reason", "current_skill")
    return good, j.filter(F.col("reason").isNotNull()).select(*keys, "reason")


def combine(entries: DataFrame, headers: DataFrame, key: str = "episode", source: str = "source"):
    """(rows, duplicate keys with their sources, header conflicts)."""
    return entries, duplicate_sources(entries, [key], source), header_conflicts(headers)


def resume(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return overlay(new, existing, keys)


def diff(original: DataFrame, converted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, rule): everything a conversion must not change, and what it must produce.

    Every field that is no text or skill, and texts without the structure, stay as they are, also where the
    converted table has lost the column; structured texts obey the checking rules; skills come from the ``now``
    item of their text.
    """
    made = {*keys, *TEXT_FIELDS, *SKILL_FIELDS}
    kept = [f for f in original.columns if f not in made]
    there = converted.withColumns({f: F.lit(None).cast(original.schema[f].dataType) for f in kept if f not in converted.columns})
    unchanged = compare(original, there, keys, kept)
    o = original.select(*keys, *[F.col(f).alias(f"_o_{f}") for f in TEXT_FIELDS])
    j = by_shuffle(o, converted, keys)

    def flag(name: str, rule: str, test: Column) -> Column:
        return F.when(
            F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("field"), F.lit(rule).alias("rule"))
        )

    rows = []
    for f in TEXT_FIELDS:
        was, now = F.col(f"_o_{f}"), F.col(f)
        structured = F.coalesce(X.has_plan_structure(was), F.lit(False))
        reason = X.structured_text_reason(now, was, X.is_placeholder_word)
        rows.append(flag(f, "plain_text_changed", ~structured & ~was.eqNullSafe(now)))
        rows.append(
            F.when(structured & reason.isNotNull(), F.struct(F.lit(f).alias("field"), reason.alias("rule")))
        )
    content, updated = F.col("content"), F.col("updated_content")
    whole = F.col("updated_content_w_instruction")
    expected = F.concat(X.instruction_prefix(content), X.plan_tail(updated))
    valid = lambda s: X.is_placeholder_word(s) | X.is_cot_skill(s)
    skill, updated_skill = F.col("skill"), F.col("updated_skill")
    rows += [
        flag("updated_content_w_instruction", "not_instruction_plus_tail", whole.isNotNull() & ~whole.eqNullSafe(expected)),
        flag("skill", "missing", skill.isNull()),
        flag("skill", "not_now_item", skill.isNotNull() & ~skill.eqNullSafe(X.single_now_item(content))),
        flag("skill", "not_valid", skill.isNotNull() & ~valid(skill)),
        flag("updated_skill", "present_without_text", updated.isNull() & updated_skill.isNotNull()),
        flag("updated_skill", "missing", updated.isNotNull() & updated_skill.isNull()),
        flag("updated_skill", "not_now_item", updated_skill.isNotNull() & updated.isNotNull() & ~updated_skill.eqNullSafe(X.single_now_item(updated))),
        flag("updated_skill", "not_now_item_with_instruction", updated_skill.isNotNull() & updated.isNotNull() & ~updated_skill.eqNullSafe(X.single_now_item(whole))),
        flag("updated_skill", "not_valid", updated_skill.isNotNull() & updated.isNotNull() & ~valid(updated_skill)),
    ]
    found = j.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("_v")).select(*keys, "_v.*")
    return unchanged.unionByName(found)


def index_problems(converted: DataFrame, key: str = "episode") -> DataFrame:
    return index_gaps(converted, key)
