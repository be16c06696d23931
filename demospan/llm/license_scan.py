"""Licence scan: ordered signature rules behind a keyword filter, overlaps settled by priority.

A match that lies within another of higher priority is suppressed, and so is one within a longer match of
its own priority. DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .common import ascii_lower, cut
from .license_rules import names as all_names, rules as all_rules

#: words that stand together, and their labels
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: no text has it once its words are written
MARK = "\x01"


def _let(value: Column, fn) -> Column:
    return F.element_at(F.transform(F.array(value), fn), 1)


def spoken(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one space before, between and behind."""
    clean = F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(clean), F.lit(" "))


def _spaces(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("bigint")


def _whole(expression: str) -> str:
    return f"(?<= )(?:{expression})(?= )"


def _base(s: Column) -> Column:
    """Counts, first and last word and labels of the base phrases."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        here = s.contains(f" {phrase} ")
        counts.append(F.when(here, F.size(F.regexp_extract_all(s, F.lit(_whole(phrase)), F.lit(0)))).otherwise(0).cast("bigint"))
        before_first, before_last = (F.element_at(F.split(s, _whole(phrase), -1), 1), F.element_at(F.split(s, _whole(phrase), -1), -1))
        firsts.append(F.when(here, _spaces(before_first) - 1))
        # words up to the last place: all of them but those behind it and its own
        lasts.append(F.when(here, _spaces(s) - _spaces(before_last) - len(phrase.split())))
        labels.append(F.when(here, F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return F.struct(
        F.when(F.trim(s) == "", F.lit(0).cast("bigint")).otherwise(_spaces(s) - 1).alias("n_words"),
        total.alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
    )


def _any_of(words: set[str]) -> str:
    """An expression for any of the keywords; those that begin a word are looked for there only, by first letter."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words):
        if w[0] == " ":
            heads.setdefault(w[1], []).append(w[2:])
    return "|".join([f" (?:{'|'.join(f'{c}(?:{chr(124).join(rest)})' for c, rest in heads.items())})", *sorted(w for w in words if w[0] != " ")])


def _spoken_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, b, s``: the base of each row, and its words if some keyword may stand in them."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    any_word = _any_of({w for _, _, _, w, _ in all_rules()})
    both = _let(spoken(docs["text"]), lambda s: F.struct(_base(s).alias("b"), F.when(s.rlike(any_word), s).alias("s")))
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.md5(text).alias("text_key"), both.alias("v"))
    return rows.select("doc_id", "text_key", "v.b", "v.s")


def detections(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, label, priority, weight, rule, first_word, past_word, kept``: every match of a rule.

    Rows that repeat a document give its matches once.
    """
    return _detections(_spoken_rows(docs))


def _table(rows: list[dict], fields: str) -> Column:
    """One constant instead of thousands of expression nodes."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")


def _detections(rows: DataFrame) -> DataFrame:
    rules = all_rules()
    # the rules on a name share its expression; they are tried where the bare name stands
    named = {expression: word for _, word, expression in all_names()}
    groups: dict[tuple[str, str], list[dict]] = {}
    for i, (label, priority, weight, word, rx) in enumerate(rules):
        bare = next((n for n, w in named.items() if w == word and n in rx), rx)
        groups.setdefault((word, bare), []).append({"rule": i, "label": label, "priority": priority, "weight": weight, "expression": _whole(rx)})
    rule = "rule:int,label:string,priority:int,weight:double,expression:string"
    listed = _table([{"word": w, "bare": _whole(b), "rules": r} for (w, b), r in groups.items()], f"word:string,bare:string,rules:array<struct<{rule}>>")
    gated = rows.where("s IS NOT NULL").select("doc_id", "text_key", "s").dropDuplicates(["doc_id", "text_key"])
    tried = gated.select("*", F.explode(F.filter(listed, lambda g: F.col("s").contains(g["word"]))).alias("g"))
    tried = tried.where(F.expr("s RLIKE g.bare")).select("doc_id", "text_key", "s", F.explode("g.rules").alias("r"))
    # matches are put between marks: every second piece is one, and words before a piece are those of all before it
    pieces = F.split(F.regexp_replace("s", F.col("r.expression"), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    spaces = tried.select(
        "doc_id", "text_key", "r.label", "r.priority", "r.weight", "r.rule", F.posexplode(F.transform(pieces, _spaces)).alias("k", "spaces")
    )
    upto = W.partitionBy("doc_id", "text_key", "rule").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    places = spaces.withColumn("first_word", F.sum("spaces").over(upto) - 1).where("k % 2 = 1")
    places = places.withColumn("past_word", F.col("first_word") + F.col("spaces") + 1).drop("k", "spaces")
    order = W.partitionBy("doc_id", "text_key").orderBy("first_word", F.desc("past_word"), F.desc("priority"), "rule").rowsBetween(W.unboundedPreceding, -1)
    levels = sorted({r[1] for r in rules})
    # a match lies within an earlier one if that reaches as far; the farthest reach of each level is kept
    reach = [F.when(F.col("priority") <= p, F.max(F.when(F.col("priority") == p, F.col("past_word"))).over(order)) for p in levels]
    covered = F.coalesce(F.greatest(*reach) >= F.col("past_word"), F.lit(False))
    return places.withColumn("kept", ~covered)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``: a row per row of ``docs``.

    ``score`` is the greatest weight of a match that stands, 1 for a base phrase, 0 where nothing matches.
    A null text is empty. Repeated rows and null ids are scanned each; an empty table gives no rows; other
    columns are ignored.
    """
    rows = cut(_spoken_rows(docs))
    kept = (
        _detections(rows).where("kept").groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_set("label")).alias("more"), F.max("weight").alias("weight"))
        .withColumnsRenamed({"doc_id": "d", "text_key": "t"})
    )
    rows = rows.select("doc_id", "text_key", "b.*")
    joined = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("weight", F.lit(0.0))).alias("score"),
    )
