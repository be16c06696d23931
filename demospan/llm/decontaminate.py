"""Benchmark decontamination by spaced-seed hashing.

A mask names the word positions of a seed that count; the positions between may differ. Hashes of the
masked words of every document place are joined with those of the benchmark. Around every hit document
and item are laid on each other along the hit's diagonal, and the overlap is verified word by word, so
replaced words are tolerated. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil
from uuid import uuid4

from pyspark.sql import Column, DataFrame, functions as F

from .common import BitFilter

#: five words each, as shingles have; three shapes, so that a replaced word spares some seed around it
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 7))
WINDOW = 12
SHARE = 0.8
#: numbers of the seeds of short items, by their words
RUN = 100
#: words of the bitmap that keeps places without a benchmark hash out of the join; a fixed size
BITMAP = 1 << 14


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; every letter beyond ASCII counts as one."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " ", -1))


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def run_of(n: int, window: int, share: float) -> int | None:
    """Successive words of which some run stays whole in an item of ``n`` words that meets a text; None for long ones.

    With d words replaced, one of d + 1 parts of the item is untouched.
    """
    return n // (n - ceil(share * n - 1e-9) + 1) if n < window else None


def _seed(hashes: Column, at: Column, number: int, mask: Sequence[int]) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(hashes, at + o) for o in mask])


def _places(hashes: Column, mask: Sequence[int]) -> Column:
    last = F.size(hashes) - mask[-1] - 1
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _seeds(hashes: Column, masks: dict[int, Sequence[int]], keep=None, used=None) -> Column:
    """All seeds as (place, seed) of the masks; ``used`` says which arrays a mask is for."""

    def of(number: int, mask: Sequence[int]) -> Column:
        places = _places(hashes, mask)
        if used is not None:
            places = F.when(used(number), places).otherwise(F.array().cast("array<int>"))
        if keep is not None:
            places = F.filter(places, lambda i: keep(_seed(hashes, i, number, mask)))
        return F.transform(places, lambda i: F.struct(i.alias("place"), _seed(hashes, i, number, mask).alias("seed")))

    return F.concat(*[of(number, mask) for number, mask in masks.items()])


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``doc_id, text_key, item_id, item_words, matched, start_word``: one row per document and item met.

    They meet when, on the diagonal of some seed hit, ``window`` successive words of the item (all of a
    shorter item) agree with the document in at least ``share`` of the places. ``matched`` counts the
    agreeing places of the whole item on the best diagonal, the first of equals; ``start_word`` is the
    document word on which the item's first word lies, and is negative if the item begins before the text.

    Items of under ``window`` words have seeds of their own, successive words of which some stay whole wherever
    words are replaced; the documents are searched for them only if there are such items.

    Null and empty texts and items without a word meet nothing. Repeated rows count once, rows
    that share an id but not a text count each (``text_key`` is a hash of the text); a null doc_id is a
    value. Items with a null id or text are ignored; of equal item ids every text is tried. An empty table
    gives no rows; other columns are ignored.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    items = (
        benchmark.where("item_id IS NOT NULL AND text IS NOT NULL")
        .select(F.col("item_id"), words_of(F.col("text")).alias("item"))
        .where(F.size("item") > 0)
        .distinct()
    )
    items = items.withColumn("item_key", F.md5(F.array_join("item", " ")))
    short: dict[int, list[int]] = {}
    for (n,) in items.where(F.size("item") < window).select(F.size("item")).distinct().collect():  # under ``window`` numbers
        short.setdefault(run_of(n, window, share), []).append(n)
    masks = dict(enumerate(MASKS)) | {RUN + r: range(r) for r in sorted(short)}
    used = lambda number: F.size("item").isin(short[number - RUN]) if number >= RUN else F.lit(True)
    item_seeds = items.select("item_id", "item_key", F.explode(_seeds(_hashed(F.col("item")), masks, used=used)).alias("s")).select(
        "item_id", "item_key", F.col("s.place").alias("item_place"), "s.seed"
    )
    known = BitFilter(item_seeds, "seed", BITMAP)
    found = _let(_hashed(words_of(F.col("text"))), lambda h: _seeds(h, masks, known.may_hold))
    places = rows.select("doc_id", "text_key", F.explode(found).alias("s")).select("doc_id", "text_key", "s.place", "s.seed")
    diagonals = (
        places.join(item_seeds, "seed")
        .select("doc_id", "text_key", "item_id", "item_key", (F.col("place") - F.col("item_place")).alias("start_word"))
        .distinct()
        .join(items, ["item_id", "item_key"])
    )
    with_words = rows.join(
        diagonals.withColumnsRenamed({"doc_id": "d", "text_key": "k"}),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")),
    )
    n = F.size("item")
    # the item's words beside the document's; places outside the text agree with nothing
    agree = _let(
        words_of(F.col("text")),
        lambda w: F.transform(F.col("item"), lambda x, i: F.coalesce((F.when(F.col("start_word") + i >= 0, F.get(w, F.col("start_word") + i)) == x).cast("int"), F.lit(0))),
    )
    laid = with_words.select("doc_id", "text_key", "item_id", "start_word", n.alias("item_words"), agree.alias("agree"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    width = F.least(F.col("item_words"), F.lit(window))
    windows = F.transform(F.sequence(F.lit(1), F.col("item_words") - width + 1), lambda i: total(F.slice(F.col("agree"), i, width)))
    met = laid.withColumn("matched", total(F.col("agree"))).where(F.array_max(windows) >= F.lit(share) * width)
    best = met.groupBy("doc_id", "text_key", "item_id").agg(
        F.max(F.struct("matched", (-F.col("start_word")).alias("first"), (-F.col("item_words")).alias("words"))).alias("b")
    )
    return best.select(
        "doc_id", "text_key", "item_id", (-F.col("b.words")).cast("bigint").alias("item_words"),
        F.col("b.matched").cast("bigint").alias("matched"), (-F.col("b.first")).cast("bigint").alias("start_word"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that meet no benchmark item, all columns as they are."""
    own, where = (f"__{uuid4().hex}_{n}" for n in ("own", "id"))
    met = overlaps(docs, benchmark, window, share).select(F.col("doc_id").alias(where), F.col("text_key").alias(own)).distinct()
    text = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(met, docs["doc_id"].cast("bigint").eqNullSafe(met[where]) & (text == met[own]), "left_anti")
