"""Near duplicates by SimHash, with pivot distance tables.

Every fingerprint has a row in a table of its Hamming distances to fixed reference fingerprints (pivots).
Two fingerprints within r bits differ by at most r in every coordinate, so a pair with a larger coordinate
difference is discarded without looking at its bits; survivors are verified.

Which pairs meet at all: the 64 bits are cut into r + 3 blocks, so two fingerprints within r bits agree on
at least 3 of them. Every choice of 3 blocks is a key. A key that too many fingerprints share is refined in
the same way over its remaining bits, which bounds a group by 2^16 fingerprints; no pair is lost.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, kept_rows, texts
from .components import components

WORDS = 3
RADIUS = 3
SEED = 42
PIVOTS = 16
SHARED_BLOCKS = 3
#: keys shared by more fingerprints are refined; it changes the work, never the result
REFINE_ABOVE = 4096
BLOCK = 1 << 16


def simhash(text: str, words: int = WORDS) -> int:
    """64 bits; bit i is set where over half the hashes of the word shingles have it."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = list(accumulate((len(t) + 1 for t in tokens)))
    starts = [0, *ends[:-1]]
    last = ends[words - 1 :] or ends[-1:]
    votes, n = np.zeros(64, dtype=np.int64), len(last)
    for at in range(0, n, BLOCK):
        part = [xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts[at : at + BLOCK], last[at : at + BLOCK])]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())


def _fingerprinted(told: DataFrame, words: int) -> DataFrame:
    """The rows of ``told`` with ``fp`` (bigint) in place of their text, which is the last column."""
    names = told.columns[:-1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(t.as_py(), words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), _signed(fps)], [*names, "fp"])

    return told.mapInArrow(rows, ", ".join(f"{c} bigint" for c in [*names, "fp"]))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, fp`` (bigint) for every row."""
    return _fingerprinted(texts(docs).select("doc_id", "text"), words)


def block_masks(bits: list[int], blocks: int, shared: int = SHARED_BLOCKS) -> list[int]:
    """A mask for every choice of ``shared`` of the ``blocks`` into which the bit positions are cut."""
    cuts = [len(bits) * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, shared)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _table(masks: list) -> F.Column:
    """Masks, or a list of them for each choice, as one constant."""
    nested = isinstance(masks[0], list)
    longs = [[_long(m) for m in row] for row in masks] if nested else [_long(m) for m in masks]
    return F.from_json(F.lit(json.dumps(longs)), "array<array<bigint>>" if nested else "array<bigint>")


def _keyed(fps: DataFrame, masks: F.Column) -> DataFrame:
    keys = F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))
    return fps.select("*", F.posexplode(keys).alias("place", "key"))


def _pivots() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(PIVOTS)], dtype=np.uint64)


def linked_in_groups(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join every two members of a group that links within ``radius`` connect.

    Rows of a group are neighbours. Members are compared at growing shifts; a pair already joined is not
    looked at again, so a group of n gives fewer than n pairs.
    """
    n = len(fp)
    table = np.bitwise_count(fp[:, None] ^ _pivots()[None, :]).astype(np.int8)
    root = np.arange(n)
    found: list[tuple[int, int]] = []
    left = np.nonzero(group[1:] == group[:-1])[0]
    shift = 1
    while len(left):
        a, b = left, left + shift
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
        for j in range(PIVOTS):
            near = np.abs(table[a, j] - table[b, j]) <= radius
            a, b = a[near], b[near]
        close = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        for x, y in zip(a[close].tolist(), b[close].tolist()):
            rx, ry = x, y
            while root[rx] != rx:
                rx = int(root[rx])
            while root[ry] != ry:
                ry = int(root[ry])
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
                found.append((x, y))
        if close.any():
            while (root[root] != root).any():
                root = root[root]
        shift += 1
        left = left[left + shift < n]
        left = left[group[left] == group[left + shift]]
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _links(radius: int):
    """Edges of sorted groups; a group that spans batches is put together first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(choice, key, fp):
            new = np.r_[False, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])]
            a, b = linked_in_groups(np.cumsum(new), fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

        held = [np.zeros(0, dtype=np.int64)] * 3
        for batch in batches:
            held = [np.r_[h, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)] for h, c in zip(held, ("choice", "key", "fp"))]
            choice, key, _ = held
            if len(key) < 50_000:
                continue
            ended = np.nonzero((choice != choice[-1]) | (key != key[-1]))[0]
            if len(ended):
                at = ended[-1] + 1
                yield edges(*[h[:at] for h in held])
                held = [h[at:] for h in held]
        if len(held[0]):
            yield edges(*held)

    return rows


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: pairs of the distinct fingerprints ``fp`` whose components are those of all links."""
    masks = block_masks(list(range(64)), radius + SHARED_BLOCKS)
    keyed = _keyed(fps.select("fp"), _table(masks)).withColumnRenamed("place", "choice")
    sizes = keyed.groupBy("choice", "key").count().where("count > 1")
    shared = keyed.join(sizes, ["choice", "key"])
    small = shared.where(F.col("count") <= REFINE_ABOVE).select("choice", "key", "fp")
    rests = [[b for b in range(64) if not m >> b & 1] for m in masks]
    finer = [[m | s for s in block_masks(rest, radius + SHARED_BLOCKS)] for m, rest in zip(masks, rests)]
    large = shared.where(F.col("count") > REFINE_ABOVE).select("choice", "fp")
    refined = _keyed(large, F.get(_table(finer), F.col("choice"))).select(
        (len(masks) + F.col("choice") * len(finer[0]) + F.col("place")).alias("choice"), "key", "fp"
    )
    out = small.union(refined)
    grouped = out.repartition("choice", "key").sortWithinPartitions("choice", "key", "fp")
    return grouped.mapInArrow(_links(radius), "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id``: a row per row of ``docs``.

    Documents whose fingerprints differ in ``radius`` bits or fewer are linked; a component is named by
    its smallest doc_id. A text without words, or a null one, has fingerprint zero and links like any
    other. Rows with equal fingerprints are in one component. A null doc_id never names a component that
    has another. An empty table gives no rows; other columns are ignored.
    """
    rows = cut(fingerprints(docs, words))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(distinct.select("fp"), radius))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    # two plain aggregations instead of a window: a component may hold a third of all fingerprints
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The row with the smallest doc_id of each component, all columns as they are; null ids come last.

    Of several rows with that id, the one with the smallest text hash stays. Components named by one id keep one
    row together; those without any id keep one each.
    """
    told = texts(docs).select("doc_id", F.xxhash64("text").alias("own"), "text")
    rows = cut(_fingerprinted(told, words).withColumnRenamed("fp", "node"))
    links = fingerprint_links(rows.select(F.col("node").alias("fp")).distinct(), radius)
    return keep_least(docs, least_rows(rows, components(links)))


def least_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``doc_id, own``: the rows of ``rows(doc_id, own, node)`` that ``keep_one`` keeps; ``roots(node, root)`` joins nodes."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")
    first = rows.groupBy("node").agg(F.min(place).alias("first"))
    of = roots.withColumnRenamed("node", "of")
    named = first.join(of, first["node"] == of["of"], "left").select(F.coalesce("root", "node").alias("root"), "first")
    least = named.groupBy("root").agg(F.min("first").alias("first")).select("root", "first.doc_id", "first.own")
    nameless = F.when(F.col("doc_id").isNull(), F.col("root"))
    return least.groupBy("doc_id", nameless.alias("nameless")).agg(F.min("own").alias("own")).select("doc_id", "own")


def keep_least(docs: DataFrame, least: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text hash ``least(doc_id, own)`` names, one for each."""
    return kept_rows(docs, F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))), least)
