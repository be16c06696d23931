"""Exact duplicates by composable polynomial fingerprints, equal fingerprints confirmed chunk by chunk.

A text is cut into chunks of bytes. Each chunk has a hash that is a polynomial in its bytes; the hashes
of neighbouring chunks combine by shifting the right one by the length of the left, so the chunks of a
huge text may be hashed anywhere and in any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from .common import BitFilter, cut, kept_rows, texts

CHUNK = 1 << 16
#: words of the bitmap of texts whose fingerprint is shared; a fixed size
BITMAP = 1 << 14
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003, 998_244_353)
KEY = ["f1", "f2", "n_bytes"]


def _powers(base: int, prime: int) -> np.ndarray:
    out = np.empty(CHUNK, dtype=np.uint64)
    x = 1
    for i in range(CHUNK):
        out[i] = x
        x = x * base % prime
    return out


_POWERS: list[np.ndarray] = []


def chunk_hash(chunk: bytes) -> tuple[int, int]:
    """Both polynomials of at most CHUNK bytes; a byte counts as its value plus one."""
    if not _POWERS:
        _POWERS.extend(_powers(b, p) for b, p in zip(BASES, PRIMES))
    x = np.frombuffer(chunk, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int((x * w[: len(x)]).sum() % np.uint64(p)) for w, p in zip(_POWERS, PRIMES))


def combine(left: tuple[int, int], left_length: int, right: tuple[int, int]) -> tuple[int, int]:
    """The hash of two neighbouring pieces from their own hashes and the length of the left one."""
    return tuple((a + pow(b, left_length, p) * c) % p for a, c, b, p in zip(left, right, BASES, PRIMES))


def normalise(text: str) -> bytes:
    """Each run of ASCII white space becomes one space; leading and trailing runs too."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return b" " if raw else b""
    spaces = b" \t\n\r\x0b\x0c"
    return (b" " if raw[0] in spaces else b"") + b" ".join(words) + (b" " if raw[-1] in spaces else b"")


def _cut_up(data: bytes) -> list[bytes]:
    return [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)] or [b""]


def fingerprint(chunks: list[bytes]) -> tuple[int, int]:
    whole, length = (0, 0), 0
    for c in chunks:
        whole = combine(whole, length, chunk_hash(c))
        length += len(c)
    return whole


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f1, f2, size, sha = [], [], [], []
        for text in batch.column("text"):
            data = normalise(text.as_py())
            a, b = fingerprint(_cut_up(data))
            f1.append(a)
            f2.append(b)
            size.append(len(data))
            sha.append(hashlib.sha256(data).hexdigest())
        found = [pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found], ["doc_id", *KEY, "text_sha256"])


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*KEY, "chunk_no", "chunk"]
    kinds = [pa.int64()] * 4 + [pa.binary()]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        rows, held = [], 0
        for text in batch.column("text"):
            data = normalise(text.as_py())
            pieces = _cut_up(data)
            a, b = fingerprint(pieces)
            for i, piece in enumerate(pieces):
                rows.append((a, b, len(data), i, piece))
                held += len(piece)
                if held > 1 << 24:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, f1, f2, n_bytes, text_sha256`` of the normalised text, a row per document."""
    return texts(docs).mapInArrow(_rows, "doc_id bigint, f1 bigint, f2 bigint, n_bytes bigint, text_sha256 string")


def collisions(docs: DataFrame) -> DataFrame:
    """Fingerprints that differing texts share, found by comparing their chunks byte by byte.

    Equal chunks at the same place fold before the shuffle, so a group of copies, however large, sends
    one row per task; a fingerprint with two different chunks at one place is a collision.
    """
    chunks = texts(docs).select("text").mapInArrow(
        _chunk_rows, "f1 bigint, f2 bigint, n_bytes bigint, chunk_no bigint, chunk binary"
    )
    kinds = chunks.groupBy(*KEY, "chunk_no", "chunk").agg(F.lit(1).alias("one"))
    return kinds.groupBy(*KEY, "chunk_no").count().where("count > 1").select(*KEY).distinct()


def exact_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of ``docs``.

    Texts are equal when identical after each run of ASCII white space became one space. The row with the
    smallest doc_id of equal texts stays; of several rows with that id one stays. Null texts count as
    empty. A null doc_id comes after all others; keep_id is null only if every id of the group is. An
    empty table gives no rows; other columns are ignored.
    """
    rows = cut(fingerprints(docs))
    numbered = rows.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", *KEY, "text_sha256").orderBy(F.lit(1))))
    contents = rows.groupBy(*KEY, "text_sha256").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    # only texts whose fingerprint another row has are compared; the bitmap of their ids lets a few more through
    shared = rows.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY)
    ids = rows.join(shared, KEY, "left_semi").select(F.xxhash64("doc_id").alias("id")).distinct()
    compared = docs.where(BitFilter(ids, "id", BITMAP).may_hold(F.xxhash64(docs["doc_id"].cast("bigint"))))
    clash = collisions(compared).withColumn("clash", F.lit(True))
    # a fingerprint is a class of its own unless the comparison split it; then its contents are
    classes = contents.join(clash, KEY, "left").withColumn("class", F.when(F.col("clash"), F.col("text_sha256")))
    w = W.partitionBy(*KEY, "class")
    classes = classes.select(
        *KEY, "text_sha256", F.min("least").over(w).alias("keep_id"), F.sum("rows").over(w).alias("group_size")
    )
    return numbered.join(classes, [*KEY, "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact_groups keeps, all columns as they are."""
    sha = F.sha2(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), "[\\x20\\x09-\\x0D]+", " ").cast("binary"), 256)
    return kept_rows(docs, sha, exact_groups(docs).where("kept").select("doc_id", F.col("text_sha256").alias("own")))
