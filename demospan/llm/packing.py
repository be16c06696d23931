"""Best-fit packing planned over a histogram of lengths; documents take planned slots by rank.

A plan depends only on how many pieces there are of each length (at most ``capacity`` counts). It is a
list of runs: the pieces of one length with ranks first..last go to consecutive sequences, so many to
each, at one offset. Every piece finds its run by its rank among the pieces of its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from .common import cut, texts

CAPACITY = 2048
END = 0
#: pieces of a length are ranked in so many parts
RANK_PARTS = 1024
WORD_CACHE = 500_000
#: documents encoded at once
TOGETHER = 128
WORD_END = "</w>"
#: texts of these characters alone are in normal form, have no special lower case and no odd white space
PLAIN = re.compile("[\x00-\x1b\x20-\u024f\u2010-\u2027\u20ac]*")


class Encoder:
    """Token ids of whole texts from a ``tokenizers`` file, remembering the ids of each word.

    No token crosses white space or a word of the file's splitter, and its last token alone carries the word
    end. So the words not seen before are encoded together by the library, and the texts are put together
    from a table. Other tokenizer files and unusual texts go to the library whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        wanted = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.by_word = spec["normalizer"].get("normalizers") == wanted and split["behavior"] == "Removed" and split["invert"]
        self.by_word = self.by_word and spec["model"].get("end_of_word_suffix") == WORD_END
        self.words = regex.compile(split["pattern"]["Regex"]).findall if self.by_word else None
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ends = np.zeros(self.full.get_vocab_size(), dtype=bool)
        for token, i in self.full.get_vocab().items():
            self.ends[i] = token.endswith(WORD_END)
        self.seen: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Puts the ids of chunks of text without white space into the table."""
        split = {c: self.words(c) for c in chunks}
        new = list({w for words in split.values() for w in words if w not in self.seen})
        if new:
            found = self.full.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids
            ids = np.array(found, dtype="<u4")
            ends = (np.nonzero(self.ends[ids])[0] + 1).tolist()
            data = ids.tobytes()
            if len(ends) == len(new):
                self.seen.update((w, data[4 * a : 4 * b]) for w, a, b in zip(new, [0, *ends], ends))
            else:
                self.seen.update((w, self._whole(w)) for w in new)
        for c, words in split.items():
            if c not in self.seen:
                self.seen[c] = b"".join([self.seen[w] for w in words])

    def many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.seen) > WORD_CACHE:
            self.seen.clear()
        seen = self.seen
        plain = [self.by_word and PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        chunks = [t.lower().split() if p else None for t, p in zip(texts, plain)]
        new: set[str] = set()
        for c in chunks:
            if c:
                new.update(filterfalse(seen.__contains__, c))
        if new:
            self._learn(new)
        return [self._whole(t) if c is None else b"".join([seen[x] for x in c]) for t, c in zip(texts, chunks)]

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids``: the ids of every document and its end id, cut at ``capacity``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path(tokenizer))
        names = ["doc_id", "piece", "start", "length", "ids"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for first in range(0, len(batch), TOGETHER):
                out = []
                some = batch.slice(first, TOGETHER)
                encoded = encoder.many(some.column("text").to_pylist())
                for doc, ids in zip(some.column("doc_id").to_pylist(), encoded):
                    ids += int(end).to_bytes(4, "little")
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        out.append((doc, i, at // 4, len(part) // 4, part))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return texts(docs).mapInArrow(rows, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs ``length, first rank, how many sequences, pieces in each, first sequence, offset``.

    Best fit, longest pieces first. Sequences with equal room are one block of numbers, so the work and the
    plan grow with the number of lengths, not of pieces.
    """
    room: dict[int, list[list[int]]] = {}  # room left -> blocks of sequences (first, how many)
    made, runs = 0, []
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0

        def put(first: int, many: int, each: int, free: int) -> None:
            nonlocal left, rank
            runs.append((length, rank, many, each, first, capacity - free))
            rank += many * each
            left -= many * each
            if free - each * length:
                room.setdefault(free - each * length, []).append([first, many])

        for free in sorted(r for r in room if r >= length):
            each = free // length
            blocks = room.pop(free)
            while blocks and left:
                first, many = blocks.pop()
                full = min(many, left // each)
                if full:
                    put(first, full, each, free)
                if full < many:
                    if left:
                        put(first + full, 1, left, free)
                        full += 1
                    if full < many:
                        blocks.append([first + full, many - full])
            if blocks:
                room.setdefault(free, []).extend(blocks)
            if not left:
                break
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            if full:
                put(made, full, each, capacity)
                made += full
            if rest:
                put(made, 1, rest, capacity)
                made += 1
    return np.array(runs, dtype=np.int64).reshape(-1, 6)


def ranked(lengths: DataFrame, order: list[str]) -> DataFrame:
    """``rank``: place from 0 among the rows of a length.

    A length may hold a third of all rows, so it is ranked in parts and the parts are summed up.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(RANK_PARTS))
    rows = lengths.withColumn("part", part)
    sizes = rows.groupBy("length", "part").count()
    before = F.sum("count").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy("length", "part").orderBy(*order)) - 1
    return rows.withColumn("nth", nth).join(starts, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before")).drop("nth", "before", "part")


def placed(lengths: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, offset`` for rows with ``length`` 1 to capacity. Only the histogram reaches the driver."""
    counts = {r[0]: r[1] for r in lengths.groupBy("length").count().collect()}  # at most capacity rows
    runs = plan(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    keys = (runs[:, 0] << 44) + runs[:, 1]

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (length.to_numpy() << 44) + rank.to_numpy(), side="right") - 1
        run = runs[at]
        i = rank.to_numpy() - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 4] + i // run[:, 3], "offset": run[:, 5] + i % run[:, 3] * run[:, 0]})

    rows = ranked(lengths, order).withColumn("slot", slot("length", "rank"))
    return rows.select(*lengths.columns, "slot.sequence_id", "slot.offset")


def digest(cut_pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of their ids."""
    return cut_pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a row per piece.

    A null text is empty: one piece holding the end id. Rows that repeat a doc_id are packed each on its
    own, null ids too. An empty table gives no rows; other columns are ignored.
    """
    rows = cut(digest(pieces(docs, tokenizer, capacity, end)))
    return placed(rows, ["doc_id", "piece", "start", "ids_crc32"], capacity)
