"""Encoding and decoding with the merges of a piece file, in time linear in the text.

Merging the best pair first leaves every prefix of a text with one encoding, so one last token: of the tokens
that end there, as an automaton lists them, the one that stays apart from the last token of the prefix before
it. Two tokens stay apart if their own merges, taken in the order of the scores, never bring up a better pair
across their border; that depends on the two tokens only and is remembered. The table of last tokens is read
backwards to the ids.

No piece has the word mark after another letter, or a line break, so no token crosses a border of either:
a text is put together from its words, whose ids are remembered too.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .packing import tokenizer_path

MARK = "▁"
BREAK = "\n"
RUNS = re.compile("( +)")
#: words and pairs of tokens in a table of what is remembered; beyond it a new table is begun
WORD_CACHE, PAIR_CACHE = 300_000, 500_000
#: documents in one batch of results
TOGETHER = 128
REPLACED = "�".encode()


class Merges:
    """The merges of one token by itself: scores, and its first and last symbol after each."""

    __slots__ = ("scores", "firsts", "lasts", "whole")

    def __init__(self, token: str, score: dict[str, float]):
        symbols = list(token)
        self.scores, self.firsts, self.lasts = [], [symbols[0]], [symbols[-1]]
        while True:
            found = [(score[a + b], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in score]
            if not found:
                break
            best, i = max(found)  # equal scores: the leftmost pair
            symbols[-i : 2 - i] = [symbols[-i] + symbols[1 - i]]
            self.scores.append(best)
            self.firsts.append(symbols[0])
            self.lasts.append(symbols[-1])
        self.whole = len(symbols) == 1


class PieceBpe:
    """Ids of whole texts under a merge-type piece file with byte fallback, and back."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.end = model.eos_id()
        self.id = {model.id_to_piece(i): i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.score = {p: model.get_score(i) for p, i in self.id.items()}
        byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        if model.normalize("ﬁ  a ") != f"{MARK}ﬁ{MARK}{MARK}a{MARK}" or len(byte) != 256 or any(map(model.is_unused, ids)):
            raise ValueError("the piece file must keep texts as they are, put a mark before them and fall back to bytes")
        self.packed = {p: i.to_bytes(4, "little") for p, i in self.id.items()}
        self.packed_bytes = [byte[b].to_bytes(4, "little") for b in range(256)]
        self.byte_of = {i: b for b, i in byte.items()}
        self.written = [b""] * len(ids)  # of control and unknown ids nothing is written
        for p, i in self.id.items():
            self.written[i] = p.replace(MARK, " ").encode()
        for i, b in self.byte_of.items():
            self.written[i] = bytes([b])
        for i in ids:
            if model.is_unknown(i):
                self.written[i] = " ⁇ ".encode()
        self.marked = {i for p, i in self.id.items() if p.startswith(MARK)}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if Merges(p, self.score).whole:  # else its letters never become it
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.by_word = not any(MARK in p.lstrip(MARK) or BREAK in p for p in self.id)
        self.merges: dict[str, Merges] = {}
        self.apart_known: dict[tuple[str, str], bool] = {}
        self.seen: defaultdict[str, dict[str, bytes]] = defaultdict(dict)
        self.rarely: defaultdict[str, dict[str, bytes]] = defaultdict(dict)

    def _merges(self, token: str) -> Merges:
        found = self.merges.get(token)
        if found is None:
            found = self.merges[token] = Merges(token, self.score)
        return found

    def apart(self, a: str, b: str) -> bool:
        """Whether the texts of two tokens, one after the other, are encoded as these two tokens."""
        known = self.apart_known.get((a, b))
        if known is None:
            if len(self.apart_known) > PAIR_CACHE:
                self.apart_known.clear()
            known = self.apart_known[a, b] = self._apart(self._merges(a), self._merges(b))
        return known

    def _apart(self, a: Merges, b: Merges) -> bool:
        i = j = 0
        nothing = float("-inf")
        while True:
            across = self.score.get(a.lasts[i] + b.firsts[j])
            left = a.scores[i] if i < len(a.scores) else nothing
            right = b.scores[j] if j < len(b.scores) else nothing
            if across is not None and across > left and across >= right:  # equal scores: the leftmost goes first
                return False
            if left == right == nothing:
                return True
            if left >= right:
                i += 1
            else:
                j += 1

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text written with marks; a letter without a piece is a token too."""
        n = len(text)
        last: list[str | None] = [None] * (n + 1)  # token of each prefix
        known = self.apart_known.get
        for end, token in self.automaton.iter(text):  # of one end the longest comes first
            end += 1
            if last[end] is not None:
                continue
            start = end - len(token)
            if start:
                before = last[start]
                if before is None:  # no piece fits there
                    before = last[start] = text[start - 1]
                apart = known((before, token))
                if not (self.apart(before, token) if apart is None else apart):
                    continue
            last[end] = token
        found = []
        while n:
            token = last[n] or text[n - 1]
            found.append(token)
            n -= len(token)
        return found[::-1]

    def _ids(self, marked: str) -> bytes:
        out = []
        for t in self.tokens(marked):
            found = self.packed.get(t)
            out.append(b"".join([self.packed_bytes[b] for b in t.encode("utf-8", "surrogatepass")]) if found is None else found)
        return b"".join(out)

    def _words(self, words: list[str], mark: str) -> bytes:
        """Ids of words with the marks before each."""
        seen = self.seen[mark]
        found = list(map(seen.get, words))
        if None in found:
            old = self.rarely[mark]
            if len(seen) > WORD_CACHE:  # words of the last table come back as they are met
                old = self.rarely[mark] = seen
                seen = self.seen[mark] = {}
            for i, w in enumerate(words):
                if found[i] is None:
                    ids = seen.get(w) or old.get(w)
                    found[i] = seen[w] = self._ids(mark + w) if ids is None else ids
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text, without the end id."""
        if not text:
            return b""
        if not self.by_word:
            return self._ids(MARK + text.replace(" ", MARK))
        out = []
        for i, line in enumerate((" " + text.replace(MARK, " ")).split(BREAK)):  # both stand as a mark
            if i:
                out.append(self._words([BREAK], ""))
            if "  " in line or line.endswith(" "):
                parts = RUNS.split(line)
                out.extend(self._words([w], MARK * len(r)) for r, w in zip(["", *parts[1::2]], parts[::2]) if r or w)
            else:
                words = line.split(" ")
                if words[0]:
                    out.append(self._words(words[:1], ""))
                out.append(self._words(words[1:], MARK))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the first mark is dropped, bytes that are no letter are replaced one by one."""
        data = b"".join(map(self.written.__getitem__, ids))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = self._mended(ids).decode()
        first = next((i for i in ids if self.written[i]), None)
        return text[1:] if first in self.marked else text

    def _mended(self, ids: list[int]) -> bytes:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        run[:n].decode()
                    except UnicodeDecodeError:
                        continue
                    out.append(bytes(run[:n]))
                    break
                else:
                    n = 1
                    out.append(REPLACED)
                del run[:n]
            if i is not None:
                out.append(self.written[i])
        return b"".join(out)


@lru_cache(maxsize=2)
def _pieces(path: str) -> PieceBpe:
    return PieceBpe(path)


def _id_lists(found: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))


def _encoded(docs: DataFrame, model: str, back: bool) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _pieces(tokenizer_path(model))
        end = np.array([bpe.end], dtype="<i4").tobytes()
        for batch in batches:
            for first in range(0, len(batch), TOGETHER):
                some = batch.slice(first, TOGETHER)
                found = [bpe.encode(t) + end for t in some.column("text").to_pylist()]
                out = {"doc_id": some.column("doc_id"), "ids": _id_lists(found)}
                if back:
                    out["decoded"] = pa.array([bpe.decode(np.frombuffer(x, dtype="<i4").tolist()) for x in found], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return texts(docs).mapInArrow(rows, "doc_id bigint, ids array<int>" + (", decoded string" if back else ""))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text and the end id.

    Null and empty texts have the end id alone. Rows that repeat or have a null doc_id are encoded each on
    its own; an empty table gives no rows; other columns are ignored.
    """
    return _encoded(docs, model, False)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """The same with ``decoded``, the text that the ids stand for."""
    return _encoded(docs, model, True)


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of rows (doc_id, ids); null ids have an empty text."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _pieces(tokenizer_path(model))
        for batch in batches:
            found = [bpe.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "text"])

    return rows.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(ids AS array<int>) AS ids").mapInArrow(back, "doc_id bigint, text string")
