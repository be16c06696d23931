"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each place; the dynamic programme
carries only the best score up to a place and the number of ids on that path. Ties go to the piece that
starts first, as in the tokenizer; scores add in double precision from left to right.

No piece of the vocabulary has the word mark after another letter, so no path crosses from a letter to a
mark: a text is the sum of its words, and the count of a word is remembered. A mark that stands in the text
itself is treated as any other, as the tokenizer does.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .packing import tokenizer_path

MARK = "▁"
UNKNOWN_PENALTY = 10.0
NOTHING = float("-inf")
BREAK = "\n"
MARKS = re.compile(f"({MARK}+)")
WORD_CACHE = 500_000


class Counter:
    """Counts ids of texts under the unigram model of a piece file: pieces with scores, bytes as fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.vocabulary = [(model.id_to_piece(i), model.get_score(i)) for i in range(size)]
        self.unknown = model.unk_id()
        lowest = min(s for _, s in self.vocabulary)
        self.unknown_score = lowest - UNKNOWN_PENALTY
        self.byte_fallback = all(f"<0x{b:02X}>" in {p for p, _ in self.vocabulary} for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = frozenset(p for p, _ in self.vocabulary if len(p) == 1)
        self.by_word = not any(MARK in p.lstrip(MARK) for p, _ in self.vocabulary)
        # nor does a piece hold a line break, so lines are apart too
        self.by_line = not any(BREAK in p for p, _ in self.vocabulary) and self.byte_fallback
        self.break_ids = self.viterbi(BREAK)
        self.seen: defaultdict[str, dict[str, int]] = defaultdict(dict)

    def viterbi(self, text: str) -> int:
        """Ids of a text already written with word marks."""
        n = len(text)
        if self.single.issuperset(text):  # no place without a piece: nothing can be unknown
            best, ids = [0.0] + [NOTHING] * n, [0] * (n + 1)
            for end, (length, score) in self.automaton.iter(text):  # the longest of an end comes first
                start = end + 1 - length
                value = best[start] + score
                if value > best[end + 1]:
                    best[end + 1], ids[end + 1] = value, ids[start] + 1
            return ids[n]
        best = [0.0] + [None] * n
        ids = [0] * (n + 1)
        unknown = [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):
            ends[end].append(found)
        for end in range(n):
            top, count, is_unknown, single = None, 0, False, False
            for length, score in sorted(ends[end], reverse=True):
                single |= length == 1
                value = best[end + 1 - length] + score
                if top is None or value > top:
                    top, count, is_unknown = value, ids[end + 1 - length] + 1, False
            if not single:
                value = best[end] + self.unknown_score
                if top is None or value > top:
                    fused = unknown[end] and not self.byte_fallback
                    top, is_unknown = value, True
                    count = ids[end] + (len(text[end].encode("utf-8", "surrogatepass")) if self.byte_fallback else 0 if fused else 1)
            best[end + 1], ids[end + 1], unknown[end + 1] = top, count, is_unknown
        return ids[n]

    def _counts(self, words: list[str], mark: str) -> int:
        """Sum over words with the mark, or nothing, before each."""
        seen = self.seen[mark]
        try:
            return sum([seen[w] for w in words])
        except KeyError:
            if len(seen) > WORD_CACHE:
                seen.clear()
            for w in set(words).difference(seen):
                seen[w] = self.viterbi(mark + w)
            return sum([seen[w] for w in words])

    def count(self, text: str) -> int:
        marked = (MARK + text.replace(" ", MARK)) if text else ""
        if not self.by_word:
            return self.viterbi(marked)
        if not text:
            return 0
        text = text.replace(MARK, " ")  # both stand as a mark
        total, first = 0, True
        for line in text.split(BREAK) if self.by_line else [text]:
            if first:
                line = " " + line
            else:
                total += self.break_ids
            if "  " in line or line.endswith(" "):
                total += self._runs(line)
            else:
                words = line.split(" ")
                total += self._counts(words[:1], "") if words[0] else 0
                total += self._counts(words[1:], MARK)
            first = False
        return total

    def _runs(self, line: str) -> int:
        """The same for a line with several spaces together or at its end."""
        parts = MARKS.split(line.replace(" ", MARK))
        return sum(self._counts([word], run) for run, word in zip(["", *parts[1::2]], parts[0::2]) if run or word)


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, n_chars`` for every row.

    Text is taken as it is, with a word mark before it and for every space. Null and empty texts have no
    tokens. Rows that repeat or have a null doc_id are counted each on its own; other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path(vocabulary))
        for batch in batches:
            all_texts = batch.column("text").to_pylist()
            counts = pa.array([counter.count(t) for t in all_texts], pa.int64())
            chars = pa.array([len(t) for t in all_texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, chars], ["doc_id", "n_tokens", "n_chars"])

    return texts(docs).mapInArrow(rows, "doc_id bigint, n_tokens bigint, n_chars bigint")
