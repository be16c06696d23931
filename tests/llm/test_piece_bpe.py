"""Ids and texts of the merge-type piece file against the library itself."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from demospan.llm import piece_bpe, queries
from demospan.llm.packing import tokenizer_path

D = "/root/testdata/sf0.001"
ODD = [
    "", " ", "   ", "a  b", " a", "a ", "\x00a", "x▁y", "▁▁", "ﬁ Ⅳ é", "é", "�", "<s> </s> <0x41>", "a\nb", "\n\n \n", "​ a", "\U0001f600",
    "\t\t", "\r\n x", "a" * 5000, "ab" * 3000, " " * 3000, "日本語テキスト",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(queries.PIECES))


@pytest.fixture(scope="module")
def own():
    return piece_bpe.PieceBpe(tokenizer_path(queries.PIECES))


def texts(own):
    rng = random.Random(3)
    yield from ODD
    letters = "abcdeinorst  \n▁.é日<>0\U0001f600\t"
    for _ in range(5000):
        yield "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
    pieces = list(own.id)
    for _ in range(5000):
        yield "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 8))).replace("▁", rng.choice([" ", "", "▁"]))


def test_ids_and_texts_are_the_library_s(own, library):
    for t in texts(own):
        ids = np.frombuffer(own.encode(t), dtype="<i4").tolist() + [own.end]
        assert ids == library.encode(t, add_eos=True), t
        assert own.decode(ids) == library.decode(ids), t


def test_any_ids_are_decoded_as_by_the_library(own, library):
    rng = random.Random(5)
    for _ in range(5000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(262) for _ in range(rng.randrange(9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_small_caches_and_whole_texts(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "WORD_CACHE", 3)
    monkeypatch.setattr(piece_bpe, "PAIR_CACHE", 3)
    small = piece_bpe.PieceBpe(tokenizer_path(queries.PIECES))
    for t in texts(small):
        want = library.encode(t)
        assert np.frombuffer(small.encode(t), dtype="<i4").tolist() == want
        if "▁" not in t:  # without cutting at words
            small.by_word = False
            assert np.frombuffer(small.encode(t), dtype="<i4").tolist() == want
            small.by_word = True


def digests(library, rows):
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    out = Counter()
    for d, t in rows:
        ids = library.encode(t or "", add_eos=True)
        out[d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))] += 1
    return out


def test_query(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in queries.op11_piece_round_trip(spark, D).collect()) == digests(library, rows)


def test_odd_rows(docs_of, library):
    rows = [*enumerate(ODD), (None, "x y"), (None, None), (3, None), (7, "same"), (7, "same"), (8, "long " * 100_000)]
    docs = docs_of(rows)
    want = Counter((d, tuple(library.encode(t or "", add_eos=True))) for d, t in rows)
    ids = piece_bpe.encoded(docs, queries.PIECES)
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids.collect()) == want
    texts_back = Counter((d, library.decode(library.encode(t or ""))) for d, t in rows)
    assert Counter(tuple(r) for r in piece_bpe.decoded(ids, queries.PIECES).collect()) == texts_back
    both = piece_bpe.round_trip(docs, queries.PIECES)
    assert both.columns == ["doc_id", "ids", "decoded"]
    assert Counter((r.doc_id, r.decoded) for r in both.collect()) == texts_back
    assert piece_bpe.round_trip(docs_of([]), queries.PIECES).count() == 0
    none = ids.sparkSession.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert [tuple(r) for r in piece_bpe.decoded(none, queries.PIECES).collect()] == [(1, "")]
