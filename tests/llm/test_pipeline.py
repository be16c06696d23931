"""Every stage on what the one before it kept, against plain Python; odd rows go through all of them."""

from collections import Counter

import corpus_pipeline as C
import pytest
from demospan.llm import quality_crf
from demospan.llm.queries import PACK_TOKENIZER
from demospan.llm.packing import Encoder, tokenizer_path

from .test_dedup import exact_brute
from .test_near_stage import jaccard_brute

D = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(C.STAGES):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, D)
        if i < 4:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        ids = Counter(r.doc_id for r in docs.collect())
        if name == "quality classifier":
            labels = spark.read.parquet(f"{D}/labels.parquet")
            scores = quality_crf.scores(quality_crf.train(spark.read.parquet(f"{D}/documents.parquet"), labels), [t for _, t in rows])
            assert ids == Counter(d for (d, _), s in zip(rows, scores) if s >= 0.3) and 0 < len(ids) < len(rows)
        elif name == "exact dedup":
            assert ids == Counter(x[0] for x in exact_brute(rows).elements() if x[3])
        elif name == "simhash near-dedup":
            assert set(ids) == {x[1] for x in jaccard_brute(rows)} and max(ids.values()) == 1
        elif name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
            from .test_texts import overlap_brute

            assert set(ids) == {d for d, t in rows if not overlap_brute(t, items)}
        else:
            encoder = Encoder(tokenizer_path(PACK_TOKENIZER))
            assert ids == Counter({d: -(-(len(encoder.ids(t)) // 4 + 1) // 2048) for d, t in rows})


@pytest.mark.parametrize("stage", C.STAGES, ids=lambda s: s[0])
def test_odd_rows_go_through(spark, docs_of, stage):
    rows = [(1, None), (2, ""), (2, ""), (None, "some words here"), (None, None), (3, "x " * 100_000), (4, "same"), (5, "same"), (4, "same"), (4, "other text")]
    docs = docs_of(rows)
    out = stage[1](spark, docs, D)
    assert out.count() <= max(len(rows), 110) and (stage is C.STAGES[-1] or out.columns == docs.columns)
    assert stage[1](spark, docs.limit(0), D).count() == 0
    if stage[0] == "exact dedup":
        assert Counter(r.doc_id for r in out.collect()) == Counter([1, 3, 4, 4, None])


def test_run(spark):
    assert C.run(spark, D).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
