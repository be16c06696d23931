"""The line field against brute force over all labellings, and held-out accuracy."""

import itertools
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from demospan.llm import quality_crf as Q


@pytest.mark.parametrize("n", [1, 2, 5])
def test_marginals_are_those_of_all_labellings(n):
    rng = np.random.default_rng(n)
    state, moves = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
    weight = {}
    for y in itertools.product((0, 1), repeat=n):
        weight[y] = np.exp(sum(state[i, k] for i, k in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
    z = sum(weight.values())
    want = np.array([[sum(w for y, w in weight.items() if y[i] == k) / z for k in (0, 1)] for i in range(n)])
    nodes, pairs, log_z = Q.marginals(state, moves)
    assert np.allclose(nodes, want) and np.isclose(log_z, np.log(z))
    joint = [[sum(w * sum((p, q) == (a, b) for p, q in zip(y, y[1:])) for y, w in weight.items()) / z for b in (0, 1)] for a in (0, 1)]
    assert np.allclose(pairs, joint)


def test_batches_give_the_marginals_of_single_documents():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 7, 7, 2, 12])
    state, moves = rng.normal(size=(sizes.sum(), 2)), rng.normal(size=(2, 2))
    at = np.r_[0, np.cumsum(sizes)]
    want = np.concatenate([Q.marginals(state[a:b], moves)[0][:, 1] for a, b in zip(at, at[1:])])
    assert np.allclose(Q.good_marginals(state, moves, sizes), want)
    rows = [rng.normal(size=(n, 4)) for n in sizes]
    weights = rng.normal(size=(4, 2))
    for part, _, here, nodes, pairs in Q._Chains(rows).marginals(weights, moves):
        expected = [Q.marginals(rows[i] @ weights, moves) for i in part]
        for j, (n, _, _) in enumerate(expected):
            assert np.allclose(nodes[j, here[j]], n)
        assert np.allclose(pairs, sum(p for _, p, _ in expected))


def test_features_of_a_line():
    rows, sizes = Q.own_features("AB cd\n\n12 12 | é!")
    assert rows.shape == (3, Q.FEATURES) and sizes.tolist() == [6, 1, 12]
    assert rows[0][0] == 0.5 and rows[1][9] == 1 and rows[2][3] == 0.25 and np.isclose(rows[2][6], 0.25)
    both = Q.with_neighbours(rows)
    assert np.array_equal(both[1, Q.FEATURES : 2 * Q.FEATURES], rows[0]) and not both[0, Q.FEATURES : 2 * Q.FEATURES].any()


def test_held_out_documents_are_judged_well_and_never_read(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(docs, labels, sample=300)
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert Q.train(docs, turned, sample=300) is not None
    assert np.array_equal(Q.train(docs, turned, sample=300).weights, model.weights)
    got = {r.doc_id: r for r in Q.quality(docs, model).collect()}
    true = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{d}/labels.parquet'").fetchall())
    out = [i for i in true if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    right = {q: np.mean([got[i].predicted == q for i in out if true[i] == q]) for q in (0, 1)}
    assert right[0] > 0.9 and right[1] > 0.97, right


def test_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (2, ""), (None, "some words"), (3, "\n" * 3000), (4, "x " * 200_000), (5, "line\n" * 2500)]
    docs = docs_of(rows)
    no_labels = spark.createDataFrame([(1, None), (None, 1), (9, 7)], "doc_id bigint, quality int")
    model = Q.train(docs, no_labels)
    got = Q.quality(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert Q.quality(docs_of([]), model).count() == 0 and Q.keep_good(docs_of([]), model).count() == 0
    both = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1), (5, 1)], "doc_id bigint, quality int")
    assert len(Q.quality(docs, Q.train(docs, both)).collect()) == len(rows)
