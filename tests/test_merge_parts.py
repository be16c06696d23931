"""A frame's boxes are merged part by part, as a walk over the whole frame would; statistics of a huge column."""

import random

import numpy as np
import pytest
from demospan.operators import ordered
from demospan.operators.aggregates import element_stats
from demospan.plans import detections as D
from pyspark.sql import functions as F

COLUMNS = "frame bigint, rank bigint, id bigint, x double, y double, w double, h double, scores array<double>"


def jittered(seed):
    rng = random.Random(seed)
    places = [(rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(0.5, 40), rng.uniform(0.5, 40)) for _ in range(25)]
    rows = []
    for i in range(600):
        x, y, w, h = rng.choice(places)
        j = lambda v: v * (1 + rng.choice([0, 0.004, 0.02, 0.06]) * rng.random())
        rows.append((rng.randrange(2), i, i, x + w * 0.03 * rng.random(), y + h * 0.03 * rng.random(), j(w), j(h), [round(rng.random(), 3), round(rng.random(), 3)]))
    rows += [(0, 900, 900, 1.0, 1.0, 0.0, 3.0, [0.5, 0.5]), (0, 901, 901, 1.0, 1.0, -1.0, 3.0, [0.5, 0.5])]
    return rows


def walk(rows):
    """The rule over the whole frame: the first overlapping track that is no worse takes the box, worse ones end in it."""
    out = {}
    for f in {r[0] for r in rows}:
        tracks = []
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: r[1]):
            box, total, taken = r[3:7], np.array(r[7]), False
            for t in list(tracks):
                if D._overlap(box, t[1]) <= 0.9:
                    continue
                if max(t[2]) >= max(r[7]):
                    t[2], taken = t[2] + total, True
                    break
                tracks, total = [u for u in tracks if u is not t], total + t[2]
            if not taken:
                tracks.append([r[2], box, total])
        out |= {(f, t[0]): t[2] for t in tracks}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_parts_give_the_frame_s_result(spark, seed):
    rows = jittered(seed)
    df = spark.createDataFrame(rows, COLUMNS)
    got = {(r.frame, r.id): r.scores for r in D.merge_detections(df).collect()}
    want = walk(rows)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    parts = D.merge_groups(df).select("frame", "part").distinct().count()
    assert 20 <= parts < 300


def test_statistics_rank_only_the_ranges_that_matter(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_BLOCK", 200)
    rng = np.random.default_rng(3)
    values = np.where(rng.random(5000) < 0.4, 7.0, rng.normal(size=5000))
    df = spark.createDataFrame([([float(v), float(i % 3)],) for i, v in enumerate(values)], "v array<double>")
    got = {r.dim: r for r in element_stats(df, "v", {"q01": 0.01, "q50": 0.5, "q99": 0.99, "all": 1.0}).collect()}
    for dim, column in ((0, values), (1, np.arange(5000) % 3.0)):
        for name, p in (("q01", 0.01), ("q50", 0.5), ("q99", 0.99), ("all", 1.0)):
            assert abs(got[dim][name] - np.quantile(column, p)) < 1e-9, (dim, name)
        assert got[dim]["count"] == 5000 and abs(got[dim]["mean"] - column.mean()) < 1e-9
    nulls = df.select(F.array(F.lit(None).cast("double")).alias("v"))
    assert [(r["count"], r["mean"]) for r in element_stats(nulls, "v").collect()] == [(0, None)]
