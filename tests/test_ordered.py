"""Cut groups must give what a plain pass over the group gives."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from demospan.operators.ordered import islands, ordered, ordered_by_blocks, percentiles, streak


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(7)
    rows = []
    for key, n in [("hot", 300), ("a", 7), ("b", 1), ("c", 40)]:
        steps = sorted(rng.sample(range(2000), n))
        rows += [(key, s, rng.randint(-5, 9), rng.choice(["x", "y", None])) for s in steps]
    rng.shuffle(rows)
    return pd.DataFrame(rows, columns=["k", "step", "v", "w"])


def expected(pdf):
    pdf = pdf.sort_values(["k", "step"]).copy()
    g = pdf.groupby("k")
    pdf["i"] = g.cumcount()
    pdf["pv"] = g["v"].shift(1)
    pdf["nv"] = g["v"].shift(-1)
    pdf["s"] = g["v"].cumsum()
    pdf["m"] = g["v"].cummax()
    pdf["l"] = g["w"].ffill()
    return pdf


@pytest.mark.parametrize("limit", [5, 25, 1000])
def test_scan_matches_plain_pass(spark, skewed, limit):
    df = spark.createDataFrame(skewed.astype(object).where(skewed.notna(), None), "k string, step long, v long, w string")
    o = ordered(df, ["k"], ["step"], split="step", rows_per_block=limit)
    got = o.scan(
        index="i",
        previous={"pv": F.col("v")},
        following={"nv": F.col("v")},
        sums={"s": F.col("v")},
        last={"l": F.col("w")},
        maxima={"m": F.col("v")},
    ).rows()
    got = got.toPandas().sort_values(["k", "step"])
    want = expected(skewed)
    for c in ["i", "pv", "nv", "s", "m"]:
        np.testing.assert_array_equal(got[c].astype(float).values, want[c].astype(float).values, err_msg=c)
    assert [x or None for x in got["l"].fillna("")] == [x or None for x in want["l"].fillna("")]


def test_hot_group_is_really_cut(spark, skewed):
    df = spark.createDataFrame(skewed[["k", "step", "v"]], "k string, step long, v long")
    o = ordered(df, ["k"], ["step"], split="step", rows_per_block=25)
    sizes = {(r.k, r._block): r["count"] for r in o.df.groupBy("k", "_block").count().collect()}
    assert max(n for (k, b), n in sizes.items() if k == "hot") <= 25
    assert all(b == -1 for (k, b) in sizes if k in "ab")


@pytest.mark.parametrize("limit", [5, 1000])
def test_streak_and_islands(spark, skewed, limit):
    df = spark.createDataFrame(skewed[["k", "step", "v"]], "k string, step long, v long")
    df = df.withColumn("sign", F.signum("v").cast("int"))
    o = ordered(df, ["k"], ["step"], split="step", rows_per_block=limit)
    got = islands(streak(o, F.col("v") >= 2, "run"), "sign").rows().toPandas().sort_values(["k", "step"])
    for _, g in got.groupby("k"):
        run, island, was = 0, 0, None
        for r in g.itertuples():
            run = run + 1 if r.v >= 2 else 0
            island += r.sign != was
            was = r.sign
            assert (r.run, r.island) == (run, island)


def test_global_running_sum_in_blocks(spark):
    df = spark.range(1000).withColumn("n", F.col("id") % 7)
    o = ordered_by_blocks(df, [], ["id"], F.floor(F.col("id") / 100))
    got = o.scan(sums={"s": F.col("n")}).rows("_all").orderBy("id").toPandas()
    assert list(got["s"]) == list(np.cumsum(got["n"]))


@pytest.mark.parametrize("limit", [5, 1000])
def test_percentiles_are_exact(spark, skewed, limit):
    df = spark.createDataFrame(skewed[["k", "v", "step"]], "k string, v long, step double")
    for value in ["v", "step"]:
        got = percentiles(df, ["k"], value, {"p5": 0.05, "p50": 0.5, "p95": 0.95}, rows_per_block=limit)
        for r in got.collect():
            vals = skewed.loc[skewed.k == r.k, value]
            assert np.allclose([r.p5, r.p50, r.p95], np.percentile(vals, [5, 50, 95]))


def odd_keys(kind):
    """One group of rows (place, value) whose sort keys are hard to cut evenly."""
    if kind == "nulls":
        return [(None if i % 3 == 0 else i, i) for i in range(60)]
    if kind == "outlier":
        return [(i, i) for i in range(99)] + [(10**15, 99)]
    if kind == "ties":
        return [(i // 20, i) for i in range(100)]
    if kind == "nan":
        return [(float("nan") if i % 5 == 0 else float(i), i) for i in range(60)]
    return [(7, i) for i in range(60)]


@pytest.mark.parametrize("limit", [3, 25, 1000])
@pytest.mark.parametrize("kind", ["nulls", "outlier", "ties", "nan", "one place"])
def test_any_sort_keys_give_the_plain_windows_result(spark, kind, limit):
    rows = odd_keys(kind)
    random.Random(1).shuffle(rows)
    place = "double" if kind == "nan" else "bigint"
    df = spark.createDataFrame([("g", *r) for r in rows] + [(None, *r) for r in rows], f"k string, at {place}, v bigint")
    o = ordered(df, ["k"], ["at", "v"], split="at", rows_per_block=limit)
    got = o.scan(index="i", sums={"s": F.col("v")}, previous={"p": F.col("v")}).rows()
    w = Window.partitionBy("k").orderBy("at", "v")
    want = df.select("*", (F.row_number().over(w) - 1).alias("i"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.lag("v").over(w).alias("p"))
    pick = lambda d: sorted(((r.k, r.v, r.i, r.s, r.p) for r in d.collect()), key=lambda x: (str(x[0]), x[2]))
    assert pick(got) == pick(want)
    blocks = o.df.where("k IS NOT NULL").groupBy("k", "_block").count().collect()
    if limit == 1000:
        assert {b._block for b in blocks} == {-1}
    else:
        assert max(b["count"] for b in blocks) <= limit


def test_large_groups_are_cut_evenly_by_a_sample(spark):
    df = spark.range(20_000).select(F.lit("g").alias("k"), F.pow(F.col("id"), 3).alias("at"), "id")
    sizes = [r["count"] for r in ordered(df, ["k"], ["at", "id"], split="at", rows_per_block=2000).df.groupBy("_block").count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 2000
