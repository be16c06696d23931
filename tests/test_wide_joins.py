"""Plans that must grow with their input: no made column passes the driver, no box is repeated without need."""

import random
from collections import Counter

import pytest
from demospan.operators import joins as J
from demospan.operators.aggregates import element_stats
from demospan.plans import annotate as AN
from demospan.plans import cot as CT
from demospan.plans import detections as D
from pyspark.sql import Window, functions as F

from bindings import QUERIES

PLAN = "Plan: 1. PICK(a)\nWhat I have done: Nothing yet\nNow I need to do: PICK(a)"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cot_rows(spark, n=20):
    text = F.concat(F.lit(PLAN), F.col("id").cast("string"))
    return spark.range(n).select(
        F.col("id").alias("episode"), F.lit(0).alias("start_step"), text.alias("content"), text.alias("updated_content"),
        text.alias("updated_content_w_instruction"), F.lit("PICK(a)").alias("skill"), F.lit("PICK(a)").alias("updated_skill"))


def test_made_texts_are_not_broadcast(spark):
    s = cot_rows(spark)
    assert "Broadcast" not in plan_of(CT.diff(s, s, ["episode"]))
    for df in CT.convert(s, CT.fields_to_convert(s, ["episode"]), ["episode"]):
        assert "Broadcast" not in plan_of(df)


def test_answers_are_not_broadcast(spark):
    e = spark.range(5).select(F.col("id").alias("episode_index"), F.lit(1).alias("task_index"), F.lit("i").alias("instruction"), F.lit(2).cast("bigint").alias("length"))
    answer = F.lit('{"plan": "1. OPEN(drawer)", "steps": [{"skill": "OPEN(drawer)", "end_step": 2}]}')
    frames = e.filter("episode_index > 0").select("episode_index", F.lit(1).cast("bigint").alias("step"), F.array(F.lit(0.5)).alias("state"), F.array(F.lit(0.0)).alias("action"))
    rows, wrong = AN.annotation_rows_with_frames(e, e.select("episode_index", answer.alias("response")), frames, "libero", "m", "v")
    assert "Broadcast" not in plan_of(rows) + plan_of(wrong)
    assert {r.episode_index for r in rows.collect()} == {1, 2, 3, 4} and [tuple(r) for r in wrong.collect()] == [(0, "no_frame")]


def test_chunks_meet_without_their_arrays(spark):
    plan = plan_of(QUERIES["flat_chunks"](spark, "/root/testdata/sf0.001"))
    assert "Broadcast" not in plan
    before = plan.split("SortMergeJoin", 1)[1]
    kept = [line for line in before.splitlines() if "Project" in line]
    assert kept and not any("vector" in line.split(" AS ")[-1] or "action_chunk" in line.split(" AS ")[-1] for line in kept[:1])


def test_texts_are_checked_by_more_than_the_tasks_that_read_them(spark):
    from bindings.q_jobs import cot_segments
    from bindings.tables import Tables

    assert cot_segments(Tables(spark, "/root/testdata/sf0.001")).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def boxes_of(rng, frames):
    rows = []
    for frame, n in frames:
        for i in range(n):
            side = 1.0 + rng.random() * 0.1
            rows.append((frame, i, i, rng.random() * 0.1, rng.random() * 0.1, side, side, [rng.random(), rng.random()]))
    return rows


SCHEMA = "frame bigint, rank bigint, id bigint, x double, y double, w double, h double, scores array<double>"


def test_boxes_of_small_frames_are_not_repeated(spark):
    df = spark.createDataFrame(boxes_of(random.Random(1), [(i, 6) for i in range(9)]), SCHEMA)
    assert "Generate" not in plan_of(D.overlapping_pairs(df)) and "Generate" not in plan_of(D.merge_detections(df))


@pytest.mark.parametrize("few", [0, 5, 64])
def test_pairs_and_merges_do_not_depend_on_where_frames_are_parted(spark, monkeypatch, few):
    rows = boxes_of(random.Random(2), [(1, 3), (2, 12), (3, 1), (4, 30), (None, 4)])
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(f, a[2], b[2]) for f in (1, 2, 3, 4) for a in rows for b in rows if a[0] == b[0] == f and a[2] < b[2] and D._overlap(a[3:7], b[3:7]) > 0.9}
    tracks = []
    for f in (1, 2, 3, 4):
        held = []
        for r in spark.createDataFrame([x for x in rows if x[0] == f], SCHEMA).orderBy("rank").collect():
            D._take(held, r, 0.9)
        tracks += [(f, t["id"], [round(s, 9) for s in t["scores"]]) for t in held]
    monkeypatch.setattr(D, "FEW", few)
    assert {(r.frame, r.a, r.b) for r in D.overlapping_pairs(df, 0.9).collect()} == want
    got = [(r.frame, r.id, [round(s, 9) for s in r.scores]) for r in D.merge_detections(df.filter("frame IS NOT NULL"), 0.9).collect()]
    assert sorted(got) == sorted(tracks)


def test_rows_of_one_value_are_one_row_before_they_are_ranked(spark, monkeypatch):
    from demospan.operators import ordered as O

    monkeypatch.setattr(O, "ROWS_PER_BLOCK", 50)
    written, cut = [], O.cut_lineage

    def told(df):
        out = cut(df)
        if "_times" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(O, "cut_lineage", told)
    df = spark.range(1000).select(F.array((F.col("id") % 3).cast("double"), F.col("id").cast("double"), F.lit(None).cast("double")).alias("v"))
    got = {r.dim: (r["count"], r.q01, r.q99) for r in element_stats(df, "v").collect()}
    assert got == {0: (1000, 0.0, 2.0), 1: (1000, pytest.approx(9.99), pytest.approx(989.01)), 2: (0, None, None)}
    assert written == [1003]


def test_roots_with_copies_nulls_and_strangers(spark):
    want = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (3, None), (None, "a"), (5, "z")], "episode bigint, name string")
    have = spark.createDataFrame(
        [(7, 1, "a"), (7, 1, "b"), (7, 1, "b"), (8, 1, "a"), (8, 1, "c"), (7, 2, "a"), (9, 2, "a"), (7, 3, None), (7, None, "a"), (7, 4, "a"), (None, 5, "z")],
        "root bigint, episode bigint, name string")
    out = J.single_complete_root(want, have)
    assert {tuple(r) for r in out.collect()} == {(1, 1, 7, "ok"), (2, 2, None, "ambiguous"), (3, 0, None, "none"), (None, 0, None, "none"), (5, 1, None, "ok")}
    # rows are dealt before copies are folded, so no task holds the groups of all that it read
    assert plan_of(out).rstrip().split("Exchange")[-1].count("HashAggregate") == 0


def test_frames_are_not_sorted_to_meet_their_segments(spark):
    from demospan.operators import frames as FR

    s = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (2, 0, 0), (2, 0, 2)], "episode bigint, start_step bigint, end_step bigint")
    f = spark.createDataFrame([(e, i) for e in (1, 2) for i in range(7)], "episode bigint, step bigint")
    met = FR.frames_in_segments_to_end(f, s)
    assert "ShuffledHashJoin" in plan_of(met)
    want = [(1, i, 0 if i < 3 else 3, 3 if i < 3 else 5) for i in range(6)] + [(2, i, 0, 2) for i in range(3)]
    assert sorted((r.episode, r.step, r.start_step, r.end_step) for r in met.collect()) == want


def test_plans_are_parsed_once(spark, monkeypatch):
    from demospan.plans import feasibility as FE

    counted = spark.sparkContext.accumulator(0)

    def tick(x):
        counted.add(1)
        return x

    told = F.udf(tick, "string").asNondeterministic()
    plans = spark.createDataFrame([(1, "1. OPEN(drawer)"), (2, "no plan"), (3, None), (4, "1. CLOSE(drawer)")], "episode bigint, plan string")
    facts = spark.createDataFrame([(e, n, a, "") for e in (1, 4) for n, a in (("free", ""), ("closed", "drawer"), ("openable", "drawer"))], "episode bigint, name string, first string, second string")
    out = FE.audit_plan_texts(plans.withColumn("plan", told("plan")), facts, "libero")
    got = {r.episode: (r.steps, r.feasible, r.failed_step) for r in out.collect()}
    assert got[1] == (1, True, None) and got[4] == (1, False, 1) and not got[2][1] and not got[3][1]
    assert counted.value == 4


def test_boxes_without_a_place_or_size_meet_none(spark, monkeypatch):
    rows = [(1, i, i, 0.0, 0.0, 1.0, 1.0, [0.5, 0.1 * i]) for i in range(3)]
    rows += [(1, 3 + i, 3 + i, *(None if c == i else 1.0 for c in range(4)), [0.5, 0.5]) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = []
    for few in (0, 64):
        monkeypatch.setattr(D, "FEW", few)
        assert D.overlapping_pairs(df).count() == 0  # the three copies are one box
        got.append(sorted((r.id, str(r.scores)) for r in D.merge_detections(df).collect()))
    assert got[0] == got[1] and len(got[0]) == 5


def test_episodes_of_few_segments_meet_without_a_shuffle_of_their_frames(spark):
    from demospan.operators import frames as FR

    given = spark.range(0, 4000, 1, 4).selectExpr("id % 1000 AS episode", "id DIV 1000 AS k", "id % 1000 % 7 AS length")
    w = Window.partitionBy("episode").orderBy("k")
    s = given.withColumn("end_step", F.sum("length").over(w)).select("episode", (F.col("end_step") - F.col("length")).alias("start_step"), "end_step")
    f = s.groupBy("episode").agg(F.max("end_step").alias("e")).select("episode", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("e") + 1)).alias("step"))
    met = FR.frames_in_segments_to_end(f, s).groupBy("episode").count()
    assert "ShuffledHashJoin" in plan_of(met) and plan_of(met).count("Exchange hashpartitioning(") == 2
    # all segments of an episode are equally long, so only the last one holds the end
    assert {tuple(r) for r in met.collect()} == {(e, 4 * (e % 7) + 1) for e in range(1000) if e % 7}


def test_frames_meet_episodes_of_few_and_of_many_segments(spark):
    from demospan.operators import frames as FR

    rng = random.Random(7)
    rows = []
    for e, n in [(1, 3), (2, FR.FEW_SEGMENTS), (3, FR.FEW_SEGMENTS + 1), (4, 200), (None, 5), (None, 60)]:
        at = 0
        for _ in range(n):
            rows.append((e, at, at := at + rng.randrange(0, 90), f"v{rng.randrange(3)}"))
    rows += [(5, 4, 2, "back"), (6, None, 5, "no start"), (7, 2, None, "no end"), (8, 0, 9, "whole"), (8, 3, 9, "twice")]
    steps = [(e, i) for e in (1, 2, 3, 4, 5, 6, 7, 8, 9, None) for i in [*range(0, 12_000, 5), 9, 9, None]]
    steps += [(e, max(r[2] for r in rows if r[0] == e) + d) for e in (1, 2, 3, 4) for d in (-1, 0, 1)]
    s = spark.createDataFrame(rows, "episode bigint, start_step bigint, end_step bigint, verb string")
    f = spark.createDataFrame(steps, "episode bigint, step bigint")
    last = {e: max((r[2] for r in rows if r[0] == e and r[2] is not None), default=None) for e in range(1, 9)}
    want = Counter(
        (e, i, a, b, v) for e, i in steps if i is not None for x, a, b, v in rows
        if e is not None and x == e and a is not None and b is not None and a < b and (a <= i < b or i == b == last[e])
    )
    for some in (s, s.where("episode IN (1, 2, 8)")):
        held = {r.episode for r in some.collect()}
        met = FR.frames_in_segments_to_end(f, some)
        assert met.columns == ["episode", "step", "start_step", "end_step", "verb"]
        assert Counter(tuple(r) for r in met.collect()) == Counter({k: n for k, n in want.items() if k[0] in held})
