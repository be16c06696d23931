"""Frames, geometry, detections and feasibility against plain passes over small data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from demospan.functions import geometry as G
from demospan.functions import vocab as V
from demospan.operators import frames as FR
from demospan.operators import ordered as ORD
from demospan.operators import segments as S
from demospan.operators.sampling import sample_points_or_centre
from demospan.plans import detections as D
from demospan.plans import feasibility as FE
from demospan.plans.traces import project_points


def trace(spark, points, limit=None):
    rows = [(k, i, float(x), float(y)) for k, pts in points.items() for i, (x, y) in enumerate(pts)]
    df = spark.createDataFrame(rows, "name string, step long, x double, y double")
    return ORD.ordered(df, ["name"], ["step"], "step", rows_per_block=limit)


@pytest.mark.parametrize("limit", [4, None])
def test_resampling_matches_linear_interpolation(spark, limit):
    rng = np.random.default_rng(3)
    points = {
        "walk": np.cumsum(rng.normal(size=(40, 2)), axis=0),
        "one": [(2, 3)],
        "still": [(1, 1)] * 9,
        "pause": [(0, 0), (0, 0), (1, 0), (1, 0), (3, 0), (3, 4)],
    }
    o = trace(spark, points, limit)
    for by_time, got in ((False, FR.resample_by_length(o, 7)), (True, FR.resample_by_time(o, 7))):
        by = {}
        for r in got.toPandas().itertuples(index=False):
            by.setdefault(r[0], {})[r[1]] = (r[2], r[3])
        for name, pts in points.items():
            pts = np.asarray(pts, dtype=float)
            at = np.arange(len(pts), dtype=float) if by_time else np.r_[0, np.cumsum(np.hypot(*np.diff(pts, axis=0).T))]
            place = np.linspace(0, at[-1], 7)
            want = np.c_[np.interp(place, at, pts[:, 0]), np.interp(place, at, pts[:, 1])]
            if at[-1] == 0:
                assert set(by[name]) == set(range(7)) and np.allclose(list(by[name].values()), pts[0])
            else:
                assert np.allclose([by[name][k] for k in range(7)], want), name


def test_frames_meet_only_their_segment_in_a_long_episode(spark):
    frames = spark.range(5000).select(F.lit(1).cast("long").alias("episode"), F.col("id").alias("step"))
    cuts = sorted(random.Random(1).sample(range(1, 5000), 300))
    segs = [(1, a, b, i) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, 4990])) if b > a]
    segments = spark.createDataFrame(segs, "episode long, start_step long, end_step long, seg_index long")
    got = FR.frames_in_segments(frames, segments)
    assert got.count() == 4990
    assert got.filter("step < start_step or step >= end_step").count() == 0


def test_even_sampling_keeps_ends_and_size(spark):
    df = spark.createDataFrame([(3, 3 + n, n) for n in range(1, 60)], "a long, b long, n int")
    for count in (1, 2, 7, 50):
        rows = df.select("a", "b", "n", S.even_sample(F.col("a"), F.col("b"), count).alias("f")).collect()
        for r in rows:
            if r.n <= count:
                want = list(range(r.a, r.b))
            elif count == 1:
                want = [r.a]
            else:
                want = sorted({r.a + round(i * (r.n - 1) / (count - 1)) for i in range(count)})
            assert r.f == want
    with pytest.raises(ValueError):
        S.even_sample(F.col("a"), F.col("b"), 0)


def test_row_rules(spark):
    seg = "array<struct<start_step:bigint,end_step:bigint>>"
    cases = [([(0, 5), (5, 9)], 9, None), ([], 3, "no_segments"), ([(1, 5)], 5, "first_start_not_zero"), ([(0, 5), (6, 9)], 9, "not_contiguous"),
             ([(0, 5), (5, 5)], 5, "non_positive_length"), ([(0, 5)], 6, "last_end_not_num_steps"), ([(0, None)], 6, "missing_steps")]
    df = spark.createDataFrame([(i, s, n) for i, (s, n, _) in enumerate(cases)], f"i int, s {seg}, n long")
    got = df.select("i", S.row_contiguity_reason(F.col("s"), F.col("n")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [c[2] for c in cases]
    runs = spark.createDataFrame([(["a", "a", "b", "a"],), ([],)], "s array<string>").select(S.row_runs(F.col("s")).alias("r")).collect()
    assert [r.r for r in runs] == [["a", "b", "a"], []]


def test_projection_round_trip_and_inverse(spark):
    m = [[300.0, 4.0, 128.0, 10.0], [-3.0, 310.0, 120.0, -5.0], [0.02, -0.01, 1.0, 2.0], [0.0, 0.0, 0.0, 1.0]]
    cams = spark.createDataFrame([(i, m, c) for i, c in enumerate([V.NO_TRANSFORM, V.HORIZONTAL_FLIP, V.ROTATED_180, "odd"])], "camera int, matrix array<array<double>>, convention string")
    rng = np.random.default_rng(5)
    pts = [(i % 4, i, *map(float, rng.uniform(-0.4, 0.4, 3))) for i in range(80)]
    p = project_points(spark.createDataFrame(pts, "camera int, step int, wx double, wy double, wz double"), cams).toPandas()
    known = p[p.camera < 3]
    assert (known.exact_error < 1e-6).all() and p[p.camera == 3].raw_x.isna().all()
    r = known.iloc[0]
    h = np.array(m) @ [r.wx, r.wy, r.wz, 1]
    u = h[0] / h[2]
    assert np.isclose(r.raw_x, u if r.camera == 0 else 255 - u) and np.isclose(r.depth, h[2])
    inv = cams.limit(1).select(G.inverse_matrix("matrix").alias("i")).first().i
    assert np.allclose(np.array(inv) @ np.array(m), np.eye(4))


def test_relative_pose_of_a_known_turn(spark):
    half = np.sin(np.pi / 4)
    quarter = [0.0, 0.0, float(half), float(half)]
    df = spark.createDataFrame([([1.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0], [1.0, 2.0, 0.0], [0.0, 0.0, 0.0, 1.0]), ([0.0] * 3, quarter, [0.0] * 3, [0.0, 0.0, 1.0, 0.0])],
                               "p array<double>, q array<double>, t array<double>, r array<double>")
    a, b = [r.v for r in df.select(G.relative_pose("p", "q", "t", "r").alias("v")).collect()]
    assert np.allclose(a, [0, 0, 0, 0, 2, 0])
    assert np.allclose(b, [0, 0, np.pi / 2, 0, 0, 0])


def test_bins_match_digitize(spark):
    xs = [-1.5, -1.0, -0.9999, -1e-20, 0.0, 0.3, 0.9999, 1.0, 7.0, *np.linspace(-1, 1, 257)]
    got = [r.b for r in spark.createDataFrame([(float(x),) for x in xs], "x double").select(G.uniform_bin(F.col("x")).alias("b")).collect()]
    assert got == list(np.digitize(xs, np.linspace(-1, 1, 257)[:-1]) - 1)


def boxes(spark, n=120, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = rng.choice([(0.1, 0.3, 1.0, 0.5), (2.0, 0.5, 0.01, 0.02), (5.0, 0.1, 3.0, 3.0)])
        jitter = [v * (1 + rng.uniform(-0.04, 0.04)) for v in base]
        rows.append((i % 3, i, i, *jitter, [rng.random(), rng.random()]))
    rows.append((0, n, n, *rows[0][3:]))
    return rows, spark.createDataFrame(rows, "frame int, rank int, id int, x double, y double, w double, h double, scores array<double>")


def iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / (a[2] * a[3] + b[2] * b[3] - both)


def test_overlapping_pairs_are_complete(spark):
    rows, df = boxes(spark)
    distinct = {}
    for r in rows:
        distinct.setdefault((r[0], r[3:7]), []).append(r[2])
    items = [(f, min(ids), box) for (f, box), ids in distinct.items()]
    want = {(f, *sorted((i, j))) for f, i, a in items for g, j, b in items if f == g and i < j and iou(a, b) > 0.9}
    got = {(r.frame, r.a, r.b) for r in D.overlapping_pairs(df).collect()}
    assert got == want and len(want) > 50


def test_greedy_merge_keeps_scores(spark):
    rows, df = boxes(spark)
    want = {}
    for f in range(3):
        tracks = []
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: r[1]):
            box, s, gone = r[3:7], np.array(r[7]), False
            for t in list(tracks):
                if iou(box, t[1]) > 0.9:
                    if s_top(r) > max(t[2]):
                        tracks = [u for u in tracks if u is not t]
                        s = s + t[2]
                    else:
                        t[2] = t[2] + s
                        gone = True
                        break
            if not gone:
                tracks.append([r[2], box, s])
        want[f] = {t[0]: t[2] for t in tracks}
    got = {}
    for r in D.merge_detections(df).collect():
        got.setdefault(r.frame, {})[r.id] = r.scores
    assert {f: set(w) for f, w in want.items()} == {f: set(g) for f, g in got.items()}
    assert all(np.allclose(got[f][i], want[f][i]) for f in want for i in want[f])


def s_top(r):
    return max(r[7])


def test_mask_points_or_centre(spark):
    pts = spark.createDataFrame([(1, i, i) for i in range(50)], "m int, x int, y int")
    box = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0), (2, 0.0, 2.0, 4.0, 4.0)], "m int, x1 double, y1 double, x2 double, y2 double")
    got = sample_points_or_centre(box, pts, ["m"], 4).collect()
    assert sum(r.m == 1 for r in got) == 4 and [(r.x, r.y) for r in got if r.m == 2] == [(2.0, 3.0)]


def simulate(plan, facts):
    """Plain fold of one plan over a set of facts, for the desk rules."""
    state = set(facts)
    for n, (verb, args) in enumerate(plan, 1):
        x, z = args[0], args[-1]
        free, carry = ("free", "", "") in state, lambda o: ("carry", o, "") in state
        has = lambda name, a, b="": (name, a, b) in state
        ok = {
            "PICKUP_FROM": free and (has("on", x, z) or (has("in", x, z) and not has("closed", z))),
            "PLACE_ON": carry(x) and not carry(z) and not any(f[0] == "in" and f[1] == z for f in state),
            "PLACE_IN": carry(x) and not carry(z) and has("open", z),
            "OPEN": free and has("closed", x) and has("openable", x),
            "CLOSE": free and has("open", x) and has("openable", x),
        }[verb]
        if not ok:
            return n
        drop, add = {
            "PICKUP_FROM": ([("free", "", ""), ("on", x, z), ("in", x, z)], [("carry", x, "")]),
            "PLACE_ON": ([("carry", x, "")], [("free", "", ""), ("on", x, z)]),
            "PLACE_IN": ([("carry", x, "")], [("free", "", ""), ("in", x, z)]),
            "OPEN": ([("closed", x, "")], [("open", x, "")]),
            "CLOSE": ([("open", x, "")], [("closed", x, "")]),
        }[verb]
        state = (state - set(drop)) | set(add)
    return None


@pytest.mark.parametrize("cut", [False, True])
def test_plans_fold_like_a_simulator(spark, cut, monkeypatch):
    if cut:
        monkeypatch.setattr(FE, "ROWS_PER_BLOCK", 2 * FE.FACTS_PER_STEP)
    rng = random.Random(11)
    start = [("free", "", ""), ("on", "cup", "table"), ("on", "pen", "table"), ("closed", "box", ""), ("openable", "box", ""), ("in", "key", "box")]
    steps, want = [], {}
    for e in range(60):
        plan, holding = [], None
        for _ in range(rng.randint(1, 9)):
            if holding and rng.random() < 0.85:
                verb, args = rng.choice([("PLACE_ON", [holding, rng.choice(["table", "pen", "cup", "box"])]), ("PLACE_IN", [holding, "box"])])
                holding = None
            else:
                verb, args = rng.choice([("PICKUP_FROM", [rng.choice(["cup", "pen", "key"]), rng.choice(["table", "box"])]), ("OPEN", ["box"]), ("CLOSE", ["box"])])
                holding = args[0] if verb == "PICKUP_FROM" else holding
            plan.append((verb, args))
        want[e] = simulate(plan, start)
        steps += [(e, i, v, a) for i, (v, a) in enumerate(plan, 1)]
    df = spark.createDataFrame(steps, "episode long, step long, verb string, arguments array<string>")
    facts = spark.createDataFrame([(e, *f) for e in range(60) for f in start], "episode long, name string, first string, second string")
    got = {r.episode: r.failed_step for r in FE.audit_plans(df, facts, "libero").collect()}
    assert got == want
    assert len({v for v in want.values()}) > 4


def test_rich_rules(spark):
    plans = {1: "1. PICKUP_FROM(block, table) 2. PLACE_IN(drawer)", 2: "1. MOVE_SLIDER(left) 2. MOVE_SLIDER(left)", 3: "1. PUSH_INTO(block, drawer) 2. PICKUP_FROM(block, drawer)",
             4: "1. TURN_ON(led) 2. TURN_ON(led)", 5: "1. PLACE_ON(table)", 6: "1. TURN_OBJECT(block, left) 2. PICKUP_FROM(block, table)"}
    start = [("free", "", ""), ("on", "block", "table"), ("open", "drawer", ""), ("slidable", "door", ""), ("at_right", "door", ""), ("switchable", "led light", ""), ("turned_off", "led light", "")]
    steps = FE.plan_steps(spark.createDataFrame(list(plans.items()), "episode long, plan string"), "calvin")
    facts = spark.createDataFrame([(e, *f) for e in plans for f in start], "episode long, name string, first string, second string")
    got = {r.episode: r.failed_step for r in FE.audit_plans(steps, facts, "calvin").collect()}
    assert got == {1: None, 2: 2, 3: None, 4: 2, 5: 1, 6: None}
    able = FE.available_actions(facts.filter("episode = 1"), "calvin", spark.createDataFrame([(1, "PICKUP_FROM", ["block", "table"]), (1, "OPEN", ["drawer"])], "episode long, verb string, arguments array<string>"))
    assert [r.verb for r in able.collect()] == ["PICKUP_FROM"]


def test_action_chunks_look_over_run_borders(spark, monkeypatch):
    monkeypatch.setattr(FR, "CHUNK_RUN", 4)
    rows = [(1, 0, s, 11, [float(s), s * 10.0]) for s in range(11)]
    df = spark.createDataFrame(rows, "episode int, seg int, step int, end_step int, action array<double>")
    got = {r.step: (r.action_chunk, r.is_pad) for r in FR.action_chunks(df, ["episode", "seg"], 3, 2).collect()}
    assert len(got) == 11
    for s in range(11):
        have = [[float(k), k * 10.0] for k in range(s, min(s + 3, 11))]
        pad = 3 - len(have)
        assert got[s] == (have + [[0.0, 100.0]] * pad, [False] * len(have) + [True] * pad)


def test_draws_repeat(spark):
    from demospan.operators import sampling as T

    df = spark.createDataFrame([(e, p) for e in range(6) for p in range(5)], "episode int, position int")
    a, b = (T.random_transition(df).collect() for _ in range(2))
    assert a == b and len(a) == 1
    ones = T.one_per_group(df, "episode", ["position"]).collect()
    assert sorted(r.episode for r in ones) == list(range(6))
    names = spark.createDataFrame([("open the drawer",), ("open the door",), ("lift",)], "name string")
    assert [r.name for r in T.closest_names(names, "open the dor").collect()][0] == "open the door"
