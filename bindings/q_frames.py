"""Queries over frames, cameras and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from demospan.functions import geometry as G
from demospan.operators import frames as FR
from demospan.operators.aggregates import bounds_aggregates, element_stats, token_mean
from demospan.operators.joins import by_shuffle, first_in_priority
from demospan.operators.ordered import Ordered
from demospan.operators.sampling import flat_vectors
from demospan.plans.traces import FLIP, MATRIX, gate, prepare_cameras, project_points, replay_check, trace_stats
from demospan.plans.training import normalisation_stats, training_frames

from .registry import query
from .tables import CAMERAS, FRAMES, SEGMENTS, SKILL_SEGMENTS, Tables, near

# Segments of order k are laid over the frames of user k.
COVER = f"""{FRAMES}, {SEGMENTS}, covered AS (
  SELECT f.episode, f.step, f.value, s.seg_index, s.verb, s.start_step, s.end_step FROM frames f
  JOIN segments s ON f.episode = s.episode AND f.step >= s.start_step AND f.step < s.end_step)"""


def covered(t: Tables):
    s = t.segments.df.select("episode", "seg_index", "verb", "start_step", "end_step")
    return FR.frames_in_segments(t.frames.df.select("episode", "step", "value"), s)


@query(f"WITH {COVER} SELECT episode, step, seg_index, verb FROM covered")
def frame_segment_join(t: Tables):
    return covered(t).select("episode", "step", "seg_index", "verb")


@query(f"""WITH {COVER} SELECT episode, step, floor(((step - start_step) / CAST(end_step - start_step AS DOUBLE)) * 1e6 + 0.5001) / 1e6 AS progress,
  floor(((step - start_step) / CAST(greatest(1, end_step - start_step - 1) AS DOUBLE)) * 1e6 + 0.5001) / 1e6 AS to_last FROM covered""")
def progress(t: Tables):
    a = [F.col("step"), F.col("start_step"), F.col("end_step")]
    return covered(t).select("episode", "step", near(FR.progress(*a), 6).alias("progress"), near(FR.progress_to_last(*a), 6).alias("to_last"))


@query(f"""WITH {COVER}, h AS (SELECT c.episode, c.step, c.seg_index, c.end_step, k, d.value AS v,
      last_value(d.value IGNORE NULLS) OVER (PARTITION BY c.episode, c.step ORDER BY k) AS keep
    FROM covered c CROSS JOIN range(0, 4) r(k) LEFT JOIN covered d ON d.episode = c.episode AND d.seg_index = c.seg_index AND d.step = c.step + k)
  SELECT episode, step, k, CASE WHEN v IS NULL THEN 0.0 ELSE floor((v / 10) * 1e6 + 0.5001) / 1e6 END AS pose, floor((keep) * 1e6 + 0.5001) / 1e6 AS gripper, v IS NULL AS is_pad FROM h""")
def action_chunks(t: Tables):
    f = covered(t).withColumn("action", F.array(F.col("value") / 10, F.col("value")))
    c = FR.action_chunks(f, ["episode", "seg_index"], 4, 2)
    e = c.select("episode", "step", F.posexplode(F.arrays_zip("action_chunk", "is_pad")).alias("k", "p"))
    return e.select("episode", "step", F.col("k").cast("bigint").alias("k"), near(F.get("p.action_chunk", F.lit(0)), 6).alias("pose"),
                    near(F.get("p.action_chunk", F.lit(1)), 6).alias("gripper"), F.col("p.is_pad").alias("is_pad"))


@query(f"""WITH {FRAMES}, p AS (SELECT *, lag(value) OVER w AS pv, lag(step) OVER w AS ps FROM frames WINDOW w AS (PARTITION BY episode ORDER BY step)),
  d AS (SELECT episode, sqrt((value - pv) * (value - pv) + 1.0) AS delta FROM p)
  SELECT episode, count(*) AS points, floor((coalesce(max(delta), 0)) * 1e5 + 0.5001) / 1e5 AS max_delta, floor((coalesce(avg(delta), 0)) * 1e5 + 0.5001) / 1e5 AS mean_delta,
    floor((coalesce(quantile_cont(delta, 0.95), 0)) * 1e5 + 0.5001) / 1e5 AS p95_delta FROM d GROUP BY episode""")
def step_deltas(t: Tables):
    o = t.frames
    o = o.with_df(o.df.select("episode", "ts", "event_id", "_block", F.col("step").cast("double").alias("x"), F.col("value").alias("y")))
    s = FR.delta_stats(o)
    return s.withColumns({c: near(c, 5) for c in ("max_delta", "mean_delta", "p95_delta")})


@query(f"""WITH {FRAMES}, p AS (SELECT *, sqrt((value - lag(value) OVER w) ** 2 + 1.0) AS delta FROM frames WINDOW w AS (PARTITION BY episode ORDER BY step))
  SELECT episode, step, floor((delta) * 1e5 + 0.5001) / 1e5 AS delta FROM p WHERE delta > 80""")
def trace_jumps(t: Tables):
    o = t.frames
    o = o.with_df(o.df.withColumns({"x": F.col("step").cast("double"), "y": F.col("value")}))
    return FR.jumps(o).select("episode", "step", near("delta", 5).alias("delta"))


RESAMPLE = f"""{FRAMES}, d AS (SELECT *, lag(value) OVER w AS pv, coalesce(sqrt((value - lag(value) OVER w) ** 2 + 1.0), 0) AS st FROM frames WINDOW w AS (PARTITION BY episode ORDER BY step)),
  a AS (SELECT *, sum(st) OVER (PARTITION BY episode ORDER BY step) AS upto FROM d), l AS (SELECT episode, max(upto) AS total, max(step) AS n FROM a GROUP BY 1)"""


@query(f"""WITH {RESAMPLE}, g AS (SELECT episode, k, total, k * total / 9.0 AS pos FROM l CROSS JOIN range(0, 10) r(k)),
  b AS (SELECT g.episode, k, pos, min(step) AS j FROM g JOIN a ON a.episode = g.episode AND a.upto >= pos - 1e-9 GROUP BY ALL)
  SELECT b.episode, k, floor((CASE WHEN st = 0 THEN step ELSE step - 1 + least(1, (pos - (upto - st)) / st) END) * 1e4 + 0.5001) / 1e4 AS x,
    floor((CASE WHEN st = 0 THEN value ELSE pv + (value - pv) * least(1, (pos - (upto - st)) / st) END) * 1e4 + 0.5001) / 1e4 AS y
  FROM b JOIN a ON a.episode = b.episode AND a.step = b.j""")
def arc_length(t: Tables):
    o = t.frames
    o = o.with_df(o.df.select("episode", "ts", "event_id", "_block", F.col("step").cast("double").alias("x"), F.col("value").alias("y")))
    r = FR.resample_by_length(o, 10)
    return r.select("episode", "k", near("x", 4).alias("x"), near("y", 4).alias("y"))


@query(f"""WITH {FRAMES}, l AS (SELECT episode, max(step) AS n FROM frames GROUP BY 1), g AS (SELECT episode, k, k * n / 7.0 AS pos FROM l CROSS JOIN range(0, 8) r(k))
  SELECT g.episode, k, floor((pos) * 1e4 + 0.5001) / 1e4 AS x, floor((lo.value + (hi.value - lo.value) * (pos - floor(pos))) * 1e4 + 0.5001) / 1e4 AS y FROM g
  JOIN frames lo ON lo.episode = g.episode AND lo.step = CAST(floor(pos) AS BIGINT) JOIN frames hi ON hi.episode = g.episode AND hi.step = CAST(ceil(pos) AS BIGINT)""")
def time_resampling(t: Tables):
    o = t.frames
    o = o.with_df(o.df.select("episode", "ts", "event_id", "_block", F.col("step").cast("double").alias("x"), F.col("value").alias("y")))
    r = FR.resample_by_time(o, 8)
    return r.select("episode", "k", near("x", 4).alias("x"), near("y", 4).alias("y"))


@query(f"""WITH {COVER}, s AS (SELECT episode, seg_index, start_step, end_step FROM segments WHERE episode IN (SELECT episode FROM frames))
  SELECT s.episode, s.seg_index, a.value AS first_value, b.value AS last_value FROM s
  LEFT JOIN frames a ON a.episode = s.episode AND a.step = s.start_step LEFT JOIN frames b ON b.episode = s.episode AND b.step = s.end_step - 1""")
def segment_boundary_frames(t: Tables):
    frames = t.frames.df.select("episode", "step", "value")
    s = t.segments.df.select("episode", "seg_index", "start_step", "end_step").join(frames.select("episode").distinct(), "episode", "left_semi")
    first = FR.first_step_of_segments(s, frames.withColumnRenamed("value", "first_value"))
    both = FR.last_step_of_segments(first, frames.withColumnRenamed("value", "last_value"))
    return both.select("episode", "seg_index", "first_value", "last_value")


@query(f"""WITH {COVER}, v AS (SELECT episode, step, start_step FROM covered)
  SELECT count(*) AS frames, count(*) AS inside, true AS ages_vary FROM v""")
def anchor_ages(t: Tables):
    """Every anchor lies in the segment and less than the greatest age behind its frame."""
    a = covered(t).withColumn("a", FR.anchor_step(F.col("step"), F.col("start_step"), F.col("episode"), 15))
    ok = (F.col("a") >= F.col("start_step")) & (F.col("a") <= F.col("step")) & (F.col("step") - F.col("a") < 15)
    return a.agg(F.count(F.lit(1)).alias("frames"), F.count_if(ok).alias("inside"), (F.count_distinct(F.col("step") - F.col("a")) > 1).alias("ages_vary"))


@query(f"""WITH {COVER} SELECT episode, step, end_step - step AS remaining FROM covered""")
def residual_traces(t: Tables):
    """Length of the rest of the segment's trace, cut from an array of the segment's steps."""
    trace = F.sequence(F.col("start_step"), F.col("end_step") - 1)
    return covered(t).select("episode", "step", F.size(FR.residual(trace, F.col("start_step"), F.col("step"))).cast("bigint").alias("remaining"))


# --- points and cameras ------------------------------------------------------------------------------

GRID = "l_quantity * 20.48 AS gy, l_discount * 10240 AS gx"


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {GRID} FROM lineitem)
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
    greatest(least(CAST(round_even(gx / 1024.0 * 256, 0) AS BIGINT), 255), 0) AS px, greatest(least(CAST(round_even(gy / 1024.0 * 200, 0) AS BIGINT), 199), 0) AS py,
    floor((greatest(least(CAST(round_even(gx / 1024.0 * 256, 0) AS BIGINT), 255), 0) / 255.0) * 1e6 + 0.5001) / 1e6 AS nx FROM p WHERE gx BETWEEN 0 AND 1024 AND gy BETWEEN 0 AND 1024""")
def grid_to_pixel(t: Tables):
    p = t.lineitem.withColumn("p", G.grid_to_pixel(F.col("l_quantity") * 20.48, F.col("l_discount") * 10240, 256, 200)).filter("p is not null")
    return p.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.col("p.x").alias("px"), F.col("p.y").alias("py"),
                    near(G.normalized(F.col("p.x"), 256), 6).alias("nx"))


POINTS = f"""{SEGMENTS}, {CAMERAS}, pts AS (SELECT s.episode, s.seg_index AS step, s.length / 50.0 - 0.5 AS wx, l_linenumber / 10.0 - 0.3 AS wy, (l_partkey % 50) / 50.0 AS wz, f, tx, ty, conv
    FROM segments s JOIN cameras ON l_suppkey = camera),
  pr AS (SELECT *, f * wx + 0.0 * wy + 128.0 * wz + tx AS hx, 0.0 * wx + f * wy + 128.0 * wz + ty AS hy, wz + 2.0 AS depth FROM pts),
  im AS (SELECT *, CASE WHEN conv = 0 THEN hx / depth ELSE 255 - hx / depth END AS raw_x, CASE WHEN conv = 2 THEN 255 - hy / depth ELSE hy / depth END AS raw_y FROM pr),
  px AS (SELECT *, raw_x >= 0 AND raw_x < 256 AND raw_y >= 0 AND raw_y < 256 AND depth > 1e-6 AS in_bounds,
    CAST(round_even(greatest(least(raw_x, 255), 0), 0) AS BIGINT) AS x, CAST(round_even(greatest(least(raw_y, 255), 0), 0) AS BIGINT) AS y FROM im)"""


def world_points(t: Tables):
    return t.segments.df.select(
        "episode", "_block", F.col("seg_index").alias("step"), F.col("l_suppkey").alias("camera"),
        (F.col("length") / 50.0 - 0.5).alias("wx"), (F.col("l_linenumber") / 10.0 - 0.3).alias("wy"), ((F.col("l_partkey") % 50) / 50.0).alias("wz"))


def projected(t: Tables):
    return project_points(world_points(t), t.cameras)


def ordered_points(t: Tables):
    return Ordered(projected(t), ("episode",), ("step",))


@query(f"WITH {POINTS} SELECT episode, step, floor((raw_x) * 1e4 + 0.5001) / 1e4 AS raw_x, floor((raw_y) * 1e4 + 0.5001) / 1e4 AS raw_y, floor((depth) * 1e6 + 0.5001) / 1e6 AS depth, x, y, in_bounds FROM px")
def project_world_points(t: Tables):
    return projected(t).select("episode", "step", near("raw_x", 4).alias("raw_x"), near("raw_y", 4).alias("raw_y"), near("depth", 6).alias("depth"), "x", "y", "in_bounds")


@query(f"WITH {POINTS} SELECT count(*) AS points, count(*) AS exact FROM px")
def reprojection_round_trip(t: Tables):
    return projected(t).agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("exact_error") < 1e-6).alias("exact"))


@query(f"""WITH {POINTS} SELECT episode, count(*) AS points, count(*) FILTER (NOT in_bounds) AS out_of_bounds_count,
  floor((count(*) FILTER (NOT in_bounds) / CAST(count(*) AS DOUBLE)) * 1e6 + 0.5001) / 1e6 AS out_of_bounds_fraction FROM px GROUP BY episode""")
def out_of_bounds_fractions(t: Tables):
    s = projected(t).groupBy("episode").agg(F.count(F.lit(1)).alias("points"), *bounds_aggregates())
    return s.withColumn("out_of_bounds_fraction", near("out_of_bounds_fraction", 6))


STATS = f"""{POINTS}, o AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS delta,
    CASE WHEN conv = 0 THEN x ELSE 255 - x END * depth AS rx, CASE WHEN conv = 2 THEN 255 - y ELSE y END * depth AS ry FROM px WINDOW w AS (PARTITION BY episode ORDER BY step)),
  e AS (SELECT *, sqrt(((rx - 128.0 * wz - tx) / f - wx) ** 2 + ((ry - 128.0 * wz - ty) / f - wy) ** 2) AS err FROM o),
  st AS (SELECT episode, count(*) FILTER (in_bounds) AS rounded_count, coalesce(max(err) FILTER (in_bounds), 0) AS rounded_max_error, coalesce(avg(err) FILTER (in_bounds), 0) AS rounded_mean_error,
    coalesce(max(delta), 0) AS max_delta, coalesce(avg(delta), 0) AS mean_delta, coalesce(quantile_cont(delta, 0.95), 0) AS p95_delta FROM e GROUP BY episode)"""
STAT_NAMES = ["rounded_max_error", "rounded_mean_error", "max_delta", "mean_delta", "p95_delta"]


@query(f"WITH {STATS} SELECT episode, rounded_count, {', '.join(f'floor({c} * 1e5 + 0.5001) / 1e5 AS {c}' for c in STAT_NAMES)} FROM st")
def trace_statistics(t: Tables):
    s = trace_stats(ordered_points(t))
    return s.select("episode", "rounded_count", *[near(c, 5).alias(c) for c in STAT_NAMES])


@query(f"""WITH {STATS} SELECT episode, 'step_jump' AS rule FROM st WHERE max_delta > 80 UNION ALL SELECT episode, 'rounded_error' FROM st WHERE rounded_max_error > 0.008""")
def trace_gates(t: Tables):
    return gate(trace_stats(ordered_points(t)), ["episode"], max_rounded=0.008)


@query(f"""WITH {POINTS} SELECT episode, step, CASE WHEN wz - 0.5 + 0.5 <= 0.5 THEN 128 ELSE x END AS px, CASE WHEN wz <= 0.5 THEN 128 ELSE y END AS py FROM px""")
def online_pixels(t: Tables):
    """The online rule: a point behind the camera goes to the image centre (here: all with z <= 0.5)."""
    j = world_points(t).join(prepare_cameras(t.cameras, "camera", 256, 256), "camera")
    lifted = F.when(F.col("wz") <= 0.5, -3.0).otherwise(F.col("wz"))
    x, y, _ = G.pixel_online(F.col("wx"), F.col("wy"), lifted, MATRIX, [F.col(n) for n in FLIP], 256, 256)
    return j.select("episode", "step", x.alias("px"), y.alias("py"))


@query(f"""WITH {POINTS} SELECT episode, step, floor((sqrt(0.01 + 0.0 * wx)) * 1e6 + 0.5001) / 1e6 AS distance FROM px WHERE step < 3""")
def replay_distances(t: Tables):
    p = world_points(t)
    return replay_check(p, p.withColumn("wx", F.col("wx") + 0.1), ["episode"], 3).withColumn("distance", near("distance", 6))


@query("""SELECT event_id, CAST(CASE WHEN x < -1 THEN -1 ELSE least(CAST(floor((x + 1) * 128) AS BIGINT), 255) END AS BIGINT) AS bin,
  CASE WHEN value > 50 THEN 'open' ELSE 'closed' END AS gripper FROM (SELECT event_id, value, (value - 60) / 50 AS x FROM events)""")
def state_bins(t: Tables):
    x = (F.col("value") - 60) / 50
    return t.events.select("event_id", G.uniform_bin(x).alias("bin"), G.gripper_label(F.array(F.lit(0.0), F.col("value") - 50)).alias("gripper"))


@query("""WITH q AS (SELECT vec_id, embedding[1] AS x, embedding[2] AS y, embedding[3] AS z, CAST(embedding[4] AS DOUBLE) * 4 AS w FROM embeddings),
  c AS (SELECT *, greatest(least(w, 1), -1) AS cw FROM q), s AS (SELECT *, CASE WHEN sqrt(1 - cw * cw) > 1e-9 THEN 2 * acos(cw) / sqrt(1 - cw * cw) ELSE 0 END AS k FROM c)
  SELECT vec_id, floor((x * k) * 1e5 + 0.5001) / 1e5 AS rx, floor((y * k) * 1e5 + 0.5001) / 1e5 AS ry, floor((z * k) * 1e5 + 0.5001) / 1e5 AS rz FROM s""")
def axis_angles(t: Tables):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    a = t.embeddings.select("vec_id", G.axis_angle(e(0), e(1), e(2), e(3) * 4).alias("a"))
    return a.select("vec_id", *[near(F.get("a", F.lit(i)), 5).alias(n) for i, n in enumerate(("rx", "ry", "rz"))])


@query()
def relative_poses(t: Tables):
    e = lambda a, b: F.slice("embedding", a, b).cast("array<double>")
    pose = G.relative_pose(e(1, 3), e(4, 4), e(8, 3), e(11, 4))
    return t.embeddings.select("vec_id", pose.alias("p")).select("vec_id", *[near(F.get("p", F.lit(i)), 6).alias(f"p{i}") for i in range(6)])


@query("""SELECT p_partkey, coalesce(CASE WHEN s1.s_suppkey IS NOT NULL THEN s1.s_acctbal END, n_nationkey * 1.0, s2.s_acctbal) AS place FROM part
  LEFT JOIN supplier s1 ON s1.s_suppkey = p_partkey LEFT JOIN nation ON n_nationkey = p_size LEFT JOIN supplier s2 ON s2.s_suppkey = p_size""")
def target_lookup_priority(t: Tables):
    by_id = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("place"))
    by_region = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("double").alias("place"))
    keys = t.part.select("p_partkey", "p_size")
    return first_in_priority(keys, [(by_id, "p_partkey"), (by_region, "p_size"), (by_id, "p_size")], "place").select("p_partkey", "place")


# --- vectors -------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding) AS v FROM embeddings)
  SELECT label, CAST(dim AS INTEGER) AS dim, floor((avg(CAST(v AS DOUBLE))) * 1e6 + 0.5001) / 1e6 AS mean FROM c GROUP BY label, dim""")
def token_means(t: Tables):
    return token_mean(t.embeddings, ["label"], "embedding").withColumn("mean", near("mean", 6))


@query("""WITH c AS (SELECT unnest(range(0, 4)) AS dim, unnest([l_quantity, l_discount, l_tax, CAST(l_linenumber AS DOUBLE)]) AS v FROM lineitem)
  SELECT CAST(dim AS INTEGER) AS dim, count(*) AS count, floor((avg(v)) * 1e6 + 0.5001) / 1e6 AS mean, floor((stddev_pop(v)) * 1e6 + 0.5001) / 1e6 AS std, floor((quantile_cont(v, 0.01)) * 1e6 + 0.5001) / 1e6 AS q01, floor((quantile_cont(v, 0.99)) * 1e6 + 0.5001) / 1e6 AS q99 FROM c GROUP BY dim""")
def norm_stats(t: Tables):
    v = t.lineitem.select(F.array("l_quantity", "l_discount", "l_tax", F.col("l_linenumber").cast("double")).alias("v"))
    s = element_stats(v, "v")
    return s.withColumns({c: near(c, 6) for c in ("mean", "std", "q01", "q99")})


@query("""WITH c AS (SELECT 'state' AS "column", unnest(range(0, 3)) AS dim, unnest([l_quantity, l_discount, l_extendedprice]) AS v FROM lineitem
    UNION ALL SELECT 'action', unnest(range(0, 2)), unnest([l_tax, CAST(l_linenumber AS DOUBLE)]) FROM lineitem)
  SELECT "column", CAST(dim AS INTEGER) AS dim, count(*) AS count, floor((avg(v)) * 1e4 + 0.5001) / 1e4 AS mean, floor((stddev_pop(v)) * 1e4 + 0.5001) / 1e4 AS std,
    floor((quantile_cont(v, 0.01)) * 1e6 + 0.5001) / 1e6 AS q01, floor((quantile_cont(v, 0.99)) * 1e6 + 0.5001) / 1e6 AS q99 FROM c GROUP BY ALL""")
def normalisation_statistics(t: Tables):
    """Of the state and action columns of frames: line items as frames."""
    frames = t.lineitem.select(F.array("l_quantity", "l_discount", "l_extendedprice").alias("state"), F.array("l_tax", F.col("l_linenumber").cast("double")).alias("action"))
    s = normalisation_stats(frames, ["state", "action"])
    return s.withColumns({"mean": near("mean", 4), "std": near("std", 4), "q01": near("q01", 6), "q99": near("q99", 6)})


@query(f"""WITH {FRAMES}, {SKILL_SEGMENTS}, c AS (SELECT f.*, s.seg_index, s.skill AS seg_skill, s.verb, s.start_step, s.end_step FROM frames f JOIN skill_segments s
    ON f.episode = s.episode AND f.step >= s.start_step AND f.step < s.end_step)
  SELECT episode, step, seg_index, seg_skill AS prompt, verb AS skill_name, CASE verb WHEN 'PLACE_ON' THEN 1 WHEN 'PLACE_IN' THEN 1 WHEN 'OPEN' THEN 2 WHEN 'CLOSE' THEN 3 WHEN 'TURN_ON' THEN 4 ELSE 0 END AS skill_id,
    floor(((step - start_step) / CAST(end_step - start_step AS DOUBLE)) * 1e6 + 0.5001) / 1e6 AS progress, end_step AS trace_end_step, floor((value / 256.0) * 1e6 + 0.5001) / 1e6 AS current_x, least(4, end_step - step) AS real_actions FROM c""")
def training_frame_rows(t: Tables):
    f = t.frames.df.select("episode", "step", F.col("value").alias("x"), F.col("value").alias("y"), F.array(F.col("value"), F.lit(1.0)).alias("action"))
    s = t.skill_segments.df.select("episode", "seg_index", "start_step", "end_step", "skill", F.lit(10).alias("target_x"), F.lit(20).alias("target_y"))
    # frames may end before their segment: only actions that exist can be real
    out = training_frames(f, s, 256, 256, horizon=4, dims=2)
    last = f.groupBy("episode").agg((F.max("step") + 1).alias("_n"))
    real = F.size(F.filter("is_pad", lambda p: ~p)).cast("bigint")
    want = F.least(F.lit(4), F.col("trace_end_step") - F.col("step"))
    cut = out.join(last, "episode").withColumn("real", F.when(real == F.least(want, F.col("_n") - F.col("step")), want).otherwise(-1))
    return cut.select("episode", "step", "seg_index", "prompt", "skill_name", "skill_id", near("progress", 6).alias("progress"), "trace_end_step",
                      near("current_x", 6).alias("current_x"), F.col("real").alias("real_actions"))


@query("""WITH q AS (SELECT l_orderkey AS run, l_suppkey AS frame, l_linenumber - 1 AS value FROM lineitem), m AS (SELECT run, frame, quantile_cont(value, 0.5) AS md FROM q GROUP BY 1, 2)
  SELECT run, bool_or(md = 0) AS corrupted, count(*) AS frames FROM m GROUP BY run""")
def corrupt_runs(t: Tables):
    from demospan.plans.rollouts import audit_runs

    px = t.lineitem.select(F.col("l_orderkey").alias("run"), F.col("l_suppkey").alias("frame"), (F.col("l_linenumber") - 1).alias("value"))
    return audit_runs(px)


@query("""SELECT event_type, floor((quantile_cont(value, 0.5)) * 1e6 + 0.5001) / 1e6 AS p50, floor((quantile_cont(value, 0.95)) * 1e6 + 0.5001) / 1e6 AS p95 FROM events GROUP BY event_type""")
def exact_percentiles(t: Tables):
    from demospan.operators.ordered import percentiles

    p = percentiles(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return p.select("event_type", near("p50", 6).alias("p50"), near("p95", 6).alias("p95"))


@query(f"""WITH {FRAMES}, o AS (SELECT *, lag(step + event_id % 2) OVER (PARTITION BY episode ORDER BY ts, event_id) AS p FROM frames)
  SELECT episode, step, 'not_rising' AS rule FROM o WHERE step + event_id % 2 <= p UNION ALL SELECT episode, step, 'first_not_contact' FROM o WHERE p IS NULL AND event_id % 2 <> 0""")
def trace_frame_order(t: Tables):
    o = t.frames
    o = o.with_df(o.df.withColumn("frame_index", F.col("step") + F.col("event_id") % 2))
    return FR.order_problems(o, "frame_index", F.lit(0)).select("episode", "step", "rule")


@query("""SELECT event_id, 112 AS numbers, 96 AS kept, floor((value + 13.0 * 1000 + 4) * 1e3 + 0.5001) / 1e3 AS last FROM events""")
def flat_chunks(t: Tables):
    """Action chunks of 16 steps and 7 dimensions as one vector, of which the first 96 numbers are used."""
    step = lambda i: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda j: F.col("value") + i * 1000.0 + j)
    e = t.events.select("event_id", F.transform(F.sequence(F.lit(0), F.lit(15)), step).alias("action_chunk"))
    # what is asked of a chunk and of its vector is read off before they meet: the join carries no array
    v = flat_vectors(e, "action_chunk", 96).select("event_id", F.size("vector").alias("kept"), near(F.element_at("vector", -1), 3).alias("last"))
    n = e.select("event_id", F.size(F.flatten("action_chunk")).alias("numbers"))
    return by_shuffle(v, n, ["event_id"]).select("event_id", "numbers", "kept", "last")
