"""Segment, run, order-rule and online-progress queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from demospan.operators import bounds as B, progress as P
from demospan.operators import segments as S
from demospan.operators.ordered import streak

from .registry import query
from .tables import FRAMES, SEGMENTS, SKILL_SEGMENTS, Tables, near


@query(f"""WITH {SEGMENTS} SELECT verb, count(*) AS count, min(length) AS min, max(length) AS max,
  floor((avg(length)) * 1e4 + 0.5001) / 1e4 AS mean, floor((stddev_pop(length)) * 1e4 + 0.5001) / 1e4 AS std FROM segments WHERE length > 0 GROUP BY verb""")
def segment_length_stats(t: Tables):
    out = S.length_stats(t.segments.rows())
    return out.withColumns({c: near(c, 4) for c in ("mean", "std")})


@query(f"WITH {SEGMENTS} SELECT episode, seg_index, verb, start_step, end_step FROM segments")
def segments_from_end_steps(t: Tables):
    ends = t.segments.df.drop("start_step", "seg_index")
    return S.from_end_steps(t.segments.with_df(ends)).df.select("episode", "seg_index", "verb", "start_step", "end_step")


@query(f"""WITH {SEGMENTS}, moved AS (
    SELECT episode, seg_index, start_step + CASE l_linenumber WHEN 3 THEN 1 WHEN 5 THEN -1 ELSE 0 END AS start_step,
      CASE WHEN l_linenumber = 7 THEN start_step ELSE end_step END AS end_step FROM segments),
  o AS (SELECT *, lag(end_step) OVER w AS e, lead(seg_index) OVER w AS nx FROM moved WINDOW w AS (PARTITION BY episode ORDER BY seg_index)),
  n AS (SELECT l_orderkey AS episode, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS num_steps FROM lineitem GROUP BY 1)
  SELECT episode, seg_index, 'first_start_not_zero' AS rule FROM o WHERE seg_index = 0 AND start_step <> 0
  UNION ALL SELECT episode, seg_index, 'gap' FROM o WHERE start_step > e
  UNION ALL SELECT episode, seg_index, 'overlap' FROM o WHERE start_step < e
  UNION ALL SELECT episode, seg_index, 'non_positive_length' FROM o WHERE end_step <= start_step
  UNION ALL SELECT episode, seg_index, 'last_end_not_num_steps' FROM o JOIN n USING (episode) WHERE nx IS NULL AND end_step <> num_steps""")
def segment_contiguity_violations(t: Tables):
    shift = F.when(F.col("l_linenumber") == 3, 1).when(F.col("l_linenumber") == 5, -1).otherwise(0)
    s = t.segments
    moved = s.df.withColumn(
        "end_step", F.when(F.col("l_linenumber") == 7, F.col("start_step")).otherwise(F.col("end_step"))
    ).withColumn("start_step", F.col("start_step") + shift)
    sizes = t.raw_segments.groupBy("episode").agg(F.sum("length").alias("num_steps"))
    return S.contiguity_violations(s.with_df(moved.drop("seg_index")), sizes)


RUNS = f"""{SEGMENTS}, marked AS (SELECT *, CASE WHEN lag(verb) OVER w IS NOT DISTINCT FROM verb THEN 0 ELSE 1 END AS c
    FROM segments WINDOW w AS (PARTITION BY episode ORDER BY seg_index)),
  runs AS (SELECT *, CAST(sum(c) OVER (PARTITION BY episode ORDER BY seg_index) AS BIGINT) AS run FROM marked)"""


@query(f"""WITH {FRAMES}, m AS (SELECT *, CASE WHEN lag(skill) OVER w IS NOT DISTINCT FROM skill THEN 0 ELSE 1 END AS c
    FROM frames WINDOW w AS (PARTITION BY episode ORDER BY step)),
  r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY episode ORDER BY step) AS BIGINT) AS run FROM m)
  SELECT episode, run, min(skill) AS skill, min(step) AS start_step, max(step) + 1 AS end_step, count(*) AS pieces
  FROM r GROUP BY episode, run""")
def compress_runs(t: Tables):
    f = t.frames
    df = f.df.select("episode", "ts", "event_id", "_block", "skill", F.col("step").alias("start_step"), (F.col("step") + 1).alias("end_step"))
    return S.compress_runs(f.with_df(df))


@query(f"""WITH {RUNS} SELECT episode, run, min(verb) AS verb, min(start_step) AS start_step, max(end_step) AS end_step,
  count(*) AS pieces FROM runs GROUP BY episode, run""")
def canonical_segments(t: Tables):
    return S.compress_runs(t.segments, "verb")


@query(f"""WITH {SKILL_SEGMENTS} SELECT episode, seg_index AS position,
    CASE WHEN seg_index = 0 THEN 'initial' ELSE 'transition' END AS kind,
    lag(skill) OVER (PARTITION BY episode ORDER BY seg_index) AS previous_skill, skill AS next_skill,
    start_step AS boundary_step FROM skill_segments""")
def transition_pairs(t: Tables):
    return S.transitions(t.skill_segments)


@query(f"""WITH {SEGMENTS}, c AS (SELECT episode, seg_index AS position, verb,
    CASE WHEN verb = 'PICKUP_FROM' THEN 'pickup' WHEN verb IN ('PLACE_ON','PLACE_IN') THEN 'place' ELSE 'other' END AS category FROM segments),
  o AS (SELECT *, lag(category) OVER (PARTITION BY episode ORDER BY position) AS p FROM c)
  SELECT episode, position, verb, category FROM o WHERE category <> 'other' AND category = p""")
def alternation_violations(t: Tables):
    return S.alternation_violations(t.segments).select("episode", "position", "verb", "category")


@query(f"""WITH {SEGMENTS}, v AS (SELECT episode, seg_index AS position, CASE WHEN l_linenumber = 4 THEN 'TURN_OBJECT' ELSE verb END AS verb,
      CAST(l_suppkey % 3 AS VARCHAR) AS a FROM segments),
  o AS (SELECT *, lag(verb) OVER w AS pv, lag(a) OVER w AS pa, lead(verb) OVER w AS nv FROM v WINDOW w AS (PARTITION BY episode ORDER BY position)),
  s AS (SELECT *, verb IN ('PLACE_ON','PLACE_IN') AS place, CASE WHEN pv IS NULL THEN verb IN ('PLACE_ON','PLACE_IN') ELSE pv = 'PICKUP_FROM' END AS holding FROM o)
  SELECT episode, position, verb, 'needs_held_object' AS rule FROM s WHERE place AND NOT holding
  UNION ALL SELECT episode, position, verb, 'needs_free_gripper' FROM s WHERE verb IN ('PICKUP_FROM','OPEN','CLOSE','TURN_ON','TURN_OFF','MOVE_SLIDER','PUSH','PUSH_INTO') AND holding
  UNION ALL SELECT episode, position, verb, 'placed_on_itself' FROM s WHERE place AND pv = 'PICKUP_FROM' AND pa = a
  UNION ALL SELECT episode, position, verb, 'turn_while_holding' FROM s WHERE verb = 'TURN_OBJECT' AND pv IS NOT NULL AND holding
  UNION ALL SELECT episode, position, verb, 'turn_after_pick' FROM s WHERE verb = 'TURN_OBJECT' AND pv = 'PICKUP_FROM'
  UNION ALL SELECT episode, position, verb, 'turn_before_place' FROM s WHERE verb = 'TURN_OBJECT' AND nv IN ('PLACE_ON','PLACE_IN')""")
def gripper_machine(t: Tables):
    s = t.segments
    df = s.df.withColumn("verb", F.when(F.col("l_linenumber") == 4, "TURN_OBJECT").otherwise(F.col("verb")))
    df = df.withColumn("argument", (F.col("l_suppkey") % 3).cast("string"))
    return S.gripper_violations(s.with_df(df))


@query(f"""WITH {SEGMENTS}, cut AS (SELECT *, least(end_step, start_step + 10) AS c FROM segments)
  SELECT episode, seg_index, verb, 'boundary' AS part, start_step, c AS end_step FROM cut
  UNION ALL SELECT episode, seg_index, verb, 'action', c, end_step FROM cut WHERE c < end_step""")
def boundary_action_split(t: Tables):
    s = t.segments.df.select("episode", "seg_index", "verb", "start_step", "end_step")
    return S.boundary_action_split(s)


@query(f"""WITH {SEGMENTS}, k AS (SELECT episode, seg_index, start_step, length, unnest(range(0, least(length, 8))) AS i FROM segments)
  SELECT episode, seg_index, i AS k, CASE WHEN length <= 8 THEN start_step + i
    ELSE start_step + CAST(round_even(i * (length - 1) / 7.0, 0) AS BIGINT) END AS frame FROM k""")
def even_sampling(t: Tables):
    s = t.segments.df.select("episode", "seg_index", F.posexplode(S.even_sample(F.col("start_step"), F.col("end_step"), 8)).alias("k", "frame"))
    return s.withColumn("k", F.col("k").cast("bigint"))


@query(f"""WITH {SEGMENTS} SELECT count(*) AS segments, count(*) AS with_both_ends FROM segments""")
def sampled_ends_kept(t: Tables):
    frames = S.even_sample(F.col("start_step"), F.col("end_step"), 8)
    df = t.segments.df.withColumn("f", frames)
    return df.agg(F.count(F.lit(1)).alias("segments"), F.count_if(S.has_both_ends(F.col("f"), F.col("start_step"), F.col("end_step"))).alias("with_both_ends"))


PLAN_ITEMS = f"""{RUNS}, seq AS (SELECT episode, run - 1 AS position, min(verb) AS skill FROM runs GROUP BY episode, run),
  plan AS (SELECT episode, position, CASE WHEN skill = 'TURN_ON' AND position = 1 THEN 'TURN_OFF' ELSE skill END AS skill FROM seq
    WHERE NOT (skill = 'OPEN' AND position = 2))"""


@query(f"""WITH {PLAN_ITEMS} SELECT coalesce(s.episode, p.episode) AS episode, coalesce(s.position, p.position) AS position,
    s.skill AS segment_skill, p.skill AS plan_skill FROM seq s FULL JOIN plan p ON s.episode = p.episode AND s.position = p.position
  WHERE s.skill IS DISTINCT FROM p.skill""")
def plan_sequence_mismatches(t: Tables):
    seq = S.compress_runs(t.segments, "verb").select("episode", (F.col("run") - 1).alias("position"), F.col("verb").alias("skill"))
    wrong = (F.col("skill") == "TURN_ON") & (F.col("position") == 1)
    short = (F.col("skill") == "OPEN") & (F.col("position") == 2)
    plan = seq.filter(~short).withColumn("skill", F.when(wrong, "TURN_OFF").otherwise(F.col("skill")))
    return S.compare_to_plan(seq, plan, ["episode"])


@query(f"""WITH {SEGMENTS}, f AS (SELECT *, CAST(l_suppkey % 2 AS VARCHAR) AS plan FROM segments),
  o AS (SELECT *, first_value(plan) OVER (PARTITION BY episode ORDER BY seg_index) AS p0 FROM f)
  SELECT episode, seg_index FROM o WHERE plan <> p0""")
def segment_plan_disagreements(t: Tables):
    s = t.segments
    s = s.with_df(s.df.withColumn("plan", (F.col("l_suppkey") % 2).cast("string")))
    s = s.scan(last={"first_plan": F.when(F.col("seg_index") == 0, F.col("plan"))})
    return s.df.filter(F.col("plan") != F.col("first_plan")).select("episode", "seg_index")


@query(f"""WITH {SEGMENTS}, e AS (SELECT episode, min_by(verb, seg_index) AS first_verb, max_by(verb, seg_index) AS last_verb FROM segments GROUP BY episode)
  SELECT episode, 'first_is_place' AS rule, first_verb AS verb FROM e WHERE first_verb IN ('PLACE_ON','PLACE_IN')
  UNION ALL SELECT episode, 'last_is_not_place', last_verb FROM e WHERE last_verb NOT IN ('PLACE_ON','PLACE_IN')""")
def first_and_last_verb_rules(t: Tables):
    at = F.struct(*[F.col(c) for c in t.segments.order])
    e = t.raw_segments.groupBy("episode").agg(F.min_by("verb", at).alias("f"), F.max_by("verb", at).alias("l"))
    place = ["PLACE_ON", "PLACE_IN"]
    rules = F.array_compact(
        F.array(
            F.when(F.col("f").isin(place), F.struct(F.lit("first_is_place").alias("rule"), F.col("f").alias("verb"))),
            F.when(~F.col("l").isin(place), F.struct(F.lit("last_is_not_place").alias("rule"), F.col("l").alias("verb"))),
        )
    )
    return e.select("episode", F.explode(rules).alias("r")).select("episode", "r.*")


@query("""SELECT o_orderkey AS episode, CAST(sum(n) OVER (ORDER BY o_orderkey) - n AS BIGINT) AS first_row, CAST(sum(n) OVER (ORDER BY o_orderkey) AS BIGINT) AS end_row
  FROM (SELECT o_orderkey, CAST(coalesce(n, 0) AS BIGINT) AS n FROM orders LEFT JOIN
    (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)""")
def episode_bounds(t: Tables):
    return bounds(t).select("episode", "first_row", "end_row")


def bounds(t: Tables):
    """Row range of each episode in one long file, by a running sum over blocks of episode ids."""
    sizes = t.raw_segments.groupBy("episode").agg(F.sum("length").alias("n"))
    e = t.orders.select(F.col("o_orderkey").alias("episode")).join(sizes, "episode", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return B.episode_bounds(e, "episode", "n")


# --- online bookkeeping over frames -----------------------------------------------------------------

HIGH = "value >= 60"


@query(f"""WITH {FRAMES}, b AS (SELECT *, max(CASE WHEN NOT ({HIGH}) THEN step END) OVER (PARTITION BY episode ORDER BY step) AS br FROM frames)
  SELECT episode, step, step - coalesce(br, -1) AS streak, step - coalesce(br, -1) >= 2 AS advance FROM b""")
def streaks(t: Tables):
    return P.advance_on_streak(t.frames, "value", 60.0, 2).df.select("episode", "step", "streak", "advance")


FROZEN = f"""{FRAMES}, b AS (SELECT *, max(CASE WHEN NOT (value >= 40) THEN step END) OVER (PARTITION BY episode ORDER BY step) AS br FROM frames),
  z AS (SELECT *, max(CASE WHEN step - coalesce(br, -1) >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY step) = 1 AS frozen FROM b)"""


@query(f"WITH {FROZEN} SELECT episode, step, frozen FROM z")
def freeze_flags(t: Tables):
    return P.freeze(t.frames, "value", 40.0, 3).df.select("episode", "step", "frozen")


@query(f"""WITH {FROZEN}, p AS (SELECT episode, step, step % 4 = 0 AS due, coalesce(lag(frozen) OVER (PARTITION BY episode ORDER BY step), false) AS held FROM z)
  SELECT episode, step, due AND NOT held AS replan, due AND held AS suppressed FROM p""")
def replan_points(t: Tables):
    return P.replans(P.freeze(t.frames, "value", 40.0, 3), 4).df.select("episode", "step", "replan", "suppressed")


CHANGES = f"""{FRAMES}, ch AS (SELECT *, CASE WHEN step > 0 AND lag(skill) OVER w IS DISTINCT FROM skill THEN 1 ELSE 0 END AS c
    FROM frames WINDOW w AS (PARTITION BY episode ORDER BY step)),
  n AS (SELECT *, CAST(sum(c) OVER (PARTITION BY episode ORDER BY step) AS BIGINT) AS changes FROM ch)"""


@query(f"""WITH {CHANGES} SELECT episode, step, changes, least(changes, 4) AS done,
    array_to_string((['PICKUP_FROM(a, b)','PLACE_ON(a, c)','OPEN(d)','CLOSE(d)'])[1:least(changes, 4)], ', ') AS done_text FROM n""")
def done_prefix(t: Tables):
    plan = F.array(*[F.lit(s) for s in ("PICKUP_FROM(a, b)", "PLACE_ON(a, c)", "OPEN(d)", "CLOSE(d)")])
    f = P.observed_changes(t.frames, "skill").df
    return f.select(
        "episode", "step", "changes",
        P.done_count(F.col("changes"), 4).alias("done"),
        F.array_join(P.done_skills(plan, F.col("changes")), ", ").alias("done_text"),
    )


@query(f"WITH {CHANGES} SELECT episode, step, least(changes, 5) AS target FROM n")
def next_target_pointer(t: Tables):
    f = P.observed_changes(t.frames, "skill").df
    return f.select("episode", "step", P.next_target(F.col("changes"), 6).alias("target"))


@query(f"""WITH {FRAMES} SELECT episode, step, CASE WHEN step + 1 >= 30 THEN 2 WHEN step + 1 >= 10 THEN 1 ELSE 0 END AS skill_index FROM frames""")
def fixed_progression(t: Tables):
    return t.frames.df.select("episode", "step", P.fixed_progression(F.col("step"), [10, 20, 30]).cast("int").alias("skill_index"))


@query(f"""WITH {CHANGES}, s AS (SELECT *, step - coalesce(max(CASE WHEN c = 1 THEN step END) OVER (PARTITION BY episode ORDER BY step), 0) AS since FROM n)
  SELECT episode, min(step) AS ended_at FROM s WHERE since > 2 GROUP BY episode""")
def skill_timeouts(t: Tables):
    return P.timeouts(t.frames, "skill", limit=2)


@query(f"""WITH {FRAMES} SELECT episode, max(rn) AS longest FROM (
   SELECT episode, step - coalesce(max(CASE WHEN NOT ({HIGH}) THEN step END) OVER (PARTITION BY episode ORDER BY step), -1) AS rn FROM frames) GROUP BY episode""")
def longest_streak(t: Tables):
    s = streak(t.frames, F.col("value") >= 60.0, "rn")
    return s.df.groupBy("episode").agg(F.max("rn").alias("longest"))
