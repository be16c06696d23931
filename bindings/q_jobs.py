"""Queries of the whole jobs. Orders stand for annotated episodes: the customer's number picks one of
twelve kinds of annotation, from sound to broken in one way."""

from __future__ import annotations

from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame, functions as F

from demospan import schemas
from demospan.operators.joins import spread
from demospan.operators.segments import explode_segments, nest_segments
from demospan.plans import annotate as AN
from demospan.plans import audit as AU
from demospan.plans import combine as CO
from demospan.plans import cot as CT
from demospan.plans import encode as EN
from demospan.plans import feasibility as FE
from demospan.plans import probe as PR
from demospan.plans import targets as TG
from demospan.plans import transitions as TR
from demospan.plans.select import has_all_verbs, has_keyword, select_episodes, skills_of, verbs_at
from demospan.functions import text as X
from demospan.session import shared_folder

from .q_text import COT
from .registry import query
from .tables import SEGMENTS, Tables, near

KIND = "CAST(o_custkey % 12 AS INTEGER)"
THING = "lower(split_part(o_orderpriority, '-', 2))"
PICK, PLACE = f"'PICKUP_FROM(' || {THING} || ', table)'", f"'PLACE_ON(' || {THING} || ', shelf)'"
BASE = f"SELECT o_orderkey AS episode, {KIND} AS k, {THING} AS x FROM orders"


def episodes(t: Tables) -> DataFrame:
    x = F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)))
    return t.orders.select("o_orderkey", "o_custkey", "o_orderpriority").select(F.col("o_orderkey").alias("episode_index"), (F.col("o_custkey") % 12).cast("int").alias("k"), x.alias("x"))


def skill(name: str, *args) -> F.Column:
    parts = [F.lit(name + "(")]
    for i, a in enumerate(args):
        parts += ([F.lit(", ")] if i else []) + [a if not isinstance(a, str) else F.lit(a)]
    return F.concat(*parts, F.lit(")"))


# --- model answers -------------------------------------------------------------------------------------


def answers(t: Tables) -> DataFrame:
    """JSON answers of a model: plan and end steps; an episode has 40 steps."""
    e = episodes(t)
    pick, place = skill("PICKUP_FROM", F.col("x"), "table"), skill("PLACE_ON", F.col("x"), "shelf")
    k = F.col("k")
    plan = (
        F.when(k == 1, F.concat(F.lit("1. "), pick, F.lit(" 3. "), place))
        .when(k == 2, F.concat(F.lit("1. "), pick))
        .when(k == 9, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Plan: 1. "), pick, F.lit("  2. "), place))
    )
    first = F.when(k == 3, "0").when(k == 4, "x").otherwise("12")
    last = F.when(k == 5, "38").when(k == 6, "43").when(k == 7, "12").when(k == 11, "41").otherwise("40")
    second = F.when(k == 8, skill("PLACE_ON", F.col("x"))).otherwise(place)
    step = lambda s, n: F.struct(s.alias("skill"), n.alias("end_step"))
    steps = F.when(k == 10, F.array().cast("array<struct<skill:string,end_step:string>>")).otherwise(F.array(step(pick, first), step(second, last)))
    body = F.to_json(F.struct(plan.alias("plan"), steps.alias("steps")))
    return e.withColumn("response", F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)).withColumn("num_steps", F.lit(40))


@query(f"""WITH b AS ({BASE}) SELECT episode, CASE k WHEN 1 THEN 'bad_numbering' WHEN 2 THEN 'plan_not_equal_steps' WHEN 3 THEN 'end_step_not_rising' WHEN 4 THEN 'end_step_not_integer'
    WHEN 6 THEN 'last_end_not_num_steps' WHEN 7 THEN 'end_step_not_rising' WHEN 8 THEN 'wrong_arity' WHEN 9 THEN 'no_plan' WHEN 10 THEN 'no_steps' END AS reason,
  CASE WHEN k IN (0, 5, 11) THEN '1. PICKUP_FROM(' || x || ', table) 2. PLACE_ON(' || x || ', shelf)' END AS plan, CAST(CASE WHEN k IN (0, 5, 11) THEN 40 END AS BIGINT) AS last_end FROM b""")
def normalize_model_steps(t: Tables):
    n = answers(t).select("episode_index", AN.normalize_steps(F.col("response"), F.col("num_steps"), "libero").alias("n"))
    return n.select(F.col("episode_index").alias("episode"), "n.reason", "n.plan", F.try_element_at("n.segments", F.lit(-1))["end_step"].alias("last_end"))


@query(f"""WITH b AS ({BASE}) SELECT episode, 1 AS attempts, CASE WHEN k IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11) THEN 'PICKUP_FROM(' || x || ', table)' END AS response, false AS failed FROM b WHERE k > 1
  UNION ALL SELECT episode, 2, 'PICKUP_FROM(' || x || ', table)', false FROM b WHERE k = 1 UNION ALL SELECT episode, 3, NULL, true FROM b WHERE k = 0""")
def annotate_with_retries(t: Tables):
    """A stand-in client: kind 1 answers rightly only after it has been told its error, kind 0 never."""
    e = episodes(t).select("episode_index", F.concat_ws("|", F.col("k").cast("string"), "x").alias("prompt"))
    r = AN.annotate_to(f"{shared_folder(t.spark)}/answers-{uuid4().hex}", e, "episode_index", EchoClient, needs_skill, attempts=3)
    return r.select(F.col("episode_index").alias("episode"), "attempts", "response", F.col("error").isNotNull().alias("failed"))


class EchoClient:
    def complete(self, prompt: str, use_schema: bool) -> str:
        if use_schema:
            raise AN.SchemaRefused("no schema")
        k, x = prompt.split("\n")[0].split("|")
        if k == "0" or (k == "1" and "refused" not in prompt):
            return "nothing"
        return f"PICKUP_FROM({x}, table)"


def needs_skill(text: str) -> str | None:
    return None if text.startswith("PICKUP_FROM(") else "no skill"


POINT = """CASE l_linenumber WHEN 1 THEN '[true, 5]' WHEN 2 THEN '[1025, 5]' WHEN 3 THEN '["512", 5]' ELSE '[' || CAST(CAST(l_quantity * 20 AS BIGINT) AS VARCHAR) || ', ' || CAST(CAST(l_suppkey % 1000 AS BIGINT) AS VARCHAR) || ']' END"""


@query(f"""WITH a AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'wrong_label' WHEN l_linenumber = 1 THEN 'point_not_numeric' WHEN l_linenumber = 2 THEN 'point_off_grid' END AS reason,
    CASE WHEN l_linenumber = 3 THEN 512 ELSE CAST(l_quantity * 20 AS BIGINT) END AS my, CASE WHEN l_linenumber = 3 THEN 5 ELSE l_suppkey % 1000 END AS mx FROM lineitem)
  SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, reason, CASE WHEN reason IS NULL THEN greatest(0, least(255, CAST(round_even(mx / 1024.0 * 256, 0) AS BIGINT))) END AS x,
    CASE WHEN reason IS NULL THEN greatest(0, least(255, CAST(round_even(my / 1024.0 * 256, 0) AS BIGINT))) END AS y FROM a""")
def normalize_points(t: Tables):
    n = F.col("l_linenumber")
    pair = F.concat(F.lit("["), (F.col("l_quantity") * 20).cast("bigint").cast("string"), F.lit(", "), (F.col("l_suppkey") % 1000).cast("string"), F.lit("]"))
    point = F.when(n == 1, "[true, 5]").when(n == 2, "[1025, 5]").when(n == 3, '["512", 5]').otherwise(pair)
    label = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "other").otherwise("target")
    response = F.concat(F.lit('{"status": "ok", "object_id": "o", "label": "'), label, F.lit('", "point_2d": '), point, F.lit("}"))
    p = AN.normalize_point(response, F.lit("o"), F.lit("target"), 256, 256)
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", p.alias("p")).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "p.reason", "p.x", "p.y")


@query(f"""WITH b AS ({BASE}) SELECT episode, CASE k WHEN 1 THEN 'contact_not_sampled' WHEN 2 THEN 'frame_not_sampled' WHEN 3 THEN 'frames_not_sorted' WHEN 4 THEN 'first_frame_not_contact' WHEN 5 THEN 'no_points' WHEN 6 THEN 'frames_repeat' WHEN 7 THEN 'status_not_ok' END AS reason,
  CASE WHEN k IN (0, 8, 9, 10, 11) THEN '20,40,60' END AS frames FROM b""")
def normalize_traces(t: Tables):
    e = episodes(t)
    k = F.col("k")
    frames = (F.when(k == 2, F.array(F.lit(20), F.lit(41))).when(k == 3, F.array(F.lit(20), F.lit(60), F.lit(40))).when(k == 4, F.array(F.lit(40), F.lit(60)))
              .when(k == 5, F.array().cast("array<int>")).when(k == 6, F.array(F.lit(20), F.lit(20))).otherwise(F.array(F.lit(20), F.lit(40), F.lit(60))))
    points = F.transform(frames, lambda f: F.struct(f.alias("frame_index"), F.array(F.lit(512), F.lit(100)).alias("point_2d"), F.lit("t").alias("label")))
    response = F.to_json(F.struct(F.when(k == 7, "no").otherwise("OK").alias("status"), F.when(k == 1, 21).otherwise(20).alias("contact_start_step"), points.alias("points")))
    n = AN.normalize_trace(response, F.lit("t"), F.array(*[F.lit(i) for i in (0, 20, 40, 60)]).cast("array<bigint>"), F.lit(0), F.lit(80), 256, 256)
    return e.select(F.col("episode_index").alias("episode"), n.alias("n")).select("episode", "n.reason", F.array_join(F.transform("n.frames", lambda f: f.cast("string")), ",").alias("frames"))


# --- annotations and their audits -------------------------------------------------------------------------


def annotations(t: Tables) -> DataFrame:
    e, k = episodes(t), F.col("k")
    x, none = F.col("x"), F.lit(None).cast("string")
    pick, place, shut = skill("PICKUP_FROM", x, "table"), skill("PLACE_ON", x, "shelf"), skill("CLOSE", "drawer")
    plan = (
        F.when(k == 1, F.concat(F.lit("1. "), pick, F.lit(" 3. "), place))
        .when(k == 3, F.concat(F.lit("1. "), place, F.lit(" 2. "), pick))
        .otherwise(F.concat(F.lit("1. "), pick, F.lit(" 2. "), place))
    )

    def seg(start, end, s, content=none, updated=none, seg_plan=none):
        lit = lambda v: (F.lit(v) if isinstance(v, int) else v).cast("bigint")
        return F.struct(
            lit(start).alias("start_step"), lit(end).alias("end_step"), none.alias("instruction"), seg_plan.alias("plan"), s.alias("skill"), updated.alias("updated_skill"),
            content.alias("content"), none.alias("updated_content"), none.alias("updated_content_w_instruction"),
            F.lit(None).cast("array<double>").alias("state"), F.lit(None).cast("array<double>").alias("action"),
        )

    first = seg(0, 10, pick, F.when(k == 8, F.concat(F.lit("do "), shut)), F.when(k == 9, shut))
    second = seg(
        F.when(k == 6, 11).otherwise(10), F.when(k == 7, 19).otherwise(20),
        F.when(k == 4, shut).when(k == 5, "FLY(x)").otherwise(place), seg_plan=F.when(k == 10, F.concat(F.lit("1. "), pick)),
    )
    swapped = F.array(seg(0, 10, place), seg(10, 20, pick))
    long = F.array(seg(0, 5, pick), seg(5, 10, pick), seg(10, 20, place))
    segments = F.when(k == 2, F.array().cast(f"array<{schemas.SEGMENT}>")).when(k == 3, swapped).when(k == 11, long).otherwise(F.array(first, second))
    return e.withColumns({"plan": plan, "segments": segments, "num_steps": F.lit(20).cast("bigint"), "instruction": F.concat(F.lit("move "), x), "source": F.lit("orders")})


VIOLATIONS = {
    "libero": """SELECT episode, NULL AS position, 'plan_bad_numbering' AS rule FROM b WHERE k = 1 UNION ALL SELECT episode, NULL, 'no_segments' FROM b WHERE k = 2
  UNION ALL SELECT episode, NULL, 'first_is_place' FROM b WHERE k = 3 UNION ALL SELECT episode, NULL, 'compressed_not_plan' FROM b WHERE k = 4 UNION ALL SELECT episode, 1, 'skill_not_in_plan' FROM b WHERE k = 4
  UNION ALL SELECT episode, 1, 'invalid_skill' FROM b WHERE k = 5 UNION ALL SELECT episode, 0, 'stray_in_content' FROM b WHERE k = 8 UNION ALL SELECT episode, 0, 'updated_skill_not_in_plan' FROM b WHERE k = 9
  UNION ALL SELECT episode, 1, 'segment_plan_differs' FROM b WHERE k = 10""",
}
VIOLATIONS["table"] = VIOLATIONS["libero"].replace("SELECT episode, 0, 'stray_in_content' FROM b WHERE k = 8 UNION ALL SELECT episode, 0, 'updated_skill_not_in_plan'", "SELECT episode, 0, 'invalid_updated_skill'").replace(
    "UNION ALL SELECT episode, NULL, 'compressed_not_plan' FROM b WHERE k = 4 UNION ALL SELECT episode, 1, 'skill_not_in_plan' FROM b WHERE k = 4", "UNION ALL SELECT episode, 1, 'invalid_skill' FROM b WHERE k = 4"
) + """ UNION ALL SELECT episode, NULL, 'last_is_not_place' FROM b WHERE k = 3
  UNION ALL SELECT episode, NULL, 'not_contiguous' FROM b WHERE k = 6 UNION ALL SELECT episode, NULL, 'last_end_not_num_steps' FROM b WHERE k = 7"""


@query(f"WITH b AS ({BASE}) SELECT episode, CAST(position AS BIGINT) AS position, rule FROM ({VIOLATIONS['libero']})")
def audit_annotations_libero(t: Tables):
    return AU.audit_annotations(annotations(t), "libero").select("episode", "position", "rule")


@query(f"WITH b AS ({BASE}) SELECT episode, CAST(position AS BIGINT) AS position, rule FROM ({VIOLATIONS['table']})")
def audit_annotations_table(t: Tables):
    return AU.audit_annotations(annotations(t), "table").select("episode", "position", "rule")


CALVIN_PLANS = ["1. PICKUP_FROM(red block, table) 2. PLACE_IN(drawer)", "1. OPEN(drawer) 2. PLACE_ON(table)", "1. PICKUP_FROM(red block, table) 2. OPEN(drawer)",
                "1. PICKUP_FROM(red block, table) 2. PLACE_ON(the Red Block)", "1. PICKUP_FROM(a, table) 2. TURN_OBJECT(a, left)", "1. TURN_OBJECT(a, left) 2. PLACE_ON(table)", "1. PLACE_ON(table) 2. MOVE_SLIDER(up)"]


@query(f"""WITH b AS (SELECT episode, k % 7 AS k FROM ({BASE})) SELECT episode, 'needs_held_object' AS rule FROM b WHERE k = 1 UNION ALL SELECT episode, 'needs_free_gripper' FROM b WHERE k = 2
  UNION ALL SELECT episode, 'placed_on_itself' FROM b WHERE k = 3 UNION ALL SELECT episode, 'turn_while_holding' FROM b WHERE k = 4 UNION ALL SELECT episode, 'turn_after_pick' FROM b WHERE k = 4
  UNION ALL SELECT episode, 'turn_before_place' FROM b WHERE k = 5 UNION ALL SELECT episode, 'needs_held_object' FROM b WHERE k = 5 UNION ALL SELECT episode, 'plan_bad_direction' FROM b WHERE k = 6
  UNION ALL SELECT episode, 'bad_action' FROM b WHERE k = 0""")
def audit_annotations_calvin(t: Tables):
    plans = F.array(*[F.lit(p) for p in CALVIN_PLANS])
    e = episodes(t).withColumn("k", F.col("k") % 7).withColumn("plan", F.get(plans, F.col("k")))
    skills = X.parse_plan_raw(F.col("plan"))
    nums = lambda n: F.array_repeat(F.lit(0.5), n)
    none = F.lit(None).cast("string")
    segs = F.transform(skills, lambda s, i: F.struct(
        (i * 10).cast("bigint").alias("start_step"), (i * 10 + 10).cast("bigint").alias("end_step"), none.alias("instruction"), none.alias("plan"), s.alias("skill"), none.alias("updated_skill"),
        none.alias("content"), none.alias("updated_content"), none.alias("updated_content_w_instruction"), nums(15).alias("state"), F.when((F.col("k") == 0) & (i == 1), nums(6)).otherwise(nums(7)).alias("action")))
    a = e.withColumns({"segments": segs, "num_steps": F.lit(20).cast("bigint")})
    return AU.audit_annotations(a, "calvin").select("episode", "rule")


@query(f"""WITH b AS ({BASE}), v AS (SELECT episode, rule FROM ({VIOLATIONS['libero']})) SELECT rule, count(*) AS failures, count(DISTINCT episode) AS episodes FROM v GROUP BY ROLLUP (rule)""")
def violation_totals(t: Tables):
    from demospan.operators.aggregates import violation_summary

    return violation_summary(AU.audit_annotations(annotations(t), "libero"))


@query(f"""WITH b AS ({BASE}), v AS (SELECT episode FROM ({VIOLATIONS['libero']})) SELECT (SELECT count(*) FROM b) AS episodes, count(*) AS failures, count(DISTINCT episode) AS failed_episodes, count(*) = 0 AS ok FROM v""")
def audit_report(t: Tables):
    a = annotations(t)
    return AU.report(AU.audit_annotations(a, "libero"), a)


@query(f"""WITH b AS ({BASE}), s AS (SELECT episode, x, unnest([0, 1]) AS seg_index FROM b WHERE k IN (0, 5, 11))
  SELECT episode, seg_index, part, start_step, end_step, CASE WHEN part = 'boundary' THEN 'Instruction: move ' || x || chr(10) || pl ELSE 'Instruction: move ' || x || chr(10) || pl || 'Current skill: ' || skill || chr(10) END AS content,
    CASE WHEN part = 'boundary' THEN pl || 'Current skill: ' || skill || chr(10) END AS updated_content FROM (SELECT s.*, p.part, p.s + CASE WHEN seg_index = 1 THEN 12 ELSE 0 END AS start_step, CASE WHEN p.part = 'boundary' THEN p.s + 10 + CASE WHEN seg_index = 1 THEN 12 ELSE 0 END ELSE CASE WHEN seg_index = 1 THEN 40 ELSE 12 END END AS end_step,
      'Plan: 1. PICKUP_FROM(' || x || ', table) 2. PLACE_ON(' || x || ', shelf)' || chr(10) AS pl, CASE WHEN seg_index = 0 THEN 'PICKUP_FROM(' || x || ', table)' ELSE 'PLACE_ON(' || x || ', shelf)' END AS skill
    FROM s CROSS JOIN (VALUES ('boundary', 0), ('action', 10)) p(part, s))""")
def training_segments(t: Tables):
    n = X.once(answers(t), "n", AN.normalize_steps(F.col("response"), F.col("num_steps"), "libero")).filter(F.col("n.reason").isNull())
    a = n.select("episode_index", F.concat(F.lit("move "), "x").alias("instruction"), "n.plan", "n.segments")
    s = CO.training_segments(a, "libero", 10)
    cast = {c: F.col(c).cast("int") for c in ("start_step", "end_step", "seg_index")}
    return s.withColumns(cast).select(F.col("episode_index").alias("episode"), "seg_index", "part", "start_step", "end_step", "content", "updated_content")


@query(f"""WITH {SEGMENTS} SELECT episode, CAST(floor(seg_index / 4) AS BIGINT) AS part, count(*) AS n, min(start_step) AS first_start, max(end_step) AS last_end FROM segments GROUP BY 1, 2""")
def nested_segments(t: Tables):
    """Episodes as rows with segment arrays in parts of at most four, and back again."""
    s = t.segments.df.select("episode", "seg_index", "start_step", "end_step", "verb")
    n = nest_segments(s, ["episode"], ["start_step", "end_step", "verb"], chunk=4)
    e = explode_segments(n.select("episode", "part", F.transform("segments", lambda x: F.struct(x["start_step"], x["end_step"])).alias("segments")), ["episode", "part"])
    return e.groupBy("episode", "part").agg(F.count(F.lit(1)).alias("n"), F.min("start_step").alias("first_start"), F.max("end_step").alias("last_end"))


# --- selection -----------------------------------------------------------------------------------------------


@query(f"""WITH b AS ({BASE}) SELECT episode FROM b WHERE k IN (0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11) AND x LIKE '%i%'""")
def select_by_verbs(t: Tables):
    a = annotations(t).withColumn("task_name", F.upper("x"))
    s = select_episodes(a, "libero", plan_size=2, keyword="I", must_contain=["place_on", "PICKUP_FROM"], skill_at=[(1, "pickup_from")])
    return s.select(F.col("episode_index").alias("episode"))


@query(f"""WITH b AS ({BASE}) SELECT episode, k <> 3 AS pick_first, x LIKE '%ur%' AS keyword, true AS has_both FROM b""")
def select_skill_at(t: Tables):
    verbs = F.transform(skills_of(F.col("plan")), lambda s: X.skill_verb_lenient(s))
    a = annotations(t).withColumn("v", verbs)
    return a.select(F.col("episode_index").alias("episode"), verbs_at(F.col("v"), [(1, "PICKUP_FROM"), (2, "PLACE_ON")], "libero").alias("pick_first"),
                    has_keyword(F.col("x"), " UR ").alias("keyword"), has_all_verbs(F.col("v"), ["PLACE_ON", "PICKUP_FROM"], "libero").alias("has_both"))


# --- feasibility ------------------------------------------------------------------------------------------------

FEASIBLE = ["1. PICKUP_FROM(cup, table) 2. PLACE_ON(cup, shelf)", "1. PLACE_ON(cup, shelf) 2. OPEN(drawer)", "1. OPEN(drawer) 2. PICKUP_FROM(cup, table) 3. PLACE_IN(cup, drawer) 4. CLOSE(drawer)",
            "1. PICKUP_FROM(cup, table) 2. PLACE_IN(cup, drawer)", "1. PICKUP_FROM(cup, table) 2. OPEN(drawer)", "1. TURN_ON(stove) 2. TURN_OFF(stove) 3. TURN_ON(lamp)", "1. PICKUP_FROM(pen, drawer)",
            "1. OPEN(drawer) 2. PICKUP_FROM(pen, drawer) 3. PLACE_ON(pen, table) 4. PICKUP_FROM(cup, table) 5. PLACE_ON(cup, pen)", "1. PICKUP_FROM(cup, table) 2. PLACE_ON(cup, pen)",
            "1. OPEN(drawer) 2. OPEN(drawer)", "1. PICKUP_FROM(cup, table) 2. PLACE_ON(cup, shelf) 3. PICKUP_FROM(cup, table)", "1. CLOSE(drawer)"]


@query(f"""WITH b AS (SELECT *, episode AS o FROM ({BASE})) SELECT episode, CAST(CASE WHEN o % 9 <= 1 THEN NULL WHEN k = 0 THEN NULL ELSE CASE k WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 3 WHEN 6 THEN 1 WHEN 8 THEN 2 WHEN 9 THEN 2 WHEN 10 THEN 3 WHEN 11 THEN 1 END END AS BIGINT) AS failed_step,
  k IN (0, 2, 7) AND o % 9 > 1 AS feasible, CASE WHEN o % 9 = 0 THEN 'plan_missing' WHEN o % 9 = 1 THEN 'plan_bad_numbering' ELSE CASE k WHEN 1 THEN 'needs carry cup' WHEN 3 THEN 'needs open drawer' WHEN 4 THEN 'needs free' WHEN 5 THEN 'needs switchable lamp' WHEN 6 THEN 'needs on pen drawer' WHEN 8 THEN 'must not be in pen *'
   WHEN 9 THEN 'needs closed drawer' WHEN 10 THEN 'needs on cup table' WHEN 11 THEN 'needs open drawer' END END AS reason FROM b""")
def audit_plans(t: Tables):
    kind = F.col("episode_index") % 9
    sound = F.get(F.array(*[F.lit(p) for p in FEASIBLE]), F.col("k"))
    e = episodes(t).withColumn("plan", F.when(kind == 1, "1. OPEN(drawer) 3. CLOSE(drawer)").when(kind != 0, sound))
    start = [("free", "", ""), ("on", "cup", "table"), ("in", "pen", "drawer"), ("closed", "drawer", ""), ("openable", "drawer", ""), ("switchable", "stove", "")]
    facts = e.select(F.col("episode_index").alias("episode"), F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("name", "first", "second"), f)]) for f in start])).alias("f")).select("episode", "f.*")
    r = FE.audit_plan_texts(e, facts, "libero", key="episode_index")
    return r.select("episode", "failed_step", "feasible", F.regexp_replace("reason", " +$", "").alias("reason"))


# --- targets -----------------------------------------------------------------------------------------------------

TARGETS = f"""{SEGMENTS}, n AS (SELECT episode, count(*) AS c FROM segments GROUP BY 1), a AS (SELECT s.episode, s.seg_index, c, l_suppkey, l_linenumber,
    CASE WHEN seg_index >= c - 1 AND c > 5 THEN 'list_too_short' WHEN l_linenumber = 7 THEN 'no_target' WHEN l_linenumber = 6 THEN 'no_grounding_point' END AS reason FROM segments s JOIN n USING (episode))"""


def attached(t: Tables) -> DataFrame:
    s = t.segments.df.select("episode", "seg_index", "l_suppkey", "l_linenumber")
    sizes = t.raw_segments.groupBy("episode").agg(F.count(F.lit(1)).alias("c"))
    listed = F.when(F.col("c") > 5, F.col("c") - 1).otherwise(F.col("c"))
    point = F.when(F.col("l_linenumber") != 6, F.array(F.lit(1.0), F.lit(2.0)))
    target = F.when(F.col("l_linenumber") != 7, F.struct(F.lit("movable").alias("type"), F.col("l_suppkey").cast("string").alias("id"), F.lit("red").alias("appearance"), F.lit("left").alias("location"), point.alias("image_point")))
    targets = s.join(sizes.withColumn("listed", listed), "episode").filter(F.col("seg_index") < F.col("listed")).select("episode", F.col("seg_index").alias("position"), "listed", target.alias("target"))
    return TG.attach_targets(s, targets)


@query(f"""WITH {TARGETS}, g AS (SELECT episode, bool_or(reason <> 'list_too_short') AS other FROM a WHERE reason IS NOT NULL GROUP BY 1)
  SELECT episode, seg_index, reason FROM a JOIN g USING (episode) WHERE reason IS NOT NULL AND (reason <> 'list_too_short' OR NOT other)""")
def target_failures(t: Tables):
    return TG.reasons(attached(t))


@query(f"""WITH {TARGETS} SELECT episode, seg_index, CASE WHEN reason IN ('list_too_short', 'no_target') THEN 'NULL' ELSE CAST(l_suppkey AS VARCHAR) END AS id, CASE WHEN reason IS NULL THEN 'left' ELSE 'NULL' END AS location,
  CASE WHEN reason IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS px FROM a""")
def patched_targets(t: Tables):
    p = TG.patch_targets(attached(t))
    return p.select("episode", "seg_index", "target.id", "target.location", F.get("target.image_point", F.lit(0)).alias("px"))


# --- structured texts ----------------------------------------------------------------------------------------------


def cot_segments(t: Tables) -> DataFrame:
    text = F.expr(COT)
    has_update = F.col("p_size") % 3 == 0
    # a part is a few bytes of a file and its texts take long to check
    return spread(t.part.select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey").select(
        F.col("p_partkey").alias("episode"), "p_name", "p_size", F.lit(0).alias("start_step"), F.col("p_size").alias("end_step"),
        text.alias("content"), F.when(has_update, text).alias("updated_content"), F.when(has_update, text).alias("updated_content_w_instruction"), F.lit(None).cast("string").alias("current_skill"))


@query(f"""WITH c AS (SELECT p_partkey AS episode, p_size, p_name, p_size % 11 <> 0 AND p_size % 7 <> 0 AS sound FROM part)
  SELECT episode, CASE WHEN sound THEN 'PICK(' || p_name || ')' END AS skill, CASE WHEN sound AND p_size % 3 = 0 THEN 'PICK(' || p_name || ')' END AS updated_skill, CASE WHEN NOT sound THEN 'now_not_single' END AS reason FROM c""")
def repair_texts(t: Tables):
    good, bad = CT.repair(cot_segments(t), ["episode"])
    g = good.select("episode", "skill", "updated_skill", F.lit(None).cast("string").alias("reason"))
    return g.unionByName(bad.select("episode", F.lit(None).cast("string").alias("skill"), F.lit(None).cast("string").alias("updated_skill"), "reason"))


@query(f"""WITH c AS (SELECT p_partkey AS episode, p_size, p_size % 11 <> 0 AND p_size % 7 <> 0 AS sound, p_size % 11 <> 0 AS marked, unnest(['content', 'updated_content', 'updated_content_w_instruction']) AS field FROM part)
  SELECT episode, field, CASE WHEN NOT sound THEN 'missing_markers' ELSE 'done_not_in_plan' END AS reason FROM c WHERE marked AND (field = 'content' OR p_size % 3 = 0) AND (NOT sound OR p_size % 4 = 3)""")
def convert_texts(t: Tables):
    """A stand-in for the model that gives the texts back: what breaks the rules must be reported."""
    s = cot_segments(t)
    return CT.convert(s, CT.fields_to_convert(s, ["episode"]), ["episode"])[1]


@query(f"""WITH c AS (SELECT p_partkey AS episode, p_size, p_name, p_size % 11 <> 0 AND p_size % 7 <> 0 AS sound FROM part WHERE p_size % 11 <> 0 AND p_size % 7 <> 0)
  SELECT episode, 'end_step' AS field, 'changed' AS rule FROM c WHERE p_size = 13 UNION ALL SELECT episode, 'content', 'invalid_plan_item' FROM c WHERE p_size <> 26
  UNION ALL SELECT episode, 'content', 'missing_markers' FROM c WHERE p_size = 26 UNION ALL SELECT episode, 'updated_content', 'invalid_plan_item' FROM c WHERE p_size % 3 = 0
  UNION ALL SELECT episode, 'updated_content_w_instruction', 'invalid_plan_item' FROM c WHERE p_size % 3 = 0
  UNION ALL SELECT episode, 'updated_content_w_instruction', 'not_instruction_plus_tail' FROM c WHERE p_size % 3 = 0 AND p_size % 2 <> 0
  UNION ALL SELECT episode, 'skill', 'not_now_item' FROM c WHERE p_size = 26
  UNION ALL SELECT p_partkey, '*', 'missing_right' FROM part WHERE p_size % 11 = 0 OR p_size % 7 = 0""")
def diff_texts(t: Tables):
    """Unconverted texts against themselves after a repair: items with trailing words are no skills."""
    s = cot_segments(t)
    new, _ = CT.repair(s, ["episode"])
    new = new.withColumns({"end_step": F.when(F.col("p_size") == 13, 0).otherwise(F.col("end_step")), "content": F.when(F.col("p_size") == 26, "lost").otherwise(F.col("content"))})
    return CT.diff(s, new, ["episode"])


@query("""SELECT p_partkey AS episode, CASE WHEN p_size % 3 = 0 THEN 'p_name' ELSE 'weight' END AS field, 'changed' AS rule FROM part WHERE p_size % 11 <> 0 AND p_size % 7 <> 0 AND p_size % 3 < 2
  UNION ALL SELECT p_partkey, 'tags', 'changed' FROM part WHERE p_size % 11 <> 0 AND p_size % 7 <> 0""")
def untranslated_fields(t: Tables):
    """Names and weights changed by a conversion, and a column that it lost; other fields stay."""
    s = cot_segments(t).withColumns({"weight": F.col("p_size") * 0.5, "tags": F.array("p_name")})
    new, _ = CT.repair(s, ["episode"])
    third = F.col("p_size") % 3
    new = new.withColumns({"p_name": F.when(third == 0, F.lit(None).cast("string")).otherwise(F.col("p_name")), "weight": F.when(third == 1, F.col("weight") + 1).otherwise(F.col("weight"))})
    return CT.diff(s, new.drop("tags"), ["episode"]).filter(F.col("field").isin("p_name", "weight", "tags", "start_step", "end_step", "p_size"))


@query("""SELECT p_partkey AS episode_index, CASE p_size % 5 WHEN 1 THEN 'bad_numbering' WHEN 2 THEN 'no_plan' WHEN 3 THEN 'empty_plan' WHEN 4 THEN 'unknown_verb' END AS rule, CASE WHEN p_size % 5 = 0 THEN 2 ELSE 0 END AS parts FROM part""")
def training_violations(t: Tables):
    """Training texts of sound plans, and a row for every plan that does not parse."""
    kind, opened = F.col("p_size") % 5, F.concat(F.lit("OPEN("), "p_name", F.lit(")"))
    plan = F.when(kind == 0, F.concat(F.lit("1. "), opened)).when(kind == 1, F.concat(F.lit("2. "), opened)).when(kind == 3, "Plan: ").when(kind == 4, F.concat(F.lit("1. FLY("), "p_name", F.lit(")")))
    segment = F.struct(F.lit(0).cast("bigint").alias("start_step"), F.lit(40).cast("bigint").alias("end_step"), opened.alias("skill"))
    a = t.part.select(F.col("p_partkey").alias("episode_index"), F.lit("i").alias("instruction"), plan.alias("plan"), F.array(segment).alias("segments"))
    parts, wrong = CO.training(a, "libero")
    made = parts.filter("content IS NOT NULL").groupBy("episode_index").agg(F.count("*").cast("int").alias("parts"))
    return a.select("episode_index").join(wrong, "episode_index", "left").join(made, "episode_index", "left").select("episode_index", "rule", F.coalesce("parts", F.lit(0)).alias("parts"))


@query("""SELECT p_partkey AS episode_index, CASE WHEN p_size % 4 = 1 THEN 'no_frame' WHEN p_size % 4 = 2 THEN 'plan_not_equal_steps' END AS reason,
  CASE WHEN p_size % 4 IN (0, 3) THEN CAST(p_size AS DOUBLE) + 9 END AS x, CASE WHEN p_size % 4 IN (0, 3) THEN 10 END AS fps FROM part""")
def annotation_rows_with_states(t: Tables):
    """Annotations whose segments carry the state and action of their last frame; answers without a frame or with another plan are reasons."""
    kind = F.col("p_size") % 4
    e = t.part.select(F.col("p_partkey").alias("episode_index"), F.lit(1).cast("bigint").alias("task_index"), F.lit("t").alias("task_name"), F.lit("raw").alias("raw_instruction"), F.col("p_name").alias("instruction"), F.lit(10).cast("bigint").alias("length"), "p_size")
    opened = "OPEN(drawer)"
    answer = F.to_json(F.struct(F.when(kind == 2, "1. CLOSE(drawer)").otherwise(f"1. {opened}").alias("plan"), F.array(F.struct(F.lit(opened).alias("skill"), F.lit(10).alias("end_step"))).alias("steps")))
    answers = e.select("episode_index", answer.alias("response"))
    frames = e.filter(kind != 1).select("episode_index", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("step"), "p_size")
    frames = frames.select("episode_index", F.col("step").cast("bigint").alias("step"), F.array((F.col("p_size") + F.col("step")).cast("double")).alias("state"), F.array(F.lit(0.0)).alias("action"))
    rows, wrong = AN.annotation_rows_with_frames(e.drop("p_size"), answers, frames, "libero", "m", "v1")
    good = rows.select("episode_index", F.lit(None).cast("string").alias("reason"), F.get("segments", F.lit(0))["state"][0].alias("x"), F.col("fps").cast("int").alias("fps"))
    return good.union(wrong.select("episode_index", "reason", F.lit(None).cast("double"), F.lit(None).cast("int")))


@query("""SELECT o_orderkey AS episode_index, o_custkey AS task_index, CASE WHEN o_custkey % 3 > 0 THEN 1 END AS entries, 'agentview' AS image_key, 224 AS image_width, CASE WHEN o_custkey % 3 = 0 THEN 'no_traces' END AS reason FROM orders""")
def trace_annotation_rows(t: Tables):
    """Skill episodes with their trace entries and the settings of the run; an episode without entries is a reason."""
    o = t.orders.select(F.col("o_orderkey").alias("episode_index"), F.col("o_custkey").alias("task_index"), F.lit("i").alias("instruction"), F.lit(5).cast("bigint").alias("num_steps"), F.lit(None).cast("bigint").alias("fps"), F.lit("1. OPEN(x)").alias("plan"), F.array(F.struct(F.lit(0).cast("bigint").alias("start_step"), F.lit(5).cast("bigint").alias("end_step"), F.lit("OPEN(x)").alias("skill"))).alias("segments"))
    entry = F.from_json(F.to_json(F.struct(F.lit(0).alias("skill_index"), F.lit("OPEN(x)").alias("skill"), F.lit(0).alias("start_step"), F.lit(5).alias("end_step"))), schemas.TRACE_ENTRY)
    entries = o.filter("task_index % 3 > 0").select("episode_index", F.lit(0).alias("seg_index"), entry.alias("entry"))
    rows, wrong = AN.trace_annotation_rows(o, entries, {"image_key": "agentview", "image_width": 224, "image_height": 224, "semantic_target_enabled": True}, "m", "v1")
    good = rows.filter("fps = 10").select("episode_index", "task_index", F.size("target_traces").alias("entries"), "image_key", F.col("image_width").cast("int").alias("image_width"), F.lit(None).cast("string").alias("reason"))
    gone = wrong.join(o, "episode_index").select("episode_index", "task_index", F.lit(None).cast("int"), F.lit("agentview"), F.lit(224), "reason")
    return good.union(gone)


# --- files, latents, probe -----------------------------------------------------------------------------------------


@query(f"""WITH {SEGMENTS}, e AS (SELECT episode, printf('episode_%06d/skill_%03d_start_step_%06d.png', episode, seg_index, start_step) AS name, l_linenumber FROM segments)
  SELECT episode, name FROM e WHERE l_linenumber > 5""")
def image_backfill(t: Tables):
    s = t.segments.df.select("episode", "seg_index", "start_step", "l_linenumber")
    have = TR.expected_files(s.filter(F.col("l_linenumber") <= 5)).select("name")
    return TR.backfill(s, have)


@query("""SELECT label AS episode, vec_id AS step, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, floor(CAST(embedding[(r * 4 + c) * 4 + 1] AS DOUBLE) * 1e5 + 0.5001) / 1e5 AS first FROM embeddings CROSS JOIN range(0, 4) x(r) CROSS JOIN range(0, 4) y(c)""")
def latent_patches(t: Tables):
    l = t.embeddings.select(F.col("label").alias("episode"), F.col("vec_id").alias("step"), "embedding")
    p = EN.patch_rows(l, 4, 4)
    return p.select("episode", "step", "row", "col", near(F.get("vec", F.lit(0)).cast("double"), 5).alias("first"))


class LengthEncoder:
    """A stand-in encoder: byte length and first byte of each image."""

    def encode(self, images: list[bytes]) -> np.ndarray:
        return np.array([[len(b), b[0] if b else 0] for b in images], dtype=np.float32)


@query("SELECT conv_id AS episode, turn AS step, CAST(octet_length(encode(text)) AS DOUBLE) AS size FROM conversations")
def encoded_frames(t: Tables):
    f = t.conversations.select(F.col("conv_id").alias("episode"), F.col("turn").alias("step"), F.encode("text", "UTF-8").alias("image"))
    return EN.encode_frames(f, LengthEncoder).select("episode", "step", F.get("embedding", F.lit(0)).cast("double").alias("size"))


@query()
def linear_probe_loss(t: Tables):
    """A linear probe from latents to two of their own sums: it must fit them exactly."""
    total = lambda a, n: F.aggregate(F.slice("embedding", a, n), F.lit(0.0), lambda s, x: s + x.cast("double"))
    data = t.embeddings.select(F.col("label").alias("step"), F.col("embedding").alias("vector"), F.array(total(1, 8), total(9, 8)).alias("pose"))
    models = PR.fit_linear_probe(data, 2)
    return PR.loss_by_step(data, models).select("step", "samples", (F.col("loss") < 1e-6).alias("fits"))
