"""Rows and texts of single operators, and files written to the shared folder and read back.

Where an operator has two inputs and the tables offer one, the second is a filtered or changed copy of the
first, so that every case occurs; the SQL says so in the same words.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from demospan.functions import geometry as G, text as X
from demospan.operators import bounds as B, frames as FR, progress as P
from demospan.plans import annotate as AN, audit as AU, detections as DE, feasibility as FE, select as SE, targets as TG, traces as TR
from demospan.session import shared_folder
from demospan.sources import readers as R, sinks as W

from .q_segments import bounds
from .registry import query
from .tables import FRAMES, SEGMENTS, Tables, near


def folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/files-{uuid4().hex}"


# --- files ---------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS task_index, p_name AS task FROM part")
def read_task_list(t: Tables):
    root = folder(t)
    t.part.select(F.col("p_partkey").alias("task_index"), F.col("p_name").alias("task")).write.json(f"{root}/meta/tasks.jsonl")
    return R.read_tasks(t.spark, root).select("task_index", "task")


@query("SELECT o_orderkey AS episode_index, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS instruction, o_custkey AS length FROM orders")
def read_episode_list(t: Tables):
    """The first of several tasks, else the single one; both come with white space around."""
    root = folder(t)
    padded = lambda c: F.concat(F.lit("  "), c, F.lit("\n"))
    several = F.when(F.col("o_custkey") % 3 == 0, F.array(padded(F.col("o_orderpriority")), F.lit("second")))
    e = t.orders.select(F.col("o_orderkey").alias("episode_index"), several.alias("tasks"), padded(F.col("o_orderstatus")).alias("task"), F.col("o_custkey").alias("length"))
    e.write.json(f"{root}/meta/episodes.jsonl")
    return R.read_episodes(t.spark, root).select("episode_index", "instruction", "length")


@query("SELECT doc_id AS episode_index, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id AS VARCHAR) ELSE 'old' END AS instruction FROM documents")
def annotations_written_twice(t: Tables):
    """An episode written again replaces its rows, the others stay."""
    path = folder(t)
    a = t.documents.select(F.col("doc_id").alias("episode_index"), F.lit("old").alias("instruction"))
    W.write_annotations(a, path, buckets=16)
    W.write_annotations(a.filter("episode_index % 3 > 0").withColumn("instruction", F.col("episode_index").cast("string")), path, buckets=16)
    return t.spark.read.schema("episode_index bigint, instruction string").json(path).select("episode_index", "instruction")


@query("SELECT o_orderkey AS episode_index FROM orders WHERE o_orderstatus = 'F'")
def written_ids(t: Tables):
    path = folder(t)
    W.write_ids(t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("episode_index")), path)
    return t.spark.read.text(path).select(F.col("value").cast("bigint").alias("episode_index"))


@query("SELECT o_orderkey AS episode, o_orderstatus AS error FROM orders WHERE o_custkey % 5 = 0")
def written_errors(t: Tables):
    path = folder(t)
    W.write_errors(t.orders.filter(F.col("o_custkey") % 5 == 0).select(F.col("o_orderkey").alias("episode"), F.col("o_orderstatus").alias("error")), path)
    return t.spark.read.parquet(path)


@query("SELECT p_partkey AS episode_index, p_name AS instruction, p_size AS num_steps FROM part")
def combined_document_round_trip(t: Tables):
    """Written as one JSON document in parts, its lines read back entry by entry."""
    path = folder(t)
    a = t.part.select(F.col("p_partkey").alias("episode_index"), F.col("p_name").alias("instruction"), F.col("p_size").alias("num_steps"))
    W.write_document(a, t.spark.range(1).select(F.lit("v1").alias("schema_version")), path)
    rows, _, _ = R.read_document_parts(t.spark, path, "episode_index bigint, instruction string, num_steps int")
    return rows.drop("source")


@query("""SELECT o_orderkey AS episode_index, CASE WHEN o_orderkey % 7 = 0 THEN 'not_an_object' WHEN o_orderkey % 11 = 0 THEN 'unreadable' END AS reason,
    CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS num_steps FROM orders WHERE o_custkey % 50 <> 7
  UNION ALL SELECT DISTINCT -1, 'not_an_object', CAST(NULL AS BIGINT) FROM orders WHERE o_custkey % 50 = 7""")
def quarantined_entries(t: Tables):
    """Orders as entries of combined documents: some are no object, some have a field of the wrong type, one document is broken."""
    path = folder(t)
    key, doc = F.col("o_orderkey"), F.col("o_custkey") % 50
    entry = (
        F.when(key % 7 == 0, F.lit('["lost"]')).when(key % 11 == 0, F.concat(F.lit('{"num_steps": true, "instruction": "'), key, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"num_steps": '), "o_custkey", F.lit("}")))
    )
    line = F.concat(F.lit('"'), key, F.lit('": '), entry)
    docs = t.orders.select(doc.alias("doc"), line.alias("line")).groupBy("doc").agg(F.array_join(F.collect_list("line"), ",\n").alias("lines"))
    whole = F.concat(F.when(F.col("doc") == 7, F.lit("[")).otherwise(F.lit("{")), "lines", F.lit("}"))
    docs.select("doc", whole.alias("value")).repartition("doc").write.partitionBy("doc").text(path)
    rows, _, letters = R.read_combined_checked(t.spark, f"{path}/*")
    good = rows.select("episode_index", F.lit(None).cast("string").alias("reason"), "num_steps")
    bad = letters.select(F.coalesce(F.col("key").cast("bigint"), F.lit(-1)).alias("episode_index"), "reason", F.lit(None).cast("bigint").alias("num_steps"))
    return good.union(bad)


@query("SELECT p_partkey AS line, p_name AS plan FROM part")
def read_plan_lines(t: Tables):
    path = folder(t)
    t.part.select(F.concat(F.lit(" "), "p_partkey", F.lit(" "), "p_name", F.lit("  "))).toDF("value").write.text(path)
    plan = R.read_plan_samples(t.spark, path).select("plan")
    return plan.select(F.split_part("plan", F.lit(" "), F.lit(1)).cast("bigint").alias("line"), F.regexp_replace("plan", "^[0-9]+ ", "").alias("plan"))


@query("SELECT o_orderkey AS episode_idx, o_custkey AS task_id, o_orderstatus = 'F' AS success FROM orders WHERE o_custkey % 4 > 0")
def read_rollout_files(t: Tables):
    """Files of another suite are left out; a file holds the runs of one customer."""
    path = folder(t)
    run = F.struct(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("episode_idx"), (F.col("o_orderstatus") == "F").alias("success"))
    files = t.orders.groupBy("o_custkey").agg(F.collect_list(run).alias("completed_episodes"))
    suite = F.when(F.col("o_custkey") % 4 > 0, "own").otherwise("other")
    files.select(suite.alias("task_suite"), F.lit("m").alias("model_name"), "completed_episodes").write.json(path)
    rows, _ = R.read_rollouts(t.spark, path, "own")
    return rows.select("episode_idx", "task_id", "success")


@query("""SELECT o_custkey % 100 AS episode, count(*) OVER (PARTITION BY o_custkey % 100) AS listed, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) - 1 AS position,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey AS VARCHAR) END AS id, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS x FROM orders WHERE o_custkey % 100 < 40""")
def target_lists_round_trip(t: Tables):
    """Orders as targets, some null, some without a point, in a gzip list per episode; a filter on episodes opens their files only."""
    path = folder(t)
    point = F.when(F.col("o_orderstatus") == "F", F.array("o_totalprice", F.lit(0.0)))
    target = F.struct(F.lit("movable").alias("type"), F.col("o_orderkey").cast("string").alias("id"), F.lit("é").alias("appearance"), F.lit(None).cast("string").alias("location"), point.alias("image_point"))
    rows = t.orders.select((F.col("o_custkey") % 100).alias("episode"), F.col("o_orderkey").alias("seg_index"), F.when(F.col("o_orderstatus") != "P", target).alias("target"))
    W.write_targets(rows, path)
    back = R.read_target_lists(t.spark, path).filter(F.col("episode").isin(list(range(40))))
    return back.select("episode", "listed", "position", "target.id", F.get("target.image_point", F.lit(0)).alias("x"))


@query("""SELECT label AS episode, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS step, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding)] AS DOUBLE) AS last, CAST(len(embedding) AS INTEGER) AS n FROM embeddings""")
def latent_blocks_round_trip(t: Tables):
    """Embeddings as latents of their label's episode, in a compressed block each, read back in order."""
    path = folder(t)
    e = t.embeddings.select(F.col("label").alias("episode"), F.col("vec_id").alias("step"), F.col("embedding"), F.array(F.size("embedding")).alias("shape"))
    W.write_latent_blocks(e, path)
    v = F.col("embedding")
    return R.read_latents(t.spark, path).select("episode", "step", v[0].cast("double").alias("first"), F.element_at(v, -1).cast("double").alias("last"), F.get("shape", F.lit(0)).alias("n"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN p_name END AS target, CASE p_size % 4 WHEN 3 THEN NULL ELSE p_name END AS contact FROM part""")
def grounded_targets(t: Tables):
    """Object and destination of grounded actions: put down, pick up, put down without a destination, unknown."""
    kind = F.col("p_size") % 4
    name = F.when(kind == 0, "place_on").when(kind == 1, "pickup_from").when(kind == 2, "place_in").otherwise("wave")
    p = F.when(kind == 2, F.array("p_name", F.lit("robot"))).otherwise(F.array("p_name", F.lit("robot"), "p_type"))
    g = X.grounded_target_objects(name, p)
    return t.part.select("p_partkey", g["target"].alias("target"), g["contact"].alias("contact"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS skills, CASE p_size % 4 WHEN 2 THEN 'no_known_skill' WHEN 3 THEN 'no_plan' END AS reason FROM part""")
def plan_answers(t: Tables):
    """Answers that hold a plan alone: two skills, one of two known, none known, no plan."""
    kind = F.col("p_size") % 4
    one, two, other = (F.concat(F.lit(v + "("), "p_name", F.lit(")")) for v in ("OPEN", "CLOSE", "FLY"))
    plan = F.when(kind == 0, F.concat(F.lit("1. "), one, F.lit(" 2. "), two)).when(kind == 1, F.concat(F.lit("1. "), one, F.lit(" 2. "), other)).when(kind == 2, F.concat(F.lit("1. "), other))
    a = AN.plan_answer(F.to_json(F.struct(plan.alias("plan"))), "libero")
    return t.part.select("p_partkey", F.nullif(F.coalesce(F.size(a["skills"]), F.lit(-1)), F.when(kind == 3, F.coalesce(F.size(a["skills"]), F.lit(-1)))).alias("skills"), a["reason"].alias("reason"))


# --- single values -------------------------------------------------------------------------------------


@query("""SELECT s_suppkey, floor(s_suppkey * 1e3 + 0.5001) / 1e3 AS x, floor(s_acctbal * 1e3 + 0.5001) / 1e3 AS rz, CASE WHEN s_nationkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS g, 7 AS n FROM supplier""")
def state_vectors(t: Tables):
    """Position, rotation and gripper in one list."""
    three = lambda c: F.array(c.cast("double"), F.lit(0.0), c.cast("double"))
    v = G.state_vector(three(F.col("s_suppkey")), three(F.col("s_acctbal")), F.array((F.col("s_nationkey") % 2 == 0).cast("double")))
    s = t.supplier.select("s_suppkey", v.alias("v"))
    return s.select("s_suppkey", near(F.get("v", F.lit(0)), 3).alias("x"), near(F.get("v", F.lit(5)), 3).alias("rz"), F.get("v", F.lit(6)).alias("g"), F.size("v").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN l_discount WHEN l_returnflag = 'N' THEN l_quantity / 255.0 END AS x,
  CASE WHEN l_returnflag = 'A' THEN l_tax WHEN l_returnflag = 'N' THEN l_linenumber / 1.0 END AS y FROM lineitem""")
def point_fallback(t: Tables):
    """Given fractions, else the pixel by the image size (an image one row high divides by one), else nothing."""
    flag = F.col("l_returnflag")
    xy = F.when(flag == "A", F.array("l_discount", "l_tax"))
    pixel = F.when(flag == "N", F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")))
    p = G.point_xy(xy, pixel, F.lit(256), F.lit(1))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name END AS name, CASE p_size % 6 WHEN 0 THEN p_type || ',' || p_brand WHEN 1 THEN '' WHEN 2 THEN '' END AS parameters FROM part""")
def grounded_actions(t: Tables):
    """Name and texts, trimmed; none, an empty list, a number among them, no name, and broken JSON."""
    name, first, second = (F.concat(F.lit(" "), F.col(c), F.lit(" ")) for c in ("p_name", "p_type", "p_brand"))
    kind = F.col("p_size") % 6
    action = (F.when(kind == 0, F.to_json(F.struct(name.alias("name"), F.array(first, second).alias("parameters"))))
              .when(kind == 1, F.to_json(F.struct(name.alias("name")))).when(kind == 2, F.to_json(F.struct(name.alias("name"), F.array().cast("array<string>").alias("parameters"))))
              .when(kind == 3, F.to_json(F.struct(name.alias("name"), F.array("p_size").alias("parameters")))).when(kind == 4, F.to_json(F.struct(F.array(first).alias("parameters")))).otherwise("{"))
    a = X.grounded_action(action)
    return t.part.select("p_partkey", a["name"].alias("name"), F.array_join(a["parameters"], ",").alias("parameters"))


@query("""SELECT p_partkey, '(:objects' || chr(10) || '  ' || p_name || ' - part' || chr(10) || ')' || chr(10) || '(:state' || chr(10) || '  in(' || p_name || ')' || chr(10) || '  key(' || p_partkey || ')' || chr(10) || ')' AS state FROM part""")
def state_texts(t: Tables):
    facts = F.array(F.concat(F.lit("key("), F.col("p_partkey").cast("string"), F.lit(")")), F.concat(F.lit("in("), "p_name", F.lit(")")))
    return t.part.select("p_partkey", X.state_text(F.array(F.concat("p_name", F.lit(" - part"))), facts).alias("state"))


@query("SELECT p_partkey, 'Plan: ' || p_name || ' Current step: ' || p_size || '. ' || p_type AS prompt FROM part")
def online_prompts(t: Tables):
    return t.part.select("p_partkey", X.online_prompt(F.col("p_name"), F.col("p_size"), F.col("p_type")).alias("prompt"))


PROMPT = AN.PROMPTS["target"].replace("'", "''")


@query(f"""SELECT p_partkey, replace(replace(replace(replace('{PROMPT}', '{{skill}}', p_name), '{{object}}', p_type), '{{policy}}', p_brand), '{{grid}}', CAST(p_size AS VARCHAR)) AS prompt FROM part""")
def target_prompts(t: Tables):
    p = AN.prompt_text("target", skill=F.col("p_name"), object=F.col("p_type"), policy=F.col("p_brand"), grid=F.col("p_size"))
    return t.part.select("p_partkey", p.alias("prompt"))


POLICY = "CASE l_returnflag WHEN 'A' THEN '{}' WHEN 'R' THEN '{}' ELSE '{}' END".format(*[AN.POLICIES["contact"][AN.VERB_GROUP[v]] for v in ("PICKUP_FROM", "OPEN", "TURN_ON")])


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {POLICY} AS policy FROM lineitem")
def contact_policies(t: Tables):
    """What to point at, by the group of the verb."""
    verb = F.when(F.col("l_returnflag") == "A", "PICKUP_FROM").when(F.col("l_returnflag") == "R", "OPEN").otherwise("TURN_ON")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", AN.policy_text(verb, "contact").alias("policy"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 1 THEN 'observation.images.top' WHEN 2 THEN 'observation.images.wrist' WHEN 3 THEN 'observation.images.wrist' END AS stream,
  CASE p_size % 3 WHEN 0 THEN 'agentview' WHEN 1 THEN 'robot0_eye_in_hand' END AS camera FROM part""")
def image_streams(t: Tables):
    """Aliases of image streams and the camera of a stream; an unknown one gives null."""
    pick = lambda names: F.get(F.array(*[F.lit(x) for x in names]), (F.col("p_size") % len(names)).cast("int"))
    stream = R.image_stream(pick(["none", "top", "wrist", "observation.images.wrist", "side"]))
    return t.part.select("p_partkey", stream.alias("stream"), R.camera_of_stream(pick(["image", "wrist_image", "depth"])).alias("camera"))


@query("SELECT p_partkey, replace(lower(p_name), ' ', '_') AS object_id, replace(lower(p_type), ' ', '_') AS type, p_brand AS appearance, 'size ' || p_size AS location FROM part WHERE p_size % 5 > 0")
def scene_object_rows(t: Tables):
    """Parts as object lines, some of which are facts and no objects."""
    name = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    line = F.concat(F.lit("("), name("p_name"), F.when(F.col("p_size") % 5 > 0, F.lit(" - ")).otherwise(" on "), name("p_type"), F.lit(") ; "), "p_brand", F.lit(" | size "), "p_size")
    return R.scene_objects(t.part.select("p_partkey", line.alias("value"))).select("p_partkey", "object_id", "type", "appearance", "location")


# --- selections ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS episode FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400")
def episode_range(t: Tables):
    """A range that begins below zero is clamped elsewhere (tests); here both ends lie inside."""
    return t.orders.filter(SE.in_range(F.col("o_orderkey"), 100, 400, 10_000)).select(F.col("o_orderkey").alias("episode"))


@query("SELECT p_partkey FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def exact_task(t: Tables):
    """Names with their white space blown up still match."""
    wanted = t.part.agg(F.min("p_name")).first()[0]
    return t.part.filter(SE.has_task(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \n ")), F.lit(" ")), wanted)).select("p_partkey")


HIGH_BOX = "l_extendedprice >= 30000"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS f FROM lineitem) WHERE {HIGH_BOX} OR l_linenumber = f""")
def high_detections(t: Tables):
    """The height counts only once a frame has an earlier detection."""
    d = t.lineitem.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("rank"), F.col("l_extendedprice").alias("y"), "l_partkey", "l_suppkey")
    return DE.high_enough(d, 30000.0, only_with_tracks=True).select(F.col("frame").alias("l_orderkey"), F.col("rank").alias("l_linenumber"), "l_partkey", "l_suppkey")


@query("""WITH h AS (SELECT n_nationkey % 5 AS fps FROM nation WHERE n_nationkey < 1)
  SELECT o_orderkey AS episode, CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE 7 END AS width, CASE WHEN o_custkey % 3 = 0 THEN o_custkey ELSE 256 END AS height, CASE WHEN o_custkey % 5 = 0 THEN o_custkey ELSE 9 END AS fps FROM orders""")
def header_fallback(t: Tables):
    """The row's value, else the one on which all header rows agree, else the default; a disputed one is no value."""
    v = lambda n: F.when(F.col("o_custkey") % n == 0, F.col("o_custkey"))
    rows = t.orders.select(F.col("o_orderkey").alias("episode"), v(2).alias("width"), v(3).alias("height"), v(5).alias("fps"))
    kind = "bigint"
    header = t.nation.select(F.lit(7).cast(kind).alias("width"), F.lit(None).cast(kind).alias("height"), F.col("n_nationkey").cast(kind).alias("fps"))
    return AU.with_header(rows, header, {"width": F.lit(1), "height": F.lit(256), "fps": F.lit(9)}).select("episode", "width", "height", "fps")


@query("SELECT o_orderkey AS episode, CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE 11 END AS width FROM orders")
def header_missing(t: Tables):
    """No header row at all: every row stays, with the default."""
    rows = t.orders.select(F.col("o_orderkey").alias("episode"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("width"))
    return AU.with_header(rows, t.nation.filter("n_nationkey < 0").select(F.col("n_nationkey").cast("bigint").alias("width")), {"width": F.lit(11)})


# --- joins ---------------------------------------------------------------------------------------------

ROWS_SQL = """e AS (SELECT o_orderkey AS episode, sum(n) OVER (ORDER BY o_orderkey) - n AS first_row, sum(n) OVER (ORDER BY o_orderkey) AS end_row
  FROM (SELECT o_orderkey, CAST(coalesce(n, 0) AS BIGINT) AS n FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey))"""


@query(f"""WITH {ROWS_SQL} SELECT event_id, episode, CAST(event_id * 5 - first_row AS BIGINT) AS step FROM events LEFT JOIN e ON event_id * 5 >= first_row AND event_id * 5 < end_row""")
def rows_to_episodes(t: Tables):
    """Offsets into the long file back to episode and local step; offsets past its end find none."""
    rows = t.events.select("event_id", (F.col("event_id") * 5).alias("offset"))
    return B.rows_in_episodes(rows, bounds(t).select("episode", "first_row", "end_row"), "offset").select("event_id", "episode", "step")


@query(f"""WITH {SEGMENTS}, m AS (SELECT episode, max(end_step) AS e FROM segments GROUP BY 1), f AS (SELECT episode, unnest(range(0, CAST(e AS BIGINT) + 2)) AS step FROM m)
  SELECT f.episode, s.verb, count(*) AS steps, CAST(max(f.step) AS BIGINT) AS last_step, CAST(sum(f.step) AS BIGINT) AS step_sum FROM f JOIN m USING (episode) JOIN segments s ON s.episode = f.episode AND s.end_step > s.start_step AND f.step >= s.start_step AND (f.step < s.end_step OR f.step = e AND s.end_step = e) GROUP BY 1, 2""")
def last_step_joins_last_segment(t: Tables):
    """Every step from 0 to one past the end of the last segment: the end itself still belongs to it."""
    s = t.segments.rows().select("episode", "start_step", "end_step", "verb")
    f = s.groupBy("episode").agg(F.max("end_step").alias("e")).select("episode", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("e") + 1)).alias("step"))
    met = FR.frames_in_segments_to_end(f, s).groupBy("episode", "verb")
    return met.agg(F.count(F.lit(1)).alias("steps"), F.max("step").alias("last_step"), F.sum("step").alias("step_sum"))


@query("""WITH t AS (SELECT p_type AS task, max(p_partkey) AS k FROM part WHERE p_size % 3 > 0 GROUP BY 1) SELECT DISTINCT p_type AS task, 't' || k AS target FROM part LEFT JOIN t ON t.task = p_type""")
def targets_by_task(t: Tables):
    """Tasks with the latest list under their name, null for tasks without one."""
    lists = t.part.filter(F.col("p_size") % 3 > 0).select(F.col("p_type").alias("task"), F.col("p_partkey").alias("source"), F.array(F.concat(F.lit("t"), F.col("p_partkey").cast("string"))).alias("target_objects"))
    return TG.targets_of_tasks(t.part.select(F.col("p_type").alias("task")).distinct(), lists).select("task", F.get("target_objects", F.lit(0)).alias("target"))


@query("""SELECT s_suppkey % 7 AS camera, count(*) AS frames FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 7 NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey > 3) GROUP BY 1""")
def uncalibrated_cameras(t: Tables):
    frames = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select((F.col("s_suppkey") % 7).alias("camera"))
    return TR.uncalibrated(frames, t.supplier.filter("s_suppkey > 3").select(F.col("s_suppkey").alias("camera")))


@query("""WITH c AS (SELECT p_partkey AS episode, p_name AS n_name, p_partkey % 3 AS k FROM part)
  SELECT episode, 'PICKUP_FROM' AS verb, n_name || ',table' AS arguments FROM c WHERE k = 0 UNION ALL SELECT episode, 'OPEN', 'drawer' FROM c WHERE k < 2 UNION ALL SELECT episode, 'PLACE_ON', n_name || ',table' FROM c WHERE k = 2""")
def available_next_actions(t: Tables):
    """Which of three actions could come next: the thing on the table, or in the hand, and a drawer that opens or does not."""
    n = t.part.select(F.col("p_partkey").cast("bigint").alias("episode"), F.col("p_name").alias("n_name"), (F.col("p_partkey") % 3).alias("k"))

    def fact(name, first="", second="", when=F.lit(True)):
        lit = lambda v: v if isinstance(v, F.Column) else F.lit(v)
        return F.when(when, F.struct(F.lit(name).alias("name"), lit(first).alias("first"), lit(second).alias("second")))

    thing, k = F.col("n_name"), F.col("k")
    facts = n.select("episode", F.explode(F.array_compact(F.array(
        fact("free", when=k < 2), fact("on", thing, "table", k == 0), fact("carry", thing, when=k == 2), fact("closed", "drawer"), fact("openable", "drawer")))).alias("f")).select("episode", "f.*")
    action = lambda verb, *args: F.struct(F.lit(verb).alias("verb"), F.array(*args).alias("arguments"))
    candidates = n.select("episode", F.explode(F.array(action("PICKUP_FROM", thing, F.lit("table")), action("OPEN", F.lit("drawer")), action("PLACE_ON", thing, F.lit("table")))).alias("c")).select("episode", "c.*")
    return FE.available_actions(facts, "libero", candidates).select("episode", "verb", F.array_join("arguments", ",").alias("arguments"))


@query(f"""WITH {FRAMES}, r AS (SELECT *, sum(CASE WHEN skill IS DISTINCT FROM w THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY step) AS run FROM (SELECT *, lag(skill) OVER (PARTITION BY episode ORDER BY step) AS w FROM frames)),
  s AS (SELECT *, row_number() OVER (PARTITION BY episode, run ORDER BY step) AS i, max(CASE WHEN NOT value >= 20 THEN step END) OVER (PARTITION BY episode, run ORDER BY step) AS low, min(step) OVER (PARTITION BY episode, run) AS f0 FROM r),
  z AS (SELECT *, step - greatest(coalesce(low, -1), f0 - 1) >= 2 AS reached FROM s)
  SELECT episode, step, bool_or(reached) OVER (PARTITION BY episode, run ORDER BY step) AS frozen FROM z""")
def freeze_within_skill(t: Tables):
    return P.freeze_within(t.frames, "skill", "value", 20.0, 2).df.select("episode", "step", "frozen")
