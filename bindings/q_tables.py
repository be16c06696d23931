"""Join, aggregate, sampling and set queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from demospan.operators import aggregates as A
from demospan.operators import joins as J
from demospan.operators import sampling as T
from demospan.operators import setops as U
from demospan.plans import detections as D
from demospan.plans.rollouts import remaining, score, score_verifier

from .registry import query
from .tables import FRAMES, Tables, near

# --- joins --------------------------------------------------------------------------------------------


def tasks(t: Tables):
    """Part names as task texts: names repeat, and the first listed part counts."""
    return t.part.select(F.col("p_partkey").alias("task_index"), F.col("p_name").alias("task"))


def instructions(t: Tables):
    name = F.when(F.col("l_linenumber") == 6, F.concat("p_name", F.lit(" twice"))).otherwise(F.col("p_name"))
    l = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    j = l.join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    given = F.when(F.col("l_suppkey") % 5 == 0, F.col("l_partkey")).alias("task_index")
    return j.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", name.alias("instruction"), given)


INSTRUCTIONS = """e AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_linenumber = 6 THEN p_name || ' twice' ELSE p_name END AS instruction,
    CASE WHEN l_suppkey % 5 = 0 THEN l_partkey END AS given FROM lineitem JOIN part ON l_partkey = p_partkey),
  k AS (SELECT p_name, min(p_partkey) AS found FROM part GROUP BY p_name)"""


@query(f"""WITH {INSTRUCTIONS} SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, coalesce(given, found) AS task_index FROM e JOIN k ON instruction = p_name""")
def episode_tasks(t: Tables):
    return J.episodes_to_tasks(instructions(t), tasks(t))[0].drop("instruction")


@query(f"""WITH {INSTRUCTIONS} SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, instruction FROM e ANTI JOIN k ON instruction = p_name""")
def episodes_without_task(t: Tables):
    return J.episodes_to_tasks(instructions(t), tasks(t))[1]


@query("SELECT p_name AS task, p_partkey AS task_index, count(*) OVER (PARTITION BY p_name) AS occurrences FROM part QUALIFY occurrences > 1")
def duplicate_tasks(t: Tables):
    return A.duplicates(tasks(t), ["task"], "task_index")


@query("SELECT o_orderkey AS episode FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")
def missing_episodes(t: Tables):
    return J.missing(t.orders.select(F.col("o_orderkey").alias("episode")), t.lineitem.select(F.col("l_orderkey").alias("episode")), ["episode"])


@query("SELECT o_orderkey AS episode FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey ORDER BY 1 LIMIT 20")
def missing_episode_sample(t: Tables):
    return J.missing_sample(t.orders.select(F.col("o_orderkey").alias("episode")), t.lineitem.select(F.col("l_orderkey").alias("episode")), ["episode"])


@query("SELECT o_orderkey AS episode, o_orderpriority AS task FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey")
def present_episodes(t: Tables):
    e = t.orders.select(F.col("o_orderkey").alias("episode"), F.col("o_orderpriority").alias("task"))
    return J.present_in_both(e, t.lineitem.select(F.col("l_orderkey").alias("episode")), ["episode"])


@query("""SELECT doc_id FROM documents ANTI JOIN benchmark USING (text)""")
def not_held_out(t: Tables):
    """Texts that are not held out, by the hash of the text so that long texts are not shuffled."""
    docs = t.documents.select("doc_id", F.sha2("text", 256).alias("key"))
    return J.missing(docs, t.benchmark.select(F.sha2("text", 256).alias("key")), ["key"]).select("doc_id")


@query("""SELECT s_suppkey AS task_id, i AS episode_idx FROM supplier CROSS JOIN range(0, 8) r(i) ANTI JOIN
  (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08) d ON s_suppkey = l_suppkey AND i = l_linenumber""")
def resume_pending(t: Tables):
    done = t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08)).select(F.col("l_suppkey").alias("task_id"), F.col("l_linenumber").alias("episode_idx"))
    return remaining(t.supplier.select(F.col("s_suppkey").alias("task_id")), 8, done).withColumn("episode_idx", F.col("episode_idx").cast("bigint"))


FILES = """f AS (SELECT CASE p_size % 4 WHEN 0 THEN 'libero_10' WHEN 1 THEN 'libero_90' WHEN 2 THEN 'libero_goal' ELSE 'other' END AS suite,
    CASE WHEN p_size % 5 = 0 THEN 'pick_up_the_' || replace(p_name, ' ', '_') || '_and_put_it_in_the_box' ELSE replace(p_name, ' ', '_') END AS stem,
    lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS path FROM part),
  a AS (SELECT *, replace(stem, '_', ' ') AS lang FROM f),
  al AS (SELECT suite, path, lang AS alias FROM a UNION ALL SELECT suite, path, regexp_replace(lang, '^pick up (.+) and put it (.+)$', 'put \\1 \\2') FROM a WHERE lang LIKE 'pick up % and put it %'),
  best AS (SELECT alias, arg_min(path, CASE suite WHEN 'libero_10' THEN '0' WHEN 'libero_90' THEN '1' WHEN 'libero_goal' THEN '2' ELSE '9' END || path) AS path FROM al GROUP BY alias)"""


@query(f"""WITH {FILES} SELECT p_partkey AS episode, path FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ' ' || upper(p_name) ELSE 'put the ' || p_name || '  in the box' END AS ins FROM part)
  JOIN best ON alias = trim(regexp_replace(lower(ins), '\\s+', ' ', 'g'))""")
def task_file_lookup(t: Tables):
    k, name = F.col("p_size"), F.col("p_name")
    suite = F.when(k % 4 == 0, "libero_10").when(k % 4 == 1, "libero_90").when(k % 4 == 2, "libero_goal").otherwise("other")
    plain = F.translate(name, " ", "_")
    stem = F.when(k % 5 == 0, F.concat(F.lit("pick_up_the_"), plain, F.lit("_and_put_it_in_the_box"))).otherwise(plain)
    files = t.part.select(suite.alias("suite"), stem.alias("stem"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("path"))
    ins = F.when(k % 2 == 0, F.concat(F.lit(" "), F.upper(name))).otherwise(F.concat(F.lit("put the "), name, F.lit("  in the box")))
    episodes = t.part.select(F.col("p_partkey").alias("episode"), ins.alias("instruction"))
    return J.resolve_task_files(episodes, files)[0].select("episode", "path")


@query("""WITH want AS (SELECT DISTINCT l_orderkey AS episode, l_linenumber AS name FROM lineitem), have AS (SELECT DISTINCT l_suppkey % 3 AS root, l_orderkey AS episode, l_linenumber AS name FROM lineitem),
  h AS (SELECT episode, root, count(DISTINCT name) AS held FROM have GROUP BY 1, 2), w AS (SELECT episode, count(DISTINCT name) AS wanted FROM want GROUP BY 1),
  r AS (SELECT h.episode, count(*) AS roots, min(root) AS root FROM h JOIN w ON h.episode = w.episode AND held = wanted GROUP BY 1)
  SELECT w.episode, coalesce(roots, 0) AS roots, CASE WHEN roots = 1 THEN root END AS root, CASE WHEN roots = 1 THEN 'ok' WHEN roots IS NULL THEN 'none' ELSE 'ambiguous' END AS state FROM w LEFT JOIN r USING (episode)""")
def complete_image_roots(t: Tables):
    name = F.col("l_linenumber").alias("name")
    want = t.lineitem.select(F.col("l_orderkey").alias("episode"), name)
    have = t.lineitem.select((F.col("l_suppkey") % 3).alias("root"), F.col("l_orderkey").alias("episode"), name)
    return J.single_complete_root(want, have)


@query("SELECT l_orderkey AS episode, l_linenumber AS name, min(l_suppkey % 7) AS root FROM lineitem GROUP BY 1, 2")
def first_root_with_image(t: Tables):
    have = t.lineitem.select(F.col("l_orderkey").alias("episode"), F.col("l_linenumber").alias("name"), (F.col("l_suppkey") % 7).alias("root"))
    return J.best_by(have, ["episode", "name"], F.col("root"), ["root"])


@query("""SELECT l_orderkey AS state_id, l_partkey, l_suppkey, l_extendedprice, EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = 1 AND b.l_returnflag = a.l_returnflag
   AND b.l_suppkey % 3 = a.l_suppkey % 3 AND b.l_partkey % 2 = a.l_partkey % 2) AS matched FROM lineitem a""")
def match_grounded_actions(t: Tables):
    act = [F.col("l_orderkey").alias("state_id"), F.col("l_returnflag").alias("name"), F.array(F.col("l_suppkey") % 3, F.col("l_partkey") % 2).alias("parameters")]
    available = t.lineitem.filter(F.col("l_linenumber") == 1).select(*act)
    return J.match_actions(t.lineitem.select(*act, "l_partkey", "l_suppkey", "l_extendedprice"), available).select("state_id", "l_partkey", "l_suppkey", "l_extendedprice", "matched")


@query("""WITH a AS (SELECT c_custkey AS k, c_name AS name, c_nationkey AS nation FROM customer WHERE c_acctbal > 0),
  b AS (SELECT c_custkey AS k, CASE WHEN c_mktsegment = 'BUILDING' THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_nationkey <> 7 THEN c_nationkey END AS nation FROM customer WHERE c_acctbal < 9000)
  SELECT a.k, '*' AS field, 'missing_right' AS rule FROM a ANTI JOIN b USING (k) UNION ALL SELECT b.k, '*', 'missing_left' FROM b ANTI JOIN a USING (k)
  UNION ALL SELECT k, 'name', 'changed' FROM a JOIN b USING (k) WHERE a.name IS DISTINCT FROM b.name UNION ALL SELECT k, 'nation', 'changed' FROM a JOIN b USING (k) WHERE a.nation IS DISTINCT FROM b.nation""")
def key_diff(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), "c_acctbal", "c_mktsegment")
    left = c.filter(F.col("c_acctbal") > 0)
    right = c.filter(F.col("c_acctbal") < 9000).withColumns(
        {"name": F.when(F.col("c_mktsegment") == "BUILDING", F.upper("name")).otherwise(F.col("name")), "nation": F.when(F.col("nation") != 7, F.col("nation"))})
    return J.compare(left, right, ["k"], ["name", "nation"])


@query("""WITH d AS (SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS id,
    CAST(l_linenumber * 0.01 AS DOUBLE) AS x, CAST(l_discount + 0.2 AS DOUBLE) AS y, CAST(1.0 + (l_quantity % 2) * 0.02 AS DOUBLE) AS w, CAST(1.5 AS DOUBLE) AS h,
    CAST(l_tax + 0.1 AS DOUBLE) AS s1, CAST(l_discount + 0.05 AS DOUBLE) AS s2 FROM lineitem),
  f AS (SELECT frame, list([{'id': id, 'x': x, 'y': y, 'w': w, 'h': h, 's1': s1, 's2': s2}] ORDER BY id) AS ds FROM d GROUP BY frame),
  r AS (SELECT frame, list_reduce(ds, lambda acc, one: list_transform(
    [list_filter(acc, lambda o: list_transform([greatest(least(o.x + o.w, one[1].x + one[1].w) - greatest(o.x, one[1].x), 0) * greatest(least(o.y + o.h, one[1].y + one[1].h) - greatest(o.y, one[1].y), 0)],
        lambda i: i / (o.w * o.h + one[1].w * one[1].h - i))[1] > 0.9)],
    lambda near: list_transform([coalesce(list_position(list_transform(near, lambda o: greatest(o.s1, o.s2) >= greatest(one[1].s1, one[1].s2)), true), 0)],
      lambda j: list_transform([CASE WHEN j = 0 THEN near ELSE near[1:j] END],
        lambda met: list_transform([{'s1': one[1].s1 + coalesce(list_sum(list_transform(met, lambda m: m.s1)), 0), 's2': one[1].s2 + coalesce(list_sum(list_transform(met, lambda m: m.s2)), 0)}],
          lambda total: list_concat(list_transform(
            list_filter(acc, lambda o: NOT list_contains(list_transform(met, lambda m: m.id), o.id) OR (j > 0 AND o.id = near[j].id)),
            lambda o: CASE WHEN j > 0 AND o.id = near[j].id THEN {'id': o.id, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h, 's1': total.s1, 's2': total.s2} ELSE o END),
            CASE WHEN j > 0 THEN [] ELSE [{'id': one[1].id, 'x': one[1].x, 'y': one[1].y, 'w': one[1].w, 'h': one[1].h, 's1': total.s1, 's2': total.s2}] END))[1])[1])[1])[1]) AS kept FROM f),
  u AS (SELECT frame, unnest(kept) AS o FROM r)
  SELECT frame, o.id AS id, floor(greatest(o.s1, o.s2) * 1e6 + 0.5001) / 1e6 AS top, floor((o.s1 + o.s2) * 1e6 + 0.5001) / 1e6 AS total FROM u""")
def merged_detections(t: Tables):
    """Greedy merge of near-copies per image in the order of the line numbers."""
    merged = D.merge_detections(boxes(t))
    return merged.select("frame", "id", near(F.array_max("scores"), 6).alias("top"), near(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def boxes(t: Tables):
    """Line items as boxes in an image per order: quantities and prices make nearly equal boxes."""
    nth = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"))
    d = t.lineitem.select(
        F.col("l_orderkey").alias("frame"), nth.cast("bigint").alias("id"),
        (F.col("l_linenumber") * 0.01).alias("x"), (F.col("l_discount") + 0.2).alias("y"),
        (F.lit(1.0) + (F.col("l_quantity") % 2) * 0.02).alias("w"), F.lit(1.5).alias("h"),
        F.array(F.col("l_tax") + 0.1, F.col("l_discount") + 0.05).alias("scores"))
    return d.select("frame", F.col("id").alias("rank"), "id", "x", "y", "w", "h", "scores")


BOXES = """b AS (SELECT l_orderkey AS frame, l_linenumber * 0.01 AS x, l_discount + 0.2 AS y, 1.0 + (l_quantity % 2) * 0.02 AS w, CAST(1.5 AS DOUBLE) AS h FROM lineitem),
  d AS (SELECT frame, CAST(x AS DOUBLE) AS x, y, w, h, count(*) AS copies FROM b GROUP BY ALL)"""


@query(f"""WITH {BOXES}, p AS (SELECT a.frame, a.copies AS ca, b.copies AS cb, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i,
    a.w * a.h + b.w * b.h AS s FROM d a JOIN d b ON a.frame = b.frame AND (a.x, a.y, a.w) < (b.x, b.y, b.w))
  SELECT frame, count(*) AS pairs, CAST(sum(ca * cb) AS BIGINT) AS weight FROM p WHERE i / (s - i) > 0.9 GROUP BY frame""")
def overlapping_boxes(t: Tables):
    p = D.overlapping_pairs(boxes(t))
    return p.groupBy("frame").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("a_copies") * F.col("b_copies")).alias("weight"))


# --- aggregates ------------------------------------------------------------------------------------------


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS successes, count(*) FILTER (o_orderstatus <> 'F') AS failures,
  floor(count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) * 1e6 + 0.5001) / 1e6 AS rate FROM orders""")
def rollout_summary(t: Tables):
    return score(t.rollouts)[0].withColumn("rate", near("rate", 6))


@query("""SELECT o_orderpriority AS task, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS successes, floor(count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) * 1e6 + 0.5001) / 1e6 AS rate
  FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def success_per_task(t: Tables):
    return score(t.rollouts)[1].withColumn("rate", near("rate", 6))


@query("SELECT o_orderpriority AS task, o_orderkey AS episode FROM orders WHERE o_orderstatus <> 'F'")
def failed_rollouts(t: Tables):
    return score(t.rollouts)[2]


@query("""WITH s AS (SELECT text, toxic = 1 AS known_false, max(quality) = 1 AS accepted FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
  SELECT count(*) AS total, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected, count(*) FILTER (known_false) AS known_false,
    count(*) FILTER (known_false AND NOT accepted) AS caught, count(*) FILTER (known_false AND accepted) AS missed,
    count(*) FILTER (NOT known_false AND accepted) AS accepted_unlabelled, count(*) FILTER (NOT known_false AND NOT accepted) AS rejected_unlabelled,
    count(*) FILTER (accepted IS NULL) AS without_verdict FROM s""")
def verifier_confusion(t: Tables):
    """Distinct labelled texts; texts are told apart by their hash, so long ones are not shuffled."""
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("key")).join(t.labels, "doc_id")
    s = d.groupBy("key", (F.col("toxic") == 1).alias("known_false")).agg((F.max("quality") == 1).alias("accepted"))
    return A.verifier_confusion(s)


@query("""WITH d AS (SELECT md5(text) AS text, toxic = 1 AS known_false, doc_id FROM documents JOIN labels USING (doc_id)), u AS (SELECT text, known_false, min(doc_id) AS line FROM d GROUP BY 1, 2),
  r AS (SELECT md5(text) AS text, length(max(text)) % 2 = 0 AS accepted FROM documents GROUP BY 1 HAVING max(length(text)) % 3 > 0), j AS (SELECT * FROM u LEFT JOIN r USING (text))
  SELECT count(*) AS total, count(*) FILTER (accepted IS NULL) AS without_verdict, count(*) FILTER (accepted) AS accepted, count(*) FILTER (known_false AND NOT accepted) AS caught, count(*) FILTER (known_false AND accepted) AS missed FROM j""")
def verifier_score(t: Tables):
    """Samples deduplicated in line order, then scored against one verdict per text."""
    d = t.documents.select("doc_id", F.md5("text").alias("text"), F.length("text").alias("n"))
    samples = d.join(t.labels, "doc_id").select("text", (F.col("toxic") == 1).alias("known_false"), F.col("doc_id").alias("line"))
    verdicts = d.groupBy("text").agg(F.max("n").alias("n")).filter(F.col("n") % 3 > 0).select("text", (F.col("n") % 2 == 0).alias("accepted"))
    return score_verifier(samples, verdicts).select("total", "without_verdict", "accepted", "caught", "missed")


@query("""SELECT event_type AS function, user_id AS thread, count(*) AS calls, floor(sum(value) * 1e4 + 0.5001) / 1e4 AS total, floor(avg(value) * 1e6 + 0.5001) / 1e6 AS mean, min(value) AS min, max(value) AS max
  FROM events GROUP BY ROLLUP (event_type, user_id)""")
def timing_report(t: Tables):
    c = t.events.select(F.col("event_type").alias("function"), F.col("user_id").alias("thread"), "value")
    r = A.timing_report(c, "function", "thread", "value")
    return r.withColumns({"total": near("total", 4), "mean": near("mean", 6)})


@query("SELECT lang AS key, count(DISTINCT source) AS values FROM documents GROUP BY lang HAVING count(DISTINCT source) > 1")
def header_conflicts(t: Tables):
    return A.header_conflicts(t.documents.select(F.col("lang").alias("key"), F.col("source").alias("value")))


@query("""SELECT o_orderkey AS episode, CAST(o_totalprice AS BIGINT) % 8 AS size, coalesce(n, 0) AS counted FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders) LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  WHERE CAST(o_totalprice AS BIGINT) % 8 <> coalesce(n, 0)""")
def declared_size_mismatches(t: Tables):
    d = t.orders.select(F.col("o_orderkey").alias("episode"), (F.floor("o_totalprice") % 8).alias("size"))
    return A.count_mismatches(d, t.lineitem.select(F.col("l_orderkey").alias("episode")), "episode", "size")


@query("SELECT c_custkey AS first_customer, c_name AS name, c_mktsegment AS segment FROM customer ORDER BY c_custkey LIMIT 1")
def first_episode_metadata(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("first_customer"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return A.first_episode_metadata(c, "first_customer", ["first_customer", "name", "segment"])


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS i FROM lineitem), n AS (SELECT i, lead(i) OVER (ORDER BY i) AS nx FROM d) SELECT i + 1 AS gap_start, nx - 1 AS gap_end FROM n WHERE nx > i + 1""")
def index_gaps(t: Tables):
    return A.index_gaps(t.lineitem, "l_orderkey", span=1000)


@query("""SELECT l_orderkey AS episode, p_name AS object, l_returnflag AS attribute FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F' GROUP BY ALL""")
def scene_nodes(t: Tables):
    return A.scene_nodes(facts(t), ["episode"])


@query("""SELECT l_orderkey AS episode, p_name AS "from", p_brand AS "to", l_returnflag AS relation FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' GROUP BY ALL""")
def scene_edges(t: Tables):
    return A.scene_edges(facts(t), ["episode"])


def facts(t: Tables):
    j = t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus").join(t.part.select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("l_orderkey").alias("episode"), F.col("l_returnflag").alias("name"), F.col("p_name").alias("first"), F.when(F.col("l_linestatus") == "O", F.col("p_brand")).alias("second"))


@query("""WITH s AS (SELECT l_orderkey AS frame, l_linenumber AS thing, l_suppkey AS track, max(l_discount) AS score, max(CASE WHEN l_suppkey % 2 = 0 THEN l_tax END) AS text_score FROM lineitem GROUP BY 1, 2, 3),
  f AS (SELECT *, CASE WHEN text_score IS NULL THEN score ELSE 0.65 * score + 0.35 * text_score END AS fused FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY frame, thing ORDER BY fused DESC, track) AS k FROM f)
  SELECT frame, thing, track, floor(fused * 1e6 + 0.5001) / 1e6 AS fused FROM r WHERE k = 1""")
def best_tracks(t: Tables):
    l = t.lineitem.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("thing"), F.col("l_suppkey").alias("track"), "l_discount", "l_tax")
    keys = ["frame", "thing", "track"]
    detector = l.groupBy(*keys).agg(F.max("l_discount").alias("score"))
    text = l.filter(F.col("track") % 2 == 0).groupBy(*keys).agg(F.max("l_tax").alias("text_score"))
    return A.best_track(A.fused_scores(detector, text, keys), "frame", "thing", "track").withColumn("fused", near("fused", 6))


@query("""WITH l AS (SELECT p_partkey AS line, CASE WHEN p_size % 3 = 0 THEN 'none' ELSE 'gpu:' || p_type || ':2' END AS gres, p_brand AS part, p_name || ',n' || p_size AS nodes FROM part),
  g AS (SELECT *, split_part(gres, ':', 2) AS accelerator FROM l WHERE contains(gres, ':')), p AS (SELECT accelerator, arg_max(part, line) AS partition FROM g GROUP BY 1)
  SELECT DISTINCT accelerator, unnest(string_split(nodes, ',')) AS node, partition FROM g JOIN p USING (accelerator)""")
def accelerator_nodes(t: Tables):
    gres = F.when(F.col("p_size") % 3 == 0, "none").otherwise(F.concat(F.lit("gpu:"), "p_type", F.lit(":2")))
    listing = t.part.select(F.col("p_partkey").alias("line"), gres.alias("gres"), F.col("p_brand").alias("partition"), F.concat("p_name", F.lit(",n"), "p_size").alias("nodes"))
    nodes, partitions = A.accelerator_nodes(listing)
    return nodes.join(partitions, "accelerator")


# --- samples, splits, sets ---------------------------------------------------------------------------------


@query("SELECT o_orderkey AS episode, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank FROM orders")
def numeric_order(t: Tables):
    e = t.orders.select(F.col("o_orderkey").alias("episode"))
    return A.with_rank(e, ["episode"], "episode")


@query("SELECT o_orderkey AS episode, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25")
def limited_selection(t: Tables):
    e = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("episode"), "o_totalprice")
    return T.top(e, [F.col("episode")], 25)


@query("""WITH r AS (SELECT o_orderkey AS episode, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank, count(*) OVER () AS n FROM orders)
  SELECT CAST(floor(rank / ceil(n / 8.0)) AS BIGINT) AS block, min(rank) AS start FROM r GROUP BY 1""")
def block_splits(t: Tables):
    return T.block_starts(t.orders.select(F.col("o_orderkey").alias("episode")), ["episode"], "episode", 8)


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS episode FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT episode, row_number() OVER (ORDER BY episode) - 1 AS rank, count(*) OVER () AS n FROM d)
  SELECT episode, CAST(floor(rank / ceil(n / 4.0)) AS BIGINT) AS block FROM r""")
def failed_episode_batches(t: Tables):
    from demospan.plans.targets import failed_episode_batches as batches

    failed = t.lineitem.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("episode"))
    return batches(failed).select("episode", "block")


@query("SELECT md5(text) AS text, source = 'src1' AS known_false, min(doc_id) AS line FROM documents GROUP BY 1, 2")
def stable_dedupe(t: Tables):
    d = t.documents.select(F.md5("text").alias("text"), (F.col("source") == "src1").alias("known_false"), F.col("doc_id").alias("line"))
    return T.distinct_in_order(d, ["text", "known_false"], "line")


@query("SELECT count(*) AS episodes, true AS near_tenth, count(*) AS stable FROM orders")
def train_val_split(t: Tables):
    """The split is a hash of the episode: the same for every row of it, and near the asked ratio."""
    s = t.orders.select(T.train_validation(F.col("o_orderkey")).alias("a"), T.train_validation(F.col("o_orderkey")).alias("b"))
    share = F.count_if(F.col("a") == "val") / F.count(F.lit(1))
    return s.agg(F.count(F.lit(1)).alias("episodes"), share.between(0.05, 0.15).alias("near_tenth"), F.count_if(F.col("a") == F.col("b")).alias("stable"))


@query("SELECT batch, count(*) AS rows FROM (SELECT CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 64) AS BIGINT) AS batch FROM events) GROUP BY 1")
def mini_batch_sizes(t: Tables):
    return T.mini_batches(t.events.select("event_id"), ["event_id"], 64).groupBy("batch").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT least(100, count(*)) AS rows, least(100, count(*)) AS distinct_rows FROM events")
def sampled_rows(t: Tables):
    s = T.sample_rows(t.events.select("event_id"), ["event_id"], 100)
    return s.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("distinct_rows"))


@query(f"WITH {FRAMES} SELECT episode, count(*) > 0 AS drawn FROM frames GROUP BY episode")
def one_frame_per_episode(t: Tables):
    e = t.events.select(F.col("user_id").alias("episode"), "event_id", "event_type")
    s = T.one_per_group(e, "episode", ["event_id"])
    return s.join(e, ["episode", "event_id"], "left_semi").select("episode", F.lit(True).alias("drawn"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS mask, l_linenumber AS x, l_suppkey AS y FROM lineitem WHERE l_quantity > 10)
  SELECT o_orderkey AS mask, greatest(1, least(4, (SELECT count(*) FROM d WHERE mask = o_orderkey))) AS points FROM orders""")
def mask_points(t: Tables):
    pts = t.lineitem.filter(F.col("l_quantity") > 10).select(F.col("l_orderkey").alias("mask"), F.col("l_linenumber").alias("x"), F.col("l_suppkey").alias("y")).distinct()
    box = t.orders.select(F.col("o_orderkey").alias("mask"), *[F.lit(v).alias(c) for c, v in (("x1", 0.0), ("y1", 0.0), ("x2", 10.0), ("y2", 8.0))])
    return T.sample_points_or_centre(box, pts, ["mask"], 4).groupBy("mask").agg(F.count(F.lit(1)).alias("points"))


@query("""SELECT name, 1 - levenshtein(lower(name), 'smal rings') / greatest(length(name), 10) AS similarity FROM (SELECT DISTINCT p_name AS name FROM part)
  WHERE 1 - levenshtein(lower(name), 'smal rings') / greatest(length(name), 10) >= 0.4 ORDER BY 2 DESC, 1 LIMIT 5""")
def closest_task_names(t: Tables):
    """Names most like a misspelt one (edit distance; the measure differs from sequence matching)."""
    return T.closest_names(t.part.select(F.col("p_name").alias("name")), "smal rings")


@query("""SELECT md5(text) AS episode, source, count(*) AS rows FROM documents
  WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1) GROUP BY 1, 2""")
def duplicate_shards(t: Tables):
    d = t.documents.select(F.md5("text").alias("episode"), "source")
    return A.duplicate_sources(U.union_shards([d.filter(F.col("source") < "src2"), d.filter(F.col("source") >= "src2")]), ["episode"], "source")


@query("""SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN 'new' ELSE c_mktsegment END AS v FROM customer WHERE c_nationkey < 15 OR c_acctbal > 5000""")
def resume_overlay(t: Tables):
    row = [F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")]
    new = t.customer.filter(F.col("c_acctbal") > 5000).select(*row).withColumn("v", F.lit("new"))
    return U.overlay(new, t.customer.filter(F.col("c_nationkey") < 15).select(*row), ["k"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_record(t: Tables):
    return U.latest(t.events.select("user_id", "event_type", "event_id"), ["user_id"], F.col("event_id"))


@query("""SELECT c_custkey AS id, coalesce(CASE WHEN o.k IS NOT NULL THEN o.name END, c_name) AS name, c_mktsegment AS place FROM customer LEFT JOIN (SELECT s_suppkey AS k, s_name AS name FROM supplier) o ON o.k = c_custkey""")
def partial_updates(t: Tables):
    base = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("place"))
    updates = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("place"))
    return U.update_by_id(base, updates, "id", ["name", "place"])[0]


@query("SELECT o_custkey AS id FROM orders ANTI JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) c ON c_custkey = o_custkey GROUP BY 1")
def unknown_updates(t: Tables):
    base = t.customer.filter(F.col("c_nationkey") < 12).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    updates = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("name")).distinct()
    return U.update_by_id(base, updates, "id", ["name"])[1].select("id").distinct()


@query("""SELECT user_id AS episode, event_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'purchase' AND s.value > 100)""")
def unresolved_errors(t: Tables):
    e = t.events.select(F.col("user_id").alias("episode"), "event_id", "event_type", "value")
    return U.unresolved_errors(e.filter(F.col("event_type") == "error"), e.filter((F.col("event_type") == "purchase") & (F.col("value") > 100)), ["episode"]).select("episode", "event_id")


@query("SELECT p_partkey, p_size % 3 <> 1 AS same FROM part")
def same_key_sets(t: Tables):
    a = F.create_map(F.lit("content"), F.col("p_name"), F.lit("plan"), F.col("p_type"))
    b = F.when(F.col("p_size") % 3 == 1, F.create_map(F.lit("content"), F.lit(""))).otherwise(F.create_map(F.lit("plan"), F.lit(""), F.lit("content"), F.lit("")))
    return t.part.select("p_partkey", U.same_keys(a, b).alias("same"))


@query("""WITH l AS (SELECT l_orderkey AS task, l_linenumber AS repeat, bool_and(l_tax < 0.07) AS readable FROM lineitem GROUP BY 1, 2), f AS (SELECT task, min(repeat) FILTER (NOT readable) AS lost FROM l GROUP BY 1)
  SELECT task, repeat FROM l JOIN f USING (task) WHERE readable AND (lost IS NULL OR repeat < lost)""")
def readable_prefix(t: Tables):
    from demospan.plans.probe import readable_prefix as prefix

    l = t.lineitem.groupBy(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("repeat")).agg(F.bool_and(F.col("l_tax") < 0.07).alias("readable"))
    return prefix(l.filter("readable").select("task", "repeat"), l.select("task", "repeat"), ["task"], "repeat")
