"""Streaming jobs run over the table files until they are drained, and document readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from demospan.session import shared_folder
from demospan.sources.readers import document_entries, is_index
from demospan.streaming import progress as S

from .registry import query
from .tables import Tables, near


def drained(t: Tables, stream: DataFrame, mode: str, state_store: str | None = None, then=None) -> DataFrame:
    """Run a stream over all present files; its output lands in the shared folder.

    ``then`` adds to the source, and the stream runs on from its checkpoint.
    """
    path = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(key)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    try:
        t.spark.conf.set(key, state_store or before)
        run(stream, f"{path}/check", mode, save)
        if then:
            then()
            run(stream, f"{path}/check", mode, save)
    finally:
        t.spark.conf.set(key, before)
    return t.spark.read.parquet(f"{path}/out")


def run(stream: DataFrame, checkpoint: str, mode: str, save) -> None:
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()


def table_stream(t: Tables, name: str) -> DataFrame:
    """The table as a stream of its files, whether it is one file or a folder of them."""
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.sf_dir}/{name}.parquet*")


@query("""SELECT o_orderpriority AS task, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS successes, floor(count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) * 1e6 + 0.5001) / 1e6 AS rate FROM orders GROUP BY 1""")
def running_success_stream(t: Tables):
    s = table_stream(t, "orders").select(F.col("o_orderpriority").alias("task"), (F.col("o_orderstatus") == "F").alias("success"))
    return drained(t, S.running_success(s), "complete").select("task", "total", "successes", near("rate", 6).alias("rate"))


@query("""WITH RECURSIVE f AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id AS step, ts, event_type AS skill, value >= 90 AS high FROM events),
  w AS (SELECT episode, i, step, ts, skill, least(greatest(0, CASE WHEN high THEN 1 ELSE 0 END), 1) AS streak, 0 AS skill_index, 0 AS done FROM f WHERE i = 1
    UNION ALL SELECT f.episode, f.i, f.step, f.ts, f.skill, CASE WHEN NOT f.high THEN 0 WHEN w.streak + 1 >= 2 AND w.skill_index < 4 THEN 0 ELSE w.streak + 1 END,
      w.skill_index + CASE WHEN f.high AND w.streak + 1 >= 2 AND w.skill_index < 4 THEN 1 ELSE 0 END, least(5, w.done + CASE WHEN f.skill <> w.skill THEN 1 ELSE 0 END) FROM w JOIN f ON f.episode = w.episode AND f.i = w.i + 1)
  SELECT episode, step, CAST(skill_index AS INTEGER) AS skill_index, CAST(done AS INTEGER) AS done, CAST(streak AS BIGINT) AS streak FROM w""")
def tracked_skills_stream(t: Tables):
    """Skill index, done skills and streak of every step; a marker ends the source, so the last hour is answered too."""
    out = to_the_end(t, F.col("value") / 100, "60 days").filter(~F.col("timed_out"))
    return out.select("episode", "step", "skill_index", "done", "streak")


def to_the_end(t: Tables, progress, timeout: str) -> DataFrame:
    as_steps = lambda df: df.select(
        F.col("user_id").alias("episode"), F.col("event_id").alias("step"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("skill"), progress.alias("progress"))
    folder = f"{shared_folder(t.spark)}/end-{uuid.uuid4().hex}"
    s = S.with_end(as_steps(table_stream(t, "events")), folder)
    tracked = S.track_skills(s, plan_size=5, timeout=timeout, lateness="1 hour")
    return drained(t, tracked, "update", S.ROCKSDB, then=lambda: S.mark_end(as_steps(t.events), folder, "1 HOUR"))


@query("""WITH RECURSIVE f AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_us(ts) // 1000 AS ms, event_type AS skill FROM events),
  m AS (SELECT max(ms) + 1000 AS mark FROM f),
  w AS (SELECT episode, i, ms, skill, ms AS changed, 0 AS ended FROM f WHERE i = 1 AND ms + 1 <= (SELECT mark FROM m)
    UNION ALL SELECT f.episode, f.i, f.ms, f.skill, CASE WHEN f.ms >= w.changed + 86400000 OR f.skill <> w.skill THEN f.ms ELSE w.changed END, w.ended + CASE WHEN f.ms >= w.changed + 86400000 THEN 1 ELSE 0 END
    FROM w JOIN f ON f.episode = w.episode AND f.i = w.i + 1 AND f.ms + 1 <= (SELECT mark FROM m))
  SELECT episode, CAST(arg_max(ended, i) + CASE WHEN arg_max(changed, i) + 86400000 <= (SELECT mark FROM m) AND max(i) = (SELECT count(*) FROM f g WHERE g.episode = w.episode) THEN 1 ELSE 0 END AS BIGINT) AS timeouts
  FROM w GROUP BY episode""")
def skill_timeouts_stream(t: Tables):
    """How often an episode went a day without a new skill: within its steps, or at its end."""
    return to_the_end(t, F.lit(0.0), "1 day").groupBy("episode").agg(F.count_if("timed_out").alias("timeouts"))


@query("""SELECT o_orderkey AS episode, CASE WHEN o_custkey % 2 = 0 AND o_custkey % 3 > 0 THEN 0 ELSE 1 END AS batch FROM orders""")
def annotated_once(t: Tables):
    """A stream in two batches, the second of which holds all of the first: an episode is asked for again only after a failure."""
    path = f"{shared_folder(t.spark)}/annotated-{uuid.uuid4().hex}"
    orders = t.orders.select(F.col("o_orderkey").alias("episode"), "o_custkey")

    def answers(second: bool):
        error = F.when((F.col("o_custkey") % 3 == 0) & ~F.lit(second), "refused")
        return lambda df: df.select("episode", F.lit("answer").alias("response"), error.alias("error"), F.lit(1).alias("attempts"))

    orders.filter(F.col("o_custkey") % 2 == 0).write.parquet(f"{path}/in")
    stream = t.spark.readStream.schema(orders.schema).parquet(f"{path}/in")
    run(stream, f"{path}/check", "append", S.annotate_new(f"{path}/out", answers(False)))
    orders.write.mode("append").parquet(f"{path}/in")
    run(stream, f"{path}/check", "append", S.annotate_new(f"{path}/out", answers(True)))
    return S.annotated(t.spark, f"{path}/out").filter(F.col("error").isNull()).select("episode", F.col("batch").cast("int").alias("batch"))


@query("""SELECT p_partkey AS source, '1' AS key, p_name AS skill FROM part UNION ALL SELECT p_partkey, '12', p_type FROM part""")
def combined_document_entries(t: Tables):
    """Documents with header and numeric keys, one per part, split into their episode entries."""
    entry = lambda c: F.struct(F.col(c).alias("skill"))
    doc = t.part.select(F.col("p_partkey").alias("source"), F.to_json(F.struct(F.lit("v1").alias("schema_version"), entry("p_name").alias("1"), entry("p_type").alias("12"))).alias("value"))
    e = document_entries(doc).filter(is_index(F.col("key")))
    return e.select("source", "key", F.get_json_object("value", "$.skill").alias("skill"))


@query("SELECT p_partkey AS source, 'schema_version' AS key, p_brand AS value FROM part")
def combined_document_headers(t: Tables):
    doc = t.part.select(F.col("p_partkey").alias("source"), F.to_json(F.struct(F.col("p_brand").alias("schema_version"), F.struct("p_name").alias("7"))).alias("value"))
    return document_entries(doc).filter(~is_index(F.col("key")))
