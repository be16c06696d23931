"""Online loops on file streams, with late, repeated and out-of-order rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from demospan.plans import annotate as AN
from demospan.streaming import progress as S

START = dt.datetime(2024, 1, 1)
STEP = "episode bigint, step bigint, ts timestamp, skill string, progress double"


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, S.ROCKSDB)
    yield spark
    spark.conf.set(key, before)


def run(spark, stream, path, mode="update"):
    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/check").foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def write(spark, rows, path):
    spark.createDataFrame(rows, STEP).coalesce(1).write.mode("append").parquet(path)


def row(episode, step, skill, progress, second=None):
    return (episode, step, START + dt.timedelta(seconds=step if second is None else second), skill, progress)


def test_streaks_changes_and_replayed_rows(rocks, tmp_path):
    src = str(tmp_path / "in")
    high = [0.95, 0.2, 0.95, 0.95, 0.99, 0.95, 0.95]
    rows = [row(1, i, "a" if i < 4 else "b", p) for i, p in enumerate(high)]
    write(rocks, rows[::-1] + rows[2:4] + [row(9, 0, "a", 0.0, second=500)], src)
    stream = rocks.readStream.schema(STEP).parquet(src)
    out = run(rocks, S.track_skills(stream, plan_size=3, threshold=0.9, needed=2, timeout="1000 seconds"), str(tmp_path))
    got = {r.step: r for r in out.filter("episode = 1").collect()}
    assert [got[i].streak for i in range(7)] == [1, 0, 1, 0, 1, 0, 1]
    assert [got[i].advanced for i in range(7)] == [False, False, False, True, False, True, False]
    assert [got[i].skill_index for i in range(7)] == [0, 0, 0, 1, 1, 2, 2]
    assert [got[i].done for i in range(7)] == [0, 0, 0, 0, 1, 1, 1]


@pytest.mark.parametrize("files", [1, 2, 5])
def test_order_of_files_does_not_matter(rocks, tmp_path, files):
    rng = random.Random(3)
    rows = [row(e, i, "ab"[i // 7 % 2], rng.random()) for e in range(3) for i in range(60)]
    rng.shuffle(rows)
    src = str(tmp_path / "in")
    for i in range(files):
        write(rocks, rows[i::files], src)
    write(rocks, [row(9, 0, "a", 0.0, second=2000)], src)
    stream = rocks.readStream.schema(STEP).option("maxFilesPerTrigger", 1).parquet(src)
    tracked = S.track_skills(stream, plan_size=4, threshold=0.5, needed=2, timeout="5000 seconds", lateness="100 seconds")
    got = {(r.episode, r.step): (r.skill_index, r.done, r.streak, r.advanced) for r in run(rocks, tracked, str(tmp_path)).filter("episode < 9").collect()}
    want = {}
    for e in range(3):
        streak, index, done, was = 0, 0, 0, None
        for r in sorted(x for x in rows if x[0] == e):
            done, was = min(done + (was not in (None, r[3])), 4), r[3]
            streak = streak + 1 if r[4] >= 0.5 else 0
            advanced = streak >= 2 and index < 3
            index, streak = index + advanced, 0 if advanced else streak
            want[(e, r[1])] = (index, done, streak, advanced)
    assert got == want


def test_timeout_and_late_rows(rocks, tmp_path):
    src = str(tmp_path / "in")
    write(rocks, [row(1, 0, "a", 0.1), row(1, 1, "a", 0.1)], src)
    stream = S.track_skills(rocks.readStream.schema(STEP).option("maxFilesPerTrigger", 1).parquet(src), plan_size=3, timeout="20 seconds", lateness="5 seconds")
    run(rocks, stream, str(tmp_path))
    write(rocks, [row(2, 0, "a", 0.1, second=100)], src)
    run(rocks, stream, str(tmp_path))
    write(rocks, [row(1, 2, "a", 0.1, second=3), row(2, 1, "a", 0.1, second=101)], src)
    out = run(rocks, stream, str(tmp_path)).collect()
    assert [r.episode for r in out if r.timed_out] == [1]
    assert not any(r.episode == 1 and r.step == 2 and not r.timed_out for r in out), "a row behind the watermark is dropped"


def test_running_success(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("t", True), ("t", False), ("u", True)], "task string, success boolean").write.parquet(src)
    stream = spark.readStream.schema("task string, success boolean").parquet(src)
    out = run(spark, S.running_success(stream), str(tmp_path), "complete")
    assert {(r.task, r.total, r.successes, r.rate) for r in out.collect()} == {("t", 2, 1, 0.5), ("u", 1, 1, 1.0)}


def test_rollout_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "r")
    schema = "task_id bigint, episode_idx bigint, success boolean"
    write_batch = S.upsert_rollouts(path)
    first = spark.createDataFrame([(1, 0, False), (1, 1, True)], schema)
    write_batch(first, 0)
    write_batch(first, 0)
    write_batch(spark.createDataFrame([(1, 0, True)], schema), 1)
    got = S.current_rollouts(spark.read.parquet(path)).select("task_id", "episode_idx", "success").collect()
    assert sorted(map(tuple, got)) == [(1, 0, True), (1, 1, True)]


class Flaky:
    """Answers nothing for prompts with an x."""

    def complete(self, prompt, use_schema):
        return "bad" if "x" in prompt.split("\n")[0] else "good"


def test_incremental_annotation_retries_failures_only(spark, tmp_path):
    path = str(tmp_path / "a")

    def annotate(df):
        return AN.annotate(df, "episode", Flaky, lambda s: None if s == "good" else "refused", attempts=2)

    step = S.annotate_new(path, annotate)
    schema = "episode bigint, prompt string"
    step(spark.createDataFrame([(1, "a"), (2, "x")], schema), 0)
    step(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], schema), 1)
    rows = [(r.batch, r.episode, r.error is None) for r in spark.read.parquet(path).collect()]
    assert sorted(rows) == [(0, 1, True), (0, 2, False), (1, 2, True), (1, 3, True)]
    good, errors = AN.split_errors(spark.read.parquet(path).filter("batch = 1"), spark.read.parquet(path).filter("batch = 0 and error is not null"), "episode")
    assert errors.count() == 0 and good.filter(F.col("episode") == 2).count() == 1
