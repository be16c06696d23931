"""Online loops as Structured Streaming: state per running episode.

Rows may come in any order within the lateness: a step waits in the state until the watermark has passed it
and is then taken in order of time, so the answers do not depend on how the source was cut into files.
Rows behind the watermark are dropped, which ``late_rows`` counts; a repeated step is taken once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.joins import pending
from ..operators.setops import latest


class SkillTracker(StatefulProcessor):
    """Skill index by streaks of high progress, done skills by observed changes.

    The state of an episode is a handful of numbers and the steps of the last ``lateness``.
    """

    def __init__(self, threshold: float, needed: int, interval: int, plan_size: int, timeout_ms: int):
        self.threshold, self.needed, self.interval = threshold, needed, interval
        self.plan_size, self.timeout_ms = plan_size, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = "taken_us bigint, taken_step bigint, checks bigint, streak bigint, skill_index int, done int, observed string, changed_ms bigint"
        self.state = handle.getValueState("episode", schema)
        self.waiting = handle.getMapState("waiting", "at_us bigint, step bigint", "skill string, progress double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = self.state.get()[:2] if self.state.exists() else (None, None)
        for batch in rows:
            times = batch["ts"].astype("int64") // {"ns": 1000, "us": 1}[batch["ts"].dt.unit]
            for at, step, skill, progress in zip(times.tolist(), batch["step"].tolist(), batch["skill"], batch["progress"].tolist()):
                if taken[0] is None or (at, step) > tuple(taken):
                    self.waiting.updateValue((at, step), (skill, progress))
        yield self._take(key, timerValues.getCurrentWatermarkInMs())

    def _take(self, key, watermark_ms: int) -> pd.DataFrame:
        """Answers to the waiting steps that the watermark has passed, in order of time."""
        due, next_us = [], None
        for k, v in self.waiting.iterator():
            if k[0] < watermark_ms * 1000:
                due.append((k, v))
            else:
                next_us = k[0] if next_us is None else min(next_us, k[0])
        if next_us is not None:
            self.handle.registerTimer(next_us // 1000 + 1)
        due.sort()
        if not due:
            return pd.DataFrame([], columns=COLUMNS)
        before = self.state.get() if self.state.exists() else (None, None, 0, 0, 0, 0, None, None)
        _, was, checks, streak, index, done, observed, changed = before
        out = []
        for (at_us, step), (skill, progress) in due:
            self.waiting.removeKey((at_us, step))
            if changed is not None and changed + self.timeout_ms <= at_us // 1000:  # it had ended before this step
                out.append((key[0], was + 1, index, done, streak, False, True))
                checks, streak, index, done, observed, changed = 0, 0, 0, 0, None, None
            if observed is not None and skill != observed and done < self.plan_size:
                done += 1
            if skill != observed or changed is None:
                observed, changed = skill, at_us // 1000
            advanced = False
            if checks % self.interval == 0:
                streak = streak + 1 if progress >= self.threshold else 0
                if streak >= self.needed and index < self.plan_size - 1:
                    index, streak, advanced = index + 1, 0, True
                    checks = -1  # the next skill starts with a check
            checks += 1
            out.append((key[0], step, index, done, streak, advanced, False))
            was = step
        self.state.update((at_us, step, checks, streak, index, done, observed, changed))
        self.handle.registerTimer(changed + self.timeout_ms)
        return pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        yield self._take(key, watermark)
        if not self.state.exists():
            return
        _, step, _, streak, index, done, _, changed = self.state.get()
        if changed + self.timeout_ms <= watermark and not any(True for _ in self.waiting.keys()):
            self.state.clear()
            yield pd.DataFrame([(key[0], step + 1, index, done, streak, False, True)], columns=COLUMNS)

    def close(self) -> None:
        pass


def with_end(steps: DataFrame, folder: str) -> DataFrame:
    """The stream of steps with the markers that ``mark_end`` puts into a folder."""
    spark = steps.sparkSession
    spark.createDataFrame([], steps.schema).write.mode("append").parquet(folder)  # a stream needs its folder
    return steps.unionByName(spark.readStream.schema(steps.schema).parquet(folder))


def mark_end(steps: DataFrame, folder: str, lateness: str) -> None:
    """Ends a bounded source: a row of no episode, behind which the watermark has passed all of ``steps`` (a batch).

    Steps wait until the watermark has passed them, so those of the last ``lateness`` would never be answered. Run
    the stream on from its checkpoint after this, once it has read all of the source.
    """
    last = (F.max("ts") + F.expr(f"INTERVAL {lateness}") + F.expr("INTERVAL 1 SECOND")).alias("ts")
    row = steps.agg(last).where("ts IS NOT NULL")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in steps.schema if f.name != "ts"]
    row.select("ts", *none).select(*steps.columns).write.mode("append").parquet(folder)


def late_rows(query) -> int:
    """Rows that a query's recent batches dropped because they were behind the watermark."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)


COLUMNS = ["episode", "step", "skill_index", "done", "streak", "advanced", "timed_out"]
OUTPUT = "episode bigint, step bigint, skill_index int, done int, streak bigint, advanced boolean, timed_out boolean"


def track_skills(
    steps: DataFrame,
    plan_size: int,
    threshold: float = 0.9,
    needed: int = 2,
    interval: int = 1,
    timeout: str = "20 seconds",
    lateness: str = "10 seconds",
) -> DataFrame:
    """Stream of (episode, step, ts, skill, progress) -> skill index, done count, timeouts.

    A step is answered once the watermark, ``lateness`` behind the latest row, has passed it. An episode
    ends when no new skill is seen for ``timeout`` of event time; at 10 frames per second 20 seconds are
    the usual 200 steps. Needs the RocksDB state store.
    """
    ms = int(pd.Timedelta(timeout).total_seconds() * 1000)
    return (
        steps.withWatermark("ts", lateness)
        .groupBy("episode")
        .transformWithStateInPandas(
            SkillTracker(threshold, needed, interval, plan_size, ms), OUTPUT, outputMode="Update", timeMode="EventTime"
        )
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def running_success(rollouts: DataFrame, task: str = "task") -> DataFrame:
    """Success counts and rate so far, per task: a streaming aggregation."""
    done, total = F.sum(F.col("success").cast("bigint")), F.count(F.lit(1))
    return rollouts.groupBy(task).agg(total.alias("total"), done.alias("successes"), (done / total).alias("rate"))


def upsert_rollouts(path: str):
    """foreachBatch writer: keyed (task_id, episode_idx), each batch in its own folder.

    A replayed batch overwrites its own folder, so results are neither lost nor counted twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def current_rollouts(df: DataFrame) -> DataFrame:
    """Latest record per (task_id, episode_idx) of what the writer stored."""
    return latest(df, ["task_id", "episode_idx"], F.struct("batch", F.col("success").cast("int")))


KEY_BUCKETS = 256


def annotate_new(path: str, annotate, key: str = "episode", buckets: int = KEY_BUCKETS):
    """foreachBatch writer for incremental annotation: only keys without a good row are sent on.

    ``annotate(requests) -> (key, response, error, attempts)``. Each batch's results are written
    once, good and failed together, so no answer is asked for twice; failures do not count as done,
    so the next run that sees them tries again. The keys that are done lie in a table of their own, in buckets and out of the
    readers' sight: a batch reads the keys of its own buckets, and no result of an earlier batch. A replayed batch replaces what it
    wrote. ``annotated`` reads the results.
    """

    def bucket(df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mine = [r[0] for r in bucket(batch.select(key)).select("_bucket").distinct().collect()]  # at most ``buckets``
        todo = batch
        try:
            done = spark.read.parquet(f"{path}/_keys").filter((F.col("batch") != batch_id) & F.col("_bucket").isin(mine))
            todo = pending(batch, done.select(key), [key])
        except AnalysisException as e:  # the first batch finds no table yet
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        annotate(todo).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        good = spark.read.parquet(f"{path}/batch={batch_id}").filter(F.col("error").isNull())
        bucket(good.select(key).distinct()).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/_keys/batch={batch_id}")

    return write


def annotated(spark: SparkSession, path: str) -> DataFrame:
    """What ``annotate_new`` has written, with its batch."""
    return spark.read.parquet(path)
