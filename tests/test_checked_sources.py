"""Broken input is kept aside, episode files are found by number, and buckets are rewritten where touched."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
from demospan.sources import readers as R, sinks as W
from pyspark.sql import functions as F


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))


SEGMENT = {"start_step": 0, "end_step": 5, "skill": "OPEN(door)"}


def test_broken_shards_are_dead_letters(spark, tmp_path):
    put(tmp_path / "episode_000001.json", json.dumps({"episode_index": 1, "num_steps": 5, "segments": [SEGMENT]}, indent=2))
    put(tmp_path / "episode_000002.json", '{"episode_index": 2, "num_st')
    put(tmp_path / "episode_000003.json", {"episode_index": 3, "num_steps": True})
    put(tmp_path / "episode_000004.json", {"episode_index": 4, "segments": [{**SEGMENT, "start_step": 1.5}]})
    put(tmp_path / "episode_000005.json", "[1, 2]")
    put(tmp_path / "episode_000006.json", "")
    put(tmp_path / "episode_7.json", {"episode_index": 7})
    rows, letters = R.read_annotations_checked(spark, str(tmp_path))
    assert [(r.episode_index, r.num_steps, len(r.segments)) for r in rows.collect()] == [(1, 5, 1)]
    got = {r.source[-11:-5]: r.reason for r in letters.collect()}
    assert {k: got[k] for k in ("000002", "000003", "000004", "000005")} == {
        "000002": "unreadable", "000003": "unreadable", "000004": "unreadable", "000005": "not_an_object",
    }
    assert [r.episode_index for r in R.read_annotations(spark, str(tmp_path)).collect()] == [1]


def test_broken_entries_are_dead_letters(spark, tmp_path):
    put(tmp_path / "a.json", json.dumps({"version": "v1", "4": {"num_steps": 3}, "5": "lost", "6": {"num_steps": "many"}, "7": None}, indent=1))
    put(tmp_path / "b.json", "{broken")
    put(tmp_path / "c.json", {"episode_index": 9, "segments": [SEGMENT]})
    rows, header, letters = R.read_combined_checked(spark, str(tmp_path))
    assert sorted(r.episode_index for r in rows.collect()) == [4, 9]
    assert [(r.key, r.value) for r in header.collect()] == [("version", "v1")]
    assert {(r.key, r.reason) for r in letters.collect()} == {
        ("5", "not_an_object"), ("6", "unreadable"), ("7", "not_an_object"), (None, "not_an_object"),
    }


def test_document_parts_are_read_back(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("episode_index"), F.concat(F.lit('say "}{" '), "id").alias("instruction"))
    W.write_document(rows, spark.range(1).select(F.lit("v1").alias("version")), str(tmp_path / "d"))
    back, header, letters = R.read_document_parts(spark, str(tmp_path / "d"), "episode_index bigint, instruction string")
    assert {tuple(r) for r in back.select("episode_index", "instruction").collect()} == {tuple(r) for r in rows.collect()}
    assert [(r.key, r.value) for r in header.collect()] == [("version", "v1")] and letters.count() == 0


def test_frames_of_some_episodes_open_their_files_only(spark, tmp_path):
    for e in (0, 1, 999, 1000, 2500):
        path = tmp_path / f"data/chunk-{e // 1000:03d}/episode_{e:06d}.parquet"
        path.parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({"v": [e, e + 1]}), path)
    assert R.read_frames(spark, str(tmp_path)).count() == 10
    one = R.read_frames(spark, str(tmp_path), episodes=[1000])
    assert [f.rsplit("/", 1)[1] for f in one.inputFiles()] == ["episode_001000.parquet"]
    some = R.read_frames(spark, str(tmp_path), ["v"], episodes=[2500, 0, 999, 0])
    assert len(some.inputFiles()) == 3
    assert sorted((r.episode, r.step, r.chunk, r.v) for r in some.collect()) == [
        (0, 0, 0, 0), (0, 1, 0, 1), (999, 0, 0, 999), (999, 1, 0, 1000), (2500, 0, 2, 2500), (2500, 1, 2, 2501),
    ]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "a")
    first = spark.range(1000).select(F.col("id").alias("episode_index"), F.lit("old").alias("instruction"))
    W.write_annotations(first, path, buckets=8)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "a").rglob("*.json")}
    assert len(files) <= 8
    again = spark.createDataFrame([(7, "new"), (5000, "added"), (None, "no key")], "episode_index bigint, instruction string")
    W.write_annotations(again, path, buckets=8)
    W.write_annotations(again, path, buckets=8)  # a rerun changes nothing
    kept = [f for f, at in files.items() if f.exists() and f.stat().st_mtime_ns == at]
    assert len(files) - 3 <= len(kept) < len(files)
    rows = {r.episode_index: r.instruction for r in spark.read.json(path).collect()}
    assert len(rows) == 1002 and rows[7] == "new" and rows[5000] == "added" and rows[8] == "old" and rows[None] == "no key"
    assert spark.read.json(path).count() == 1002
