"""Sources, sinks and whole jobs on small files."""

import gzip
import json
from pathlib import Path
from uuid import uuid4

import numpy as np
import pytest
from pyspark.sql import functions as F

from demospan import schemas
from demospan.functions import vocab as V
from demospan.plans import annotate as AN
from demospan.plans import audit as AU
from demospan.plans import combine as CO
from demospan.plans import cot as CT
from demospan.plans import encode as EN
from demospan.plans import probe as PR
from demospan.plans import rollouts as RO
from demospan.plans import transitions as TR
from demospan.plans.select import in_range, select_episodes, verbs_at
from demospan.sources import readers as R
from demospan.sources import sinks as W


def episode(i, **more):
    return {
        "episode_index": i, "task_index": 0, "instruction": "move the cup", "num_steps": 20, "fps": 10,
        "plan": "1. PICKUP_FROM(cup, table) 2. PLACE_ON(cup, shelf)",
        "segments": [{"start_step": 0, "end_step": 12, "skill": "PICKUP_FROM(cup, table)"}, {"start_step": 12, "end_step": 20, "skill": "PLACE_ON(cup, shelf)"}],
        **more,
    }


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data))


def test_metadata_lists(spark, tmp_path):
    put(tmp_path / "meta/info.json", "{}")
    put(tmp_path / "meta/tasks.jsonl", '{"task_index": 0, "task": "a"}\n\n{"task_index": 1, "task": "a"}\n')
    put(tmp_path / "meta/episodes.jsonl", '{"episode_index": 0, "length": 5, "tasks": [" pick: go left "]}\n{"episode_index": 1, "length": 6, "task": "a", "task_index": 7}\n')
    assert R.resolve_snapshot(str(tmp_path)) == str(tmp_path)
    assert R.read_tasks(spark, str(tmp_path)).filter("task is not null").count() == 2
    rows = R.with_task_names(R.read_episodes(spark, str(tmp_path))).orderBy("episode_index").collect()
    assert [(r.task_name, r.instruction, r.task_index, r.length) for r in rows] == [("pick", "go left", None, 5), (None, "a", 7, 6)]
    with pytest.raises(FileNotFoundError):
        R.resolve_snapshot(str(tmp_path / "none"))


def test_frame_files(spark, tmp_path):
    for e in (0, 1001):
        f = tmp_path / f"data/chunk-{e // 1000:03d}/episode_{e:06d}.parquet"
        f.parent.mkdir(parents=True)
        spark.range(4).select(F.array(F.col("id").cast("double")).alias("state")).coalesce(1).toPandas().to_parquet(f)
    got = R.read_frames(spark, str(tmp_path)).orderBy("episode", "step").collect()
    assert [(r.episode, r.step, r.chunk, r.state[0]) for r in got if r.step in (0, 3)] == [(0, 0, 0, 0.0), (0, 3, 0, 3.0), (1001, 0, 1, 0.0), (1001, 3, 1, 3.0)]
    assert spark.range(1).select(R.chunk_path(F.lit(1001))).first()[0] == "data/chunk-001/episode_001001.parquet"


def test_shards_and_combined_files(spark, tmp_path):
    for i in (3, 1):
        put(tmp_path / f"s/episode_{i:06d}.json", json.dumps(episode(i), indent=1))
    put(tmp_path / "s/episode_1.json", episode(9))
    assert sorted(r.episode_index for r in R.read_annotations(spark, str(tmp_path / "s")).collect()) == [1, 3]
    no_index = episode(0)
    del no_index["episode_index"]
    put(tmp_path / "c/all.json", {"schema_version": "v1", "fps": 10, "4": no_index, "12": episode(12)})
    put(tmp_path / "c/one.json", episode(5))
    rows, header = R.read_combined(spark, str(tmp_path / "c"))
    assert sorted(r.episode_index for r in rows.collect()) == [4, 5, 12]
    assert {r.key: r.value for r in header.collect()} == {"schema_version": "v1", "fps": "10"}
    assert AU.audit_annotations(rows, "libero").count() == 0


def test_document_round_trip(spark, tmp_path):
    a = spark.read.schema(schemas.ANNOTATION).json(spark.sparkContext.parallelize([json.dumps(episode(i)) for i in (10, 2)]))
    W.write_document(a, CO.header_row(a, "v1", fps=10), str(tmp_path / "doc"))
    parts = sorted(p for p in (tmp_path / "doc").iterdir() if p.suffix == ".txt")
    whole = json.loads("".join(p.read_text() for p in parts))
    assert list(whole) == ["schema_version", "fps", "2", "10"] and whole["10"]["segments"][1]["end_step"] == 20
    assert [r.key for r in W.document_rows(a).orderBy("key").collect()] == ["10", "2"]
    W.write_annotations(a, str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 2
    W.write_ids(a, str(tmp_path / "ids"))
    assert [r.value for r in spark.read.text(str(tmp_path / "ids")).collect()] == ["2", "10"]
    W.append_manifest(a, str(tmp_path / "runs"), model="m")
    assert spark.read.parquet(str(tmp_path / "runs")).first().model == "m"
    assert "- episodes: 2\n- tasks: 1\n- steps: 40" in W.dataset_card(a, "demo")


def test_target_lists(spark, tmp_path):
    target = {"type": "movable", "id": "cup", "appearance": "red", "location": "left", "image_point": [1, 2]}
    (tmp_path / "7_targets.json.zip").write_bytes(R.target_lists_text([target, None]))
    (tmp_path / "8_targets.json.zip").write_bytes(gzip.compress(b"[]"))
    rows = R.read_target_lists(spark, str(tmp_path)).orderBy("episode", "position").collect()
    assert [(r.episode, r.position, r.listed, r.target and r.target.id) for r in rows] == [(7, 0, 2, "cup"), (7, 1, 2, None), (8, 0, 0, None)]


def test_latents(spark, tmp_path):
    block = np.arange(24, dtype="<f4").reshape(3, 2, 4)
    (tmp_path / "episode_5.bin.gz").write_bytes(gzip.compress(block.tobytes()))
    put(tmp_path / "episode_5.json", {"dtype": "<f4", "shape": [3, 2, 4]})
    l = R.read_latents(spark, str(tmp_path))
    rows = l.orderBy("step").collect()
    assert [r.step for r in rows] == [0, 1, 2] and rows[2].embedding == block[2].ravel().tolist() and rows[0].shape == [2, 4]
    assert EN.patch_rows(l, 1, 2).filter("step = 1 and col = 1").first().vec == block[1, 1].tolist()
    W.write_latents(l, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_samples_rollouts_videos_scene(spark, tmp_path):
    put(tmp_path / "s.txt", "pick up bowl\n\nfly away, f\npick up bowl\n")
    s = R.read_samples(spark, str(tmp_path / "s.txt"))
    assert [(r.text, r.known_false) for r in s.orderBy("line").collect()] == [("pick up bowl", False), ("fly away", True), ("pick up bowl", False)]
    verdicts = spark.createDataFrame([("pick up bowl", True), ("fly away", False)], "text string, accepted boolean")
    c = RO.score_verifier(s, verdicts).first()
    assert (c.total, c.accepted, c.caught, c.missed) == (2, 1, 1, 0)
    assert R.read_plan_samples(spark, str(tmp_path / "s.txt")).count() == 3

    done = [{"task_id": 0, "episode_idx": i, "success": i == 0, "task_prompt": "p", "plan": "x"} for i in range(2)]
    put(tmp_path / "r/a.json", {"task_suite": "libero_10", "model_name": "m", "completed_episodes": done})
    put(tmp_path / "r/b.json", {"task_suite": "other", "model_name": "m", "completed_episodes": done})
    rows, foreign = R.read_rollouts(spark, str(tmp_path / "r"), "libero_10")
    assert rows.count() == 2 and foreign.count() == 1
    left = RO.remaining(spark.createDataFrame([(0,), (1,)], "task_id long"), 2, rows)
    assert sorted((r.task_id, r.episode_idx) for r in left.collect()) == [(1, 0), (1, 1)]

    put(tmp_path / "v/videos/chunk-002/top/episode_000009.mp4", "x")
    v = R.list_videos(spark, str(tmp_path / "v")).first()
    assert (v.episode, v.chunk, v.stream, v.length) == (9, 2, "top", 1)
    lines = spark.createDataFrame([("  cup - movable ; red cup | left ",), ("robot0 - robot",), ("(:init",)], "value string")
    assert [tuple(r) for r in R.scene_objects(lines).collect()] == [("cup", "movable", "red cup", "left"), ("robot0", "robot", None, None)]
    names = spark.range(1).select(R.image_stream(F.lit("top")), R.image_stream(F.lit("x")), R.camera_of_stream(F.lit("image"))).first()
    assert list(names) == ["observation.images.top", None, "agentview"]


def test_combine_and_train(spark):
    a = spark.read.schema(schemas.ANNOTATION).json(spark.sparkContext.parallelize([json.dumps(episode(i)) for i in (1, 2, 2)])).withColumn("source", F.lit("s"))
    rows, twice, absent = CO.combine(a, spark.createDataFrame([(1,), (3,)], "episode_index long"))
    assert [r.episode_index for r in rows.collect()] == [1]
    assert [(r.episode_index, r.rows) for r in twice.collect()] == [(2, 2)] and [r.episode_index for r in absent.collect()] == [3]
    parts = CO.training_segments(rows, "libero", 10)
    got = [(r.seg_index, r.part, r.start_step, r.end_step, r.updated_skill) for r in parts.orderBy("start_step").collect()]
    assert got == [(0, "boundary", 0, 10, "PICKUP_FROM(cup, table)"), (0, "action", 10, 12, None), (1, "boundary", 12, 20, "PLACE_ON(cup, shelf)")]
    assert CO.start_intervals(parts).first().interval_end == 10
    good, bad = AN.annotation_rows(
        spark.createDataFrame([(1, 0, "go", 20)], "episode_index long, task_index long, instruction string, length long"),
        spark.createDataFrame([(1, json.dumps({"plan": "1. OPEN(a)", "steps": [{"skill": "OPEN( a )", "end_step": 19}]}))], "episode_index long, response string"),
        "libero", "m", "v")
    assert bad.count() == 0 and good.first().segments[0].end_step == 20


def trace_episode(**change):
    dense = {"trace": [[10 + s, 10] for s in range(12)], "raw_trace": [[10.0, 10.0]] * 12, "out_of_bounds_fraction": 0.0, "out_of_bounds_count": 0, "frame_indices": list(range(12)),
             "in_bounds": [True] * 12, "projection_depth": [1.0] * 12, "reprojection_checks": {"exact_max_error_meters": 1e-9, "rounded_in_bounds_max_error_meters": 0.001}}
    point = {"object_id": "cup", "label": "l", "point": [5, 5]}
    contact = {"contact_start_step": 2, "frame_indices": [2, 4], "trace": [[1, 1], [2, 2]], "model_trace": [[1, 1], [2, 2]]}
    second = json.loads(json.dumps(dense))
    second.update(trace=[[30, 10 + s] for s in range(8)], raw_trace=[[1.0, 1.0]] * 8, frame_indices=list(range(12, 20)), in_bounds=[True] * 8, projection_depth=[1.0] * 8)
    entries = [
        {"skill_index": 0, "skill": "PICKUP_FROM(cup, table)", "start_step": 0, "end_step": 12, "sampled_frame_indices": [0, 2, 4], "semantic_target": point, "contact_prediction": point, "prediction_trace": contact, "end_effector_trace": dense},
        {"skill_index": 1, "skill": "PLACE_ON(cup, shelf)", "start_step": 12, "end_step": 20, "sampled_frame_indices": [12], "semantic_target": point, "contact_prediction": point, "end_effector_trace": second},
    ]
    e = episode(1, target_traces=entries, image_key="image", end_effector_trace_enabled=True)
    e = json.loads(json.dumps(e))
    for path, value in change.items():
        at = e
        *way, last = path.split("__")
        for k in way:
            at = at[int(k) if k.isdigit() else k]
        at[last] = value
    return e


def audit(spark, **change):
    t = spark.read.schema(schemas.TRACE_ANNOTATION).json(spark.sparkContext.parallelize([json.dumps(trace_episode(**change))]))
    a = spark.read.schema(schemas.ANNOTATION).json(spark.sparkContext.parallelize([json.dumps(episode(1))]))
    header = spark.sql("select 64L image_width, 48L image_height, cast(null as boolean) semantic_target_enabled, cast(null as boolean) contact_prediction_enabled, cast(null as boolean) contact_extraction_enabled, false contact_prediction_only_enabled, false end_effector_trace_enabled")
    return sorted((r.position, r.rule) if r.position is not None else (-1, r.rule) for r in AU.audit_traces(t, a, header).collect())


def test_trace_audit(spark):
    assert audit(spark) == []
    p = "target_traces__0__"
    cases = {
        p + "skill": ("x", [(0, "wrong_skill")]),
        p + "skill_index": (4, [(0, "wrong_skill_index")]),
        p + "semantic_target": (None, [(-1, "semantic_count"), (0, "semantic_target_missing")]),
        p + "semantic_target__point": ([64, 1], [(0, "semantic_target_off_image")]),
        p + "prediction_trace__frame_indices": ([4, 2], [(0, "prediction_trace_first_frame_not_contact"), (0, "prediction_trace_frames_not_sorted")]),
        p + "prediction_trace__contact_start_step": (3, [(0, "prediction_trace_contact_not_sampled"), (0, "prediction_trace_first_frame_not_contact"), (0, "prediction_trace_frame_outside_contact")]),
        p + "end_effector_trace__trace": ([[1, 1]], [(-1, "dense_points_not_num_steps"), (0, "dense_trace_not_every_step")]),
        p + "end_effector_trace__reprojection_checks__exact_max_error_meters": (1.0, [(0, "dense_exact_error")]),
        "num_steps": (21, [(-1, "num_steps_differ")]),
    }
    for path, (value, want) in cases.items():
        assert audit(spark, **{path: value}) == want, path


def test_trace_combination_strips_and_counts(spark):
    t = spark.read.schema(schemas.TRACE_ANNOTATION).json(spark.sparkContext.parallelize([json.dumps(trace_episode())])).withColumn("source", F.lit("s"))
    a = spark.read.schema(schemas.ANNOTATION).json(spark.sparkContext.parallelize([json.dumps(episode(1))]))
    rows, header, stats, wrong, twice, absent = CO.combine_traces(t, a)
    first, second = rows.first().target_traces
    assert first.sampled_frame_indices == [0, 2, 4] and second.sampled_frame_indices is None
    assert "in_bounds" not in first.end_effector_trace.asDict() and len(first.end_effector_trace.trace) == 12
    assert header.first().image_key == "image" and wrong.count() == 0 and twice.count() == 0 and absent is None
    assert {(r.verb, r["count"], r["min"]) for r in stats.collect()} == {("PICKUP_FROM", 1, 12), ("PLACE_ON", 1, 8)}


def test_conversion_keeps_instruction_and_rebuilds(spark):
    old = "Instruction: do it.\nPlan: 1. grab the bowl\n What I have done: Nothing.\nNow I need to do: grab the bowl\n"
    new = "Instruction: other.\nPlan: 1. PICK(bowl) now\n What I have done: nothing\nNow I need to do: PICK(bowl)\n"
    seg = spark.createDataFrame([(1, 0, old, old.split("\n", 1)[1], old, None)], "episode long, seg_index long, content string, updated_content string, updated_content_w_instruction string, current_skill string")
    asked = CT.fields_to_convert(seg, ["episode", "seg_index"])
    assert asked.count() == 3
    answers = asked.withColumn("text", F.when(F.col("field") == "updated_content", new.split("\n", 1)[1]).otherwise(new))
    out, wrong = CT.convert(seg, answers, ["episode", "seg_index"])
    r = out.first()
    assert wrong.count() == 0 and r.current_skill == "PICK(bowl)" and r.content.startswith("Instruction: do it.\nPlan: 1. PICK(bowl)\n")
    assert r.updated_content_w_instruction == "Instruction: do it.\n" + r.updated_content
    good, bad = CT.repair(out, ["episode", "seg_index"])
    assert bad.count() == 0 and good.first().updated_skill == "PICK(bowl)"
    assert CT.diff(seg, good, ["episode", "seg_index"]).count() == 0


def test_selection_errors(spark):
    with pytest.raises(ValueError):
        verbs_at(F.col("v"), [(1, "OPEN"), (1, "CLOSE")], "libero")
    with pytest.raises(ValueError):
        verbs_at(F.col("v"), [(1, "JUMP")], "libero")
    with pytest.raises(ValueError):
        in_range(F.col("i"), 5, 5, 10)
    df = spark.createDataFrame([(i, "1. OPEN(a)") for i in range(9)], "episode_index long, plan string")
    assert [r.episode_index for r in select_episodes(df, "libero", skill_at=[(1, "open")], limit=2).collect()] == [0, 1]
    with pytest.raises(ValueError):
        select_episodes(df, "libero", limit=0)


def test_probe_and_images(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 4, [float(v) for v in x], [float(2 * x[0] - x[2])]) for i, x in enumerate(rng.normal(size=(60, 3)))]
    data = spark.createDataFrame(rows, "step int, vector array<double>, pose array<double>")
    loss = PR.loss_by_step(data, PR.fit_linear_probe(data, 1)).collect()
    assert len(loss) == 4 and all(r.loss < 1e-9 for r in loss)
    segs = spark.createDataFrame([(1, 0, 0), (1, 1, 12)], "episode long, seg_index long, start_step long")
    names = [r.name for r in TR.expected_files(segs).collect()]
    have = spark.createDataFrame([("a", 1, n) for n in names] + [("b", 1, names[0])], "root string, episode long, name string")
    assert TR.image_roots(segs, have).first().root == "a"
    assert TR.backfill(segs, have.filter("root = 'b'")).first().name == names[1]


class CountingClient:
    """Leaves a file for each call in the folder that its prompt names."""

    def complete(self, prompt, use_schema):
        folder, kind = prompt.split("\n")[0].split("|")
        Path(folder, uuid4().hex).touch()
        return kind


def test_a_model_is_asked_once_however_many_outputs_are_read(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    requests = spark.createDataFrame([(i, f"{calls}|{'good' if i % 2 else 'bad'}") for i in range(10)], "episode bigint, prompt string")
    r = AN.annotate_to(str(tmp_path / "answers"), requests, "episode", CountingClient, lambda s: None if s == "good" else "no", attempts=3)
    good, errors = AN.split_errors(r, None, "episode")
    assert good.count() == 5 and errors.count() == 5 and r.count() == 10
    assert len(list(calls.iterdir())) == 5 + 5 * 3


def test_rows_are_not_lost_without_their_other_half(spark):
    from demospan.plans import traces as TR

    frames = spark.createDataFrame([(1, 0.1, 0.2, 1.0), (2, 0.1, 0.2, 1.0), (None, 0.1, 0.2, 1.0)], "camera bigint, wx double, wy double, wz double")
    eye = [[float(i == j) for j in range(4)] for i in range(4)]
    cameras = spark.createDataFrame([(1, eye, V.NO_TRANSFORM)], "camera bigint, matrix array<array<double>>, convention string")
    p = {r.camera: r for r in TR.project_points(frames, cameras).collect()}
    assert len(p) == 3 and p[1].raw_x is not None and p[2].raw_x is None and p[2].x is None and not p[2].in_bounds
    assert {(r.camera, r.frames) for r in TR.uncalibrated(frames, cameras).collect()} == {(2, 1), (None, 1)}
