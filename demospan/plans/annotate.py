"""Batch annotation through a pluggable client, and the checks that turn its output into rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions import geometry as G
from ..functions import text as X
from ..functions import vocab as V
from ..operators.joins import by_shuffle, pending
from ..operators.setops import unresolved_errors


class SchemaRefused(Exception):
    """Raised by a client whose service does not accept a response schema."""


class Client(Protocol):
    def complete(self, prompt: str, use_schema: bool) -> str: ...


def annotate(
    requests: DataFrame,
    key: str,
    client: Callable[[], Client],
    check: Callable[[str], str | None],
    done: DataFrame | None = None,
    attempts: int = 4,
    backoff: float = 0.0,
    partitions: int | None = None,
) -> DataFrame:
    """(key, prompt) -> (key, response, error, attempts), leaving out keys already done.

    The error of a failed attempt is appended to the next prompt. A refused response schema is
    dropped once, which does not use up an attempt. One client is made per partition.
    """
    todo = requests if done is None else pending(requests, done, [key])
    todo = todo.select(key, "prompt")
    todo = todo.repartition(partitions, key) if partitions else todo
    kind = dict(todo.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, use_schema = client(), True
        for batch in batches:
            rows = []
            for k, prompt in zip(batch[key], batch["prompt"]):
                response, error, used = None, None, 0
                while used < attempts:
                    ask = prompt if error is None else f"{prompt}\nThe previous answer was refused: {error}"
                    try:
                        response = made.complete(ask, use_schema)
                        error = check(response)
                    except SchemaRefused as e:
                        if use_schema:
                            use_schema = False
                            continue
                        error = str(e)
                    except Exception as e:  # noqa: BLE001 - any client failure becomes an error row
                        error = f"{type(e).__name__}: {e}"
                    used += 1
                    if error is None:
                        break
                    if backoff and used < attempts:
                        time.sleep(backoff * used)
                rows.append((k, response if error is None else None, error, used))
            yield pd.DataFrame(rows, columns=[key, "response", "error", "attempts"])

    return todo.mapInPandas(run, f"{key} {kind}, response string, error string, attempts int")


def annotate_to(path: str, requests: DataFrame, key: str, client, check, **how) -> DataFrame:
    """The rows of ``annotate``, written once to ``path`` and read from there.

    Whatever is derived from them afterwards (good rows, dead letters, annotation rows) reads what was
    written, so the model is not asked again and the outputs agree with each other.
    """
    annotate(requests, key, client, check, **how).write.mode("errorifexists").parquet(path)
    return requests.sparkSession.read.parquet(path)


def split_errors(results: DataFrame, earlier: DataFrame | None, key: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters) of stored results. A key that succeeded now is no longer a dead letter."""
    good, bad = results.filter(F.col("error").isNull()), results.filter(F.col("error").isNotNull())
    errors = bad.select(key, "error")
    if earlier is not None:
        errors = errors.unionByName(unresolved_errors(earlier.select(key, "error"), results, [key]))
    return good, errors


PROMPTS = {
    # one template per job; {fields} are filled from columns of the row
    "skills": (
        "Split the demonstration into skills.\nTask: {instruction}\nSteps: {num_steps} at {fps} frames per second.\n"
        "Allowed skills: {skills}\nGive the plan as a numbered string and each skill with its exclusive end_step; "
        "the last end_step is {num_steps}. Answer with JSON only: plan, steps."
    ),
    "target": (
        "Mark the target of the skill.\nSkill: {skill}\nObject: {object}\n{policy}\n"
        "Answer with JSON only: status, reasoning, object_id, label, point_2d as [y, x] on a {grid} grid."
    ),
    "trace": (
        "Trace the contact point over the frames {frames}.\nSkill: {skill}\n{policy}\n"
        "Answer with JSON only: status, reasoning, contact_start_step, points."
    ),
    "conversion": "Rewrite the plan texts in skill syntax and keep the keys.\n{fields}",
}

POLICIES = {
    # verb group -> what to point at, for the three kinds of queries
    "semantic": {
        "pick": "Point at the body of the object that will be picked up.",
        "place": "Point at the place that receives the carried object.",
        "move": "Point at the handle or edge that is grasped, not at the middle of the furniture.",
        "switch": "Point at the knob, button or switch that is operated.",
    },
    "contact": {
        "pick": "Point at the rim, edge or handle where the gripper will touch the object.",
        "place": "The object is already held: point at the place where the gripper touches it.",
        "move": "Point at the handle or edge where the gripper will touch.",
        "switch": "Point at the control where the gripper will touch.",
    },
    "extraction": {
        "pick": "The contact is on the object that is picked up.",
        "place": "The contact is where the gripper already holds the object.",
        "move": "The contact is on a handle or edge.",
        "switch": "The contact is on the control.",
    },
}
VERB_GROUP = {
    "PICKUP_FROM": "pick",
    "PLACE_ON": "place",
    "PLACE_IN": "place",
    "OPEN": "move",
    "CLOSE": "move",
    "TURN_ON": "switch",
    "TURN_OFF": "switch",
}


def policy_text(verb: Column, kind: str) -> Column:
    return V.literal_map({v: POLICIES[kind][g] for v, g in VERB_GROUP.items()})[verb]


def prompt_text(job: str, **fields: Column) -> Column:
    """Fill a template from columns."""
    out = F.lit(PROMPTS[job])
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


# --- model answers -> rows ------------------------------------------------------------------------


def normalize_steps(response: Column, num_steps: Column, dataset: str) -> Column:
    """struct(plan, skills, segments, reason) from a model answer with a plan and end steps.

    Ends must rise, the plan must list the same skills, and the last end may be off by two steps,
    in which case it is set right.
    """

    def placed(steps: Column, total: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            parsed = X.parse_skill(s["skill"], dataset)
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(steps, i - 1)["end_step"])
            near = F.abs(s["end_step"] - total) <= V.END_SNAP_STEPS
            end = F.when((i == F.size(steps) - 1) & near, total).otherwise(s["end_step"])

            def shape(p: Column) -> Column:
                reason = (
                    p["reason"].isNotNull(),
                    s["end_step"].isNull(),
                    s["end_step"] <= start,
                )
                said = (
                    F.when(reason[0], p["reason"])
                    .when(reason[1], "end_step_not_integer")
                    .when(reason[2], "end_step_not_rising")
                )
                return F.struct(
                    start.cast("bigint").alias("start_step"),
                    end.alias("end_step"),
                    p["skill"].alias("skill"),
                    said.alias("reason"),
                )

            return X.let(parsed, shape)

        return F.transform(steps, one)

    def collect(r: Column) -> Column:
        steps = F.transform(
            r["answer"]["steps"],
            lambda s: F.struct(s["skill"].alias("skill"), s["end_step"].try_cast("double").cast("bigint").alias("end_step")),
        )
        plan = r["answer"]["plan"]
        listed = F.from_json(plan, "array<string>")
        from_list = F.struct(
            F.transform(listed, lambda s: X.canonical_skill(s, dataset)).alias("skills"),
            F.when(F.exists(listed, lambda s: X.canonical_skill(s, dataset).isNull()), "invalid_plan_skill").alias("reason"),
        )
        is_list = F.ltrim(plan).startswith("[") & listed.isNotNull()
        return F.struct(
            r["total"].alias("total"),
            plan.isNull().alias("no_plan"),
            (F.coalesce(F.size(steps), F.lit(0)) <= 0).alias("no_steps"),
            X.let(steps, lambda s: placed(s, r["total"])).alias("segments"),
            F.when(is_list, from_list).otherwise(X.parse_plan(plan, dataset)).alias("plan"),
        )

    def judge(p: Column) -> Column:
        first_wrong = X.first_of(F.transform(p["segments"], lambda s: s["reason"]), lambda x: x.isNotNull())
        skills = F.transform(p["segments"], lambda s: s["skill"])
        last = F.try_element_at(p["segments"], F.lit(-1))
        reason = (
            F.when(p["no_steps"], "no_steps")
            .when(p["no_plan"], "no_plan")
            .when(first_wrong.isNotNull(), first_wrong)
            .when(p["plan"]["reason"].isNotNull(), p["plan"]["reason"])
            .when(p["plan"]["skills"] != skills, "plan_not_equal_steps")
            .when(last["end_step"] != p["total"], "last_end_not_num_steps")
            .when(F.exists(p["segments"], lambda s: s["end_step"] <= s["start_step"]), "non_positive_length")
        )
        return F.struct(p["segments"].alias("segments"), skills.alias("skills"), reason.alias("reason"))

    def shape(j: Column) -> Column:
        ok = j["reason"].isNull()
        segments = F.transform(j["segments"], lambda s: F.struct(s["start_step"], s["end_step"], s["skill"]))
        return F.struct(
            F.when(ok, X.format_plan(j["skills"])).alias("plan"),
            F.when(ok, j["skills"]).alias("skills"),
            F.when(ok, segments).alias("segments"),
            j["reason"].alias("reason"),
        )

    answer = F.from_json(X.strip_code_fence(response), schemas.MODEL_RESPONSE)
    both = F.struct(answer.alias("answer"), num_steps.cast("bigint").alias("total"))
    return X.let(X.let(X.let(both, collect), judge), shape)


def normalize_point(
    response: Column, object_id: Column, label: Column, width: int, height: int, grid: int = V.MODEL_GRID
) -> Column:
    """struct(x, y, model_y, model_x, reason): a model point as a pixel, or the first rule it breaks."""

    def judge(a: Column) -> Column:
        y, x = X.strict_number(F.get(a["r"]["point_2d"], F.lit(0))), X.strict_number(F.get(a["r"]["point_2d"], F.lit(1)))
        return F.struct(
            y.alias("y"),
            x.alias("x"),
            F.when(a["r"].isNull(), "not_an_object")
            .when(F.upper(F.trim(F.coalesce(a["r"]["status"], F.lit("")))) != "OK", "status_not_ok")
            .when(~F.trim(F.coalesce(a["r"]["object_id"], F.lit(""))).eqNullSafe(a["object_id"]), "wrong_object")
            .when(~F.trim(F.coalesce(a["r"]["label"], F.lit(""))).eqNullSafe(a["label"]), "wrong_label")
            .when(F.coalesce(F.size(a["r"]["point_2d"]), F.lit(0)) != 2, "point_not_pair")
            .alias("reason"),
        )

    def shape(p: Column) -> Column:
        reason = (
            F.when(p["reason"].isNotNull(), p["reason"])
            .when(p["y"].isNull() | p["x"].isNull(), "point_not_numeric")
            .when(~p["y"].between(0, grid) | ~p["x"].between(0, grid), "point_off_grid")
        )
        ok = reason.isNull()
        my, mx = G.half_even(p["y"]), G.half_even(p["x"])
        pixel = G.grid_to_pixel(my.cast("double"), mx.cast("double"), width, height, grid, grid)
        return F.struct(
            F.when(ok, pixel["x"]).alias("x"),
            F.when(ok, pixel["y"]).alias("y"),
            F.when(ok, my).alias("model_y"),
            F.when(ok, mx).alias("model_x"),
            reason.alias("reason"),
        )

    whole = F.struct(
        F.from_json(X.strip_code_fence(response), schemas.POINT_RESPONSE).alias("r"),
        object_id.alias("object_id"),
        label.alias("label"),
    )
    return X.let(X.let(whole, judge), shape)


def normalize_trace(
    response: Column,
    label: Column,
    sampled: Column,
    start: Column,
    end: Column,
    width: int,
    height: int,
    grid: int = V.MODEL_GRID,
) -> Column:
    """struct(contact_start_step, frames, trace, reason) from a traced answer."""

    def points(a: Column) -> Column:
        contact = a["r"]["contact_start_step"].try_cast("bigint")

        def one(p: Column) -> Column:
            read = F.struct(
                X.strict_number(F.get(p["point_2d"], F.lit(0))).alias("y"),
                X.strict_number(F.get(p["point_2d"], F.lit(1))).alias("x"),
                p["frame_index"].try_cast("bigint").alias("frame"),
            )

            def judge(q: Column) -> Column:
                y, x, frame = q["y"], q["x"], q["frame"]
                reason = (
                    F.when(~F.trim(F.coalesce(p["label"], F.lit(""))).eqNullSafe(a["label"]), "wrong_label")
                    .when(~F.coalesce(F.array_contains(a["sampled"], frame), F.lit(False)), "frame_not_sampled")
                    .when((frame < contact) | (frame >= a["end"]), "frame_outside_contact")
                    .when((F.size(p["point_2d"]) != 2) | y.isNull() | x.isNull(), "point_not_numeric")
                    .when(~y.between(0, grid) | ~x.between(0, grid), "point_off_grid")
                )
                pixel = G.grid_to_pixel(
                    G.half_even(y).cast("double"), G.half_even(x).cast("double"), width, height, grid, grid
                )
                return F.struct(frame.alias("frame"), pixel.alias("pixel"), reason.alias("reason"))

            return X.let(read, judge)

        listed = F.transform(a["r"]["points"], one)
        return F.struct(
            contact.alias("contact"),
            listed.alias("points"),
            F.when(a["r"].isNull(), "not_an_object")
            .when(F.upper(F.trim(F.coalesce(a["r"]["status"], F.lit("")))) != "OK", "status_not_ok")
            .when(contact.isNull(), "contact_not_integer")
            .when(~F.array_contains(a["sampled"], contact), "contact_not_sampled")
            .when((contact < a["start"]) | (contact >= a["end"]), "contact_outside_segment")
            .when(F.coalesce(F.size(a["r"]["points"]), F.lit(0)) <= 0, "no_points")
            .alias("reason"),
        )

    def check(p: Column) -> Column:
        frames = F.transform(p["points"], lambda q: q["frame"])
        first_wrong = X.first_of(F.transform(p["points"], lambda q: q["reason"]), lambda r: r.isNotNull())

        def order(f: Column) -> Column:
            return (
                F.when(f != F.array_sort(f), "frames_not_sorted")
                .when(F.size(F.array_distinct(f)) != F.size(f), "frames_repeat")
                .when(F.get(f, F.lit(0)) != p["contact"], "first_frame_not_contact")
            )

        return F.struct(
            p["contact"].alias("contact"),
            frames.alias("frames"),
            p["points"].alias("points"),
            F.coalesce(p["reason"], first_wrong, X.let(frames, order)).alias("reason"),
        )

    def shape(p: Column) -> Column:
        ok = p["reason"].isNull()
        return F.struct(
            F.when(ok, p["contact"]).alias("contact_start_step"),
            F.when(ok, p["frames"]).alias("frames"),
            F.when(ok, F.transform(p["points"], lambda q: F.array(q["pixel"]["x"], q["pixel"]["y"]))).alias("trace"),
            p["reason"].alias("reason"),
        )

    whole = F.struct(
        F.from_json(X.strip_code_fence(response), schemas.TRACE_RESPONSE).alias("r"),
        label.alias("label"),
        sampled.alias("sampled"),
        start.alias("start"),
        end.alias("end"),
    )
    return X.let(X.let(X.let(whole, points), check), shape)


def plan_answer(response: Column, dataset: str = "libero") -> Column:
    """struct(plan, skills, reason) from an answer that holds only a plan text."""
    plan = X.strip(F.get_json_object(response, "$.plan"))

    def shape(p: Column) -> Column:
        skills = X.parse_plan_serving(p, dataset)
        return F.struct(
            p.alias("plan"),
            skills.alias("skills"),
            F.when(F.coalesce(p, F.lit("")) == "", "no_plan").when(F.size(skills) == 0, "no_known_skill").alias("reason"),
        )

    return X.let(plan, shape)


def annotation_rows(episodes: DataFrame, answers: DataFrame, dataset: str, model: str, prompt_version: str) -> tuple[DataFrame, DataFrame]:
    """(annotation rows, rows with a reason) from episodes and model answers."""
    joined = by_shuffle(episodes, answers.select("episode_index", "response"), ["episode_index"])
    n = X.once(joined, "_n", normalize_steps(F.col("response"), F.col("length"), dataset))
    good = n.filter(F.col("_n.reason").isNull()).select(
        "episode_index",
        "task_index",
        "instruction",
        F.col("length").alias("num_steps"),
        F.lit(V.FPS[dataset]).alias("fps"),
        F.col("_n.plan").alias("plan"),
        F.col("_n.segments").alias("segments"),
        F.lit(model).alias("model"),
        F.lit(prompt_version).alias("prompt_version"),
        F.current_timestamp().alias("created_at"),
        F.col("response").alias("raw_model_response"),
    )
    return good, n.filter(F.col("_n.reason").isNotNull()).select("episode_index", F.col("_n.reason").alias("reason"))


def annotation_rows_with_frames(
    episodes: DataFrame, answers: DataFrame, frames: DataFrame, dataset: str, model: str, prompt_version: str
) -> tuple[DataFrame, DataFrame]:
    """The same with the state and action of each segment's last frame, for datasets that keep them.

    ``frames``: (episode_index, step, state, action). Columns task_name and raw_instruction of ``episodes`` are
    kept. An episode with a segment whose last frame is not there has the reason no_frame.
    """
    good, wrong = annotation_rows(episodes, answers, dataset, model, prompt_version)
    more = episodes.select("episode_index", *[c for c in ("task_name", "raw_instruction") if c in episodes.columns])
    named = by_shuffle(good, more, ["episode_index"])
    ends = named.select("episode_index", F.posexplode("segments").alias("seg_index", "_s")).select(
        "episode_index", "seg_index", "_s.*", (F.col("_s.end_step") - 1).alias("step")
    )
    last = frames.select("episode_index", "step", "state", "action", F.lit(True).alias("_there"))
    held = by_shuffle(ends, last, ["episode_index", "step"], "left")
    # the segments of an answer were one row, and are again
    whole = held.groupBy("episode_index").agg(
        F.array_sort(F.collect_list(F.struct("seg_index", "start_step", "end_step", "skill", "state", "action"))).alias("_all"),
        F.count_if(F.col("_there").isNull()).alias("_missing"),
    )
    segments = F.transform("_all", lambda s: s.dropFields("seg_index"))
    rows = by_shuffle(named.drop("segments"), whole, ["episode_index"])
    done = rows.filter("_missing = 0").withColumn("segments", segments).drop("_all", "_missing")
    return done, wrong.union(rows.filter("_missing > 0").select("episode_index", F.lit("no_frame").alias("reason")))


#: a trace annotation has these from its run, absent ones null; the switches are off unless the run says so
TRACE_SETTINGS = {
    "image_key": "string", "image_width": "bigint", "image_height": "bigint", "query_image_width": "bigint", "query_image_height": "bigint",
    "model_coordinate_width": "bigint", "model_coordinate_height": "bigint", "trace_frame_count": "bigint",
}
TRACE_SWITCHES = (
    "semantic_target_enabled", "contact_prediction_enabled", "contact_extraction_enabled", "contact_prediction_only_enabled", "end_effector_trace_enabled",
)


def trace_annotation_rows(
    annotations: DataFrame, entries: DataFrame, settings: dict, model: str, prompt_version: str, **source: str
) -> tuple[DataFrame, DataFrame]:
    """(trace annotation rows, episodes with a reason) from skill episodes and their trace entries.

    ``entries``: (episode_index, seg_index, entry). ``source`` names where the data came from (repository, root,
    skill annotations). An episode without entries has the reason no_traces.
    """
    listed = entries.groupBy("episode_index").agg(F.sort_array(F.collect_list(F.struct("seg_index", "entry"))).alias("_l"))
    j = annotations.join(listed, "episode_index", "left")
    fields = [F.lit(settings.get(n)).cast(kind).alias(n) for n, kind in TRACE_SETTINGS.items()]
    switches = [F.lit(bool(settings.get(n, False))).alias(n) for n in TRACE_SWITCHES]
    fps = F.col("fps") if "fps" in annotations.columns else F.lit(None)
    rows = j.filter(F.col("_l").isNotNull()).select(
        "episode_index", "task_index", "instruction", "num_steps", F.coalesce(fps, F.lit(10)).cast("bigint").alias("fps"), "plan", "segments",
        F.transform("_l", lambda x: x["entry"]).alias("target_traces"), *fields, *switches,
        F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"), *[F.lit(v).alias(n) for n, v in source.items()],
        F.current_timestamp().alias("created_at"),
    )
    return rows, j.filter(F.col("_l").isNull()).select("episode_index", F.lit("no_traces").alias("reason"))
