"""Audits of annotations and traces. Rules are (name, Column) pairs: a new dataset adds rules, not code.

Each annotation row holds its own plan and segments, so the rules are row expressions: an audit is
one pass over the table without a shuffle, and its output is a table of violations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions import vocab as V
from ..operators.segments import row_contiguity_reason, row_runs

Rule = tuple[str, Column]


def episode_plan(plan: Column, segments: Column) -> Column:
    """Plan of the episode: its own text, else the first plan text found on a segment."""
    found = X.first_of(F.transform(segments, lambda s: s["plan"]), lambda p: p.isNotNull())
    return F.coalesce(plan, found)


def episode_instruction(instruction: Column, segments: Column) -> Column:
    """Instruction of the episode, else the first one on a segment without its label."""
    found = X.first_of(
        F.transform(segments, lambda s: s["instruction"]), lambda p: X.strip(F.coalesce(p, F.lit(""))) != ""
    )
    return F.coalesce(F.nullif(X.strip(instruction), F.lit("")), X.strip_instruction_label(found))


def prepare(annotations: DataFrame, dataset: str) -> DataFrame:
    """Parse plan and skills once; the rules read the results."""
    skills = F.transform("segments", lambda s: X.canonical_skill(s["skill"], dataset))
    seg_plans = F.transform(
        "segments", lambda s: F.when(s["plan"].isNotNull(), X.parse_plan(s["plan"], dataset))
    )
    df = annotations.withColumns(
        {
            "_plan": X.parse_plan(episode_plan(F.col("plan"), F.col("segments")), dataset),
            "_skills": skills,
            "_updated": F.transform("segments", lambda s: X.canonical_skill(s["updated_skill"], dataset)),
            "_seg_plans": seg_plans,
        }
    )
    # the projection below must see the parsed values, not parse them again in every rule
    return df.withColumns(
        {
            "_planned": F.col("_plan.skills"),
            "_verbs": F.transform("_plan.skills", lambda s: X.skill_verb(s)),
            "_first_args": F.transform("_plan.skills", lambda s: F.get(X.skill_arguments(s), F.lit(0))),
        }
    )


def per_segment(name: str, test) -> Rule:
    """Positions of segments for which ``test(segment, position)`` holds."""
    found = F.filter(
        F.transform("segments", lambda s, i: F.when(F.coalesce(test(s, i), F.lit(False)), i.cast("bigint"))),
        lambda i: i.isNotNull(),
    )
    return name, found


def per_episode(name: str, test: Column) -> Rule:
    return name, F.when(F.coalesce(test, F.lit(False)), F.array(F.lit(-1).cast("bigint")))


def shared_rules(dataset: str) -> list[Rule]:
    planned = F.col("_planned")

    def stray(s: Column, field: str) -> Column:
        return s[field].contains("(") & (F.size(F.array_except(X.skill_mentions(s[field], dataset), planned)) > 0)

    skill = lambda i: F.get(F.col("_skills"), i)
    updated = lambda i: F.get(F.col("_updated"), i)
    return [
        per_segment("invalid_skill", lambda s, i: skill(i).isNull()),
        per_episode(
            "compressed_not_plan",
            ~F.exists("_skills", lambda s: s.isNull()) & (row_runs(F.col("_skills")) != planned),
        ),
        per_segment("skill_not_in_plan", lambda s, i: skill(i).isNotNull() & ~F.array_contains(planned, skill(i))),
        per_segment("invalid_updated_skill", lambda s, i: s["updated_skill"].isNotNull() & updated(i).isNull()),
        per_segment(
            "updated_skill_not_in_plan", lambda s, i: updated(i).isNotNull() & ~F.array_contains(planned, updated(i))
        ),
        per_segment("invalid_segment_plan", lambda s, i: F.get(F.col("_seg_plans"), i)["reason"].isNotNull()),
        per_segment("segment_plan_differs", lambda s, i: F.get(F.col("_seg_plans"), i)["skills"] != planned),
        per_segment("stray_in_content", lambda s, i: stray(s, "content")),
        per_segment("stray_in_updated_content", lambda s, i: stray(s, "updated_content")),
        per_segment("stray_in_updated_content_w_instruction", lambda s, i: stray(s, "updated_content_w_instruction")),
    ]


def timing_rules() -> list[Rule]:
    reason = row_contiguity_reason(F.col("segments"), F.coalesce("num_steps", F.try_element_at("segments", F.lit(-1))["end_step"]))
    names = ["missing_steps", "first_start_not_zero", "not_contiguous", "non_positive_length", "last_end_not_num_steps"]
    return [per_episode(n, reason == n) for n in names]


def payload_rules(state_size: int = V.CALVIN_STATE_SIZE, action_size: int = V.ACTION_SIZE) -> list[Rule]:
    """Canonical rows carry the state and action of each segment's last frame."""
    canonical = F.col("plan").isNotNull() & F.col("num_steps").isNotNull()

    def bad(field: str, size: int):
        wrong = lambda s: s[field].isNull() | (F.size(s[field]) != size) | F.exists(s[field], lambda v: v.isNull())
        return lambda s, i: canonical & wrong(s)

    return [per_segment("bad_state", bad("state", state_size)), per_segment("bad_action", bad("action", action_size))]


def first_verb_rule() -> Rule:
    return per_episode("first_is_place", F.get(F.col("_verbs"), F.lit(0)).isin(V.PLACE_VERBS))


def pick_place_rules() -> list[Rule]:
    verbs = F.col("_verbs")
    repeats = F.exists(
        F.transform(
            verbs,
            lambda v, i: (i > 0)
            & (X.verb_category(v) != "other")
            & (X.verb_category(v) == X.verb_category(F.get(verbs, i - 1))),
        ),
        lambda b: b,
    )
    return [
        per_episode("last_is_not_place", ~F.try_element_at(verbs, F.lit(-1)).isin(V.PLACE_VERBS)),
        per_episode("not_alternating", repeats),
    ]


def gripper_rules() -> list[Rule]:
    """Every verb fixes the gripper state it leaves, so a step only looks at its neighbours."""
    verbs, args = F.col("_verbs"), F.col("_first_args")

    def any_step(test) -> Column:
        def one(v: Column, i: Column) -> Column:
            before, after = F.get(verbs, i - 1), F.get(verbs, i + 1)
            place = v.isin(V.PLACE_VERBS)
            holding = F.when(i == 0, place).otherwise(before.isin(V.PICK_VERBS))
            return F.coalesce(test(v, i, before, after, place, holding), F.lit(False))

        return F.exists(F.transform(verbs, one), lambda b: b)

    turn = "TURN_OBJECT"
    return [
        per_episode("needs_held_object", any_step(lambda v, i, b, a, place, h: place & ~h)),
        per_episode("needs_free_gripper", any_step(lambda v, i, b, a, place, h: v.isin(V.FREE_GRIPPER_VERBS) & h)),
        per_episode(
            "placed_on_itself",
            any_step(
                lambda v, i, b, a, place, h: place & b.isin(V.PICK_VERBS) & (F.get(args, i) == F.get(args, i - 1))
            ),
        ),
        per_episode("turn_while_holding", any_step(lambda v, i, b, a, place, h: (v == turn) & (i > 0) & h)),
        per_episode("turn_after_pick", any_step(lambda v, i, b, a, place, h: (v == turn) & b.isin(V.PICK_VERBS))),
        per_episode("turn_before_place", any_step(lambda v, i, b, a, place, h: (v == turn) & a.isin(V.PLACE_VERBS))),
    ]


def rules_for(dataset: str) -> list[Rule]:
    shared = shared_rules(dataset)
    if dataset == "libero":
        return [first_verb_rule(), *shared]
    if dataset == "calvin":
        return [*shared, *timing_rules(), *gripper_rules(), *payload_rules()]
    if dataset == "table":
        return [first_verb_rule(), *pick_place_rules(), *shared, *timing_rules()]
    raise ValueError(f"unknown dataset kind {dataset!r}")


def audit_annotations(annotations: DataFrame, dataset: str, extra: list[Rule] | None = None, key: str = "episode_index") -> DataFrame:
    """(source, episode, position, rule); position is null for rules about the whole episode.

    A missing segment list or an unreadable plan is the only finding of its row.
    """
    df = annotations if "source" in annotations.columns else annotations.withColumn("source", F.lit(None).cast("string"))
    df = prepare(df, dataset)
    stop = F.when(F.coalesce(F.size("segments"), F.lit(0)) <= 0, "no_segments").when(
        F.col("_plan.skills").isNull(), F.concat(F.lit("plan_"), F.coalesce("_plan.reason", F.lit("missing")))
    )
    rules = [*rules_for(dataset), *(extra or [])]

    def rows(name: str, at: Column) -> Column:
        return F.transform(
            F.coalesce(at, F.array().cast("array<bigint>")),
            lambda p: F.struct(F.nullif(p, F.lit(-1).cast("bigint")).alias("position"), F.lit(name).alias("rule")),
        )

    found = F.flatten(F.array(*[rows(name, at) for name, at in rules]))
    whole = F.array(F.struct(F.lit(None).cast("bigint").alias("position"), stop.alias("rule")))
    out = df.select("source", F.col(key).alias("episode"), F.explode(F.when(stop.isNotNull(), whole).otherwise(found)).alias("_v"))
    return out.select("source", "episode", "_v.position", "_v.rule")


def report(violations: DataFrame, episodes: DataFrame) -> DataFrame:
    """ok, episodes checked, episodes failed, failures."""
    f = violations.agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("episode").alias("failed_episodes"))
    n = episodes.agg(F.count(F.lit(1)).alias("episodes"))
    return n.crossJoin(F.broadcast(f)).withColumn("ok", F.col("failures") == 0)


# --- traces -----------------------------------------------------------------------------------------


def with_header(rows: DataFrame, header: DataFrame, fields: dict[str, Column | None]) -> DataFrame:
    """Episode values with the header's value, then the default, where they are missing.

    However many header rows there are, their global aggregate is one row, which is broadcast. A field on
    which they disagree has no header value (``aggregates.header_conflicts`` reports it).
    """
    agreed = lambda f: F.when(F.min(f) == F.max(f), F.max(f))
    h = header.agg(*[agreed(f).alias(f"_h_{f}") for f in fields])
    joined = rows.crossJoin(F.broadcast(h))
    filled = {
        f: F.coalesce(F.col(f), F.col(f"_h_{f}"), *([d] if d is not None else [])) for f, d in fields.items()
    }
    return joined.withColumns(filled).drop(*[f"_h_{f}" for f in fields])


def _off_image(point: Column) -> Column:
    x, y = F.get(point, F.lit(0)), F.get(point, F.lit(1))
    return ~F.coalesce(
        (F.size(point) == 2) & G.inside_image(x, y, F.col("image_width"), F.col("image_height")), F.lit(False)
    )


def _contact_rules(name: str, e: Column, start: Column, end: Column) -> list[tuple[str, Column]]:
    t, frames, contact = e[name], e[name]["frame_indices"], e[name]["contact_start_step"]
    sampled = F.coalesce(e["sampled_frame_indices"], F.array().cast("array<bigint>"))
    have = t.isNotNull()
    sized = have & (F.size(t["trace"]) > 0) & (F.size(frames) == F.size(t["trace"]))
    return [
        (f"{name}_empty", have & ~F.coalesce(F.size(t["trace"]) > 0, F.lit(False))),
        (f"{name}_frames_not_same_length", have & (F.size(t["trace"]) > 0) & ~F.coalesce(F.size(frames) == F.size(t["trace"]), F.lit(False))),
        (f"{name}_contact_not_sampled", sized & ~F.array_contains(sampled, contact)),
        (f"{name}_contact_outside_segment", sized & ~((contact >= start) & (contact < end))),
        (f"{name}_frame_not_sampled", sized & (F.size(F.array_except(frames, sampled)) > 0)),
        (f"{name}_frame_outside_contact", sized & F.exists(frames, lambda f: (f < contact) | (f >= end))),
        (f"{name}_frames_not_sorted", sized & (frames != F.array_sort(frames))),
        (f"{name}_frames_repeat", sized & (F.size(F.array_distinct(frames)) != F.size(frames))),
        (f"{name}_first_frame_not_contact", sized & (F.get(frames, F.lit(0)) != contact)),
        (f"{name}_model_trace_length", sized & t["model_trace"].isNotNull() & (F.size(t["model_trace"]) != F.size(t["trace"]))),
        (f"{name}_point_off_image", sized & F.exists(t["trace"], _off_image)),
    ]


def audit_traces(
    traces: DataFrame,
    annotations: DataFrame,
    header: DataFrame,
    max_delta: float = V.MAX_STEP_DELTA_PIXELS,
    max_out_of_bounds: float = V.MAX_OUT_OF_BOUNDS_FRACTION,
    max_exact: float = V.MAX_EXACT_REPROJECTION_METERS,
    max_rounded: float = V.MAX_ROUNDED_REPROJECTION_METERS,
) -> DataFrame:
    """(episode, position, rule) for trace rows against their skill episodes.

    One join by episode; everything else is a row expression over the nested entries.
    """
    for limit in (max_delta, max_exact, max_rounded):
        if limit <= 0:
            raise ValueError("limits must be positive")
    t = with_header(
        traces,
        header,
        {
            "image_width": None,
            "image_height": None,
            "semantic_target_enabled": F.lit(True),
            "contact_prediction_enabled": F.lit(True),
            "contact_extraction_enabled": F.lit(True),
            "contact_prediction_only_enabled": F.lit(False),
            "end_effector_trace_enabled": F.lit(False),
        },
    )
    skills = annotations.select("episode_index", F.col("segments").alias("_skill_segments"), F.col("num_steps").alias("_num_steps"))
    df = t.join(skills, "episode_index", "left")
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start_step"], s["end_step"], s["skill"]))
    want, have = plain(F.col("_skill_segments")), plain(F.col("segments"))
    n, entries = F.size("_skill_segments"), F.col("target_traces")
    required = F.col("contact_prediction_enabled") | F.col("contact_prediction_only_enabled")

    def entry_rules(e: Column, i: Column) -> Column:
        s = F.get(F.col("_skill_segments"), i)
        start, end, d = s["start_step"], s["end_step"], e["end_effector_trace"]
        inside = i < n
        dense = inside & F.col("end_effector_trace_enabled")
        full = dense & (F.size(d["trace"]) == end - start)
        same = lambda f: d[f].isNotNull() & (F.size(d[f]) != F.size(d["trace"]))
        jump = F.exists(
            F.transform(
                d["trace"],
                lambda p, k: (k > 0)
                & (
                    F.hypot(
                        F.get(p, F.lit(0)) - F.get(F.get(d["trace"], k - 1), F.lit(0)),
                        F.get(p, F.lit(1)) - F.get(F.get(d["trace"], k - 1), F.lit(1)),
                    )
                    > max_delta
                ),
            ),
            lambda b: b,
        )
        steps = F.when(end > start, F.sequence(start, end - 1))
        rules = [
            ("wrong_skill_index", inside & ~e["skill_index"].eqNullSafe(i.cast("bigint"))),
            ("wrong_skill", inside & ~e["skill"].eqNullSafe(s["skill"])),
            ("wrong_interval", inside & ~(e["start_step"].eqNullSafe(start) & e["end_step"].eqNullSafe(end))),
            ("semantic_target_missing", inside & F.col("semantic_target_enabled") & e["semantic_target"].isNull()),
            ("semantic_target_off_image", inside & e["semantic_target"].isNotNull() & _off_image(e["semantic_target"]["point"])),
            ("contact_prediction_missing", inside & required & e["contact_prediction"].isNull()),
            ("contact_prediction_off_image", inside & e["contact_prediction"].isNotNull() & _off_image(e["contact_prediction"]["point"])),
            *[(r, inside & c) for name in ("prediction_trace", "extraction_trace") for r, c in _contact_rules(name, e, start, end)],
            ("dense_trace_missing", dense & d.isNull()),
            ("dense_trace_not_every_step", dense & d.isNotNull() & ~F.coalesce(F.size(d["trace"]) == end - start, F.lit(False))),
            ("dense_frames_not_every_step", full & d["frame_indices"].isNotNull() & (d["frame_indices"] != steps)),
            *[(f"dense_{f}_length", full & same(f)) for f in ("raw_trace", "in_bounds", "projection_depth", "source_world_positions")],
            ("dense_out_of_bounds", full & (F.coalesce(d["out_of_bounds_fraction"], F.lit(0.0)) > max_out_of_bounds)),
            ("dense_point_off_image", full & F.exists(d["trace"], _off_image)),
            ("dense_jump", full & jump),
            ("dense_exact_error", full & (d["reprojection_checks"]["exact_max_error_meters"] > max_exact)),
            ("dense_rounded_error", full & (d["reprojection_checks"]["rounded_in_bounds_max_error_meters"] > max_rounded)),
        ]
        return F.array_compact(
            F.array(
                *[
                    F.when(F.coalesce(c, F.lit(False)), F.struct(i.cast("bigint").alias("position"), F.lit(r).alias("rule")))
                    for r, c in rules
                ]
            )
        )

    counted = lambda f: F.aggregate(entries, F.lit(0), lambda acc, e: acc + f(e))
    one = lambda c: F.when(c, 1).otherwise(0)
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    semantic = counted(lambda e: one(e["semantic_target"].isNotNull()))
    contact = counted(lambda e: size(e["prediction_trace"]["trace"]) + size(e["extraction_trace"]["trace"]))
    dense = counted(lambda e: size(e["end_effector_trace"]["trace"]))
    has_skill = F.col("_skill_segments").isNotNull() & (n > 0)
    usable = has_skill & F.col("segments").isNotNull() & entries.isNotNull()
    whole = [
        ("no_skill_episode", F.col("_num_steps").isNull() & F.col("_skill_segments").isNull()),
        ("no_image_size", F.col("image_width").isNull() | F.col("image_height").isNull()),
        ("num_steps_differ", usable & ~F.col("num_steps").eqNullSafe(F.col("_num_steps"))),
        ("segments_differ", usable & ~have.eqNullSafe(want)),
        ("entry_count_differs", usable & (F.size(entries) != n)),
        ("semantic_count", usable & F.col("semantic_target_enabled") & (semantic != n)),
        (
            "no_contact_points",
            usable & (F.col("contact_prediction_enabled") | F.col("contact_extraction_enabled")) & (contact == 0),
        ),
        ("dense_points_not_num_steps", usable & F.col("end_effector_trace_enabled") & (dense != F.col("_num_steps"))),
    ]
    whole_rows = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(None).cast("bigint").alias("position"), F.lit(r).alias("rule")))
                for r, c in whole
            ]
        )
    )
    entry_rows = F.when(usable, F.flatten(F.transform(entries, entry_rules)))
    empty = F.array().cast("array<struct<position:bigint,rule:string>>")
    found = F.concat(whole_rows, F.coalesce(entry_rows, empty))
    return df.select(F.col("episode_index").alias("episode"), F.explode(found).alias("_v")).select("episode", "_v.position", "_v.rule")
