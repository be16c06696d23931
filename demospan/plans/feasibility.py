"""Symbolic check of plans against a starting state, as joins and running values.

Each step reads facts and writes facts. The value a step reads is the latest write to the same fact
by an earlier step, else the starting state: a running last value per (episode, fact). Up to the
first step that fails, every earlier step has been applied, so the first failing step is exact; no
plan is folded row by row and no episode is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..operators.ordered import ROWS_PER_BLOCK, ordered
from ..operators.segments import compare_to_plan
from ..session import cut_lineage

# What each verb needs and changes. A condition is a list of alternatives, each a list
# of facts (name, first, second, expected); an effect is (name, first, second, new value). "1" and
# "2" are the skill's arguments, "held" the carried object, "slider" the sliding part, "*" any object.
FREE = ("free", "", "", True)
_PICK_EFFECTS = [("carry", "1", "", True), ("free", "", "", False), ("on", "1", "2", False), ("in", "1", "2", False)]
_OPEN = ([[FREE, ("closed", "1", "", True), ("openable", "1", "", True)]], [("closed", "1", "", False), ("open", "1", "", True)])
_CLOSE = ([[FREE, ("open", "1", "", True), ("openable", "1", "", True)]], [("open", "1", "", False), ("closed", "1", "", True)])
_ON = [("turned_on", "1", "", True), ("turned_off", "1", "", False)]
_OFF = [("turned_off", "1", "", True), ("turned_on", "1", "", False)]


def _slide(to: str, back: str):
    return (
        [[FREE, ("slidable", "slider", "", True), (to, "slider", "", False)]],
        [(to, "slider", "", True), (back, "slider", "", False)],
    )


RULES = {
    "libero": {
        "PICKUP_FROM": (
            [[FREE, ("on", "1", "2", True)], [FREE, ("in", "1", "2", True), ("closed", "2", "", False)]],
            _PICK_EFFECTS,
        ),
        "PLACE_ON": (
            [[("carry", "1", "", True), ("carry", "2", "", False), ("in", "2", "*", False)]],
            [("carry", "1", "", False), ("free", "", "", True), ("on", "1", "2", True)],
        ),
        "PLACE_IN": (
            [[("carry", "1", "", True), ("carry", "2", "", False), ("open", "2", "", True)]],
            [("carry", "1", "", False), ("free", "", "", True), ("in", "1", "2", True)],
        ),
        "OPEN": _OPEN,
        "CLOSE": _CLOSE,
        "TURN_ON": ([[FREE, ("switchable", "1", "", True)]], _ON),
        "TURN_OFF": ([[FREE, ("switchable", "1", "", True)]], _OFF),
    },
    "calvin": {
        "PICKUP_FROM": (
            [[FREE, ("on", "1", "2", True)], [FREE, ("in", "1", "2", True), ("open", "2", "", True)]],
            _PICK_EFFECTS,
        ),
        "PLACE_ON": (
            [[("carry", "held", "", True), ("no_surface", "1", "", False)]],
            [("carry", "held", "", False), ("free", "", "", True), ("on", "held", "1", True)],
        ),
        "PLACE_IN": (
            [[("carry", "held", "", True), ("open", "1", "", True), ("=", "held", "1", False)]],
            [("carry", "held", "", False), ("free", "", "", True), ("in", "held", "1", True)],
        ),
        "OPEN": _OPEN,
        "CLOSE": _CLOSE,
        "TURN_ON": ([[FREE, ("switchable", "1", "", True), ("turned_off", "1", "", True)]], _ON),
        "TURN_OFF": ([[FREE, ("switchable", "1", "", True), ("turned_on", "1", "", True)]], _OFF),
        "MOVE_SLIDER left": _slide("at_left", "at_right"),
        "MOVE_SLIDER right": _slide("at_right", "at_left"),
        "PUSH": ([[FREE]], []),
        "PUSH_INTO": (
            [[FREE, ("on", "1", "*", True), ("open", "2", "", True), ("on", "1", "2", False)]],
            [("on", "1", "*", False), ("in", "1", "2", True)],
        ),
        # the object ends where it was; a held one is put down
        "TURN_OBJECT": (
            [[FREE, ("on", "1", "*", True)], [FREE, ("in", "1", "*", True)], [("carry", "1", "", True)]],
            [("carry", "1", "", False), ("free", "", "", True)],
        ),
    },
}
RULES["table"] = {v: RULES["libero"][v] for v in ("PICKUP_FROM", "PLACE_ON", "PLACE_IN")}

FACT = ["episode", "name", "first", "second"]


def plan_steps(plans: DataFrame, dataset: str, key: str = "episode", plan: str = "plan") -> DataFrame:
    """(episode, step from 1, verb, arguments) of valid plan texts."""
    return _steps(plans.select(F.col(key).alias("episode"), X.parse_plan(F.col(plan), dataset)["skills"].alias("skills")))


def _steps(parsed: DataFrame) -> DataFrame:
    """The steps of (episode, skills)."""
    s = parsed.select("episode", F.posexplode("skills").alias("step", "skill"))
    return s.select(
        "episode",
        (F.col("step") + 1).cast("bigint").alias("step"),
        "skill",
        X.skill_verb(F.col("skill")).alias("verb"),
        X.skill_arguments(F.col("skill")).alias("arguments"),
    )


def _objects(steps: DataFrame, facts: DataFrame, dataset: str) -> DataFrame:
    """Add the carried object and the sliding part where the grammar leaves them out."""
    if dataset != "calvin":
        return steps.withColumns({"held": F.lit(""), "slider": F.lit(""), "rule": F.col("verb")})
    o = ordered(steps, ["episode"], ["step"], split="step")
    o = o.scan(previous={"_verb": F.col("verb"), "_thing": F.get("arguments", F.lit(0))})
    known = facts.filter(F.col("name").isin("carry", "slidable")).groupBy("episode").agg(
        F.min(F.when(F.col("name") == "carry", F.col("first"))).alias("_carried"),
        F.min(F.when(F.col("name") == "slidable", F.col("first"))).alias("_slider"),
    )
    s = o.rows().join(known, "episode", "left")
    held = F.when(F.col("_verb") == "PICKUP_FROM", F.col("_thing")).when(F.col("_verb").isNull(), F.col("_carried"))
    slides = F.col("verb") == "MOVE_SLIDER"
    return s.withColumns(
        {
            "held": F.coalesce(held, F.lit("")),
            "slider": F.coalesce("_slider", F.lit("")),
            "rule": F.when(slides, F.concat("verb", F.lit(" "), F.get("arguments", F.lit(0)))).otherwise(F.col("verb")),
        }
    ).drop("_verb", "_thing", "_carried", "_slider")


def _ref(word: str) -> Column:
    named = {
        "1": F.get("arguments", F.lit(0)),
        "2": F.get("arguments", F.lit(1)),
        "held": F.col("held"),
        "slider": F.col("slider"),
    }
    return F.coalesce(named.get(word, F.lit(word)), F.lit(""))


READ, WRITE = 0, 1
FACTS_PER_STEP = 16


def _cell(kind: int, clause: int, literal: int, name: str, first: str, second: str, value: bool) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(clause).alias("clause"),
        F.lit(literal).alias("literal"),
        F.lit(name).alias("name"),
        _ref(first).alias("first"),
        _ref(second).alias("second"),
        F.lit(value).alias("value"),
    )


def _step_facts(steps: DataFrame, dataset: str) -> DataFrame:
    """Every step's reads and writes in one pass: (episode, step, kind, clause, literal, fact, value).

    A read that always holds stands for the step itself; a verb without a rule gets one that never does.
    """
    chosen = F
    for verb, (needs, effects) in RULES[dataset].items():
        cells = [_cell(READ, 0, -1, "=", "", "", True)]
        cells += [_cell(READ, c, i, *lit) for c, clause in enumerate(needs) for i, lit in enumerate(clause)]
        cells += [_cell(WRITE, 0, i, *lit) for i, lit in enumerate(effects)]
        chosen = chosen.when(F.col("rule") == verb, F.array(*cells))
    unknown = F.array(_cell(READ, 0, -1, "=", "", "", False))
    return steps.select("episode", "step", F.explode(chosen.otherwise(unknown)).alias("_f")).select("episode", "step", "_f.*")


def audit_plans(steps: DataFrame, facts: DataFrame, dataset: str) -> DataFrame:
    """(episode, steps, feasible, failed_step, reason) for every plan.

    ``facts``: (episode, name, first, second) that hold at the start; names that take one or no
    object leave the rest empty. The reason names the fact that was not as needed.
    """
    facts = facts.select("episode", "name", F.coalesce("first", F.lit("")).alias("first"), F.coalesce("second", F.lit("")).alias("second"))
    uses = _step_facts(_objects(steps, facts, dataset), dataset).withColumn("asked", F.col("second"))

    # "*" stands for every object the fact is ever mentioned with in the episode
    star = F.col("second") == "*"
    written = uses.filter((F.col("kind") == WRITE) & ~star).select(*FACT)
    mentioned = facts.unionByName(written).filter(F.col("second") != "").distinct()
    spread = uses.filter(star).drop("second").join(mentioned, ["episode", "name", "first"])
    start = facts.select(
        *FACT,
        F.lit(0).cast("bigint").alias("step"),
        F.lit(WRITE).alias("kind"),
        F.lit(0).alias("clause"),
        F.lit(0).alias("literal"),
        F.lit(True).alias("value"),
        F.col("second").alias("asked"),
    )
    events = uses.unionByName(spread).unionByName(start)

    o = ordered(
        events,
        FACT,
        ["step", "kind", "clause", "literal"],
        split="step",
        rows_per_block=ROWS_PER_BLOCK // FACTS_PER_STEP,
        sized_by=steps,
        size_keys=["episode"],
    )
    seen = o.scan(last={"now": F.when(F.col("kind") == WRITE, F.col("value"))}).rows().filter(F.col("kind") == READ)
    now = F.when(F.col("name") == "=", F.col("first") == F.col("second")).otherwise(F.coalesce("now", F.lit(False)))
    text = (
        F.when(F.col("literal") == -1, "no rule for the verb")
        .otherwise(F.concat_ws(" ", F.when(F.col("value"), "needs").otherwise("must not be"), "name", "first", "asked"))
    )
    # a "*" read is several rows: it is met when any of its facts holds, or when none does
    literal = seen.groupBy("episode", "step", "clause", "literal", "value", text.alias("text")).agg(F.bool_or(now).alias("now"))
    met = F.col("now") == F.col("value")
    clause = literal.groupBy("episode", "step", "clause").agg(
        F.bool_and(met).alias("ok"),
        F.min_by(F.when(~met, F.col("text")), F.when(~met, F.col("literal"))).alias("why"),
    )
    step = clause.groupBy("episode", "step").agg(F.bool_or("ok").alias("ok"), F.min_by("why", "clause").alias("why"))
    failed = F.when(~F.col("ok"), F.col("step"))
    return step.groupBy("episode").agg(
        F.count(F.lit(1)).alias("steps"),
        F.bool_and("ok").alias("feasible"),
        F.min(failed).alias("failed_step"),
        F.min_by("why", failed).alias("reason"),
    )


def audit_plan_texts(plans: DataFrame, facts: DataFrame, dataset: str, key: str = "episode", plan: str = "plan") -> DataFrame:
    """The same for plan texts: (episode, steps, feasible, failed_step, reason), a row for every plan.

    A text that is no valid plan is not feasible and has the parser's reason. Texts are parsed once and written
    down: their steps are counted, their facts are written and read, and each would parse them anew.
    """
    texts = X.once(plans.select(F.col(key).alias("episode"), F.col(plan).alias("_text")), "_p", X.parse_plan(F.col("_text"), dataset))
    why = F.when(F.col("_p.skills").isNull(), F.concat(F.lit("plan_"), F.coalesce("_p.reason", F.lit("missing"))))
    parsed = cut_lineage(texts.select("episode", F.col("_p.skills").alias("skills"), why.alias("_why")))
    said = parsed.select("episode", "_why")
    judged = audit_plans(_steps(parsed), facts, dataset)
    return said.join(judged, "episode", "left").select(
        "episode",
        F.coalesce("steps", F.lit(0)).alias("steps"),
        (F.col("_why").isNull() & F.coalesce("feasible", F.lit(True))).alias("feasible"),
        "failed_step",
        F.coalesce("_why", "reason").alias("reason"),
    )


def available_actions(facts: DataFrame, dataset: str, candidates: DataFrame) -> DataFrame:
    """Which of the candidate (episode, verb, arguments) could be the next step in the given state."""
    steps = candidates.withColumn("step", F.lit(1).cast("bigint"))
    one_step = steps.withColumn("_id", F.concat_ws("|", F.col("episode").cast("string"), "verb", F.array_join("arguments", ",")))
    spread_facts = one_step.select("episode", "_id").join(facts, "episode").drop("episode").withColumnRenamed("_id", "episode")
    result = audit_plans(one_step.drop("episode").withColumnRenamed("_id", "episode"), spread_facts, dataset)
    ok = result.filter("feasible").select(F.col("episode").alias("_id"))
    return one_step.join(ok, "_id", "left_semi").drop("_id", "step")


def audit_transitions(observed: DataFrame, planned: DataFrame, key: str = "episode") -> DataFrame:
    """Positions at which the observed skills leave the planned order (both exploded by position)."""
    return compare_to_plan(observed, planned, [key])
