"""Queries of the text expressions. The texts are built from part and order rows, or are documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from demospan.functions import text as X
from demospan.functions import vocab as V
from demospan.plans.audit import episode_instruction, episode_plan
from demospan.plans.rollouts import labelled_sample

from .registry import query
from .tables import Tables

WS = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
ARITY_SQL = """CASE {v} WHEN 'PLACE_ON' THEN 2 WHEN 'PLACE_IN' THEN 2 WHEN 'PICKUP_FROM' THEN 2 WHEN 'OPEN' THEN 1
  WHEN 'CLOSE' THEN 1 WHEN 'TURN_ON' THEN 1 WHEN 'TURN_OFF' THEN 1 END"""
PATTERN = "^([A-Z_]+)\\((.*)\\)$"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


# --- skill texts, one or more per part ------------------------------------------------------------

SKILL_TEXT = """CASE p_size % 10 WHEN 0 THEN 'PICKUP_FROM(' || p_name || ', ' || lower(p_type) || ')'
  WHEN 1 THEN '  PLACE_ON( ' || p_name || ' ,  left plate )  ' WHEN 2 THEN 'OPEN(' || p_name || ', ' || p_brand || ')'
  WHEN 3 THEN 'FLY(' || p_name || ')' WHEN 4 THEN p_name WHEN 5 THEN 'CLOSE()' WHEN 6 THEN 'place_in(' || p_name || ', box)'
  WHEN 7 THEN 'PUSH(the ' || p_name || ', Left, Sweep_Off)' WHEN 8 THEN 'MOVE_SLIDER( right )'
  ELSE 'TURN_ON(A  Green Light)' END"""
PLAN_TEXT = """CASE p_size % 8 WHEN 0 THEN '1. PICKUP_FROM(' || p_name || ', table) 2. PLACE_ON(' || p_name || ', ' || lower(p_type) || ')'
  WHEN 1 THEN 'Plan: 1. OPEN(drawer)   2. CLOSE(drawer) 3. TURN_ON(' || p_name || ')' WHEN 2 THEN '1. OPEN(box) 3. CLOSE(box)'
  WHEN 3 THEN '' WHEN 4 THEN 'go to ' || p_name || '; - stop' WHEN 5 THEN '1. PICKUP_FROM(' || p_name || ') 2. OPEN(box)'
  WHEN 6 THEN '1. FLY(' || p_name || ') 2. OPEN(box),' ELSE '1. 2. OPEN(box)' END"""


def parts(t: Tables, **texts: str):
    return t.part.select("p_partkey", *[F.expr(sql).alias(name) for name, sql in texts.items()])


SKILL_SQL = f"""s AS (SELECT p_partkey, {collapsed(SKILL_TEXT)} AS raw FROM part),
  m AS (SELECT *, regexp_extract(raw, '{PATTERN}', 1) AS v,
    list_transform(string_split(regexp_extract(raw, '{PATTERN}', 2), ','), lambda x: trim(x)) AS args FROM s),
  r AS (SELECT *, CASE WHEN v = '' THEN 'malformed' WHEN {ARITY_SQL.format(v='v')} IS NULL THEN 'unknown_verb'
    WHEN len(args) <> {ARITY_SQL.format(v='v')} THEN 'wrong_arity' WHEN list_contains(args, '') THEN 'empty_argument' END AS reason FROM m)"""


@query(f"""WITH {SKILL_SQL} SELECT p_partkey, reason, CASE WHEN reason IS NULL THEN v || '(' || array_to_string(args, ', ') || ')' END AS skill,
  CASE WHEN reason IS NULL THEN v END AS verb FROM r""")
def parse_skills(t: Tables):
    p = parts(t, s=SKILL_TEXT).withColumn("p", X.parse_skill(F.col("s"), "libero"))
    return p.select("p_partkey", "p.reason", "p.skill", "p.verb")


@query(f"""WITH {SKILL_SQL} SELECT reason, count(*) AS skills FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def invalid_skills(t: Tables):
    p = parts(t, s=SKILL_TEXT).select(X.parse_skill(F.col("s"), "libero")["reason"].alias("reason"))
    return p.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("skills"))


ALIASES = "CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.OBJECT_ALIASES.items()) + " ELSE {x} END"
CALVIN_ARITY = "CASE v " + " ".join(f"WHEN '{v}' THEN {n}" for v, n in V.ARITY["calvin"].items()) + " END"


@query(f"""WITH s AS (SELECT p_partkey, {collapsed(SKILL_TEXT)} AS raw FROM part),
  m AS (SELECT *, regexp_extract(raw, '{PATTERN}', 1) AS v,
    list_transform(string_split(regexp_extract(raw, '{PATTERN}', 2), ','), lambda x: trim(x)) AS args FROM s),
  ok AS (SELECT *, list_transform(args, lambda x: lower(trim(regexp_replace(x, '(?i)^(the|a|an)\\s+', '')))) AS o, list_transform(args, lambda x: lower(x)) AS w FROM m WHERE len(args) = {CALVIN_ARITY}),
  al AS (SELECT *, list_transform(o, lambda x: {ALIASES.format(x='x')}) AS a FROM ok)
  SELECT p_partkey, CASE v WHEN 'PUSH' THEN v || '(' || a[1] || ', ' || w[2] || ', ' || w[3] || ')' WHEN 'MOVE_SLIDER' THEN v || '(' || w[1] || ')'
    ELSE v || '(' || array_to_string(a, ', ') || ')' END AS skill FROM al
  WHERE NOT list_contains(args, '') AND (v <> 'PUSH' OR (w[2] IN ('left','right') AND w[3] IN ('slide','sweep_off'))) AND (v <> 'MOVE_SLIDER' OR w[1] IN ('left','right'))""")
def normalise_rich_skills(t: Tables):
    p = parts(t, s=SKILL_TEXT).select("p_partkey", X.canonical_skill(F.col("s"), "calvin").alias("skill"))
    return p.filter(F.col("skill").isNotNull())


@query(f"""WITH {SKILL_SQL} SELECT p_partkey, CASE WHEN reason IS NULL THEN v || '(' || array_to_string(args, ', ') || ')' ELSE raw END AS shown,
  CASE WHEN v <> '' THEN v ELSE upper(trim(split_part(raw, '(', 1))) END AS verb,
  CASE WHEN v = 'PICKUP_FROM' THEN 'pickup' WHEN v IN ('PLACE_ON','PLACE_IN') THEN 'place' ELSE 'other' END AS category,
  CASE v WHEN 'PLACE_ON' THEN 1 WHEN 'PLACE_IN' THEN 1 WHEN 'OPEN' THEN 2 WHEN 'CLOSE' THEN 3 WHEN 'TURN_ON' THEN 4 WHEN 'TURN_OFF' THEN 4 ELSE 0 END AS expert FROM r""")
def skill_display_and_experts(t: Tables):
    p = parts(t, s=SKILL_TEXT)
    verb = F.coalesce(X.skill_verb(F.col("s")), F.lit(""))
    return p.select("p_partkey", X.skill_for_display(F.col("s"), "libero").alias("shown"), X.skill_verb_lenient(F.col("s")).alias("verb"),
                    X.verb_category(verb).alias("category"), X.expert_id(verb).alias("expert"))


@query(f"""WITH {SKILL_SQL} SELECT p_partkey, CASE WHEN list_contains(args, '') THEN NULL WHEN v IN ('PICKUP_FROM','OPEN','CLOSE','TURN_ON','TURN_OFF') THEN args[1]
    WHEN v IN ('PLACE_ON','PLACE_IN') AND len(args) >= 2 THEN args[2] END AS target,
  CASE WHEN list_contains(args, '') THEN NULL WHEN v IN ('PICKUP_FROM','OPEN','CLOSE','TURN_ON','TURN_OFF') OR (v IN ('PLACE_ON','PLACE_IN') AND len(args) >= 2) THEN args[1] END AS contact FROM r""")
def target_objects(t: Tables):
    return parts(t, s=SKILL_TEXT).select("p_partkey", X.target_objects(F.col("s")).alias("o")).select("p_partkey", "o.*")


# --- plans ------------------------------------------------------------------------------------------

STRICT = f"""p AS (SELECT p_partkey, trim(regexp_replace({collapsed(PLAN_TEXT)}, '^Plan:', '')) AS text FROM part),
  n AS (SELECT *, regexp_extract_all(text, '(\\d+)\\.\\s*', 1) AS numbers, string_split_regex(text, '\\d+\\.\\s*')[2:] AS bodies FROM p),
  i AS (SELECT p_partkey, k, numbers[k] AS number, trim(bodies[k]) AS body FROM (SELECT *, unnest(range(1, len(numbers) + 1)) AS k FROM n)),
  m AS (SELECT *, regexp_extract(body, '{PATTERN}', 1) AS v, list_transform(string_split(regexp_extract(body, '{PATTERN}', 2), ','), lambda x: trim(x)) AS args FROM i),
  c AS (SELECT *, CASE WHEN CAST(number AS BIGINT) <> k THEN 'bad_numbering' WHEN body = '' THEN 'empty_item' WHEN v = '' THEN 'malformed'
    WHEN {ARITY_SQL.format(v='v')} IS NULL THEN 'unknown_verb' WHEN len(args) <> {ARITY_SQL.format(v='v')} THEN 'wrong_arity'
    WHEN list_contains(args, '') THEN 'empty_argument' END AS reason, v || '(' || array_to_string(args, ', ') || ')' AS skill FROM m),
  g AS (SELECT p_partkey, arg_min(reason, k) FILTER (reason IS NOT NULL) AS reason, string_agg(k || '. ' || skill, ' ' ORDER BY k) AS plan, count(*) AS items FROM c GROUP BY 1)"""


@query(f"""WITH {STRICT} SELECT p.p_partkey, CASE WHEN text = '' THEN 'empty_plan' WHEN items IS NULL THEN 'no_items' ELSE reason END AS reason,
  CASE WHEN text <> '' AND items > 0 AND reason IS NULL THEN plan END AS plan FROM p LEFT JOIN g USING (p_partkey)""")
def parse_plans(t: Tables):
    p = parts(t, s=PLAN_TEXT).withColumn("p", X.parse_plan(F.col("s"), "libero"))
    return p.select("p_partkey", "p.reason", X.format_plan(F.col("p.skills")).alias("plan"))


@query(f"""WITH p AS (SELECT p_partkey AS id, {stripped(PLAN_TEXT)} AS text FROM part UNION ALL SELECT doc_id + 1000000000, {stripped('text')} FROM documents),
  n AS (SELECT id, text, list_filter(list_transform(string_split_regex(' ' || text, '\\s\\d+\\.\\s*')[2:], lambda x: regexp_replace(x, '^[ \\n\\t;]+|[ \\n\\t;]+$', '', 'g')), lambda x: x <> '') AS items,
    list_transform(list_filter(string_split_regex(text, '[\\n;]+'), lambda x: {stripped('x')} <> ''), lambda x: regexp_replace(x, '^[ \\n\\t\\-]+|[ \\n\\t\\-]+$', '', 'g')) AS chunks FROM p)
  SELECT id, CAST(CASE WHEN len(items) > 0 THEN len(items) ELSE len(chunks) END AS INTEGER) AS steps,
    md5(array_to_string(CASE WHEN len(items) > 0 THEN items ELSE chunks END, '|')) AS hash FROM n""")
def parse_plans_lenient(t: Tables):
    rows = parts(t, s=PLAN_TEXT).unionAll(t.documents.select(F.col("doc_id") + 1000000000, "text"))
    p = rows.select(F.col("p_partkey").alias("id"), X.parse_plan_lenient(F.col("s")).alias("p"))
    return p.select("id", F.size("p").alias("steps"), F.md5(F.array_join("p", "|")).alias("hash"))


@query(f"""WITH p AS (SELECT p_partkey, string_split(regexp_replace({stripped(PLAN_TEXT)}, '\\d+\\.\\s*([A-Z_]+\\()', '@@\\1', 'g'), '@@') AS pieces FROM part),
  n AS (SELECT p_partkey, list_filter(list_transform(pieces, lambda x: regexp_replace(trim(x), '[,;]+$', '')), lambda x: regexp_extract(x, '{PATTERN}', 1) IN
    ('PLACE_ON','PLACE_IN','PICKUP_FROM','OPEN','CLOSE','TURN_ON','TURN_OFF')) AS skills FROM p)
  SELECT p_partkey, array_to_string(skills, ' | ') AS skills FROM n""")
def parse_plans_serving(t: Tables):
    return parts(t, s=PLAN_TEXT).select("p_partkey", F.array_join(X.parse_plan_serving(F.col("s")), " | ").alias("skills"))


@query(f"""WITH p AS (SELECT p_partkey, trim(regexp_replace({collapsed(PLAN_TEXT)}, '^Plan:', '')) AS text FROM part)
  SELECT p_partkey, array_to_string(CASE WHEN regexp_matches(text, '\\d+\\.\\s*') THEN
    list_filter(list_transform(string_split_regex(text, '\\d+\\.\\s*')[2:], lambda x: trim(x)), lambda x: x <> '') WHEN text = '' THEN [] ELSE [text] END, ' | ') AS skills FROM p""")
def parse_plans_raw(t: Tables):
    return parts(t, s=PLAN_TEXT).select("p_partkey", F.array_join(X.parse_plan_raw(F.col("s")), " | ").alias("skills"))


@query("""SELECT p_partkey, '1. PICKUP_FROM(' || p_name || ', table) 2. PLACE_ON(' || p_name || ', ' || lower(p_type) || ')' AS plan,
  'Instruction: move ' || p_name || chr(10) || 'Plan: 1. PICKUP_FROM(' || p_name || ', table) 2. PLACE_ON(' || p_name || ', ' || lower(p_type) || ')' || chr(10)
    || 'Current skill: PICKUP_FROM(' || p_name || ', table)' || chr(10) AS context FROM part""")
def plan_strings(t: Tables):
    pick = F.concat(F.lit("PICKUP_FROM("), "p_name", F.lit(", table)"))
    place = F.concat(F.lit("PLACE_ON("), "p_name", F.lit(", "), F.lower("p_type"), F.lit(")"))
    plan = X.format_plan(F.array(pick, place))
    return t.part.select("p_partkey", plan.alias("plan"), X.skill_context(F.concat(F.lit("move "), "p_name"), plan, pick).alias("context"))


@query(f"""WITH p AS (SELECT p_partkey, 'Plan:  ' || ({PLAN_TEXT}) || ' ; Done: ' || p_name AS s, p_size % 3 AS d, p_name FROM part),
  q AS (SELECT p_partkey, d, p_name, regexp_replace({collapsed('s')}, '^\\s*Plan:\\s*', '') AS x FROM p)
  SELECT p_partkey, 'Plan: ' || regexp_replace(string_split_regex(x, '\\s*;\\s*Done:\\s*')[1], '^[ ;]+|[ ;]+$', '', 'g') || '; Done: ' ||
    CASE d WHEN 0 THEN 'None' WHEN 1 THEN p_name ELSE p_name || ', ' || p_name END AS prefix FROM q""")
def scene_plan_prefix(t: Tables):
    p = parts(t, s=f"'Plan:  ' || ({PLAN_TEXT}) || ' ; Done: ' || p_name", d="p_size % 3", n="p_name")
    done = F.array_repeat("n", F.col("d"))
    return p.select("p_partkey", X.plan_done_prefix(F.col("s"), done).alias("prefix"))


# --- free texts ----------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({collapsed('text')}) AS hash FROM documents")
def collapse_whitespace(t: Tables):
    return t.documents.select("doc_id", F.md5(X.collapse_whitespace(F.col("text"))).alias("hash"))


@query(f"""WITH d AS (SELECT doc_id, {collapsed('text')} AS s FROM documents)
  SELECT doc_id, CASE WHEN contains(s, ':') THEN md5(trim(substr(s, instr(s, ':') + 1))) ELSE md5(s) END AS instruction,
    CASE WHEN contains(s, ':') AND trim(substr(s, 1, instr(s, ':') - 1)) <> '' THEN md5(trim(substr(s, 1, instr(s, ':') - 1))) END AS task_name FROM d""")
def split_task_text(t: Tables):
    s = t.documents.select("doc_id", X.split_task(F.col("text")).alias("p"))
    return s.select("doc_id", F.md5("p.instruction").alias("instruction"), F.md5("p.task_name").alias("task_name"))


MIRROR = "' left ' || p_name || '(left, right) left right. Right ' || p_type || ' bright left-hand'"


@query(f"""WITH s AS (SELECT p_partkey, regexp_replace({MIRROR}, '([^a-zA-Z0-9])(left|right)([^a-zA-Z0-9])', '\\1<<\\2>>\\3', 'g') AS m FROM part)
  SELECT p_partkey, replace(replace(m, '<<left>>', 'right'), '<<right>>', 'left') AS skill FROM s""")
def mirror_directions(t: Tables):
    return parts(t, s=MIRROR).select("p_partkey", X.mirror_directions(F.col("s")).alias("skill"))


MENTIONS = "'Current skill: PICKUP_FROM(' || p_name || ', table) then OPEN(' || p_brand || ') or FLY(x), CLOSE() and PLACE_ON(' || p_name || ',box) ' || p_type"


@query(f"""WITH s AS (SELECT p_partkey, p_name, p_brand FROM part)
  SELECT p_partkey, 'PICKUP_FROM(' || p_name || ', table)' AS skill FROM s UNION ALL SELECT p_partkey, 'OPEN(' || p_brand || ')' FROM s
  UNION ALL SELECT p_partkey, 'PLACE_ON(' || p_name || ', box)' FROM s""")
def skill_mentions(t: Tables):
    return parts(t, s=MENTIONS).select("p_partkey", F.explode(X.skill_mentions(F.col("s"), "libero")).alias("skill"))


@query("""SELECT p_partkey, 'PLACE_ON(' || p_name || ', box)' AS stray FROM part UNION ALL SELECT p_partkey, 'OPEN(' || p_brand || ')' FROM part WHERE p_size % 2 = 0""")
def stray_mentions(t: Tables):
    p = parts(t, s=MENTIONS, n="p_name", b="p_brand", z="p_size")
    pick, opening = F.concat(F.lit("PICKUP_FROM("), "n", F.lit(", table)")), F.concat(F.lit("OPEN("), "b", F.lit(")"))
    plan = F.array_compact(F.array(pick, F.when(F.col("z") % 2 == 1, opening)))
    return p.select("p_partkey", F.explode(F.array_except(X.skill_mentions(F.col("s"), "libero"), plan)).alias("stray"))


@query("""SELECT event_id, CASE WHEN regexp_matches(trim(s), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN TRY_CAST(trim(s) AS DOUBLE) END AS number,
   lower(trim(s)) IN ('true','completed','yes') AS done FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' ' || CAST(value AS VARCHAR) WHEN 1 THEN 'true' WHEN 2 THEN 'NaN'
     WHEN 3 THEN ' Yes ' WHEN 4 THEN '1e3' ELSE event_type END AS s FROM events)""")
def strict_numbers_and_flags(t: Tables):
    k = F.col("event_id") % 6
    s = (F.when(k == 0, F.concat(F.lit(" "), F.col("value").cast("string"))).when(k == 1, "true").when(k == 2, "NaN")
         .when(k == 3, " Yes ").when(k == 4, "1e3").otherwise(F.col("event_type")))
    return t.events.select("event_id", X.strict_number(s).alias("number"), X.loose_boolean(s).alias("done"))


@query("""WITH l AS (SELECT p_partkey, list_transform(range(0, p_size * 3), lambda x: CAST(x * 7 AS VARCHAR)) AS w FROM part)
  SELECT p_partkey, CASE WHEN length(array_to_string(w, ', ')) <= 200 THEN array_to_string(w, ', ')
    ELSE array_to_string(w[1:20], ', ') || ', ... , ' || array_to_string(w[greatest(len(w) - 19, 1):], ', ') END AS frames FROM l""")
def compact_frame_lists(t: Tables):
    items = F.transform(F.sequence(F.lit(0), F.col("p_size") * 3 - 1), lambda x: x * 7)
    return t.part.select("p_partkey", X.compact_list(F.when(F.col("p_size") > 0, items).otherwise(F.array().cast("array<int>")), 200).alias("frames"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'PICKUP_FROM(x, y)' WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE o_orderpriority END AS prompt FROM orders""")
def policy_prompts(t: Tables):
    st = F.col("o_orderstatus")
    skill = F.when(st == "F", "PICKUP_FROM(x, y)").otherwise("")
    return t.orders.select("o_orderkey", X.policy_prompt(skill, F.when(st == "O", "OPEN"), F.col("o_orderpriority")).alias("prompt"))


NAMES = "CASE WHEN p_size % 3 = 0 THEN 'KITCHEN_SCENE10_' || replace(p_name, ' ', '_') WHEN p_size % 3 = 1 THEN 'ROOM_SCENE2_pick_up_the_' || replace(p_name, ' ', '_') || '_and_place_it_on_the_plate' ELSE 'close_the_microwave' END"


@query(f"""WITH s AS (SELECT p_partkey, {NAMES} AS stem FROM part),
  l AS (SELECT p_partkey, replace(regexp_replace(stem, '^[A-Z]+_SCENE\\d+_', ''), '_', ' ') AS language FROM s)
  SELECT p_partkey, language AS alias FROM l UNION ALL
  SELECT p_partkey, 'put ' || regexp_extract(language, '^pick up (.+) and (?:put|place) it (.+)$', 1) || ' ' || regexp_extract(language, '^pick up (.+) and (?:put|place) it (.+)$', 2) FROM l WHERE language LIKE 'pick up % it %'
  UNION ALL SELECT p_partkey, 'move away the yellow and white mug to close the microwave door' FROM l WHERE language = 'close the microwave'""")
def task_languages(t: Tables):
    return parts(t, s=NAMES).select("p_partkey", F.explode(X.language_aliases(X.language_of_stem(F.col("s")))).alias("alias"))


LINES = "CASE WHEN o_orderkey % 4 = 0 THEN '  ' || o_orderpriority || ', f' WHEN o_orderkey % 4 = 1 THEN o_orderstatus || ' f' ELSE o_orderpriority END"


@query(f"""WITH s AS (SELECT o_orderkey, trim({LINES}) AS s FROM orders)
  SELECT o_orderkey, CASE WHEN s LIKE '%, f' THEN trim(substr(s, 1, length(s) - 3)) ELSE s END AS text, s LIKE '%, f' AS known_false FROM s""")
def labelled_samples(t: Tables):
    s = t.orders.select("o_orderkey", labelled_sample(F.expr(LINES)).alias("p"))
    return s.select("o_orderkey", "p.*")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'top' WHEN 1 THEN '1. OPEN(' || o_orderpriority || ')' END AS plan,
   CASE o_orderkey % 3 WHEN 0 THEN 'do it' WHEN 1 THEN o_orderstatus END AS instruction FROM orders""")
def episode_plan_and_instruction(t: Tables):
    k = F.col("o_orderkey") % 3
    none = F.lit(None).cast("string")
    seg = lambda p, i: F.struct(p.alias("plan"), i.alias("instruction"))
    second = seg(F.when(k == 1, F.concat(F.lit("1. OPEN("), "o_orderpriority", F.lit(")"))), F.when(k == 1, F.concat(F.lit("Instruction: "), "o_orderstatus")))
    segments = F.array(seg(none, F.lit(" ")), second)
    plan, ins = F.when(k == 0, "top"), F.when(k == 0, " do it ").when(k == 1, "  ")
    return t.orders.select("o_orderkey", episode_plan(plan, segments).alias("plan"), episode_instruction(ins, segments).alias("instruction"))


# --- structured texts -------------------------------------------------------------------------------------

COT = """CASE WHEN p_size % 2 = 0 THEN 'Instruction: move ' || p_name || '.' || chr(10) ELSE '' END || 'Plan: 1. PICK(' || p_name || ')' || chr(10) ||
  '2. PLACE(' || p_name || ', box, ' || lower(p_type) || ') with care' || chr(10) || ' What I have done: ' || CASE p_size % 4 WHEN 0 THEN 'Nothing yet' WHEN 1 THEN 'tbd' WHEN 2 THEN 'PICK(' || p_name || ')'
  ELSE 'OPEN(box)' END || chr(10) || CASE WHEN p_size % 11 = 0 THEN '' ELSE 'Now I need to do: ' END || CASE WHEN p_size % 7 = 0 THEN '1. PICK(' || p_name || ')' || chr(10) || '2. OPEN(box)' ELSE 'PICK(' || p_name || ')' END || chr(10)"""
COT_PARTS = f"""c AS (SELECT p_partkey, p_name, p_size, p_type, {COT} AS s FROM part), m AS (SELECT *, p_size % 11 <> 0 AS marked, p_size % 7 = 0 AS two FROM c)"""


@query(f"""WITH {COT_PARTS} SELECT p_partkey, marked, CASE WHEN p_size % 2 = 0 THEN 'Instruction: move ' || p_name || '.' || chr(10) END AS prefix, CASE WHEN marked THEN substr(s, instr(s, 'Plan:')) ELSE substr(s, instr(s, 'Plan:')) END AS tail,
  '1. PICK(' || p_name || ')' || chr(10) || '2. PLACE(' || p_name || ', box, ' || lower(p_type) || ') with care' AS plan, CASE WHEN marked AND NOT two THEN 'PICK(' || p_name || ')' END AS now FROM m""")
def structured_sections(t: Tables):
    s = F.col("s")
    return parts(t, s=COT).select(
        "p_partkey", X.has_plan_structure(s).alias("marked"), X.instruction_prefix(s).alias("prefix"), X.plan_tail(s).alias("tail"),
        X.section(s, V.PLAN_MARKER, V.DONE_MARKER).alias("plan"), X.single_now_item(s).alias("now"))


@query(f"""WITH {COT_PARTS} SELECT p_partkey, CASE WHEN marked AND NOT two THEN CASE WHEN p_size % 2 = 0 THEN 'Instruction: move ' || p_name || '.' || chr(10) ELSE '' END ||
    'Plan: 1. PICK(' || p_name || ')' || chr(10) || '2. PLACE(' || p_name || ', box, ' || lower(p_type) || ')' || chr(10) || ' What I have done: ' ||
    CASE p_size % 4 WHEN 0 THEN 'Nothing.' WHEN 1 THEN 'TBD.' WHEN 2 THEN 'PICK(' || p_name || ')' ELSE 'OPEN(box)' END || chr(10) || 'Now I need to do: PICK(' || p_name || ')' || chr(10) END AS text,
  CASE WHEN NOT marked OR two THEN 'missing_markers' WHEN p_size % 4 = 3 THEN 'done_not_in_plan' END AS reason FROM m""")
def canonical_structured_texts(t: Tables):
    p = parts(t, s=COT).withColumn("text", X.canonical_structured_text(F.col("s")))
    return p.select("p_partkey", "text", X.structured_text_reason(F.col("text"), F.col("s")).alias("reason"))


ITEMS = """CASE p_size % 8 WHEN 0 THEN '3. PICK(' || p_name || ')' WHEN 1 THEN 'PLACE(' || p_name || ', box)' WHEN 2 THEN 'PLACE(a, b, ' || p_type || ')' WHEN 3 THEN 'tbd...'
  WHEN 4 THEN 'Nothing else' WHEN 5 THEN 'ROTATE(knob) slowly' WHEN 6 THEN 'OPEN()' ELSE p_name END"""


@query(f"""WITH i AS (SELECT p_partkey, p_size % 8 AS k, p_name, p_type, regexp_replace({ITEMS}, '^\\d+\\.\\s*', '') AS s FROM part)
  SELECT p_partkey, k IN (2) OR (k = 0) AS is_skill, k IN (3, 4) AS by_prefix, k = 3 AS by_word,
    CASE k WHEN 3 THEN 'TBD.' WHEN 4 THEN 'Nothing.' WHEN 5 THEN 'ROTATE(knob)' ELSE s END AS item FROM i""")
def structured_items(t: Tables):
    i = parts(t, s=ITEMS)
    plain = X.strip_step_number(F.col("s"))
    return i.select("p_partkey", X.is_cot_skill(plain).alias("is_skill"), X.is_placeholder_prefix(plain).alias("by_prefix"),
                    X.is_placeholder_word(plain).alias("by_word"), X.canonical_item(F.col("s")).alias("item"))


@query("""SELECT conv_id, turn, coalesce(nullif(text, ''), role) AS active FROM (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN text END AS text FROM conversations)""")
def active_texts(t: Tables):
    updated = F.when(F.col("turn") % 2 == 0, F.col("text"))
    return t.conversations.select("conv_id", "turn", X.active_text(F.nullif(updated, F.lit("")), F.col("role")).alias("active"))


@query("SELECT page_id, CASE WHEN instr(html, '{') > 0 THEN substr(html, instr(html, '{'), instr(html, '}') - instr(html, '{') + 1) END AS object FROM pages")
def first_json_objects(t: Tables):
    """The first balanced object of each page, null without one: the pages' first braces are a style rule without nesting."""
    return t.pages.select("page_id", X.first_json_object(F.col("html")).alias("object"))
