"""Repair of a conversation's structure as a lightest derivation.

Items say how many rows are used up and which role came last. An edit deduces an item from another and adds to
its weight, a pair (cost, audit): both only grow, and of one item no two audits of a cost begin one another, so
the functions are superior and the agenda, taken least first, finalises each item at its lightest derivation.
The goal is the first item that has used up all rows after an even number of speakers.

A long conversation is cut into blocks. A block's items from each role before it are deduced apart from the
others; blocks are then put together, so many at a time, by deductions from two items: what leads to a block and
the block. Only letters for rows and audits go through these steps; texts meet their block's edits once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import ordered
from .common import cut, streamed_sha256
from .conversation_trie import turn_id

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
#: what came last: nothing, a system turn, a user turn, an assistant turn
NONE, SYSTEM, USER, ASSISTANT = range(4)
WHOLE = (NONE, ASSISTANT)
#: rows and bytes of a block, and blocks that are put together at once
ROWS, BYTES, TOGETHER = 512, 1 << 24, 64
SPACE = " \t\n\x0b\x0c\r"
GONE = "-"
REMEMBERED = 100_000

Step = tuple[int, str, int, int]


def lightest(start: int, steps: Callable[[int, int], Iterable[Step]], length: int) -> Iterator[tuple[int, int, str]]:
    """``state, cost, audit`` of the items at ``length`` in the order in which they are finalised."""
    agenda, final = [(0, "", 0, start)], set()
    while agenda:
        cost, audit, at, state = heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == length:
            yield state, cost, audit
        for more, letters, to, then in steps(at, state):
            if (to, then) not in final:
                heappush(agenda, (cost + more, audit + letters, to, then))


def _speaker(state: int) -> int:
    """Who is to speak after ``state``."""
    return ASSISTANT if state == USER else USER


def edits(rows: str) -> Callable[[int, int], Iterator[Step]]:
    """Steps over rows: s, u, a by role or x for another, capital if unfinished, GONE if it must be deleted."""

    def steps(at: int, state: int) -> Iterator[Step]:
        then = _speaker(state)
        yield INSERT, "I", at, then
        if at == len(rows):
            return
        yield DELETE, "D", at + 1, state
        row = rows[at]
        if row == GONE:
            return
        role = row.lower()
        more = UNFINISHED if role != row else 0
        if role == "ua"[then - USER]:
            yield KEEP + more, "K", at + 1, then
        elif role == "s" and state == NONE:
            yield KEEP + more, "K", at + 1, SYSTEM
        yield REROLE + more, "R", at + 1, then

    return steps


def repair(rows: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits, the ASCII-least audit of equal ones."""
    return next((cost, audit) for state, cost, audit in lightest(NONE, edits(rows), len(rows)) if state in WHOLE)


def spans(rows: str) -> list[Step]:
    """``before, after, cost, audit`` of the lightest edits of a block for every two states."""
    return [(q, r, c, a) for q in range(4) for r, c, a in lightest(q, edits(rows), len(rows))]


def joined(blocks: list[list[Step]]) -> list[Step]:
    """The same for a sequence of blocks."""

    def steps(at: int, state: int) -> Iterator[Step]:
        if at < len(blocks):
            for before, after, cost, audit in blocks[at]:
                if before == state:
                    yield cost, audit, at + 1, after

    return [(q, r, c, a) for q in range(4) for r, c, a in lightest(q, steps, len(blocks))]


def after(state: int, rows: str, audit: str) -> int:
    """The state that a block's edits lead to."""
    row = iter(rows)
    for edit in audit:
        own = "" if edit == "I" else next(row)
        if edit != "D":
            state = SYSTEM if edit == "K" and state == NONE and own in "sS" else _speaker(state)
    return state


def sliced(audit: str, blocks: list[str]) -> list[tuple[int, str]]:
    """State before each block and its part of the audit; the last one has the inserts at the end."""
    out, state, at = [], NONE, 0
    for i, rows in enumerate(blocks):
        end, left = at, len(rows)
        while left:
            left -= audit[end] != "I"
            end += 1
        if i == len(blocks) - 1:
            end = len(audit)
        out.append((state, audit[at:end]))
        state, at = after(state, rows, audit[at:end]), end
    return out


def turns(state: int, audit: str, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The rows (role, text) after their edits."""
    out, row = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(row)
        if edit == "D":
            continue
        then = SYSTEM if edit == "K" and state == NONE and role[:1] == "s" else _speaker(state)
        out.append((role if edit == "K" else ("user", "assistant")[then - USER], text))
        state = then
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults that crc32 of conv_id:turn, modulo 20, puts in.

    0 drops a row, 1 empties its text, 2 takes out its full stops, exclamation and question marks, 3 repeats it, 4
    makes it the user's. A null turn in the number, role or text is one space.
    """
    space = F.lit(" ")
    number = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
        (F.crc32(number) % 20).alias("fault"),
    ).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("n")).drop("n")


def _blocks(rows: DataFrame) -> DataFrame:
    """``conv_id, block, alone, t, marks`` and sums: rows in order, cut into blocks."""
    initial = F.substring("role", 1, 1)
    o = ordered(rows.where("conv_id IS NOT NULL"), ["conv_id"], ["turn", "role", "text"], split="turn").scan(
        index="at", previous={"was": F.struct("turn", initial.alias("role"))}, following={"next": F.lit(1)}, sums={"upto": F.octet_length("text")}
    )
    rest = F.rtrim("text", F.lit(SPACE))
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    mark = F.when(rest == "", GONE).when(F.right(rest, F.lit(1)).isin(".", "!", "?"), role).otherwise(F.upper(role))
    pair = F.concat(F.col("was.role"), initial)
    placed = o.rows().select(
        "conv_id", "at", "turn", "role", "text", mark.alias("mark"), turn_id(F.col("role"), F.col("text")).alias("id"),
        (F.floor(F.col("at") / ROWS) + F.floor(F.col("upto") / BYTES)).alias("block"), F.col("next").isNull().alias("last"),
        (F.col("was").isNotNull() & ~pair.isin("su", "ua", "au")).cast("bigint").alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("was.turn"))).cast("bigint").alias("turns"),
    )
    grouped = placed.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("at", "role", "text", "mark", "id"))).alias("t"), (F.max("last") & (F.min("at") == 0)).alias("alone"),
        F.sum("illegal").alias("illegal"), F.sum("turns").alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    told = F.transform("t", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    marks = F.transform("t", lambda r: F.struct(r["at"].alias("at"), r["mark"].alias("mark"), r["id"].alias("id")))
    return grouped.select("conv_id", "block", "alone", told.alias("t"), marks.alias("marks"), "illegal", "turns", "low", "high")


def _letters(blocks: DataFrame) -> DataFrame:
    """``conv_id, block, alone, rows`` (a letter for each row) and sums; later rows of a role and text are GONE."""
    small = blocks.drop("t")
    ids = small.select("conv_id", "block", F.explode("marks").alias("m")).select("conv_id", "block", "m.at", "m.mark", "m.id")
    firsts = ids.groupBy("conv_id", "id").agg(F.min("at").alias("at")).select("conv_id", "at")
    later = ids.where(F.col("mark") != GONE).join(firsts, ["conv_id", "at"], "left_anti")
    later = later.groupBy("conv_id", "block").agg(F.collect_set("at").alias("later"))
    gone = F.coalesce("later", F.array().cast("array<bigint>"))
    letter = F.transform("marks", lambda m: F.when(F.array_contains(gone, m["at"]), GONE).otherwise(m["mark"]))
    rows = small.join(later, ["conv_id", "block"], "left").withColumn("rows", F.array_join(letter, ""))
    blank = F.size(F.filter("marks", lambda m: m["mark"] == GONE))
    cut_short = F.length(F.translate("rows", GONE + "suax", ""))
    return rows.select(
        "conv_id", "block", "alone", "rows", "illegal", "turns", "low", "high",
        blank.alias("blank"), F.size(gone).alias("duplicate"), cut_short.alias("truncated"),
    )


_SPANS = "array<struct<before:int,after:int,cost:bigint,audit:string>>"


def _rows_of(schema: str, names: list[str], kinds: list[pa.DataType]):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return schema, batch


_AUDIT = _rows_of(
    "conv_id bigint, block bigint, state int, part string, cost bigint, audit string",
    ["conv_id", "block", "state", "part", "cost", "audit"],
    [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()],
)
_SPAN_TYPE = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_SPAN = _rows_of(f"conv_id bigint, no bigint, spans {_SPANS}", ["conv_id", "no", "spans"], [pa.int64(), pa.int64(), _SPAN_TYPE])


def _steps(found: list[dict]) -> list[Step]:
    return [(s["before"], s["after"], s["cost"], s["audit"]) for s in found]


def _dicts(found: list[Step]) -> list[dict]:
    return [dict(zip(("before", "after", "cost", "audit"), s)) for s in found]


def _audits(letters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, cost, audit``, and ``conv_id, block, state, part``: the edits of each block."""
    schema, batch_of = _AUDIT

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = lru_cache(REMEMBERED)(repair)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                cost, audit = solve(r["rows"])
                out.append((r["conv_id"], r["block"], NONE, audit, cost, audit))
            yield batch_of(out)

    schema_s, batch_s = _SPAN

    def first_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield batch_s([(r["conv_id"], r["no"], _dicts(spans(r["rows"])))])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield batch_s([(r["conv_id"], r["no"], _dicts(joined([_steps(b["spans"]) for b in r["some"]])))])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                cost, audit = min((c, a) for q, s, c, a in _steps(r["spans"]) if q == NONE and s in WHOLE)
                parts = sliced(audit, [b["rows"] for b in r["blocks"]])
                yield batch_of([(r["conv_id"], b["block"], s, p, cost, audit if not i else None) for i, ((s, p), b) in enumerate(zip(parts, r["blocks"]))])

    alone = letters.where("alone").select("conv_id", "block", "rows").mapInArrow(short, schema)
    long = letters.where("NOT alone").select("conv_id", "block", "rows")
    if long.isEmpty():
        both = alone
    else:
        o = ordered(long, ["conv_id"], ["block"], split="block").scan(index="no")
        now = cut(o.rows().select("conv_id", "no", "rows").mapInArrow(first_spans, schema_s))
        while now.where("no > 0").limit(1).count():
            some = now.groupBy("conv_id", F.floor(F.col("no") / TOGETHER).alias("no")).agg(F.sort_array(F.collect_list(F.struct("no", "spans"))).alias("some"))
            now = cut(some.select("conv_id", "no", "some").mapInArrow(put_together, schema_s))
        held = long.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "rows"))).alias("blocks"))
        both = alone.union(now.join(held, "conv_id").select("conv_id", "spans", "blocks").mapInArrow(cut_up, schema))
    both = cut(both)
    return both.where("audit IS NOT NULL").select("conv_id", "cost", "audit"), both.select("conv_id", "block", "state", "part")


def mended(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) judged, and repaired.

    The first table has a row for each conv_id that has rows: gaps, blank, duplicate, truncated, illegal, cost and
    audit. The second has ``conv_id, block, alone, turns``: repaired turns (role, text) in order, in blocks that do
    not decrease; ``alone`` marks the only block of its conversation. Rows are in order of turn, null first, then
    of role and text. Rows without a conv_id belong to no conversation; a null role or text is one space; an empty
    table gives none. A role that does not begin with s, u or a cannot be kept.
    """
    known = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    blocks = cut(_blocks(known))
    letters = cut(_letters(blocks))
    audits, parts = _audits(letters)
    sums = letters.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                some = batch.slice(first, ROWS)
                out = []
                for r in some.select(["state", "part", "t"]).to_pylist():
                    found = turns(r["state"], r["part"], [(x["role"], x["text"]) for x in r["t"]])
                    out.append([{"role": a, "text": b} for a, b in found])
                columns = [*some.select(["conv_id", "block", "alone"]).columns, pa.array(out, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "block", "alone", "turns"])

    whole = blocks.select("conv_id", "block", "alone", "t").join(parts, ["conv_id", "block"]).select("conv_id", "block", "alone", "state", "part", "t")
    fixed = whole.mapInArrow(apply, "conv_id bigint, block bigint, alone boolean, turns array<struct<role:string,text:string>>")
    return sums.join(audits, "conv_id"), fixed


def digests(fixed: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of the lines role:text of each conversation's repaired turns."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    alone = fixed.where("alone").select("conv_id", F.sha2(lines, 256).alias("sha256"))
    rest = fixed.where("NOT alone AND size(turns) > 0").select("conv_id", "block", lines.alias("lines"))
    return alone.union(streamed_sha256(rest, "conv_id", "block", "lines", "\n"))


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """What ``mended`` finds in ``rows`` for every conv_id of ``conversations``, with ``repaired_sha256``."""
    judged, fixed = mended(rows)
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).where("conv_id IS NOT NULL").distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return every.join(judged, "conv_id", "left").join(digests(fixed), "conv_id", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", empty).alias("repaired_sha256"),
    )
