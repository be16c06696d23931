"""Repairs against every sequence of edits, a plain table over rows, and whole conversations in plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from demospan.llm import conversation_repair as R, queries
from demospan.operators import ordered

D = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, block string, at int, mark string, cost int"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y", 1) for r in rows], SCHEMA)


def every_edit(rows):
    """The least (cost, audit) of all edits with up to two inserts at a place."""
    inserts = [("", ""), ("u", "I"), ("a", "I"), ("ua", "II"), ("au", "II")]
    choices = [inserts]
    for x in rows:
        more = 5 if x.isupper() else 0
        mine = [("", "D", 2)]
        if x != "-":
            mine += [(x.lower(), "K", more), ("u", "R", 1 + more), ("a", "R", 1 + more)]
        choices += [mine, inserts]
    best = None
    for way in itertools.product(*choices):
        if re.fullmatch("(s?(ua)+)?", "".join(w[0] for w in way)):
            audit = "".join(w[1] for w in way)
            found = sum(w[2] for w in way[1::2]) + 5 * audit.count("I"), audit
            best = found if best is None or found < best else best
    return best


def by_table(rows):
    """The same row by row: the least (cost, audit) for what may follow."""
    into = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def insert(best):
        for _ in range(2):
            for q, (c, a) in list(best.items()):
                for x in "ua":
                    if x in into[q]:
                        new, p = (c + 5, a + "I"), into[q][x]
                        best[p] = min(best.get(p, new), new)
        return best

    best = insert({"": (0, "")})
    for x in rows:
        now = {}
        for q, (c, a) in best.items():
            ways = [(2, "D", q)]
            if x != "-":
                more = 5 if x.isupper() else 0
                ways += [(more, "K", into[q][x.lower()])] if x.lower() in into[q] else []
                ways += [(1 + more, "R", into[q][y]) for y in "ua" if y in into[q]]
            for more, e, p in ways:
                now[p] = min(now.get(p, (c + more, a + e)), (c + more, a + e))
        best = insert(now)
    return min(best[q] for q in ("", "a") if q in best)


def test_lightest_derivation():
    for n in range(3):
        for rows in itertools.product("suaxSUA-", repeat=n):
            assert R.repair("".join(rows)) == every_edit(rows) == by_table(rows)
    rng = random.Random(1)
    for _ in range(25):
        rows = "".join(rng.choice("suaxSUA-") for _ in range(3))
        assert R.repair(rows) == every_edit(rows)
    for _ in range(400):
        rows = "".join(rng.choice("ssuuuaaaxSUAX--") for _ in range(rng.randrange(40)))
        assert R.repair(rows) == by_table(rows)
        n = rng.randrange(1, 9)
        blocks = [rows[i : i + n] for i in range(0, len(rows), n)]
        if blocks:
            together = R.joined([R.spans(b) for b in blocks])
            audit = min((c, a) for q, s, c, a in together if q == R.NONE and s in R.WHOLE)
            assert audit == by_table(rows)
            assert "".join(p for _, p in R.sliced(audit[1], blocks)) == audit[1]


def repair_brute(rows):
    every = {c for c, *_ in rows if c is not None}
    hurt = defaultdict(list)
    for c, turn, role, text in rows:
        if c is None:
            continue
        role, text = (" " if role is None else role), (" " if text is None else text)
        fault = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        hurt[c] += [(turn is not None, turn or 0, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = Counter()
    for c in every:
        mine, seen, letters, faults = sorted(hurt[c]), set(), "", Counter()
        for _, _, role, text in mine:
            last = re.findall("[^\x20\x09-\x0d]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated"
            seen.add((role, text))
            faults[fault] += 1
            x = role[:1] if role[:1] and role[:1] in "sua" else "x"
            letters += "-" if fault in ("blank", "duplicate") else x.upper() if fault else x
        numbers = [t for known, t, *_ in mine if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[:1] for _, _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = by_table(letters)
        lines, state, left = [], "", iter(mine)
        for e in audit:
            _, _, role, text = (0, 0, "", "") if e == "I" else next(left)
            if e != "D":
                role = role if e == "K" else "assistant" if state == "u" else "user"
                lines.append(f"{role}:{text}")
                state = role[0]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[c, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest] += 1
    return out


def found(spark, conversations):
    rows = R.repaired(conversations, R.damaged(conversations))
    assert rows.columns == COLUMNS
    return Counter(tuple(r) for r in rows.collect())


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(80):
        for turn in range(rng.choice([1, 2, 5, 8, 70])):
            role = rng.choice(["user", "assistant", ("user", "assistant")[turn % 2], "system" if not turn else "user", "tool", "", None])
            text = rng.choice(["Fine. ", "Well!\n", f"own {rng.random()}.", "cut off", "", None, " \t\x0b", "é?", "x\x0c"])
            rows.append((c, rng.choice([turn, turn, turn + 5, None]), role, text))
    rows += [(500, t, "user", "Again.") for t in range(30)] + [(501, 3, "user", "x")] * 9
    rows += [(None, 1, "user", "x"), (None, None, None, None), (10**15, None, None, None), (-4, 2, "system", "Only.")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, bytes_, together, cut", [(512, 1 << 24, 64, 2_000_000), (7, 1 << 24, 2, 2_000_000), (512, 30, 3, 10)])
def test_repair(spark, monkeypatch, block, bytes_, together, cut):
    monkeypatch.setattr(R, "ROWS", block)
    monkeypatch.setattr(R, "BYTES", bytes_)
    monkeypatch.setattr(R, "TOGETHER", together)
    monkeypatch.setattr(ordered, "ROWS_PER_BLOCK", cut)
    rows = random_rows(block)
    assert found(spark, conversations_of(spark, rows)) == repair_brute(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", "C."), (1, 3, "assistant", " ")]
    judged, fixed = R.mended(conversations_of(spark, rows))
    assert [(r.cost, r.audit) for r in judged.collect()] == [(4, "DKKD")]
    assert [[tuple(t) for t in r.turns] for r in fixed.collect()] == [[("user", "B."), ("assistant", "C.")]]


def test_odd_tables(spark):
    assert not found(spark, conversations_of(spark, []))
    rows = [(1, None, None, None), (2, 0, "user", "long " * 100_000), (2, 1, "assistant", "x" * 300_000 + "."), (None, 0, "user", "x")]
    assert found(spark, conversations_of(spark, rows)) == repair_brute(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in queries.op13_conversation_repair(spark, D).collect()) == repair_brute(rows)
