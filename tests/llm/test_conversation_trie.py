"""Tries of conversations against sets of prefixes; the trees against sorted keys."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from demospan.llm import conversation_trie as T, queries
from demospan.llm.common import cut
from demospan.operators import ordered

D = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, at string, id int, size string, name int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y", 1) for r in rows], SCHEMA)


def trie_brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    members = defaultdict(set)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        whole = (own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].add(c)
        ends[tuple(whole)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = Counter()
    for p, m in members.items():
        digest = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], digest] += 1
    return out


def found(spark, conversations):
    rows = T.trie(*T.with_shared_openings(cut(T.turns_of(conversations))))
    assert rows.columns == COLUMNS
    return Counter(tuple(r) for r in rows.collect())


def random_rows(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        for turn in range(rng.choice([0, 1, 3, 8, 12, rng.randrange(30)])):
            text = rng.choice(["a", "b", "", None, "ç", f"own {rng.random()}"])
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "assistant", "system", None]), text))
    rows += [(c, t, "user", "the same") for c in range(200, 260) for t in range(4)]  # copies
    rows += [(c, t, "user", str(t)) for c in (301, 306, 311) for t in range(150)]  # long ones that share all
    rows += [(320 + c, t, "user", str(t if t < 70 + c else -c)) for c in range(5) for t in range(140)]
    rows += [(400, 1, "user", "x")] * 5 + [(None, 1, "user", "x"), (None, None, None, None), (10**15, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment, keys, block", [(64, 8192, 2_000_000), (3, 7, 2_000_000), (5, 1, 10)])
def test_trie(spark, monkeypatch, segment, keys, block):
    monkeypatch.setattr(T, "SEGMENT", segment)
    monkeypatch.setattr(T, "TREE_KEYS", keys)
    monkeypatch.setattr(T, "ENDS", 8)
    monkeypatch.setattr(ordered, "ROWS_PER_BLOCK", block)
    rows = random_rows(segment)
    assert found(spark, conversations_of(spark, rows)) == trie_brute(rows)


def test_odd_tables(spark):
    empty = conversations_of(spark, [])
    assert not found(spark, empty)
    rows = [(7, None, None, None)]  # its only turn lies before h, and its family's first is absent
    assert found(spark, conversations_of(spark, rows)) == trie_brute(rows)
    rows = [(5, 0, "user", "x" * 300_000), (6, 0, "user", "x" * 300_000), (None, 0, "user", "x")]
    assert found(spark, conversations_of(spark, rows)) == trie_brute(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in queries.op12_conversation_trie(spark, D).select(*COLUMNS).collect()) == trie_brute(rows)


@pytest.mark.parametrize("letters, kind", [(3, T.Few), (30, T.Indexed), (256, T.Full)])
def test_layouts_grow(letters, kind):
    rng = random.Random(letters)
    keys = [bytes(rng.randrange(letters) for _ in range(rng.randrange(1, 6))) for _ in range(4000)]
    root = T.Node(b"")
    for i, k in enumerate(keys):
        T.insert(root, k, i)
    assert isinstance(root.kids, kind)
    order, path = T.in_order(root), {}
    held = defaultdict(list)
    for place, (node, parent, end) in enumerate(order):
        if parent < 0:
            path[place] = node.path
        else:
            up = order[parent][0]
            letter = next(x for x in range(256) if up.kids.get(x) is node)
            path[place] = path[parent] + bytes([letter]) + node.path
        assert len(path[place]) == end and (node.here or len(node.kids.kids) > 1 or parent < 0)
        for i in node.here:
            held[path[place]].append(i)
    want = defaultdict(list)
    for i, k in enumerate(keys):
        want[k].append(i)
    assert held == want
