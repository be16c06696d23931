"""Exact copies, near copies, lines and components against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from demospan.llm import exact_dedup as E, line_dedup as L, simhash_dedup as S
from demospan.llm.components import components

WORDS = "the of and tion ea thou in re ly st hen ou ing blea nor esh anti wh or ti edes".split()


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


# --- components --------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    n = 60
    edges = {
        "chain": [(i, i + 1) for i in range(n)],
        "star": [(n, i) for i in range(n)],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(45)] + [(1, 1), (2, 5), (2, 5), (5, 2)],
        "none": [],
    }[kind]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(df).collect()}
    real = [(a, b) for a, b in edges if a != b]
    want = union_find({x for e in real for x in e}, real)
    assert got == want


# --- exact copies ------------------------------------------------------------------------------

CASES = [(5, "a b"), (3, "a \t\n b"), (9, "a b "), (8, "a b\n"), (1, None), (2, ""), (7, " "), (6, "\t"), (4, "a\u00a0b"), (5, "a b"), (5, "other"), (None, "a b"), (None, "alone"), (11, "x" * 200_000), (10, "x" * 200_000), (12, "x" * 199_999 + "y")]


def exact_brute(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, left = (min(known) if known else None), True
        for d in ids:
            out.append((d, keep, len(ids), d == keep and left, hashlib.sha256(t.encode()).hexdigest()))
            left = left and d != keep
    return Counter(out)


def test_exact_groups(docs_of):
    got = Counter(tuple(r) for r in E.exact_groups(docs_of(CASES)).collect())
    assert got == exact_brute(CASES)


def test_exact_keeps_one_row_of_each_group(docs_of):
    kept = E.keep_first(docs_of(CASES))
    assert kept.columns == docs_of([]).columns
    want = Counter(r[0] for r in exact_brute(CASES).elements() if r[3])
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_exact_empty(docs_of):
    assert E.exact_groups(docs_of([])).count() == 0 and E.keep_first(docs_of([])).count() == 0


def test_fingerprints_combine():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(3 * E.CHUNK // 2))
    for at in (0, 1, 17, E.CHUNK // 2, E.CHUNK):
        left, right = data[:at], data[at : at + E.CHUNK]
        whole = E.combine(E.fingerprint(E._cut_up(left)), len(left), E.chunk_hash(right))
        assert whole == E.fingerprint(E._cut_up(left + right))
    for (p, b), h in zip(zip(E.PRIMES, E.BASES), E.chunk_hash(data[:1000])):
        assert h == sum((x + 1) * pow(b, i, p) for i, x in enumerate(data[:1000])) % p


def test_equal_fingerprints_of_differing_texts_are_told_apart(spark, docs_of, monkeypatch):
    monkeypatch.setattr(E, "fingerprints", lambda d: d.select("doc_id", F.lit(1).cast("bigint").alias("f1"), F.lit(1).cast("bigint").alias("f2"), F.lit(1).cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256")))
    monkeypatch.setattr(E, "collisions", lambda d: spark.createDataFrame([(1, 1, 1)], "f1 bigint, f2 bigint, n_bytes bigint"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in E.exact_groups(docs_of([(1, "a"), (2, "b"), (3, "a")])).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 1)}


def test_chunks_that_differ_are_a_collision(docs_of, monkeypatch):
    import pyarrow as pa

    def same_fingerprint(batches):
        for batch in batches:
            t = [x.as_py().encode() for x in batch.column("text")]
            one = pa.array([1] * len(t), pa.int64())
            yield pa.RecordBatch.from_arrays([one, one, one, one, pa.array(t, pa.binary())], ["f1", "f2", "n_bytes", "chunk_no", "chunk"])

    monkeypatch.setattr(E, "_chunk_rows", same_fingerprint)
    assert E.collisions(docs_of([(1, "a"), (2, "a")])).count() == 0
    assert E.collisions(docs_of([(1, "a"), (2, "b")])).count() == 1


# --- near copies -------------------------------------------------------------------------------


def simhash_brute(t, k=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    votes = [0] * 64
    for x in s:
        h = xxhash.xxh64(x.encode(), seed=42).intdigest()
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(s))


def near_brute(rows, radius=3):
    fps = [simhash_brute(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= radius]
    root = union_find(range(len(rows)), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    return Counter((d, f"{fps[i]:016x}", least.get(root[i])) for i, (d, _) in enumerate(rows))


def near_rows():
    rng = random.Random(11)
    rows = [(100, None), (101, ""), (102, " \n "), (103, "one"), (104, "ONE"), (105, "two words"), (None, "one"), (None, "quite alone here"), (106, "É É É É"), (106, "É É É É"), (107, "word " * 70_000)]
    for i in range(60):
        base = text(rng, rng.randrange(3, 400)).split()
        rows.append((i * 10, " ".join(base)))
        for j in range(rng.randrange(4)):
            for _ in range(rng.randrange(1, 3)):
                base[rng.randrange(len(base))] = rng.choice(WORDS)
            rows.append((i * 10 + j + 1, "  ".join(base)))
    return rows


def test_near_groups(docs_of):
    rows = near_rows()
    got = S.near_groups(docs_of(rows)).select("doc_id", S.hex_digits(F.col("fp")).alias("f"), "component_id")
    want = near_brute(rows)
    assert Counter(tuple(r) for r in got.collect()) == want
    kept = S.keep_one(docs_of(rows))
    assert kept.columns == docs_of([]).columns
    assert Counter(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == Counter({x[2]: 1 for x in want if x[2] is not None})
    assert S.near_groups(docs_of([])).count() == 0 and S.keep_one(docs_of([])).count() == 0


@pytest.mark.parametrize("refine", [1, 4096])
@pytest.mark.parametrize("radius", [1, 3])
def test_links_keep_every_component(spark, monkeypatch, refine, radius):
    monkeypatch.setattr(S, "REFINE_ABOVE", refine)
    rng = random.Random(refine + radius)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0}
    for f in list(fps):
        for _ in range(rng.randrange(12)):
            for _ in range(rng.randrange(1, 5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = [S._long(f) for f in fps]
    got = S.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), radius).collect()
    close = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= radius
    assert all(close(*r) for r in got)
    links = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if close(a, b)]
    assert union_find(signed, [tuple(r) for r in got]) == union_find(signed, links)


def test_pivots_discard_no_link():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2**63, 200, dtype=np.uint64)
    fp = np.unique(np.r_[fp, fp ^ np.uint64(7), fp ^ np.uint64(8), fp ^ np.uint64(15)])
    a, b = S.linked_in_groups(np.zeros(len(fp)), fp, 3)
    links = [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 3]
    assert union_find(range(len(fp)), zip(a.tolist(), b.tolist())) == union_find(range(len(fp)), links)
    assert len(a) < len(fp)


# --- lines -------------------------------------------------------------------------------------


def shingles(line):
    return {m[1] for m in re.finditer(L.STARTS, line)}


def line_brute(rows):
    places = [(d, n, raw.strip(" ").lower()) for d, t in rows for n, raw in enumerate((t or "").split("\n"))]
    names = sorted({p[2] for p in places if p[2]})
    sets = {n: shingles(n) for n in names}
    links = [(a, b) for i, a in enumerate(names) for b in names[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = union_find(names, links)
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    first = {}
    for p in sorted((p for p in places if p[2]), key=order):
        first.setdefault(root[p[2]], p[:2])
    return places, root, Counter((d, n, not x or first[root[x]] == (d, n)) for d, n, x in places)


def test_line_groups(spark, docs_of):
    rng = random.Random(2)
    pool = [text(rng, rng.randrange(1, 40)) for _ in range(40)]
    for line in pool[:25]:
        w = line.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
            pool.append(" ".join(w))
    pool += ["", "ab", " AB ", "abcd", "x" * 30_000, "x" * 30_000 + "y", "Thé end.", "thé end."]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, pool[0]), (502, "\n\n"), (3, rows[3][1])]
    got = L.line_groups(docs_of(rows)).collect()
    places, root, want = line_brute(rows)
    assert Counter((r.doc_id, r.line_no, r.kept) for r in got) == want
    by_place = {(r.doc_id, r.line_no): r.class_id for r in got}
    classes = defaultdict(set)
    for d, n, x in places:
        if x:
            classes[root[x]].add(by_place[(d, n)])
    assert all(len(v) == 1 for v in classes.values()) and len({next(iter(v)) for v in classes.values()}) == len(classes)
    assert L.line_groups(docs_of([])).count() == 0
