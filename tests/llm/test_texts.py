"""Token counts, packing, licences, decontamination, HTML and urls against plain Python and the libraries."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from demospan.llm import decontaminate as D, html_text as H, license_rules, license_scan as S, packing as P, token_counts as T, url_filter as U
from demospan.llm.queries import PACK_TOKENIZER, RULES, UNIGRAM_PIECES

ODD = [
    None, "", " ", "  two  spaces ", "\n\t", "Don't we'll I'M 's 've '", "naïve ÉCOLE ẞ İstanbul", "日本語 テスト", "☃ 🤖🤖", "a\u00a0b\u2003c", "a\x1cb\x1fc\x85d",
    "<|endoftext|> in a text", "e\u0301 combining", "123 4567", "x" * 5000, "!!! ??? ''' ''s", "the of and " * 3000, "ﬁ ligature", "<0x41> <s> ▁ mark", "ΣΑΣ", "''s''t",
]


# --- token counts ------------------------------------------------------------------------------


def unigram():
    counter = T.Counter(P.tokenizer_path(UNIGRAM_PIECES))
    return counter, Tokenizer(Unigram(counter.vocabulary, counter.unknown, counter.byte_fallback))


def test_token_counts_are_those_of_the_tokenizer(docs_of):
    counter, full = unigram()
    rng = random.Random(4)
    some = ["".join(rng.choice("abc ▁éß日 \n<0x>1") for _ in range(rng.randrange(40))) for _ in range(300)]
    texts = [t for t in ODD if t] + some
    want = [len(full.encode(T.MARK + t.replace(" ", T.MARK)).ids) if t else 0 for t in texts]
    assert [counter.count(t) for t in texts] == want
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1, "again"), (None, "no id")]
    got = Counter((r.doc_id, r.n_tokens, r.n_chars) for r in T.token_counts(docs_of(rows), UNIGRAM_PIECES).collect())
    assert got == Counter((d, counter.count(t or ""), len(t or "")) for d, t in rows)
    assert T.token_counts(docs_of([]), UNIGRAM_PIECES).count() == 0


def test_ties_go_to_the_piece_that_starts_first():
    counter, _ = unigram()
    import ahocorasick

    counter.automaton = ahocorasick.Automaton()
    vocabulary = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -3.0), ("c", -1.0), ("bc", -2.0)]
    for p, s in vocabulary:
        counter.automaton.add_word(p, (len(p), s))
    counter.automaton.make_automaton()
    full = Tokenizer(Unigram(vocabulary, 0, False))
    counter.byte_fallback, counter.unknown_score, counter.single = False, -13.0, frozenset("abc")
    for t in ("ab", "abc", "aabbcc", "abcabc", "xxabyy", "cabxxx"):
        assert counter.viterbi(t) == len(full.encode(t).ids), t


# --- packing -----------------------------------------------------------------------------------


def test_word_table_gives_the_tokenizers_ids():
    encoder = P.Encoder(P.tokenizer_path(PACK_TOKENIZER))
    assert encoder.by_word
    rng = random.Random(9)
    some = ["".join(rng.choice("ab'stre 12é ß!?\n\u00a0\x1c") for _ in range(30)) for _ in range(400)]
    for t in [t or "" for t in ODD] + some:
        want = np.array(encoder.full.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder.ids(t) == want, repr(t)


def test_plan_fills_slots_once():
    rng = random.Random(6)
    for _ in range(60):
        counts = {rng.randrange(1, 65): rng.randrange(1, 50) for _ in range(rng.randrange(1, 30))}
        runs = P.plan(counts, 64)
        used, seen = defaultdict(list), Counter()
        for length, rank, many, each, first, offset in runs.tolist():
            assert rank == seen[length]
            seen[length] += many * each
            for i in range(many * each):
                used[first + i // each].append((offset + i % each * length, length))
        assert seen == Counter(counts)
        for slots in used.values():
            at = 0
            for offset, length in sorted(slots):
                assert offset == at
                at += length
            assert at <= 64
        # best fit decreasing, one piece at a time
        rooms = []
        for n in sorted(Counter(counts).elements(), reverse=True):
            fit = [i for i, r in enumerate(rooms) if r >= n]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= n
            else:
                rooms.append(64 - n)
        assert len(used) == len(rooms)


def test_pack(docs_of):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1, "again"), (None, "no id"), (1, "again")]
    got = P.pack(docs_of(rows), PACK_TOKENIZER).collect()
    encoder = P.Encoder(P.tokenizer_path(PACK_TOKENIZER))
    want = Counter()
    for d, t in rows:
        ids = encoder.full.encode(t or "", add_special_tokens=False).ids + [0]
        for i, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], dtype="<u4")
            want[(d, i, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.sequence_id].append((r.offset, r.length))
    for s in slots.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert P.pack(docs_of([]), PACK_TOKENIZER).count() == 0


# --- licences ----------------------------------------------------------------------------------


def words(t):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def scan_brute(t):
    w = words(t)
    s = f" {' '.join(w)} " if w else "  "
    starts, base = [], set()
    for phrase, label in S.BASE.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    found = []
    for i, (label, priority, weight, keyword, rx) in enumerate(license_rules.rules()):
        for m in re.finditer(f"(?<= )(?:{rx})(?= )", s):
            assert keyword in f" {m[0]} ", (keyword, rx)
            a = s[: m.start()].count(" ") - 1
            found.append((a, a + m[0].count(" ") + 1, priority, i, label, weight))
    kept = []
    for d in found:
        over = [
            e for e in found if e != d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2]
            and (e[2] > d[2] or e[:2] != d[:2] or e[3] < d[3])
        ]
        if not over:
            kept.append(d)
    labels = base | {d[4] for d in kept}
    score = 1.0 if base else max([d[5] for d in kept], default=0.0)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


LICENSED = [
    "Released under the MIT License.\nunder the mit license under the MIT-license", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "cc by nc cc by nc nd 4.0",
    "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License version 2 or later", "All rights reserved.", "SPDX-License-Identifier: LGPL-3.0-only",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "public domain; see the BSD 3-Clause license for details", "emit licenses summit license", "ünder the mit license",
    "the apache license version 2 " * 400, "MPL 2.0 / GPL 2.0 / LGPL 2.1", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "neither the name of Foo Inc nor the names of its contributors",
]


def test_every_text_signature(docs_of):
    """A text made from each signature, its options taken and its choices set to the first, gets its label."""
    rows = []
    for i, (label, _, _, word, rx) in enumerate(license_rules.TEXTS):
        said = rx.replace("[sc]", "s").replace("(?:[^ ]+ ){1,12}", "Foo Inc ").replace("[1-4]", "4")
        said = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", said).replace("?", "")
        assert re.fullmatch(rx, said.lower()) and word in said, (said, rx)
        rows.append((i, f"Some words. {said.capitalize()}; more words."))
    got = {r.doc_id: r.labels.split(",") for r in S.scan(docs_of(rows)).collect()}
    assert all(license_rules.TEXTS[d][0] in labels for d, labels in got.items()) and len(got) == len(rows)


def test_scan(docs_of):
    rows = [(i, t) for i, t in enumerate([*LICENSED, *ODD])] + [(3, LICENSED[3]), (3, "other mit license"), (None, LICENSED[0])]
    got = Counter(tuple(r) for r in S.scan(docs_of(rows)).collect())
    assert got == Counter((d, *scan_brute(t)) for d, t in rows)
    assert S.scan(docs_of([])).count() == 0
    assert len(license_rules.TEXTS) + len(license_rules.names()) > 150


# --- decontamination ---------------------------------------------------------------------------


def overlap_brute(t, items):
    w, out = words((t or "").lower()), {}
    for item_id, item_text in items:
        if item_id is None or item_text is None:
            continue
        item = words(item_text.lower())
        if not item:
            continue
        for first in range(-len(item) + 1, len(w)):
            same = [0 <= first + k < len(w) and w[first + k] == item[k] for k in range(len(item))]
            seeded = len(item) < D.WINDOW or any(all(k + o < len(item) and same[k + o] for o in m) for m in D.MASKS for k in range(len(item)))
            width = min(len(item), D.WINDOW)
            if seeded and max(sum(same[i : i + width]) for i in range(len(item) - width + 1)) >= D.SHARE * width:
                key = (sum(same), -first, -len(item))
                out[item_id] = max(out.get(item_id, key), key)
    return {(i, -k[2], k[0], -k[1]) for i, k in out.items()}


def test_overlaps(spark, docs_of):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(200)] + ["the", "of"] * 40
    phrase = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, phrase(n)) for i, n in enumerate([15, 30, 57, 5, 6, 12, 4, 40, 1, 2, 7, 8, 9, 10, 11, 3])] + [(None, "a b c d e f"), (90, None), (91, ""), (0, phrase(20))]
    rows = [(900, None), (901, ""), (None, items[0][1]), (902, "short")]
    for i in range(140):
        item = rng.choice(items[:16])[1].split()
        for _ in range(rng.randrange(5)):
            item[rng.randrange(len(item))] = rng.choice(vocabulary)
        cut = rng.choice([0, 0, len(item) // 2])
        rows.append((i, f"{phrase(rng.randrange(30))}, {' '.join(item[cut:]).upper()}! {phrase(rng.randrange(30))}"))
    rows.append(rows[-1])
    benchmark = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, doc_id int, seed string")
    docs = docs_of(rows)
    got = {(r.doc_id, r.item_id, r.item_words, r.matched, r.start_word) for r in D.overlaps(docs, benchmark).collect()}
    want = {(d, *x) for d, t in rows for x in overlap_brute(t, items)}
    assert got == want and len({x[0] for x in want}) > 30
    clean = D.clean(docs, benchmark)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for d, t in rows if not overlap_brute(t, items))
    assert D.overlaps(docs_of([]), benchmark).count() == 0 and D.clean(docs, benchmark.limit(0)).count() == len(rows)


# --- HTML --------------------------------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<b>x<br><p>y", "x\n\ny"),
    ("<head><title>t</title></head><body>b", "b"), ("<script>var t='</p>';</script>x<style>p{}</style>", "x"), ("<div hidden>h</div><p style='display: none'>n</p>s", "s"),
    ("<div style='visibility:hidden'>a<span style='visibility:visible'>b</span></div>", "b"), ("<ul><li>one<li>two<ul><li>in</ul></ul>z", "- one\n- two\n  - in\n\nz"),
    ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"), ("<table><tr><td>a<td>long<tr><th>wider<td>b</table>", "a     | long\nwider | b"),
    ("<table><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab |   | c\nd  | e | f"), ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r | 1\n  | 2"),
    ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"), ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"), ("<p>a</p>tail</p>x", "a\n\ntail\n\nx"), ("<details><summary>s</summary>more</details>", "s"),
    ("  lots   of \n space  ", "lots of space"), ("<h1>T</h1>body<hr>end", "T\n\nbody\nend"), ("<td>lost</td> cell", "lost cell"), ("<!-- c --><select><option>1<option>2</select>", "1\n2"), ("<tr><li></ul></table></p><", None),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_visible_text(html, want):
    got = H.visible_text(html)
    assert want is None or got == want


def test_extract(spark):
    deep = "<div>" * 20_000 + "deep" + "<ul><li>" * 3000 + "x"
    rows = [(i, h, "t", 1) for i, (h, _) in enumerate(PAGES)] + [(900, deep, "t", 1), (1, "again", "t", 1), (None, "<p>n", "t", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string, n_lines int")
    got = H.extract(pages).collect()
    assert len(got) == len(rows)
    assert Counter((r.page_id, r.text) for r in got) == Counter((r[0], H.visible_text(r[1])) for r in rows)
    assert all(r.n_lines == (len(r.text.split("\n")) if r.text else 0) for r in got)
    assert H.extract(pages.limit(0)).count() == 0


# --- urls --------------------------------------------------------------------------------------


def rule_brute(host, path):
    fit = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fit, key=len, default=None)


def test_judged(spark):
    urls = [
        None, "", "no scheme", "http://", "http://Ex.COM", "https://A.example.org/es/1?x=/y#z", "http://example.org/en/17", "http://myexample.org/es/2", "http://a.com/de/3", "http://a.com/fr/3?", "x://y://z/q",
        "http://n.net/" + "/".join("abcdefghijklmn"), "http://n.net//double//slash/", "http://n.net/é/ü", "HTTP://ÉN.net/A", "http://example.org?es/", "http://u@h:80/p#a/b", "http://org/", "http://a.example.org/en/1",
    ]
    rows = [(i, u) for i, u in enumerate(urls)] + [(1, "http://twice.net/a"), (1, "http://twice.net/a"), (None, "http://n.net/a")]
    good = [(1000 + i, f"http://h.net/good/{i}") for i in range(60)]
    bad = [(2000 + i, f"http://h.net/bad/{i}/v{i}.html") for i in range(60)]
    names = [(3000 + i, f"http://h.net/users/u{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}/home") for i in range(60)]
    pages = spark.createDataFrame([(*r, "h", "v") for r in rows + good + bad + names], "page_id bigint, url string, host string, verdict string")
    labels = spark.createDataFrame([(i, int(2000 <= i < 3000)) for i, _ in good + bad + names if i % 3] + [(0, 1), (None, 1), (5, None)], "page_id bigint, bad int")
    got = U.judged(pages, labels, RULES).collect()
    assert len(got) == len(rows) + 180
    by_id = defaultdict(list)
    for r in got:
        by_id[r.page_id].append(r)
    for i, u in rows + good + bad + names:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        rule = rule_brute(host, path)
        assert any((r.host, r.path, r.rule) == (host, path, rule) and (rule is None or r.verdict == RULES[rule]) for r in by_id[i]), u
    assert {by_id[i][0].template for i, _ in bad} == {"/bad/<n>/v<n>.html"} and {by_id[i][0].verdict for i, _ in bad} == {"block"}
    assert {by_id[i][0].verdict for i, _ in good + names} == {"allow"}
    assert all(by_id[i][0].template in ("/*/*/home", "/users/*/home") for i, _ in names)
    assert U.judged(pages.limit(0), labels, RULES).count() == 0 and U.judged(pages, labels.limit(0), RULES).where("rule IS NULL AND verdict != 'allow'").count() == 0


def test_pages_that_tell_the_levels_apart(spark):
    """The SQL and the operator on small bad sections, paths that end on others, and deep shared paths."""
    import duckdb
    import pandas as pd
    from demospan.llm import queries, sql

    rng = random.Random(12)
    urls = [f"http://hot.net/{chr(97 + i % 26)}{chr(97 + i // 26)}/{10 * i + k}" for i in range(60) for k in range(10)]
    urls += [f"http://deep.net/{'/'.join('abcdefghijkl'[: rng.randrange(13)])}/{rng.choice(['good', 'bad', 'x'])}/{1000 + i}" for i in range(120)]
    urls += [f"http://chain.net/{'a/' * k}" for k in range(30)] + ["http://one.net/" + "x/" * 400 + f"{1200 + i}" for i in range(2)] + [None, "nothing"]
    pages = pd.DataFrame({"page_id": range(len(urls)), "url": urls})
    bad = [i for i, u in enumerate(urls) if u and ("/cb/" in u or "/bad/" in u)]
    labels = pd.DataFrame([(int(u.rsplit("/", 1)[1]), int(i not in bad)) for i, u in enumerate(urls) if u and u.rsplit("/", 1)[-1].isdigit()], columns=["doc_id", "quality"])
    con = duckdb.connect()
    con.register("pages", pages)
    con.register("labels", labels)
    con.execute(sql.url_filter(queries.RULES))
    names = [d[0] for d in con.description]
    want = {r[0]: dict(zip(names, r)) for r in con.fetchall()}
    p, q = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), spark.createDataFrame(labels)
    got = {r.page_id: r.asDict() for r in U.judged(p, queries.page_labels(p, q), queries.RULES).collect()}
    assert got == want
    assert {got[i]["verdict"] for i in bad if "/cb/" in urls[i]} == {"block"}


def test_long_broken_pages_take_time_in_proportion():
    import time

    at = time.perf_counter()
    assert H.visible_text("<div>" * 80_000 + "x") == "x"
    assert H.visible_text("<p>a<table>" + "<div>" * 40_000 + "x").endswith("x")
    wide = "<table>" + "<tr><td>a<td>b" * 3000 + "<tr><td>" + "long " * 6000 + "<td>end</table>"
    text = H.visible_text(wide)
    assert len(text) < 1_000_000 and "long long" in text and text.splitlines()[-1].endswith(" | end")
    assert time.perf_counter() - at < 20
    assert H.visible_text("<table><tr><td rowspan=3000>a<td>b" + "<tr><td>c" * 1500 + "</table>").splitlines()[1400] == "  | c"
