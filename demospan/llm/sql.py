"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import decontaminate as D, url_filter as U

WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def exact_dedup() -> str:
    return r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t, doc_id) AS nth FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size,
  doc_id IS NOT DISTINCT FROM keep_id AND nth = 1 AS kept, sha256(t) AS text_sha256 FROM g"""


def decontamination() -> str:
    def seeds(name: str) -> str:
        parts = []
        short: dict[int, list[str]] = {}
        for n in range(1, D.WINDOW):
            short.setdefault(D.run_of(n, D.WINDOW, D.SHARE), []).append(str(n))
        masks = [(number, mask, "") for number, mask in enumerate(D.MASKS)]
        # words in succession for short items alone, and in the documents only if there are any
        for r, lengths in short.items():
            some = f"len(w) IN ({', '.join(lengths)})"
            masks.append((D.RUN + r, range(r), f" AND {some}" if name == "b" else f" AND EXISTS (SELECT 1 FROM b WHERE {some.replace('len(w)', 'len(b.w)')})"))
        for number, mask, only in masks:
            seed = " || ' ' || ".join(f"w[i + {o}]" for o in mask)
            parts.append(f"SELECT id, i, {number} AS mask, {seed} AS seed FROM {name}_at WHERE i + {mask[-1]} <= len(w){only}")
        return " UNION ALL ".join(parts)

    def words(table: str, key: str) -> str:
        return f"""SELECT {key} AS id, string_split(trim(regexp_replace(lower(text), '{WORD_BREAKS}', ' ', 'g')), ' ') AS w
  FROM {table} WHERE text IS NOT NULL AND trim(regexp_replace(lower(text), '{WORD_BREAKS}', ' ', 'g')) <> ''"""

    return f"""
WITH d AS ({words("documents", "doc_id")}), b AS ({words("benchmark", "item_id")}),
d_at AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
b_at AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM b),
d_seed AS ({seeds("d")}), b_seed AS ({seeds("b")}),
diagonals AS (SELECT DISTINCT d_seed.id AS doc_id, b_seed.id AS item_id, d_seed.i - b_seed.i AS first
  FROM d_seed JOIN b_seed USING (mask, seed)),
laid AS (SELECT x.doc_id, x.item_id, first, b.w AS item, d.w AS words FROM diagonals x
  JOIN d ON d.id = x.doc_id JOIN b ON b.id = x.item_id),
places AS (SELECT doc_id, item_id, first, len(item) AS n, least(len(item), {D.WINDOW}) AS width,
  unnest(range(1, len(item) + 1)) AS k, item, words FROM laid),
agree AS (SELECT doc_id, item_id, first, n, width, k,
  CASE WHEN first + k >= 1 AND first + k <= len(words) AND words[first + k] = item[k] THEN 1 ELSE 0 END AS same FROM places),
runs AS (SELECT *, sum(same) OVER (PARTITION BY doc_id, item_id, first ORDER BY k) AS upto FROM agree),
windows AS (SELECT r.doc_id, r.item_id, r.first, r.n, max(r.upto - coalesce(p.upto, 0)) AS best, any_value(r.width) AS width,
    max(r.upto) AS matched
  FROM runs r LEFT JOIN runs p ON p.doc_id = r.doc_id AND p.item_id = r.item_id AND p.first = r.first AND p.k = r.k - r.width
  WHERE r.k >= r.width GROUP BY r.doc_id, r.item_id, r.first, r.n),
totals AS (SELECT doc_id, item_id, first, CAST(sum(same) AS BIGINT) AS matched FROM agree GROUP BY ALL)
SELECT w.doc_id, w.item_id, CAST(w.n AS BIGINT) AS item_words, t.matched, CAST(w.first AS BIGINT) AS start_word
FROM windows w JOIN totals t USING (doc_id, item_id, first)
WHERE w.best >= {D.SHARE} * w.width
QUALIFY row_number() OVER (PARTITION BY w.doc_id, w.item_id ORDER BY t.matched DESC, w.first, w.n) = 1"""


def url_filter(rules: dict[str, str]) -> str:
    chosen = "CASE " + " ".join(
        "WHEN (host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}') THEN '{2}'".format(*r.split("/", 1), r)
        for r in sorted(rules, key=lambda r: (-len(r), r))
    ) + " END"
    ruled = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules.items()) + " END"
    m = f"CAST({U.SMOOTHING} AS DOUBLE)"
    return rf"""
WITH RECURSIVE parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rows_ AS (SELECT *, list_filter(string_split(regexp_replace(path, '[0-9]+', '<n>', 'g'), '/'), lambda s: s <> '') AS segs,
  try_cast(nullif(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1), '') AS BIGINT) AS shown FROM parts),
marks AS (SELECT page_id, count(*) AS labelled, sum(1 - quality) AS bad
  FROM (SELECT DISTINCT page_id, shown FROM rows_) JOIN labels ON shown = labels.doc_id WHERE quality IS NOT NULL GROUP BY ALL),
start AS (SELECT host, segs, CAST(count(*) AS BIGINT) AS pages, CAST(coalesce(sum(labelled), 0) AS BIGINT) AS labelled, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad
  FROM rows_ LEFT JOIN marks USING (page_id) GROUP BY host, segs),
levels AS (SELECT host, segs, pages, labelled, bad, '' AS template, 0 AS level FROM start
  UNION ALL
  SELECT host, segs, pages, labelled, bad, template || '/' || CASE WHEN few = many
      OR ((in_labelled >= {U.EVIDENCE} OR in_pages * {U.RARE} >= all_pages)
        AND (b * og - g * ob) * (b * og - g * ob) * n > (b + g) * (ob + og) * (b + ob) * (g + og) * CAST({U.DIFFERS} AS DOUBLE))
    THEN seg ELSE '{U.ANY}' END, level + 1
  FROM (SELECT *, CAST(in_bad AS DOUBLE) AS b, CAST(in_labelled - in_bad AS DOUBLE) AS g, CAST(all_bad - in_bad AS DOUBLE) AS ob,
      CAST(all_labelled - all_bad AS DOUBLE) - CAST(in_labelled - in_bad AS DOUBLE) AS og, CAST(all_labelled AS DOUBLE) AS n
    FROM (SELECT *, segs[level + 1] AS seg, min(segs[level + 1]) OVER node AS few, max(segs[level + 1]) OVER node AS many,
        sum(pages) OVER node AS all_pages, sum(labelled) OVER node AS all_labelled, sum(bad) OVER node AS all_bad,
        sum(pages) OVER branch AS in_pages, sum(labelled) OVER branch AS in_labelled, sum(bad) OVER branch AS in_bad
      FROM levels WHERE len(segs) > level
      WINDOW node AS (PARTITION BY host, template), branch AS (PARTITION BY host, template, segs[level + 1])))),
tree AS (SELECT * FROM levels WHERE level = len(segs)),
hosts AS (SELECT host, sum(labelled) AS hn, sum(bad) AS hb FROM tree GROUP BY host),
overall AS (SELECT CASE WHEN sum(hn) > 0 THEN CAST(sum(hb) AS DOUBLE) / CAST(sum(hn) AS DOUBLE) ELSE 0 END AS o FROM hosts),
stats AS (SELECT host, template, (CAST(sum(bad) AS DOUBLE) + {m} * ((CAST(any_value(hb) AS DOUBLE) + {m} * any_value(o)) / (CAST(any_value(hn) AS DOUBLE) + {m})))
    / (CAST(sum(labelled) AS DOUBLE) + {m}) AS bad_share
  FROM tree JOIN hosts USING (host), overall GROUP BY host, template),
judged AS (SELECT page_id, host, path, {chosen} AS rule, template, bad_share FROM rows_ JOIN tree USING (host, segs) JOIN stats USING (host, template))
SELECT page_id, host, path, rule, coalesce({ruled}, CASE WHEN bad_share > {U.REJECT_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict,
  template, bad_share FROM judged"""


def crc32(text: str) -> str:
    """CTEs ``crc_step`` and ``crc(s, v)``: the unsigned crc32 of each ASCII text ``s`` that the query ``text`` gives."""
    return f"""crc_step AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i)) AS steps),
crc AS (SELECT s, xor(list_reduce(list_transform(string_split(s, ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS v
  FROM (SELECT DISTINCT s FROM ({text})), crc_step)"""


def conversation_trie() -> str:
    return f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, strlen(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
{crc32("SELECT CAST(conv_id AS VARCHAR) AS s FROM t")},
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS first, v % 9 AS h FROM t JOIN crc ON s = CAST(conv_id AS VARCHAR)),
mixed AS (SELECT c.conv_id, 0 AS own, pos, id, size FROM c JOIN t ON t.conv_id = c.first AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, id, size FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h),
turns AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(id, '') OVER w AS path, size FROM mixed WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)),
members AS (SELECT conv_id, depth, path, size FROM turns UNION ALL SELECT conv_id, 0, '', 0 FROM c),
lasts AS (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id),
nodes AS (SELECT path, any_value(m.depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (m.depth = l.depth), '')) AS ends_sha256
  FROM members m JOIN lasts l USING (conv_id) GROUP BY path),
children AS (SELECT left(path, (depth - 1) * 64) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
below AS (SELECT DISTINCT a.path, b.path AS lower FROM members a JOIN members b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (SELECT b.path, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((k.n_convs - 1) * k.size) AS saved_tokens
  FROM below b JOIN known k ON k.path = b.lower GROUP BY b.path)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM known k JOIN sums USING (path) LEFT JOIN known p ON k.depth > 0 AND p.path = left(k.path, (k.depth - 1) * 64)"""


def conversation_repair() -> str:
    white = "[^\\x20\\x09-\\x0D]"
    value = "printf('%012d', CAST(left({v}, 12) AS BIGINT) + {cost}) || substr({v}, 13) || {more}"
    return f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
{crc32("SELECT s FROM raw")},
faulty AS (SELECT raw.*, v % 20 AS fault FROM raw JOIN crc USING (s) WHERE v % 20 <> 0 AND conv_id IS NOT NULL),
hurt AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM faulty),
placed AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM hurt),
judged AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair,
    CASE WHEN NOT regexp_matches(text, '{white}') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
inserts AS (SELECT * FROM (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2), (3, 2, 3)) x(p, times, q)),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS p, printf('%012d', 0) AS v FROM sums
  UNION ALL
  SELECT conv_id, k, p, min(v) AS v FROM (
    SELECT b.conv_id, b.k + 1 AS k, move.q AS p, {value.format(v="b.v", cost="5 * i.times + move.cost", more="repeat('I', i.times) || move.letter")} AS v
    FROM best b JOIN inserts i ON i.p = b.p JOIN judged j ON j.conv_id = b.conv_id AND j.k = b.k + 1,
      LATERAL (SELECT unnest([
        {{'letter': 'D', 'cost': 2, 'q': i.q, 'may': true}},
        {{'letter': 'R', 'cost': 1 + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'q': CASE WHEN i.q = 2 THEN 3 ELSE 2 END, 'may': fault NOT IN ('blank', 'duplicate')}},
        {{'letter': 'K', 'cost': CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'q': CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END,
          'may': fault NOT IN ('blank', 'duplicate') AND ((initial = 's' AND i.q = 0) OR (initial = 'u' AND i.q <> 2) OR (initial = 'a' AND i.q = 2))}}]) AS move)
    WHERE move.may) GROUP BY conv_id, k, p),
goals AS (SELECT s.conv_id, min({value.format(v="b.v", cost="5 * i.times", more="repeat('I', i.times)")}) AS v
  FROM sums s JOIN best b ON b.conv_id = s.conv_id AND b.k = s.n JOIN inserts i ON i.p = b.p WHERE i.q IN (0, 3) GROUP BY s.conv_id),
audits AS (SELECT conv_id, CAST(left(v, 12) AS BIGINT) AS cost, substr(v, 13) AS audit FROM goals),
steps AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS e, audit FROM audits),
done AS (SELECT conv_id, e, substr(audit, e, 1) AS edit, length(replace(left(audit, e), 'I', '')) AS k,
    length(replace(left(audit, e), 'D', '')) AS spoken FROM steps),
told AS (SELECT d.*, j.role, j.text, max(CASE WHEN spoken = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY d.conv_id) AS opened
  FROM done d LEFT JOIN judged j ON j.conv_id = d.conv_id AND j.k = d.k AND d.edit <> 'I'),
lines AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (spoken - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY e)) AS sha FROM told WHERE edit <> 'D' GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) c LEFT JOIN sums USING (conv_id) LEFT JOIN audits USING (conv_id) LEFT JOIN lines USING (conv_id)"""
