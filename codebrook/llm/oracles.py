"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from math import ceil

from . import license_scan, url_filter

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_sql(percent: int = 80) -> str:
    rows = []
    for k, ((label, text), length) in enumerate(zip(license_scan.TEMPLATES, license_scan.run_lengths(license_scan.TEMPLATES, percent))):
        own = license_scan.template_words(text)
        rows.append(f"({k}, {_text(label)}, [{', '.join(map(_text, own))}], {ceil(percent * len(own) / 100)}, {length})")
    places = "\nUNION ALL\n".join(
        f"SELECT r, doc_id, {_text(label)} AS label, unnest(list_filter(range(0, len(w)), lambda i: " + " AND ".join(f"coalesce(w[i + {j + 1}] = {_text(x)}, false)" for j, x in enumerate(phrase.split())) + ")) AS place FROM d WHERE contains(low, 'license')"
        for phrase, label in license_scan.PHRASES
    )
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
WITH d AS (
  SELECT *, regexp_extract_all(low, {word}) AS w
  FROM (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS low FROM documents)
), templates(id, label, words, required, length) AS (VALUES {", ".join(rows)}),
places AS ({places}),
base AS (SELECT r, count(*) AS n, min(place) AS a, max(place) AS b, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY r),
whole AS (SELECT r, low, w, label, words, required, length FROM d JOIN templates ON len(list_intersect(list_distinct(w), words)) >= required),
lines AS (SELECT r, label, words, required, regexp_extract_all(unnest(string_split(low, chr(10))), {word}) AS w FROM whole),
runs AS (SELECT r, label, words, required, length, w, unnest(range(1, len(w) + 1)) AS i FROM whole),
pairs AS (
  SELECT r, label, len(list_intersect(list_distinct(w), words)) AS overlap, len(words) AS size, required FROM lines
  UNION ALL SELECT r, label, len(list_intersect(list_distinct(w[i : i + length - 1]), words)), len(words), required FROM runs
), found AS (SELECT r, list(label) AS labels, max(overlap / size) AS best FROM pairs WHERE overlap >= required GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word,
  array_to_string(coalesce(base.labels, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN found USING (r)"""


def url_sql() -> str:
    values = lambda rows: ", ".join(f"({', '.join(map(_text, r))})" for r in rows)
    given, words = (", ".join(map(_text, x)) for x in (url_filter.BLOCKED_HOSTS, url_filter.BLOCKED_WORDS))
    canonical = lambda of: f"regexp_replace({of}, '^.*@|:[0-9]*$|\\.$', '', 'g')"
    pattern = r"'^.*?://([^/?#]*)([^?#]*)'"
    best = lambda what, rules, host, path: f"(SELECT {what} FROM {rules} r WHERE ({host} = r.host OR ends_with({host}, '.' || r.host)) AND starts_with({path}, r.path) ORDER BY length(r.host || r.path) DESC, length(r.host) DESC LIMIT 1)"
    return f"""
WITH rules(host, path, verdict) AS (VALUES {values(url_filter.RULES)}),
p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, {pattern}, 1, 's'), ''), '{_UP}', '{_LOW}') AS host, coalesce(regexp_extract(url, {pattern}, 2, 's'), '') AS path
  FROM pages
), hosts AS (SELECT DISTINCT {canonical("host")} AS host FROM p), others AS (
  SELECT host, '/' AS path, 'block' AS verdict FROM hosts WHERE list_has_any(regexp_split_to_array(host, '[.-]'), [{words}])
  UNION SELECT unnest([{given}]), '/', 'block'
)
SELECT page_id, host, path, {best("r.host || r.path", "rules", "p.host", "p.path")} AS rule,
  coalesce({best("r.verdict", "rules", "p.host", "p.path")}, {best("r.verdict", "others", canonical("p.host"), "CASE WHEN p.path = '' THEN '/' ELSE p.path END")}, 'allow') AS verdict
FROM p"""


def jaccard_sql() -> str:
    """All pairs that share a shingle, then the closure of the links; for small tables."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle
  FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS doc, doc_id AS root FROM n UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc),
c AS (SELECT doc, min(root) AS component_id FROM r GROUP BY doc)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.doc = doc_id"""


def search_sql(best: int = 10) -> str:
    terms = lambda: f"regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms()} AS w FROM documents WHERE text IS NOT NULL),
own AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM d WHERE len(w) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM own),
tf AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS term FROM own) GROUP BY r, term),
items AS (SELECT row_number() OVER () AS q, item_id, list_distinct({terms()}) AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
item_terms AS (SELECT q, unnest(w) AS term FROM items),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM item_terms) GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, totals),
scores AS (
  SELECT q, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // all_terms)))) AS BIGINT) AS score
  FROM item_terms JOIN weights USING (term) JOIN tf USING (term) JOIN (SELECT r, n FROM own) USING (r), totals GROUP BY q, r
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank, doc_id, score
  FROM scores JOIN (SELECT r, doc_id FROM own) USING (r) JOIN (SELECT q, item_id FROM items) USING (q) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {best}"""


def trie_sql() -> str:
    """Sums over subtrees as sums over members: each row of a conversation that isn't its node's smallest member's saves its text."""
    step = "xor(crc >> 1, 3988292384 * (crc & 1))"
    return f"""
WITH bits AS (SELECT i AS byte, list_reduce(list_prepend(i::BIGINT, range(8)), lambda crc, k: {step}) AS v FROM (SELECT unnest(range(256)) AS i)),
crc_table AS (SELECT list(v ORDER BY byte) AS t FROM bits),
turns AS (
  SELECT conv_id, [coalesce(role, ''), coalesce(text, '')] AS t, strlen(coalesce(text, '')) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1]))) % 9 AS h, n
  FROM (SELECT conv_id, max(place) AS n FROM turns GROUP BY conv_id), crc_table
), conv AS (SELECT i.conv_id, i.base, i.h, least(i.h, coalesce(b.n, 0)) AS used, least(i.h, coalesce(b.n, 0)) + greatest(i.n - i.h, 0) AS length FROM ids i LEFT JOIN ids b ON b.conv_id = i.base),
steps AS (
  SELECT c.conv_id, t.place AS depth, t.t, t.size FROM conv c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL SELECT c.conv_id, t.place - c.h + c.used, t.t, t.size FROM conv c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
), paths AS (SELECT conv_id, depth, size, list(t) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM steps
  UNION ALL SELECT conv_id, 0, 0, [] FROM conv),
own AS (SELECT p.*, length, count(*) OVER w AS members, min(p.conv_id) OVER w AS first FROM paths p JOIN conv USING (conv_id) WINDOW w AS (PARTITION BY path)),
leads AS (SELECT path, max(length) AS longest FROM own GROUP BY path),
marked AS (
  SELECT o.*, sum(CASE WHEN o.conv_id = first THEN 0 ELSE size END) OVER (PARTITION BY o.conv_id ORDER BY depth DESC) AS saved,
    max(CASE WHEN o.conv_id = first AND longest = depth THEN 1 ELSE 0 END) OVER (PARTITION BY o.conv_id) AS leaf,
    lag(first) OVER (PARTITION BY o.conv_id ORDER BY depth) AS parent
  FROM own o JOIN leads USING (path)
), kids AS (SELECT path[1 : len(path) - 1] AS path, count(DISTINCT path) AS n FROM own WHERE depth > 0 GROUP BY 1)
SELECT min(conv_id) AS conv_id, depth, min(parent) AS parent_conv_id, count(*) AS n_convs, coalesce(min(k.n), 0) AS n_children,
  CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens,
  sha256(coalesce(string_agg(CASE WHEN depth = length THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
FROM marked LEFT JOIN kids k USING (path) GROUP BY path, depth"""
