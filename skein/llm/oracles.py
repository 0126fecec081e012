"""DuckDB SQL of those dedup and decontamination queries that SQL can express, by whole windows and all pairs."""

from __future__ import annotations

SPACE_WORDS = "list_filter(string_split_regex(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
LOWER_A_Z = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = "list_filter(string_split_regex(" + LOWER_A_Z.format(text="coalesce({text}, '')") + ", '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {SPACE_WORDS.format(text=LOWER_A_Z.format(text='text'))} AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
walk AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT walk.a, link.b FROM walk JOIN link ON walk.b = link.a),
least_ AS (SELECT a AS doc_id, min(b) AS component_id FROM walk GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN least_ USING (doc_id)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {SPACE_WORDS.format(text='text')} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS g FROM d, unnest(range(1, len(w) - 33)) AS r(i) WHERE len(w) >= 35),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM hit),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = word.doc_id AND gone.p = word.p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS g FROM d, unnest(range(0, (length(x) // 2 - 99)::BIGINT)) AS r(i) WHERE length(x) >= 200),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
run AS (SELECT doc_id, i, i > coalesce(lag(i) OVER w + 100, -1) AS fresh FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
span AS (
    SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM run) GROUP BY doc_id, k),
cut AS (
    SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM span),
kept AS (
    SELECT doc_id, sum(hi - lo) AS n, count(*) AS spans, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(first(x), 2 * max(hi) + 1) AS t
    FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, x))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP8 = f"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS.format(text='text')} AS w FROM documents),
b AS (SELECT item_id, {ALNUM_WORDS.format(text='text')} AS w FROM benchmark),
g AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
win AS (
    SELECT doc_id, i, k.n, array_to_string(list_slice(w, i, i + k.n - 1), ' ') AS g FROM d, (SELECT DISTINCT n FROM g) AS k, unnest(range(1, len(w) - k.n + 2)) AS r(i) WHERE len(w) >= k.n),
hit AS (SELECT doc_id, i, win.n, item_id FROM win JOIN g ON win.n = g.n AND win.g = g.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS t FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
