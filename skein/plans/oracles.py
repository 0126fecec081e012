"""DuckDB SQL of the registered graph queries."""

from __future__ import annotations

from ..schema import CONFIDENCE_NAMES, SCORES, TRUST
from .queries import BUDGET, DEPTH, QUESTION, WIDE, WIDE_BUDGET, WIDE_DEPTH


def _slug(expression: str) -> str:
    return f"trim(lower(regexp_replace(({expression})::VARCHAR, '[^A-Za-z0-9]+', '_', 'g')), '_')"


def _id(namespace: str, expression: str) -> str:
    return f"('{namespace}::' || {_slug(expression)})"


def _case(expression: str, values) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


TAG = "CASE WHEN l_quantity >= 45 THEN 1 WHEN l_quantity >= 35 THEN 2 WHEN l_quantity >= 25 THEN 3 WHEN l_quantity >= 15 THEN 4 WHEN l_quantity >= 5 THEN 5 ELSE 6 END"
_NAMES = [f"'{n}'" for n in CONFIDENCE_NAMES]
NAT, SUP = _id("nation", "n_name"), _id("supplier", "s_name")

NODES = f"""nodes AS (
    SELECT {_id('region', 'r_name')} AS id, r_name AS label, 'region' AS kind FROM region
    UNION ALL SELECT {NAT}, n_name, 'nation' FROM nation
    UNION ALL SELECT {_id('customer', 'c_name')}, c_name, 'customer' FROM customer
    UNION ALL SELECT {SUP}, s_name, 'supplier' FROM supplier
    UNION ALL SELECT {_id('part', 'p_partkey')}, p_name, 'part' FROM part
    UNION ALL SELECT {_id('order', 'o_orderkey')}, 'Order ' || o_orderkey, 'order' FROM orders)"""
EDGES = f"""edges AS (
    SELECT {NAT} AS source, {_id('region', 'r_name')} AS target, 'in_region' AS relation, 0 AS confidence FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT {_id('customer', 'c_name')}, {NAT}, 'located_in', 0 FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT {SUP}, {NAT}, 'located_in', 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT {_id('customer', 'c_name')}, {_id('order', 'o_orderkey')}, 'placed', 0 FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT DISTINCT {_id('order', 'l_orderkey')}, {_id('part', 'l_partkey')}, 'contains', 0 FROM lineitem
    UNION ALL SELECT {SUP}, {_id('part', 'l_partkey')}, 'supplies', min({TAG}) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
STAR = f"WITH {NODES}, {EDGES}"

TRADES = f"""tn AS (SELECT {NAT} AS id, n_name AS label FROM nation),
    te AS (
        SELECT {_id('nation', 'a.n_name')} AS source, {_id('nation', 'b.n_name')} AS target, 'trades' AS relation, (count(*) % 7)::INT AS confidence
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation AS a ON c_nationkey = a.n_nationkey JOIN nation AS b ON s_nationkey = b.n_nationkey GROUP BY 1, 2)"""

PRODUCT, BRAND = _id("product", "p_name"), _id("brand", "p_brand")
LOG = f"""WITH forgets AS (
        SELECT {BRAND} AS id, max(p_partkey * 4) AS gone FROM part WHERE right(p_brand, 1)::INT % 2 = 1 AND p_partkey % 2 = 1 GROUP BY 1),
    links AS (SELECT p_partkey * 4 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 3 END AS seq, {PRODUCT} AS source, {BRAND} AS target, 'made_by' AS relation, (p_size % 7)::INT AS confidence FROM part),
    events AS (
        SELECT {PRODUCT} AS id, p_partkey * 4 + 2 AS seq, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS label, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END AS kind,
               CASE WHEN p_partkey % 5 = 0 THEN 'part:' || p_partkey END AS source, false AS bare FROM part
        UNION ALL SELECT source, seq, NULL, NULL, NULL, true FROM links UNION ALL SELECT target, seq, NULL, NULL, NULL, true FROM links),
    alive AS (SELECT e.* FROM events AS e LEFT JOIN forgets AS f ON e.id = f.id WHERE gone IS NULL OR seq > gone),
    nodes AS (
        SELECT id, CASE WHEN arg_min(bare, seq) THEN id ELSE coalesce(arg_min(label, seq) FILTER (WHERE label <> ''), '') END AS label,
               coalesce(arg_min(kind, seq) FILTER (WHERE kind <> ''), '') AS kind, arg_min(source, seq) FILTER (WHERE source IS NOT NULL) AS source
        FROM alive GROUP BY id),
    edges AS (
        SELECT source, target, relation, min(confidence) AS confidence, min(seq) AS seq FROM links LEFT JOIN forgets AS s ON source = s.id LEFT JOIN forgets AS t ON target = t.id
        WHERE seq > greatest(coalesce(s.gone, -1), coalesce(t.gone, -1)) GROUP BY 1, 2, 3)"""

DEGREES = """degrees AS (
        SELECT n.id, coalesce(c, 0)::BIGINT AS degree FROM nodes AS n
        LEFT JOIN (SELECT id, count(*) AS c FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id) AS e ON n.id = e.id),
    hub AS (
        SELECT greatest(min(degree) FILTER (WHERE seen > least(n * 99 // 100, n - 1)), 1)::BIGINT AS hub_threshold
        FROM (SELECT degree, sum(count(*)) OVER (ORDER BY degree) AS seen, sum(count(*)) OVER () AS n FROM degrees GROUP BY degree))"""


def _scored(question: str) -> str:
    terms = question.split()
    weights = ", ".join(f"greatest(ln(count(*) / greatest(1, count(*) FILTER (WHERE contains(lower(label), '{t}')))), 0) + 1 AS w{i}" for i, t in enumerate(terms))
    score = " + ".join(f"CASE WHEN lower(label) = '{t}' THEN 3 * w{i} WHEN starts_with(lower(label), '{t}') THEN 2 * w{i} WHEN contains(lower(label), '{t}') THEN w{i} ELSE 0 END" for i, t in enumerate(terms))
    return f"""idf AS (SELECT {weights} FROM nodes),
    scored AS (SELECT id, {score} AS score FROM nodes, idf WHERE {score} > 0),
    top3 AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank, max(score) OVER () AS most FROM scored ORDER BY score DESC, id LIMIT 3),
    seeds AS (SELECT id, score, rank FROM top3 WHERE score >= 0.25 * most)"""


def _reached(depth: int) -> str:
    parts = ["l0 AS (SELECT id, 0 AS depth, rank AS r FROM seeds)", "k0 AS (SELECT * FROM l0)"]
    for d in range(1, depth + 1):
        parts.append(f"""l{d} AS (
            SELECT target AS id, {d} AS depth, row_number() OVER (ORDER BY min(row(r, target))) AS r
            FROM l{d - 1} JOIN degrees USING (id) JOIN edges ON source = l{d - 1}.id
            WHERE degree <= (SELECT hub_threshold FROM hub) AND target NOT IN (SELECT id FROM k{d - 1}) GROUP BY target)""")
        parts.append(f"k{d} AS (SELECT * FROM k{d - 1} UNION ALL SELECT * FROM l{d})")
    return ",\n    ".join([*parts, f"reached AS (SELECT * FROM k{depth})"])


SEEDED = f"{STAR}, {DEGREES}, {_scored(QUESTION)}"


def _found(question: str, depth: int) -> str:
    return f"{STAR}, {DEGREES}, {_scored(question)}, {_reached(depth)}"


def _lines(question: str, depth: int, budget: int) -> str:
    return f"""{_found(question, depth)},
    lines AS (
        SELECT depth, r, 0 AS k, '' AS target, '' AS relation, '[' || CASE WHEN kind = '' THEN 'node' ELSE kind END || '] ' || label || chr(10) AS line FROM reached JOIN nodes USING (id)
        UNION ALL
        SELECT depth, r, 1, e.target, e.relation, '  → ' || e.relation || ' ' || n.label || ' (' || printf('%.2f', {_case('e.confidence', [f'{s}::DOUBLE' for s in SCORES])}) || ')' || chr(10)
        FROM reached JOIN edges AS e ON e.source = reached.id JOIN nodes AS n ON n.id = e.target WHERE e.target IN (SELECT id FROM reached)),
    placed AS (
        SELECT row_number() OVER w - 1 AS "at", k, line, coalesce(sum(octet_length(encode(line))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM lines WINDOW w AS (ORDER BY depth, r, k, target, relation)),
    shown AS (
        SELECT "at"::BIGINT AS "at", line FROM placed WHERE before < {budget}
        UNION ALL SELECT {1 << 62}::BIGINT, '…' || chr(10) FROM placed WHERE k = 0 HAVING max(before) >= {budget})"""

ENVELOPES = f"""env AS (
        SELECT subject_id, ord, 'agent:' || k AS agent, (k + ord) % 7 AS basis, 'parent' || k AS parent_hash, CASE WHEN k % 5 = 4 THEN 'mock-v9' ELSE 'mock-v1' END AS algorithm
        FROM (SELECT {NAT} AS subject_id, n_nationkey AS k, unnest([0, 1]) AS ord FROM nation UNION ALL SELECT {_id('region', 'r_name')}, r_regionkey, 0 FROM region))"""
TRUSTED = f"""ids AS (
        SELECT 'root' AS identity, NULL AS parent, NULL AS scope
        UNION ALL SELECT 'tenant:' || r_regionkey, 'root', {_slug('r_name')} FROM region WHERE r_regionkey <> 3
        UNION ALL SELECT 'agent:' || n_nationkey, 'tenant:' || n_regionkey, NULL FROM nation),
    chain AS (
        SELECT identity, 0 AS depth FROM ids WHERE identity = 'root'
        UNION ALL SELECT ids.identity, chain.depth + 1 FROM ids JOIN chain ON ids.parent = chain.identity)"""


def _le32(expression: str) -> str:
    byte = [f"lpad(to_hex((({expression})::BIGINT >> {s}) & 255), 2, '0')" for s in (0, 8, 16, 24)]
    return "lower(" + " || ".join(byte) + ")"


def _field(expression: str) -> str:
    return f"({_le32(f'octet_length(encode({expression}))')} || lower(hex(encode({expression}))))"


def _checksum(message: str) -> str:
    """Hex of the mock scheme's 64 bits, lowest byte first, over the bytes that `message` gives in hex."""
    bytes_ = f"list_transform(range(length({message}) // 2), lambda i: ('0x' || substr({message}, (2 * i + 1)::BIGINT, 2))::INT::UHUGEINT)"
    total = f"list_reduce(list_prepend(1469598103934665603::UHUGEINT, {bytes_}), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
    return "(" + " || ".join(f"lpad(lower(to_hex((({total}) // {256**k}::UHUGEINT % 256::UHUGEINT)::BIGINT)), 2, '0')" for k in range(8)) + ")"


def _byte(expression: str) -> str:
    return f"lower(lpad(to_hex(({expression})::BIGINT), 2, '0'))"


PAYLOAD = f"{_field('subject_id')} || {_field('agent')} || '01000000' || {_byte('basis')} || {_field('parent_hash')} || {_field('algorithm')}"
SIGNED = f"""WITH {ENVELOPES}, paid AS (SELECT *, split_part(agent, ':', 2)::INT AS k, lower(hex(encode(agent))) || {PAYLOAD} AS message FROM env),
    signed AS (SELECT *, CASE WHEN k % 6 = 5 THEN NULL WHEN k % 4 = 3 THEN lower(hex(encode('spoilt!!'))) ELSE {_checksum('message')} END AS signature FROM paid)"""
VERDICT = "CASE WHEN algorithm <> 'mock-v1' THEN 'UnknownAlgorithm' WHEN signature IS NULL THEN 'NoAttestations' WHEN k % 4 = 3 THEN 'BadSignature' ELSE 'Valid' END"
INTERNED = f"""ix AS (
        SELECT {NAT} AS node_id, row_number() OVER (ORDER BY n_nationkey, {NAT}) - 1 AS u64 FROM nation
        UNION ALL SELECT {SUP}, (SELECT count(*) FROM nation) + row_number() OVER (ORDER BY s_suppkey % 4, {SUP}) - 1 FROM supplier)"""

WEIGHTS = f"""{TRADES},
    lw AS (SELECT least(source, target) AS a, greatest(source, target) AS b, sum(({_case('confidence', [f'{s}::DOUBLE' for s in SCORES])})::FLOAT::DOUBLE) AS weight FROM te WHERE source <> target GROUP BY 1, 2)"""

ENTRIES = f"""WITH {WEIGHTS}, ld AS (SELECT id, sum(weight) AS d FROM (SELECT a AS id, weight FROM lw UNION ALL SELECT b, weight FROM lw) GROUP BY id),
            off AS (SELECT a, b, round(-weight / sqrt(x.d * y.d), 6) AS value FROM lw JOIN ld AS x ON a = x.id JOIN ld AS y ON b = y.id)
            SELECT id AS a, id AS b, 1.0::DOUBLE AS value FROM tn UNION ALL SELECT a, b, value FROM off UNION ALL SELECT b, a, value FROM off"""


def oracle_sql() -> dict[str, str]:
    return {
        "canonical_ids": f"SELECT c_custkey, {_id('customer', 'c_name')} AS id FROM customer",
        "product_collisions": f"SELECT {PRODUCT} AS id, count(*) AS parts FROM part GROUP BY 1 HAVING count(*) > 1",
        "confidence_rubric": f"""SELECT tag::INT AS tag, count(*) AS lines, {_case('tag', _NAMES)} AS name, round({_case('tag', [f'{s}::DOUBLE' for s in SCORES])}, 6) AS score,
            ({_case('tag', TRUST)})::INT AS trust, printf('%.2f', {_case('tag', [f'{s}::DOUBLE' for s in SCORES])}) AS shown FROM (SELECT {TAG} AS tag FROM lineitem) GROUP BY tag""",
        "trust_levels": f"{STAR} SELECT source, min({_case('confidence', TRUST)})::INT AS least, max({_case('confidence', TRUST)})::INT AS most, count(*) AS edges FROM edges WHERE relation = 'supplies' GROUP BY source",
        "tokenize_labels": f"""{STAR}, split AS (SELECT id, list_filter(string_split_regex(lower(label), '[^\\p{{L}}\\p{{N}}]+'), lambda t: octet_length(encode(t)) > 1) AS t FROM nodes)
            SELECT id, unnest(range(len(t)))::BIGINT AS at, unnest(t) AS token FROM split""",
        "node_upsert": f"{LOG} SELECT id, label, kind, source FROM nodes",
        "edge_upsert": f"{LOG} SELECT source, target, relation, confidence, seq::BIGINT AS seq FROM edges",
        "auto_endpoints": f"{LOG} SELECT id FROM nodes WHERE label = id AND kind = ''",
        "graph_merge": f"{STAR} SELECT id, CASE WHEN kind = 'nation' AND right(id, 1)::INT % 2 = 0 THEN 'first ' || label ELSE label END AS label, kind FROM nodes",
        "graph_merge_edges": f"{STAR}, {TRADES} SELECT relation, count(*) AS edges, min(confidence)::INT AS least FROM (SELECT relation, confidence FROM edges UNION ALL SELECT relation, confidence FROM te) GROUP BY relation",
        "forget_node": f"""{STAR}, gone AS (SELECT {SUP} AS id FROM supplier WHERE s_suppkey % 3 = 0)
            SELECT id, kind FROM nodes WHERE id NOT IN (SELECT id FROM gone)
            UNION ALL SELECT source || ' ' || target, relation FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)""",
        "node_by_id": f"{STAR} SELECT id, label, kind, NULL::VARCHAR AS source FROM nodes WHERE id = 'nation::nation_3'",
        "neighbors": f"{STAR} SELECT source, target, relation, confidence::INT AS confidence FROM edges WHERE source = 'supplier::supplier_000000001'",
        "node_kinds": f"{STAR} SELECT kind, count(*) AS nodes FROM nodes GROUP BY kind",
        "node_count": f"{STAR} SELECT count(*) AS node_count FROM nodes",
        "node_ids": f"{STAR} SELECT id FROM nodes",
        "fact_view": f"""{STAR}, {ENVELOPES} SELECT n.id, n.label, coalesce(c, 0)::BIGINT AS n_edges, t AS first_target, coalesce(p, 0)::BIGINT AS n_envelopes FROM nodes AS n
            LEFT JOIN (SELECT source, count(*) AS c, min(target) AS t FROM edges GROUP BY source) AS e ON n.id = e.source
            LEFT JOIN (SELECT subject_id, count(*) AS p FROM env GROUP BY 1) AS v ON n.id = v.subject_id""",
        "degree": f"{STAR}, {DEGREES} SELECT id, degree FROM degrees",
        "hub_threshold": f"{STAR}, {DEGREES} SELECT hub_threshold FROM hub",
        "seed_scores": f"{SEEDED} SELECT id, round(score, 6) AS score FROM scored",
        "seed_topk": f"{SEEDED} SELECT id, round(score, 6) AS score, rank::BIGINT AS rank FROM seeds",
        "bfs_reach": f"{_found(WIDE, WIDE_DEPTH)} SELECT id, depth::INT AS depth FROM reached",
        "render_lines": f'{_lines(QUESTION, DEPTH, BUDGET)} SELECT "at", line FROM shown',
        "query_text": f"""{_lines(WIDE, WIDE_DEPTH, WIDE_BUDGET)} SELECT string_agg(line, '' ORDER BY "at") AS text FROM shown""",
        "shortest_path": f"""WITH RECURSIVE c AS (SELECT conv_id, turn FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)),
            walk AS (SELECT turn, 0 AS n FROM c WHERE turn = (SELECT min(turn) FROM c) UNION SELECT c.turn, walk.n + 1 FROM walk JOIN c ON c.turn = walk.turn + 1)
            SELECT n::BIGINT AS "at", {_id('turn', "(SELECT min(conv_id) FROM c) || ' ' || turn")} AS id FROM walk""",
        "propagate_trust": f"""{STAR}, own AS (SELECT id, kind, CASE WHEN kind = 'customer' THEN right(label, 2)::INT ELSE 100 END AS v FROM nodes),
            placed AS (SELECT target AS id, min(v) AS v FROM edges JOIN own ON source = id WHERE relation = 'placed' GROUP BY 1),
            held AS (SELECT target AS id, min(v) AS v FROM edges JOIN placed ON source = id WHERE relation = 'contains' GROUP BY 1)
            SELECT own.id, least(own.v, coalesce(placed.v, 100), coalesce(held.v, 100))::INT AS value FROM own LEFT JOIN placed ON own.id = placed.id LEFT JOIN held ON own.id = held.id""",
        "index_intern": f"WITH {INTERNED} SELECT u64::BIGINT AS u64, node_id, 'live' AS state FROM ix",
        "index_tombstone": f"""WITH {INTERNED}, k AS (SELECT {NAT} AS node_id, n_nationkey AS k FROM nation),
            dead AS (SELECT node_id, row_number() OVER (ORDER BY 100 - k) - 1 AS died FROM k WHERE k % 4 = 0)
            SELECT u64::BIGINT AS u64, ix.node_id, CASE WHEN died IS NULL THEN 'live' ELSE 'tombstoned' END AS state, died::BIGINT AS died_seq FROM ix LEFT JOIN dead ON ix.node_id = dead.node_id
            UNION ALL SELECT (SELECT count(*) FROM ix) + row_number() OVER (ORDER BY k, node_id) - 1, node_id, 'live', NULL FROM k WHERE k % 8 = 0""",
        "index_resolve": f"""WITH RECURSIVE {INTERNED},
            step AS (SELECT a.u64, b.u64 AS into_u64 FROM nation JOIN ix AS a ON a.node_id = 'nation::nation_' || n_nationkey JOIN ix AS b ON b.node_id = 'nation::nation_' || (n_nationkey + 1) WHERE n_nationkey % 5 < 4 AND n_nationkey < 24),
            walk AS (SELECT u64, u64 AS last, 0 AS n FROM ix UNION ALL SELECT walk.u64, into_u64, n + 1 FROM walk JOIN step ON walk.last = step.u64)
            SELECT u64::BIGINT AS u64, arg_max(last, n)::BIGINT AS resolved FROM walk GROUP BY u64""",
        "index_counts": f"WITH {INTERNED} SELECT count(*) AS live_count, (max(u64) + 1)::BIGINT AS capacity FROM ix",
        "signed_payload": f"WITH {ENVELOPES} SELECT subject_id, ord::BIGINT AS ord, {_field('subject_id')} || {_field('agent')} || '01000000' || {_byte('basis')} || {_field('parent_hash')} || {_field('algorithm')} AS payload FROM env",
        "provenance_counts": f"WITH {ENVELOPES} SELECT subject_id, count(*) AS envelopes FROM env GROUP BY 1",
        "trust_chain": f"WITH RECURSIVE {TRUSTED} SELECT identity, depth::INT AS depth FROM chain",
        "is_authorized": f"""WITH RECURSIVE {TRUSTED} SELECT ids.identity, coalesce(ids.scope, p.scope) AS namespace FROM ids JOIN chain ON ids.identity = chain.identity
            LEFT JOIN ids AS p ON ids.parent = p.identity WHERE coalesce(ids.scope, p.scope) IS NOT NULL""",
        "verify_mock": f"""{SIGNED} SELECT subject_id, ord::BIGINT AS ord, {VERDICT} AS outcome, signature FROM signed""",
        "verify_authorized": f"""{SIGNED} SELECT subject_id, ord::BIGINT AS ord, agent AS asserting_agent, CASE WHEN {VERDICT} <> 'Valid' THEN {VERDICT} WHEN k = 2 THEN 'Authorized' ELSE 'Unauthorized' END AS outcome FROM signed""",
        "trust_store": f"""WITH t AS (
                SELECT 'root' AS identity, 'root key' AS k, NULL AS parent, NULL AS scope
                UNION ALL SELECT 'tenant:' || r_regionkey, 'key ' || r_regionkey, 'root', ['africa', 'america', 'asia', NULL, 'middle_east'][r_regionkey + 1] FROM region WHERE r_regionkey <> 3
                UNION ALL SELECT 'agent:' || r_regionkey, 'agent key ' || r_regionkey, 'tenant:' || r_regionkey, NULL FROM region)
            SELECT identity, 'mock-v1' AS algorithm, lower(hex(encode(k))) AS public_key, parent, scope, CASE WHEN identity IN ('root', 'tenant:0', 'agent:3') THEN lower(hex(encode(k))) END AS asked FROM t
            UNION ALL SELECT 'tenant:3', NULL, NULL, NULL, NULL, NULL""",
        "provenance_lookup": f"""WITH {ENVELOPES} SELECT 'nation::nation_3' AS what, unnest([0, 1, 2])::BIGINT AS n
            UNION ALL SELECT 'all', count(*) + count(*) FILTER (WHERE ord = 0) FROM env UNION ALL SELECT 'none', 0""",
        "index_lookup": f"""WITH {INTERNED}, k AS (SELECT {NAT} AS node_id FROM nation WHERE n_nationkey % 4 = 0)
            SELECT u64::BIGINT AS u64, ix.node_id AS own, CASE WHEN k.node_id IS NULL THEN ix.node_id END AS node_id, k.node_id IS NOT NULL AS dead, CASE WHEN k.node_id IS NULL THEN u64 END::BIGINT AS found
            FROM ix LEFT JOIN k ON ix.node_id = k.node_id UNION ALL SELECT count(*), 'nobody', NULL, false, NULL FROM ix""",
        "trust_version": "SELECT 1 AS version",
        "artifact_envelope_rows": f"""{SIGNED} SELECT subject_id, ord::BIGINT AS ord, {_field('subject_id')} || {_field('agent')} || {_byte('basis')} || {_field('parent_hash')} || {_field('algorithm')}
            || CASE WHEN signature IS NULL THEN '00000000' ELSE '01000000' || {_field('agent')} || {_field("'agent-signs-action'")} || '08000000' || signature END AS record FROM signed""",
        "fiedler": f"WITH {TRADES} SELECT id, 0.0::DOUBLE AS residual FROM tn",
        "artifact_node_rows": f"{STAR} SELECT id, {_field('id')} || {_field('label')} || {_field('kind')} || '00' AS record FROM nodes",
        "artifact_edge_rows": f"{STAR} SELECT source, target, relation, {_field('source')} || {_field('target')} || {_field('relation')} || {_byte('confidence')} AS record FROM edges",
        "artifact_roundtrip": f"WITH {TRADES} SELECT source, target, relation, confidence FROM te",
        "laplacian_weights": f"WITH {WEIGHTS} SELECT a, b, round(weight, 6) AS weight FROM lw",
        "laplacian_entries": ENTRIES,
        "embedding": ENTRIES,
    }
