"""DuckDB equivalents of the queries that SQL can express. They assume distinct ids, as the test tables have."""

from __future__ import annotations

from panelforge.llm.chat import ORACLE as CHAT
from panelforge.llm.collocations import ORACLE as PHRASES
from panelforge.llm.digest import BODY_BOUND, BUCKETS, LENGTH_BASE, LENGTH_BOUND, LENGTH_SHARE
from panelforge.llm.mixing import ORACLE as MIX
from panelforge.llm.spelling import ORACLE as SPELLING

_QUARTILES = ", ".join(f"s[{BUCKETS * k // 4}] AS b{k}" for k in (1, 2, 3))

#: Bytes are numbered rows; a triplet is a byte and the ones four and eight after it, zero beyond the end.
DIGEST = f"""WITH o AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS q, count(*) OVER () AS total FROM documents),
x AS (SELECT a.doc_id, a.q, b.q AS nq, a.n, a.t, substr(a.t, 1, a.n - a.n // 3) || substr(b.t, 1, a.n // 3) AS e FROM o a JOIN o b ON b.q = a.q % a.total + 1),
v AS (SELECT q, 0 AS k, encode(t) AS c FROM x UNION ALL SELECT q, 1, encode(e) FROM x),
y AS (SELECT q, k, unnest(regexp_extract_all(hex(c), '..')) AS two, unnest(range(0, octet_length(c))) AS i FROM v),
z AS (SELECT q, k, i, ('0x' || two)::BIGINT AS b FROM y),
w AS (SELECT q, k, b + 256 * coalesce(lead(b, 4) OVER (PARTITION BY q, k ORDER BY i), 0) + 65536 * coalesce(lead(b, 8) OVER (PARTITION BY q, k ORDER BY i), 0) AS m FROM z),
h1 AS (SELECT q, k, (m * {0x9E3779B1}) & {0xFFFFFFFF} AS m FROM w),
h2 AS (SELECT q, k, (xor(m, m >> 15) * {0x2C1B3C6D}) & {0xFFFFFFFF} AS m FROM h1),
f AS (SELECT q, k, (m >> 13) & {BUCKETS - 1} AS bucket, count(*) AS n FROM h2 GROUP BY ALL),
g AS (SELECT v.q, v.k, octet_length(v.c) AS size, r.bucket, coalesce(f.n, 0) AS n FROM v CROSS JOIN (SELECT unnest(range(0, {BUCKETS})) AS bucket) r LEFT JOIN f ON f.q = v.q AND f.k = v.k AND f.bucket = r.bucket),
s AS (SELECT q, k, max(size) AS size, list_sort(list(n)) AS s, list(n ORDER BY bucket) AS counts FROM g GROUP BY q, k),
b AS (SELECT q, k, size, counts, {_QUARTILES} FROM s),
u AS (SELECT q, k, least(CAST(floor(ln(size + 1) / ln({LENGTH_BASE})) AS BIGINT), 255) AS code, list_transform(counts, lambda c: (c > b1)::INT + (c > b2)::INT + (c > b3)::INT) AS qs FROM b),
p AS (SELECT q, k, code, qs, printf('%02x', code) || list_aggregate(list_transform(range(0, {BUCKETS // 4}), lambda j: printf('%02x', 64 * qs[4 * j + 1] + 16 * qs[4 * j + 2] + 4 * qs[4 * j + 3] + qs[4 * j + 4])), 'string_agg', '') AS mark FROM u),
j AS (SELECT x.doc_id, x.n, x.e, a.mark, c.mark AS edited, a.code, a.qs, c.code AS ecode, c.qs AS eqs, d.mark AS next, d.code AS ncode, d.qs AS nqs
  FROM x JOIN p a ON a.q = x.q AND a.k = 0 JOIN p c ON c.q = x.q AND c.k = 1 JOIN p d ON d.q = x.nq AND d.k = 0),
l AS (SELECT *, list_sum(list_transform(range(1, {BUCKETS + 1}), lambda i: [0, 1, 2, 6][abs(qs[i] - eqs[i]) + 1]))::DOUBLE AS es, list_sum(list_transform(range(1, {BUCKETS + 1}), lambda i: [0, 1, 2, 6][abs(qs[i] - nqs[i]) + 1]))::DOUBLE AS ns FROM j)
SELECT doc_id, n::BIGINT AS n_chars, sha256(encode(e)) AS edited_sha256, mark AS fingerprint, edited AS edited_fingerprint,
CASE WHEN mark = edited THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - least(1.0::DOUBLE, es / {6 * BUCKETS * BODY_BOUND}::DOUBLE + least(abs(code - ecode), {LENGTH_BOUND}) / {LENGTH_BOUND}::DOUBLE * {LENGTH_SHARE}::DOUBLE)) END AS near_edited,
CASE WHEN mark = next THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - least(1.0::DOUBLE, ns / {6 * BUCKETS * BODY_BOUND}::DOUBLE + least(abs(code - ncode), {LENGTH_BOUND}) / {LENGTH_BOUND}::DOUBLE * {LENGTH_SHARE}::DOUBLE)) END AS near_next FROM l"""

#: Hexadecimal digits, two a byte; pieces of 500 windows keep each substring near the start of its string.
REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, n, base, substr(h, 2 * base + 1, 1198) AS part FROM (SELECT *, unnest(range(0, greatest(n - 99, 0), 500)) AS base FROM d)),
w AS (SELECT doc_id, base + i AS p, md5(substr(part, 2 * i + 1, 200)) AS m FROM (SELECT *, unnest(range(0, least(500, n - 99 - base))) AS i FROM c)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id NULLS LAST, p) AS q FROM w) WHERE q > 1),
g AS (SELECT doc_id, p, sum(CASE WHEN p - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) AS before FROM r)),
s AS (SELECT doc_id, run, min(p) AS low, max(p) + 100 AS high FROM g GROUP BY doc_id, run),
k AS (SELECT s.doc_id, h, low, high, coalesce(lag(high) OVER (PARTITION BY s.doc_id ORDER BY low), 0) AS start FROM s JOIN d ON d.doc_id = s.doc_id),
u AS (SELECT doc_id, count(*) AS spans, sum(high - low)::BIGINT AS gone, string_agg(substr(h, 2 * start + 1, 2 * (low - start)), '' ORDER BY low) || substr(max(h), 2 * max(high) + 1) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN u ON u.doc_id = d.doc_id"""

ORACLES: dict[str, str] = {
    "op4_mix_sources": MIX, "op8_document_digest": DIGEST, "op9_suffix_dedup": REPEATS,
    "op11_phrase_collocations": PHRASES, "op12_spelling_variants": SPELLING, "op13_chat_format": CHAT,
}
