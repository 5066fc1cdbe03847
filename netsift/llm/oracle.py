"""DuckDB SQL of the queries that SQL can express on whole tables, written apart
from the operators: windows, shingles and substrings are spelled out and joined."""

from netsift.llm import mixing

_WORDS = ("list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")

OP1 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1),
         lambda i: array_to_string(w[i : i + 12], ' '))) AS win FROM b WHERE len(w) > 0),
dw AS (SELECT r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'win': array_to_string(w[i : i + n - 1], ' ')}})) AS x
       FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
hits AS (SELECT DISTINCT r, x.i AS i, dw.n AS n, item FROM dw JOIN bw ON bw.win = x.win AND bw.n = dw.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

OP2 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, n >= 100 AND row_number() OVER w > 1 AS old, first_value(page_id) OVER w AS first FROM p
      WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST))
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN old THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN old THEN first END AS refers_to FROM q
"""

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS g
      FROM d WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 9 * c >= 4 * (x.n + y.n)),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
class AS (SELECT reach.a AS r, min(doc_id) AS class_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT doc_id, class_id, (SELECT count(*) FROM link WHERE link.a = d.r) AS n_links FROM d JOIN class USING (r)
"""

OP4 = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, unnest(range(1, length(x) // 2 - 198)) AS i, x FROM d WHERE length(x) >= 400),
k AS (SELECT r, i, md5(substr(x, 2 * i - 1, 400)) AS h FROM w),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM k) WHERE c > 1),
runs AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 200, TRUE) AS new FROM again),
spans AS (SELECT r, min(i) AS a, max(i) + 199 AS z FROM (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS g FROM runs) GROUP BY r, g),
edges AS (SELECT r, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN a IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(a) + 2),
         lambda j: substr(x, 2 * coalesce(z[j - 1], 0)::BIGINT + 1, 2 * (coalesce(a[j], length(x) // 2 + 1) - coalesce(z[j - 1], 0) - 1)::BIGINT)), '') END)) AS kept_sha256
FROM d LEFT JOIN edges USING (r)
"""

OP11 = """
WITH marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
x AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
         'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(x.doc_id > first, FALSE)} AS bad FROM x LEFT JOIN marks ON marks.doc_id = x.doc_id),
g AS (SELECT part, bad, good, toxic, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || k.c || e.c || m.c AS filter_order FROM l a, l b, l k, l e, l m
      WHERE len(list_distinct([a.c, b.c, k.c, e.c, m.c])) = 5),
s AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS c, filter_order[1 : step - 1] AS earlier FROM o, range(1, 6) AS r(step)),
r AS (SELECT g.part, s.filter_order, s.step, s.c, g.n, g.good, g.toxic,
        list_contains(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: [bad.A, bad.B, bad.C, bad.D, bad.E][ascii(y) - 64]), s.c) AS hit,
        len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: [bad.A, bad.B, bad.C, bad.D, bad.E][ascii(y) - 64] AND contains(s.earlier, y))) > 0 AS gone,
        bad.A::INT + bad.B::INT + bad.C::INT + bad.D::INT + bad.E::INT AS n_bad
      FROM g, s),
c AS (SELECT part, filter_order, step, c, sum(n) FILTER (WHERE NOT hit AND NOT gone) AS kept, sum(n) FILTER (WHERE hit AND NOT gone) AS removed,
        sum(n) FILTER (WHERE hit AND gone) AS redundant, sum(n) FILTER (WHERE hit AND n_bad = 1) AS unique_fails,
        sum(n * good) FILTER (WHERE hit AND NOT gone) AS good_lost, sum(n * toxic) FILTER (WHERE hit AND NOT gone) AS toxic_lost
      FROM r GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, c), 0)::BIGINT AS shapley FROM c
"""


def _op13() -> str:
    """Ten rounds of assignment and exact floor means, spelled out one after the other."""
    nearest = """SELECT r, k, d FROM (SELECT r, k, d, row_number() OVER (PARTITION BY r ORDER BY d, k) AS n FROM (
        SELECT v.r, c.k, list_sum(list_transform(range(1, 65), lambda j: ((v.x[j] - c.x[j]) * (v.x[j] - c.x[j]))::HUGEINT)) AS d FROM v, {0} c)) WHERE n = 1"""
    mean = """SELECT c.k, coalesce(m.x, c.x) AS x FROM {1} c LEFT JOIN (
        SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM (
          SELECT a.k, j, sum(v.x[j]) AS s, count(*) AS n FROM {0} a JOIN v USING (r), range(1, 65) AS t(j) GROUP BY a.k, j) GROUP BY k) m USING (k)"""
    rounds = "".join(f"a{i} AS MATERIALIZED ({nearest.format(f'c{i}')}),\nc{i + 1} AS MATERIALIZED ({mean.format(f'a{i}', f'c{i}')}),\n" for i in range(10))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) - 1 AS k, x FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) <= 8),
{rounds}a10 AS MATERIALIZED ({nearest.format('c10')})
SELECT vec_id, a.k::INTEGER AS cluster, a.d::BIGINT AS distance, sum(a.d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia,
       sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c10.x, ',')) AS centroid_sha256
FROM a10 a JOIN v USING (r) JOIN c10 USING (k)
"""


ORACLE_SQL = {"op1_decontaminate": OP1, "op2_warc": OP2, "op3_jaccard_join": OP3, "op4_repeats": OP4, "op6_mixing": mixing.ORACLE_SQL,
              "op11_filter_interactions": OP11, "op13_centroids": _op13()}
