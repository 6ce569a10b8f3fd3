"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(key || '|' || (row_number() OVER (PARTITION BY key) - 1)::VARCHAR), 1, 15))::BIGINT AS h
  FROM (SELECT *, coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, 'null')) || '|' || coalesce(source, 'null') AS key FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 2 AS cap,
             [3, 1, 2][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, cap, w, (SELECT l2.level FROM l l2 WHERE l2.level * l2.w <= l2.cap ORDER BY l2.cap::DOUBLE / l2.w, l2.source NULLS LAST LIMIT 1) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, final * w) END AS target FROM g),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
b AS (SELECT *, target - passes * source_size AS budget FROM p),
r AS (SELECT d.source, d.h, sum(d.size) AS here FROM d GROUP BY ALL),
c AS (SELECT r.source, r.h, r.here, sum(r.here) OVER (PARTITION BY r.source ORDER BY r.h) AS upto FROM r),
e AS (SELECT c.source, min(c.h) AS h, arg_min(c.upto, c.h) AS upto, arg_min(c.upto - c.here, c.h) AS below
      FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source WHERE c.upto >= b.budget GROUP BY c.source),
x AS (SELECT b.*, CASE WHEN e.h IS NULL OR b.budget <= 0 THEN -1 WHEN e.upto - b.budget <= b.budget - e.below THEN e.h ELSE e.h - 1 END AS threshold
      FROM b LEFT JOIN e ON e.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, x.source_size, x.target,
       d.size * (x.passes + CASE WHEN d.h <= x.threshold THEN 1 ELSE 0 END)::BIGINT AS taken,
       (x.passes + CASE WHEN d.h <= x.threshold THEN 1 ELSE 0 END)::BIGINT AS copies
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""

OP10 = r"""
WITH i AS (
  SELECT item_id, words, len(words) AS w, least(len(words), 5) AS k FROM (
    SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM benchmark)
  WHERE len(words) > 0),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM documents),
ks AS (SELECT DISTINCT k FROM i),
ish AS (SELECT item_id, w, k, unnest(list_transform(range(1, w - k + 2), lambda p: list_aggregate(words[p:p + k - 1], 'string_agg', ' '))) AS s FROM i),
ic AS (SELECT item_id, w, k, s, count(*) AS n FROM ish GROUP BY ALL),
dsh AS (SELECT doc_id, k, len(words) AS nw, unnest(range(1, len(words) - k + 2)) AS p,
               unnest(list_transform(range(1, len(words) - k + 2), lambda p: list_aggregate(words[p:p + k - 1], 'string_agg', ' '))) AS s
        FROM d, ks WHERE len(words) >= k),
hit AS (SELECT dsh.doc_id, dsh.nw, dsh.p, ic.item_id, ic.w, ic.k, dsh.s, ic.n FROM dsh JOIN ic ON dsh.s = ic.s AND dsh.k = ic.k),
st AS (SELECT DISTINCT doc_id, item_id, nw, w, k, unnest(range(greatest(1, p - (w - k)), greatest(1, least(p, nw - w + 1)) + 1)) AS start FROM hit),
inter AS (SELECT doc_id, item_id, start, nw, w, k, sum(least(c, n)) AS m FROM (
            SELECT st.doc_id, st.item_id, st.start, st.nw, st.w, st.k, hit.s, any_value(hit.n) AS n, count(*) AS c
            FROM st JOIN hit ON st.doc_id = hit.doc_id AND st.item_id = hit.item_id
             AND hit.p BETWEEN st.start AND least(st.start + st.w - 1, st.nw) - st.k + 1 GROUP BY ALL) GROUP BY ALL),
sim AS (SELECT *, m / ((w - k + 1) + (least(start + w - 1, nw) - start + 1 - k + 1) - m)::DOUBLE AS similarity FROM inter)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_min(start, (-similarity, start))::INT AS start_word, count(*) AS n_windows
FROM sim WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
g AS (SELECT html, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT p.page_id, p.payload_bytes::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN g.last IS NOT NULL AND g.last IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.last IS DISTINCT FROM p.page_id THEN g.last END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html
"""

OP3 = r"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS turns, count(*) AS n FROM t GROUP BY conv_id),
u AS (SELECT turns, n, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY turns, n),
k AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.n > u.n AND o.turns[1:u.n] = u.turns))
SELECT k.conv_id, (pos - 1) // 256 AS segment, any_value(k.n) AS n_turns, any_value(k.copies) AS copies,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY 1, 2
"""

OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT c.a AS vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, c.a = c.component_id AS kept
FROM c LEFT JOIN n ON n.a = c.a
"""

OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, list_inner_product(a.e, o.e)::BIGINT AS score
      FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""

OP13 = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
d AS (SELECT doc_id, part,
        CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails FROM u),
j AS (SELECT part, fails, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AS good,
             EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AS toxic FROM d),
o AS (SELECT unnest(['A','B','C','D','E']) AS o UNION ALL
      SELECT o.o || f FROM o, (SELECT unnest(['A','B','C','D','E']) AS f) x WHERE length(o.o) < 5 AND NOT contains(o.o, f)),
s AS (SELECT o AS filter_order, k::INT AS step, o[k:k] AS f, o[1:k-1] AS before FROM o, range(1, 6) r(k) WHERE length(o) = 5),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM j GROUP BY ALL),
m AS (SELECT g.*, s.*, contains(fails, f) AS failing, regexp_matches(fails, '[' || before || '0]') AS gone FROM g, s),
a AS (SELECT part, filter_order, step, f,
        coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
        coalesce(sum(n) FILTER (NOT gone AND failing AND good), 0)::BIGINT AS good_lost,
        coalesce(sum(n) FILTER (NOT gone AND failing AND toxic), 0)::BIGINT AS toxic_lost
      FROM m GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM a
"""

ORACLES = {"op2_warc": OP2, "op3_chat": OP3, "op9_embeddings": OP9, "op6_mixture": OP6, "op10_decontaminate": OP10, "op11_hard_negatives": OP11, "op13_filter_audit": OP13}
