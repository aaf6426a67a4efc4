"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from lumenfold.llm.bpe import op4_bpe
from lumenfold.llm.chat import op9_chat
from lumenfold.llm.click_windows import op12_click_windows
from lumenfold.llm.decontaminate import op3_decontaminate
from lumenfold.llm.embedding_dedup import op11_near_vectors
from lumenfold.llm.filter_audit import op13_filter_audit
from lumenfold.llm.gif import op7_gif
from lumenfold.llm.language_id import op10_language
from lumenfold.llm.near_dup import op2_near_dup
from lumenfold.llm.sharding import op1_hash_tree
from lumenfold.llm.substring_dedup import op5_substring_dedup
from lumenfold.llm.token_counts import op8_token_counts
from lumenfold.llm.url_rules import op6_url_rules

QUERIES = {
    "op1_hash_tree": op1_hash_tree,
    "op2_near_dup": op2_near_dup,
    "op3_decontaminate": op3_decontaminate,
    "op4_bpe": op4_bpe,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_url_rules": op6_url_rules,
    "op7_gif": op7_gif,
    "op8_token_counts": op8_token_counts,
    "op9_chat": op9_chat,
    "op10_language": op10_language,
    "op11_near_vectors": op11_near_vectors,
    "op12_click_windows": op12_click_windows,
    "op13_filter_audit": op13_filter_audit,
}

_WORDS = r"'[^\x20\x09-\x0D]+'"



def _crc(text: str) -> str:
    """The CRC-32 of a text of ASCII, by the table t of a row."""
    return f"xor(list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split({text}, '')], lambda z, y: xor(t[(xor(z, y) & 255) + 1], z >> 8)), 4294967295)"


#: The others have hashes, vocabularies, streams or mined rules that SQL lacks; they are tested against plain Python.
ORACLES = {
    "op2_near_dup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS node, doc_id AS reach FROM s UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON node = doc_id
""",
    "op5_substring_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
k AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM w, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS s) WHERE len(w) >= 20),
d AS (SELECT doc_id, s FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
c AS (SELECT DISTINCT doc_id, s + o AS i FROM d, (SELECT unnest(range(20)) AS o)),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT t.doc_id, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY t.i) FILTER (WHERE c.i IS NULL) AS kept FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.i = t.i GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON g.doc_id = w.doc_id
""",
    "op13_filter_audit": rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
v AS (SELECT doc_id, part, t, regexp_extract_all(t, {_WORDS}) AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {{'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
  'C': 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(v.doc_id > first, false)}} AS x FROM v LEFT JOIN l ON l.doc_id = v.doc_id),
b AS (SELECT part, good, toxic, x.A AS a, x.B AS b, x.C AS c, x.D AS d, x.E AS e, count(*) AS n FROM f GROUP BY ALL),
g AS (SELECT part, good, toxic, n, [z FOR z IN ['A', 'B', 'C', 'D', 'E'] IF CASE z WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END] AS failed FROM b),
i AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS z),
o AS (SELECT p.z || q.z || r.z || s.z || u.z AS filter_order FROM i p, i q, i r, i s, i u WHERE len(list_distinct([p.z, q.z, r.z, s.z, u.z])) = 5),
k AS (SELECT filter_order, step, filter_order[step] AS z, string_split(filter_order[1:step - 1], '') AS earlier FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
r AS (SELECT part, filter_order, step, z,
  sum(CASE WHEN list_has_any(failed, list_append(earlier, z)) THEN 0 ELSE n END) AS kept,
  sum(CASE WHEN list_contains(failed, z) AND NOT list_has_any(failed, earlier) THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN list_contains(failed, z) AND list_has_any(failed, earlier) THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN failed = [z] THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN list_contains(failed, z) AND NOT list_has_any(failed, earlier) THEN n * good ELSE 0 END) AS good_lost,
  sum(CASE WHEN list_contains(failed, z) AND NOT list_has_any(failed, earlier) THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM g, k GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, z) AS BIGINT) AS shapley FROM r
""",
    "op11_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, coalesce(embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = len(embedding) AND len(list_filter(embedding, lambda y: y <> 0)) > 0, false) AS fine FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.fine AND b.fine AND a.vec_id < b.vec_id WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.9),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT vec_id AS node, vec_id AS reach FROM v UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON node = vec_id LEFT JOIN n ON n.a = vec_id
""",
    "op12_click_windows": f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
k AS (SELECT *, unnest(range(click_id % 3 + 1)) AS j FROM clicks),
c AS (SELECT k.*, {_crc("click_id || ':' || j")} AS c FROM k, tab),
h AS (SELECT click_id, c, epoch_us(arrived_at) // 3600000000 + 6 * j * (c % 10) AS hour, sha256(concat_ws('|', coalesce(client_id::VARCHAR, ''), coalesce(kind, ''),
  coalesce(CAST(floor(100 * value + 0.5) AS BIGINT)::VARCHAR, ''), coalesce(epoch_us(ts)::VARCHAR, ''), coalesce(props, ''), (c % 3)::VARCHAR)) AS hash FROM c),
l AS (SELECT *, hour + c // 10 % 200 AS due FROM h),
b AS (SELECT *, (due - min(due) OVER ()) * 10 // (max(due) OVER () - min(due) OVER () + 1) AS batch FROM l),
m AS (SELECT x AS batch, max(hour) AS most FROM range(11) AS r(x) JOIN b ON b.batch < x GROUP BY x),
g AS (SELECT b.batch, click_id, hour, hash, count(*) AS n FROM b LEFT JOIN m ON m.batch = b.batch WHERE b.batch = 0 OR hour >= most - 24 GROUP BY ALL),
o AS (SELECT g.*, most, CASE WHEN n > 1 OR count(*) OVER (PARTITION BY click_id) > 1 THEN {_crc("hash")} END AS crc, row_number() OVER (PARTITION BY click_id ORDER BY g.batch, hour, hash) AS rn FROM g LEFT JOIN m ON m.batch = g.batch, tab),
r AS (SELECT click_id, rn, batch, rn AS opener, hour AS start_hour, hash, CAST(n - 1 AS HUGEINT) AS n_repeats, 0::HUGEINT AS n_conflicts, 0::HUGEINT AS conflict_crc FROM o WHERE rn = 1
  UNION ALL SELECT click_id, rn, batch, CASE WHEN fresh THEN rn ELSE opener END, CASE WHEN fresh THEN hour ELSE start_hour END, CASE WHEN fresh THEN hash ELSE first END,
    CASE WHEN fresh THEN n - 1 ELSE n_repeats + n END, CASE WHEN fresh THEN 0 WHEN hash = first THEN n_conflicts ELSE n_conflicts + n END, CASE WHEN fresh THEN 0 WHEN hash = first THEN conflict_crc ELSE conflict_crc + n * crc END
  FROM (SELECT o.*, r.opener, r.start_hour, r.hash AS first, r.n_repeats, r.n_conflicts, r.conflict_crc, o.hour > r.start_hour + 48 OR coalesce(r.start_hour + 48 < o.most - 24, false) AS fresh FROM r JOIN o ON o.click_id = r.click_id AND o.rn = r.rn + 1)),
w AS (SELECT *, lead(batch) OVER (PARTITION BY click_id ORDER BY rn) AS next_batch FROM r QUALIFY coalesce(lead(opener) OVER (PARTITION BY click_id ORDER BY rn) <> opener, true))
SELECT click_id, start_hour, CAST(least(coalesce(next_batch, 9), (SELECT min(m.batch - 1) FROM m WHERE m.batch > w.batch AND (m.batch = 10 OR w.start_hour + 48 < m.most - 24))) AS BIGINT) AS closed_batch,
  CAST(n_repeats AS BIGINT) AS n_repeats, CAST(n_conflicts AS BIGINT) AS n_conflicts, CAST(conflict_crc AS BIGINT) AS conflict_crc, hash FROM w
""",
}
