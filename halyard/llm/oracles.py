"""DuckDB SQL for the queries that SQL can express on whole tables."""

_BASE32 = "concat(" + ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, {5 * (i // 4) + 1}, 5))::BIGINT) >> {15 - 5 * (i % 4)}) & 31)::INT, 1)" for i in range(32)) + ")"

ORACLES = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, strlen(body) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d""",
    "op10_chat_format": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(role, '\\', '\\\\'), '<|', '<\\|') AS er, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS et FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(8 + 8 + 8 + length(er) + length(et))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op12_hard_negatives": """
WITH w AS (SELECT vec_id, label, embedding FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))), false)),
v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM w),
p AS (SELECT a.vec_id AS anchor_id, a.q, a.label, b.vec_id AS positive_id, list_dot_product(a.q, b.q)::BIGINT AS positive_score FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY positive_score DESC, positive_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, b.vec_id AS negative_id, list_dot_product(t.q, b.q)::BIGINT AS negative_score FROM t JOIN v b ON b.label <> t.label)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)::INTEGER AS rank, negative_id, positive_score, negative_score
FROM n WHERE 80 * positive_score <= 100 * negative_score AND negative_score <= positive_score
QUALIFY rank <= 5""",
    "op11_prefix_trie": """
WITH u AS (SELECT conv_id AS c, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tid, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, tid) AS pos FROM u),
s AS (SELECT c, list({'tid': tid, 'size': size} ORDER BY pos) AS ids,
  xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda acc, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(acc, x)), 4294967295::BIGINT), 4294967295) % 9 AS h FROM t GROUP BY c),
r AS (SELECT s.c, coalesce(b.ids[1:s.h], []) || s.ids[s.h + 1:] AS ids FROM s LEFT JOIN s b ON b.c = s.c - s.c % 5),
n AS (SELECT ids[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN (count(*) - 1) * any_value(ids[d].size) ELSE 0 END AS gain, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(ids) = d), '')) AS ends_sha256
  FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM r) GROUP BY ids[1:d], d),
e AS (SELECT n.*, p.conv_id AS parent_conv_id FROM n LEFT JOIN n p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]),
c AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT e.*, coalesce(n_children, 0) AS n_children FROM e LEFT JOIN c USING (k, d)),
g AS (SELECT k[1:a] AS k, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(gain)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1, 2)
SELECT conv_id, f.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM f JOIN g USING (k, d)""",
}
