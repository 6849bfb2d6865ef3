"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import mixing

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CHAT = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')) v(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + len(role) + 1 + len(text) + len(regexp_extract_all(text, '<\\*\|')) + 11)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS largest FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = rf"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i + 1, i + 13), ' ') AS win FROM (SELECT item, w, unnest(range(greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS win FROM (SELECT doc_id, n, w, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, s)),
m AS (SELECT doc_id, item, i, n FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * n_both >= 90 * (x.n + y.n - n_both)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1"""


def _mixing() -> str:
    keys = list(mixing.TARGETS)
    steps = [r"""t AS (SELECT doc_id, coalesce(source, '') AS mix_source, coalesce(lang, '') AS mix_lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
  len(regexp_extract_all(coalesce(text, ''), '\|')) AS bars FROM documents),
rows AS (SELECT *, CASE WHEN bars > 0 AND bars * 5 >= n THEN 'table' WHEN n < 100 THEN 'short' WHEN n < 400 THEN 'medium' ELSE 'long' END AS mix_topic FROM t),
c0 AS MATERIALIZED (SELECT mix_source, mix_lang, mix_topic, sum(n)::DOUBLE AS tokens FROM rows GROUP BY 1, 2, 3)"""]
    for k, power in mixing.TARGETS.items():
        steps.append(f"g_{k} AS (SELECT {k}, pow(sum(tokens), {float(power)}) AS share FROM c0 GROUP BY 1)")
        steps.append(f"y_{k} AS MATERIALIZED (SELECT {k}, share / (SELECT sum(share) FROM g_{k}) * (SELECT sum(tokens) FROM c0) AS target FROM g_{k})")
    steps.append("r0 AS MATERIALIZED (SELECT *, tokens AS raked FROM c0)")
    i = 0
    for _ in range(mixing.SWEEPS):
        for k in keys:
            steps.append(f"r{i + 1} AS MATERIALIZED (SELECT mix_source, mix_lang, mix_topic, tokens, CASE WHEN sum(raked) OVER (PARTITION BY {k}) > 0 THEN raked * target / sum(raked) OVER (PARTITION BY {k}) ELSE 0 END AS raked FROM r{i} JOIN y_{k} USING ({k}))")
            i += 1
    steps.append(f"f AS (SELECT *, CASE WHEN tokens > 0 THEN raked / tokens ELSE 1.0 END AS w FROM r{i})")
    steps.append("p AS (SELECT mix_source, mix_lang, mix_topic, round(w, 9) AS weight, round(w / max(w) OVER (), 9) AS probability FROM f)")
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, mix_source AS source, mix_lang AS lang, mix_topic AS topic, n::BIGINT AS n_tokens, weight, probability,
  ('0x' || substr(md5(concat(doc_id::VARCHAR, ':mix')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < probability AS sampled
FROM rows JOIN p USING (mix_source, mix_lang, mix_topic)"""


def _hamerly(k: int = 40, rounds: int = 5) -> str:
    """Rounds of k-means over all pairs of vectors and centroids, without bounds."""
    near = """a{i} AS MATERIALIZED (SELECT nr, vec_id, v, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
  FROM (SELECT nr, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM q, c{i}) GROUP BY 1, 2, 3)"""
    move = """m{i} AS (SELECT cluster, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM a{i}) GROUP BY 1, 2),
c{j} AS MATERIALIZED (SELECT cluster, coalesce(moved, c) AS c FROM c{i} LEFT JOIN (SELECT cluster, list(x ORDER BY pos) AS moved FROM m{i} GROUP BY 1) USING (cluster))"""
    steps = [
        """q AS MATERIALIZED (SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1 AS cluster, v AS c FROM q ORDER BY sha256('2:' || vec_id::VARCHAR) LIMIT {k})",
    ]
    for i in range(rounds):
        steps += [near.format(i=i), move.format(i=i, j=i + 1)]
    steps.append(near.format(i=rounds))
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


#: crc32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"""

PREFIX_TRIE = f"""
WITH t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos, md5(concat(len(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS h, len(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC.format('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, t.pos, t.h, t.chars FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h UNION ALL SELECT c.conv_id, 1, t.pos, t.h, t.chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
n AS (SELECT conv_id, chars, h, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth FROM r),
p AS MATERIALIZED (SELECT conv_id, depth, chars, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM n UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1),
e AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM p JOIN l USING (conv_id, depth) GROUP BY 1),
g AS MATERIALIZED (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, left(key, greatest(len(key) - 32, 0)) AS parent FROM p GROUP BY 1, 2),
k AS (SELECT parent AS key, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1),
w AS (SELECT g.conv_id, g.depth, coalesce(n_children, 0) = 0 AS leaf, (n_convs - 1) * chars AS saved FROM g LEFT JOIN k USING (key)),
s AS (SELECT p.key, count_if(leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM w JOIN p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY 1)
SELECT g.conv_id, g.depth, CASE WHEN g.depth > 0 THEN up.conv_id END AS parent_conv_id, g.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM g LEFT JOIN g up ON up.key = g.parent AND g.depth > 0 LEFT JOIN k ON k.key = g.key LEFT JOIN s ON s.key = g.key LEFT JOIN e ON e.key = g.key"""

URL_FILTER = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(h, s, verdict)),
f AS (SELECT page_id, host, path, h || s AS rule, verdict FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule, len(rule)) AS rule, coalesce(arg_max(verdict, len(rule)), 'allow') AS verdict FROM f GROUP BY 1"""

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": CHAT,
    "op5_mixing": _mixing(),
    "op8_jaccard_join": JACCARD,
    "op9_warc": WARC,
    "op10_decontaminate": DECONTAMINATE,
    "op11_hamerly": _hamerly(),
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_url_filter": URL_FILTER,
}
