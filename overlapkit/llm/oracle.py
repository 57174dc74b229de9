"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from overlapkit.llm.mixing import PRIME, ROUNDS


def _draw(*parts: str | int) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(map(str, parts))})), 1, 15))::BIGINT"


def _mix(block: int = 128, shard_blocks: int = 1024) -> str:
    """The whole mix: targets, draws, raked counts, permutations, blocks."""
    rounds = f"""keys AS (SELECT source_no, r, {_draw("source_no", "r", 1)} % blocks AS k, {_draw("source_no", "r", 2)} % {PRIME} AS m, {_draw("source_no", "r", 3)} % {PRIME} AS c
  FROM src, (SELECT unnest(range(1, {ROUNDS + 1})) AS r) WHERE slots > 0),
 p0 AS (SELECT a.source_no, blocks, shard, j, j % blocks AS x FROM (SELECT source_no, shard, unnest(range(first, last)) AS j FROM raked) a JOIN src USING (source_no))"""
    for r in range(1, ROUNDS + 1):
        rounds += f""",
 q{r} AS (SELECT p.*, ((k - x) % blocks + blocks) % blocks AS mate, m, c FROM p{r - 1} p JOIN keys ON keys.source_no = p.source_no AND keys.r = {r}),
 p{r} AS (SELECT source_no, blocks, shard, j, CASE WHEN (greatest(x, mate) % {PRIME} * m + c) % {PRIME} // 1024 % 2 = 1 THEN mate ELSE x END AS x FROM q{r})"""
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
 sz AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM sz),
 s2 AS (SELECT *, [1.0::DOUBLE, 2.0, 3.0][source_no % 3 + 1] AS weight, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS budget FROM s1),
 s3 AS (SELECT *, row_number() OVER w AS rk, coalesce(sum(cap) OVER v, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER v, 0) AS free FROM s2
  WINDOW w AS (ORDER BY cap / weight, source_no), v AS (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 lv AS (SELECT arg_min(level, rk) AS final FROM (SELECT *, (budget - capped) / free AS level FROM s3) WHERE level * weight <= cap),
 s4 AS (SELECT *, least(cap, coalesce(final, 'inf'::DOUBLE) * weight) AS target, (source_size + {block - 1}) // {block} AS blocks FROM s3, lv),
 s5 AS (SELECT *, CASE WHEN blocks > 0 THEN least(3 * blocks, floor(target * blocks / source_size + 0.5)::BIGINT) ELSE 0 END AS slots FROM s4),
 src AS (SELECT *, (sum(slots) OVER (ORDER BY source_no) - slots)::BIGINT AS lo, sum(slots) OVER ()::BIGINT AS total FROM s5),
 n AS (SELECT max(total) AS total, (max(total) + {shard_blocks - 1}) // {shard_blocks} AS shards FROM src),
 sl AS (SELECT k // {shard_blocks} AS shard, k % {shard_blocks} AS i, total FROM (SELECT unnest(range(0, total)) AS k, total FROM n)),
 dr AS (SELECT shard, {_draw("shard", "i", 4)} % total AS x FROM sl),
 cnt AS (SELECT source_no, shard, count(*) AS n FROM dr JOIN src ON x >= lo AND x < lo + slots GROUP BY ALL
  UNION ALL SELECT source_no, {_draw("source_no", 0, 5)} % shards, 1 FROM src, n WHERE slots > 0),
 run AS (SELECT source_no, shard, sum(n)::BIGINT AS n FROM cnt GROUP BY ALL),
 cum AS (SELECT *, (sum(n) OVER (PARTITION BY source_no ORDER BY shard) - n)::DOUBLE AS b, sum(n) OVER (PARTITION BY source_no)::DOUBLE AS drawn FROM run),
 raked AS (SELECT source_no, shard, floor(b * (slots::DOUBLE / drawn) + 0.5)::BIGINT AS first, floor((b + n) * (slots::DOUBLE / drawn) + 0.5)::BIGINT AS last FROM cum JOIN src USING (source_no)),
 {rounds},
 times AS (SELECT source_no, x AS block_no, count(*) AS times, min(shard) AS lo, max(shard) AS hi FROM p{ROUNDS} GROUP BY ALL),
 doc AS (SELECT doc_id, size, source_no, source_size, target, (sum(size) OVER (PARTITION BY source_no ORDER BY doc_id) - size)::BIGINT AS place FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
 pc AS (SELECT *, least((block_no + 1) * {block} - place, size) - greatest(block_no * {block} - place, 0) AS words FROM
  (SELECT *, unnest(range(place // {block}, (place + size - 1) // {block} + 1)) AS block_no FROM doc WHERE size > 0)),
 tk AS (SELECT doc_id, sum(words * times)::BIGINT AS taken, min(lo) AS first_shard, max(hi) AS last_shard FROM pc JOIN times USING (source_no, block_no) GROUP BY ALL)
 SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_shard, last_shard FROM doc LEFT JOIN tk USING (doc_id)"""


_CHAT = """WITH t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS k,
  coalesce(replace(replace(replace(role, '<|', '< |'), '&', '&amp;'), '>', '&gt;'), '&null;') AS name, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
 sp AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role IS DISTINCT FROM 'system'),
 v AS (SELECT t.*, perspective, k // 256 AS part, role IS NOT DISTINCT FROM perspective AS mine,
  CASE WHEN role IS NOT DISTINCT FROM perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user|' || name || '>' END AS head
  FROM t JOIN sp ON t.conv_id IS NOT DISTINCT FROM sp.conv_id),
 w AS (SELECT *, sum(length(head) + length(said) + 8) OVER (PARTITION BY conv_id, perspective, part ORDER BY k)::BIGINT AS past FROM v)
 SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (mine) AS n_own, string_agg(head || said || '<|end|>' || chr(10), '' ORDER BY k) AS text,
 coalesce(string_agg((past - 8 - length(said)) || '-' || (past - 1), ',' ORDER BY k) FILTER (mine), '') AS mask FROM w GROUP BY conv_id, perspective, part"""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII string, bit by bit."""
    bits = "list_reduce([xor(c, b)] || range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce([4294967295] || list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT), lambda c, b: {bits}), 4294967295)"


_NEAREST = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings),
 g AS (SELECT * FROM e WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score FROM g q JOIN g c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
 SELECT query_id, row_number() OVER w AS rank, vec_id, score FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score, vec_id) QUALIFY row_number() OVER w <= 10"""


def _trie() -> str:
    return f"""WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS size, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT conv_id, {crc32_sql("any_value(conv_id)::VARCHAR")} % 6 AS h, list({{'name': name, 'size': size}} ORDER BY turn NULLS FIRST, name) AS own FROM t GROUP BY conv_id),
 r AS (SELECT a.conv_id, coalesce(b.own, [])[1:a.h] || a.own[a.h + 1:] AS s FROM o a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 100),
 m AS (SELECT conv_id, d, array_to_string(list_transform(s[1:d], lambda x: x.name), ',') AS key, CASE WHEN d > 0 THEN s[d].size ELSE 0 END AS size, d = len(s) AS here FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM r)),
 nd AS (SELECT key, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (here), '') AS ends,
  CASE WHEN any_value(d) > 0 THEN left(key, greatest(length(key) - 65, 0)) END AS parent FROM m GROUP BY key),
 kid AS (SELECT parent, count(*) AS n_children FROM nd GROUP BY parent),
 nk AS (SELECT nd.*, coalesce(n_children, 0) AS n_children FROM nd LEFT JOIN kid ON kid.parent = nd.key),
 sub AS (SELECT left(key, greatest(65 * e - 1, 0)) AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM nk) GROUP BY ALL)
 SELECT nk.conv_id, nk.depth, up.conv_id AS parent_conv_id, nk.n_convs, nk.n_children, n_leaves, saved_tokens, sha256(nk.ends) AS ends_sha256
 FROM nk JOIN sub USING (key) LEFT JOIN nk up ON up.key = nk.parent"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": _mix(), "op10_chat_perspectives": _CHAT, "op12_block_neighbours": _NEAREST, "op13_prefix_trie": _trie()}
