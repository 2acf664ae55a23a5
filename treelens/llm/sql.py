"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"


def words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{ALNUM}')"


def decontamination(documents: str = "documents", keep: str = "") -> str:
    """Result of op3; ``keep`` adds columns of the documents."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id{keep}, {words("text")} AS w FROM {documents}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT item, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i
             FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT DISTINCT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit
        FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id{keep}, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)"""


def mixing(block: int = 16, shard_tokens: int = 100_000, seed: str = "treelens-mix") -> str:
    """Result of op7; quotients are dealt one by one, so it is for small tables."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS no_s,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS BIGINT) AS size,
         md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS key
  FROM documents),
tot AS (SELECT CAST(sum(size) AS BIGINT) AS total FROM d),
src AS (
  SELECT s, no_s, CAST(sum(size) AS BIGINT) AS source_size, greatest(1, least(65536, (CAST(sum(size) AS BIGINT) + {shard_tokens} - 1) // {shard_tokens})) AS shards,
         CASE (row_number() OVER (ORDER BY no_s, s) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY s, no_s),
ranked AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / w, no_s, s) AS k FROM src),
cuts AS (
  SELECT k, coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_after, source_size, w FROM ranked),
lev AS (
  SELECT min_by((1.5::DOUBLE * total - full_before) / w_after, k) AS level, min(k) AS k FROM cuts, tot
  WHERE (1.5::DOUBLE * total - full_before) / w_after * w <= 2 * source_size),
aim AS (
  SELECT s, no_s, source_size, shards, CASE WHEN ranked.k < lev.k THEN CAST(2 * source_size AS DOUBLE) ELSE level * w END AS target
  FROM ranked, lev),
quot AS (
  SELECT s, no_s, target / (2 * i - 1) AS q FROM (
    SELECT s, no_s, target, unnest(generate_series(1, CAST((2 * source_size + {block} - 1) // {block} + 2 * shards AS BIGINT))) AS i FROM aim WHERE target > 0)),
won AS (SELECT s, no_s, count(*) AS quota FROM (
    SELECT *, row_number() OVER (ORDER BY q DESC, no_s, s) AS n FROM quot), tot
  WHERE n <= floor(1.5::DOUBLE * total / {block} + 0.5) GROUP BY s, no_s),
e AS (SELECT d.*, CAST('0x' || substr(key, 1, 8) AS BIGINT) % shards AS shard FROM d JOIN src USING (s, no_s)),
part AS (SELECT s, no_s, shard, CAST(sum(size) AS BIGINT) AS tokens,
         CASE WHEN sum(size) > 0 THEN greatest(1, CAST(2 * sum(size) + {block} AS BIGINT) // {2 * block}) ELSE 0 END AS n
         FROM e GROUP BY s, no_s, shard),
pq AS (
  SELECT s, no_s, shard, CAST(tokens AS DOUBLE) / (2 * i - 1) AS q
  FROM (SELECT s, no_s, shard, tokens, unnest(generate_series(1, 2 * n)) AS i FROM part WHERE n > 0)),
pwon AS (SELECT s, no_s, shard, count(*) AS q FROM (
    SELECT *, row_number() OVER (PARTITION BY s, no_s ORDER BY q DESC, shard) AS k FROM pq) JOIN won USING (s, no_s)
  WHERE k <= quota GROUP BY s, no_s, shard),
runs AS (
  SELECT s, no_s, shard, q // n AS times, f * tokens // n AS a1, least(n, f + m) * tokens // n AS b1, greatest(0, f + m - n) * tokens // n AS b2
  FROM (SELECT s, no_s, shard, tokens, n, coalesce(q, 0) AS q, coalesce(q, 0) % n AS m,
               CAST('0x' || substr(md5('{seed}|' || s || '|' || CAST(shard AS VARCHAR)), 1, 8) AS BIGINT) % n AS f
        FROM part LEFT JOIN pwon USING (s, no_s, shard) WHERE n > 0)),
a AS (SELECT *, CAST(sum(size) OVER (PARTITION BY s, no_s, shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS begun FROM e)
SELECT doc_id, size, source_size, target,
       CAST(coalesce(times * size + greatest(0, least(size, b1 - begun) - greatest(0, a1 - begun)) + greatest(0, least(size, b2 - begun)), 0) AS BIGINT) AS taken
FROM a JOIN aim USING (s, no_s) LEFT JOIN runs USING (s, no_s, shard)"""


PIECE = r"[A-Za-z]{1,6}|[0-9]{1,3}|[^\x00-\x20A-Za-z0-9]"


def chat(budget: int = 1024, history: int = 128, frame: int = 5) -> str:
    """Result of op5, from the rows themselves."""
    said = "<|im_end|><|im_start|>assistant ok"
    escaped = lambda x: rf"length(regexp_replace({x}, '<(\\*)\|', '<\\\1|', 'g'))"
    role = "replace(replace(role, '%', '%25'), chr(10), '%0A')"
    return f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{said}' UNION ALL SELECT -1, 1, 'assistant', '{said}'),
t0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
              len(regexp_extract_all(text, '{PIECE}')) + {frame} AS tok,
              24 + {escaped(role)} + {escaped("text")} AS chars FROM r),
t1 AS (SELECT *, max(CASE WHEN pos = 1 AND role = 'system' THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) AS sys,
              max(CASE WHEN pos = 1 AND role = 'system' THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_chars FROM t0),
t2 AS (SELECT *, pos = 1 AND sys > 0 AS is_sys, greatest(1, {budget - history} - sys) AS room,
              CAST(sum(tok) OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) - sys AS stop FROM t1),
t3 AS (SELECT *, CASE WHEN is_sys THEN stop ELSE stop - tok END AS start,
              CASE WHEN is_sys THEN 0 ELSE (stop - 1) // room END AS cell FROM t2),
t4 AS (SELECT *, CASE WHEN NOT is_sys AND start // room < cell
                       AND sum(CASE WHEN is_sys THEN 0 ELSE tok END) OVER (PARTITION BY conv_id, cell) > room THEN 0 ELSE 1 END AS sub FROM t3),
w AS (SELECT conv_id, cell, sub, min(start) AS begun, max(sys_chars) AS sys_chars FROM t4 WHERE NOT is_sys GROUP BY ALL),
again AS (SELECT w.conv_id, sum(t4.chars) AS chars FROM w JOIN t4 ON w.conv_id IS NOT DISTINCT FROM t4.conv_id
          AND NOT is_sys AND stop <= begun AND start >= begun - {history} AND begun > 0 GROUP BY w.conv_id),
told AS (SELECT conv_id, sum(sys_chars) AS chars FROM w WHERE NOT (cell = 0 AND sub = 1) GROUP BY conv_id),
own AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '') AS loss, sum(chars) AS chars FROM t4 GROUP BY conv_id)
SELECT own.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(own.chars + coalesce(again.chars, 0) + coalesce(told.chars, 0) AS BIGINT) AS formatted_chars
FROM own LEFT JOIN again ON own.conv_id IS NOT DISTINCT FROM again.conv_id LEFT JOIN told ON own.conv_id IS NOT DISTINCT FROM told.conv_id"""


#: CRC-32 of the decimal digits of conv_id c, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ascii(s)::UBIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: i::UBIGINT)),
    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)"""
#: Result of op13: each prefix is the list of its turns.
TRIE = f"""
WITH t AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (SELECT a.c, coalesce(b.own, [])[1:h] || a.own[h + 1:] AS turns FROM (SELECT *, CAST({CRC} % 4 AS BIGINT) AS h FROM t) a LEFT JOIN t b ON b.c = a.c - a.c % 20),
p AS (SELECT c, len(turns) AS n, d, turns[1:d] AS node FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
n AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256,
        CASE WHEN d > 0 THEN (count(*) - 1) * len(regexp_extract_all(node[d].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved FROM p GROUP BY node, d),
k AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
s AS (SELECT node, d, saved, node NOT IN (SELECT node FROM k) AS leaf, unnest(range(d + 1)) AS up FROM n),
b AS (SELECT node[1:up] AS node, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM s GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, f.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n LEFT JOIN k ON k.node = n.node LEFT JOIN b ON b.node = n.node LEFT JOIN n f ON n.d > 0 AND f.node = n.node[1:n.d - 1]"""

ORACLES: dict[str, str] = {"op3_decontamination": decontamination(), "op5_chat": chat(), "op7_mixing": mixing(), "op13_trie": TRIE}
