"""Registered queries of the training-data operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlas.llm import (
    chat, disclosure, mixing, packing, projections, quality, repair, sharding, simhash, token_blocks, topk, toxicity, trie)
from atlas.llm.tokens import default_vocabulary

QUERIES: dict = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            TWINS[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_blocks")
def op1_token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return token_blocks.token_blocks(table(spark, folder, "documents"), default_vocabulary())


EXTRA_CHAT = "\\### Assistant: </turn> ok"


@query("op2_chat_format", r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
moves AS (
  SELECT *, lag(role, 1, '') OVER w AS state, row_number() OVER w - 1 AS pos,
    replace(replace(text, '\', '\\'), '<', '\l') AS escaped
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
faults AS (
  SELECT *, coalesce(CASE state WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
    WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END, false) AS accepted
  FROM moves),
chats AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS told,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS learned,
    sum(length('<turn ' || role || '>' || escaped || '</turn>') + 2) AS formatted_chars,
    min(pos) FILTER (NOT accepted) AS fault, arg_max(role, pos) AS last_role
  FROM faults GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learned) AS loss_chars,
  sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
  fault IS NULL AND last_role = 'assistant' AS valid,
  CAST(coalesce(fault, CASE WHEN last_role <> 'assistant' THEN n_turns END) AS INTEGER) AS first_fault
FROM chats
""")
def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_CHAT).alias("text"))
    return chat.chat_digest(chat.format_chats(turns.unionByName(more)))


@query("op5_simhash_near_dup")
def op5_simhash_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op7_source_mix", r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos
  FROM docs GROUP BY source),
caps AS (SELECT *, [5.0, 2.0, 1.0][pos % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM sources),
steps AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spare,
    sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM caps),
level AS (SELECT max(spare / weights) AS level FROM steps WHERE spare / weights * weight <= cap),
aims AS (
  SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target,
    CASE WHEN source_size > 0 THEN least(cap, coalesce(level * weight, cap)) / source_size ELSE 0 END AS rate
  FROM steps, level),
tries AS (
  SELECT d.doc_id, d.source, size, source_size, target, seed,
    CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5(seed || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
      / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
  FROM docs d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source, range(16) r(seed)),
best AS (
  SELECT source, arg_min(seed, (miss, seed)) AS seed FROM (
    SELECT source, seed, abs(sum(taken) - any_value(target)) AS miss FROM tries GROUP BY source, seed)
  GROUP BY source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, taken
FROM tries t JOIN best b ON t.source IS NOT DISTINCT FROM b.source AND t.seed = b.seed
""")
def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    size = mixing.word_count(F.col("text"))
    return mixing.planned(docs, mixing.source_plan(docs)).select(
        "doc_id", size.alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (size * F.col("_copies")).alias("taken"))


@query("op8_exact_top_k", r"""
WITH vecs AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vecs q JOIN vecs c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= 10
""")
def op8_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op9_projection_near_dup")
def op9_projection_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return projections.near_duplicate_vectors(table(spark, folder, "embeddings"))


@query("op10_window_packing")
def op10_window_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), default_vocabulary())


@query("op3_quality_discriminant")
def op3_quality_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_toxicity_network")
def op4_toxicity_network(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_disclosure_control")
def op6_disclosure_control(spark: SparkSession, folder: str) -> DataFrame:
    found = disclosure.all_spans(table(spark, folder, "documents").select("doc_id", "text"), everywhere=True)
    base = F.filter("_spans", lambda s: s["kind"] != "term")
    counts = [F.size(disclosure.spans_of(kind)).cast("long").alias(f"n_{kind}")
              for kind in (*disclosure.KINDS, "term")]
    return found.select("doc_id", *counts, F.sha2(disclosure.joined_spans(base), 256).alias("base_sha256"),
                        disclosure.joined_spans(F.col("_spans")).alias("spans"))


# crc32 of a brief ASCII text, bit by bit; and of any text, from the bytes' hexadecimal digits and a table of 256 sums
CRC_BIT = "list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), {})"
CRC_BRIEF = ("CAST(xor(list_reduce(list_transform(string_split({}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, b: "
             + CRC_BIT.format("xor(c, b)") + ", 4294967295), 4294967295) AS BIGINT)")
CRC_TABLE = "(SELECT string_agg(printf('%08x', " + CRC_BIT.format("n") + "), '' ORDER BY n) AS sums FROM range(256) r(n))"
CRC_TEXT = """CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: CAST('0x' || x AS BIGINT)),
    lambda c, x: xor(c >> 8, CAST('0x' || substr(sums, CAST((xor(c, x) & 255) * 8 + 1 AS BIGINT), 8) AS BIGINT)), 4294967295),
    4294967295) AS BIGINT)"""


def _cheapest_shard(shards: int) -> str:
    cost = "-ln((CAST('0x' || substr(md5(s || ':' || key), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
    return f"CAST((SELECT arg_min(s, ({cost}, s)) FROM range({shards}) r(s)) AS INTEGER)"


@query("op11_rendezvous_shards", f"""
WITH tab AS {CRC_TABLE},
docs AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, strlen(coalesce(text, '')) + 1 AS size,
    {CRC_TEXT.format("coalesce(text, '')")} AS text_crc32 FROM documents, tab),
placed AS (SELECT *, {_cheapest_shard(8)} AS shard, {_cheapest_shard(9)} AS grown_shard FROM docs)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY
  substr(md5(key), 1, 3), md5(key), doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM placed
""")
def op11_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_index(table(spark, folder, "documents"))


REPAIR_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"


@query("op12_structure_repair", rf"""
WITH RECURSIVE src AS (
  SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC_BRIEF.format(REPAIR_KEY)} % 20 AS k
  FROM conversations),
damaged AS (
  SELECT conv, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM src, range(2) c(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM damaged),
rows AS (
  SELECT *, substr(role, 1, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank'
    WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' ELSE '' END AS fault
  FROM ordered),
costs AS (
  SELECT *, fault IN ('blank', 'duplicate') AS bad, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM rows),
ns AS (SELECT conv, count(*) AS n FROM rows GROUP BY conv),
back AS (
  SELECT conv, n + 1 AS i, 0 AS b0, 6 AS b1, 3 AS b2, 0 AS b3 FROM ns
  UNION ALL
  SELECT conv, i, least(c0, 3 + c2, 6 + c3), least(c1, 3 + c2, 6 + c3), least(c2, 3 + c3), least(c3, 3 + c2) FROM (
    SELECT c.conv, c.i, least(4 + b0, CASE WHEN NOT bad THEN more + CASE ini WHEN 's' THEN least(b1, 3 + b2) WHEN 'u' THEN b2 ELSE 3 + b2 END ELSE 9999999 END) AS c0,
      least(4 + b1, CASE WHEN NOT bad THEN more + CASE ini WHEN 'u' THEN b2 ELSE 3 + b2 END ELSE 9999999 END) AS c1,
      least(4 + b2, CASE WHEN NOT bad THEN more + CASE ini WHEN 'a' THEN b3 ELSE 3 + b3 END ELSE 9999999 END) AS c2,
      least(4 + b3, CASE WHEN NOT bad THEN more + CASE ini WHEN 'u' THEN b2 ELSE 3 + b2 END ELSE 9999999 END) AS c3
    FROM back b JOIN costs c ON c.conv IS NOT DISTINCT FROM b.conv AND c.i = b.i - 1)),
vecs AS (SELECT conv, i, [b0, b1, b2, b3] AS b FROM back),
steps AS (
  SELECT v.conv, v.i, v.b AS now, w.b AS after, c.bad, c.more, c.ini
  FROM vecs v LEFT JOIN vecs w ON w.conv IS NOT DISTINCT FROM v.conv AND w.i = v.i + 1
  LEFT JOIN costs c ON c.conv IS NOT DISTINCT FROM v.conv AND c.i = v.i),
walk AS (
  SELECT conv, 1::BIGINT AS i, 0 AS s, 0 AS t, '' AS letter, 0::BIGINT AS used FROM ns
  UNION ALL
  SELECT conv, CASE WHEN l = 'I' THEN i ELSE i + 1 END, CASE WHEN l = 'D' THEN s WHEN l = 'K' AND ini = 's' THEN 1
      ELSE CASE s WHEN 2 THEN 3 ELSE 2 END END, t + 1, l, i FROM (
    SELECT w.conv, w.i, w.s, w.t, p.ini, CASE WHEN p.after IS NULL THEN 'I'
      WHEN 4 + p.after[w.s + 1] = p.now[w.s + 1] THEN 'D'
      WHEN 3 + p.now[CASE w.s WHEN 2 THEN 4 ELSE 3 END] = p.now[w.s + 1] THEN 'I'
      WHEN NOT p.bad AND ((p.ini = 's' AND w.s = 0 AND p.more + p.after[2] = p.now[w.s + 1])
        OR (p.ini = 'u' AND w.s <> 2 AND p.more + p.after[3] = p.now[w.s + 1])
        OR (p.ini = 'a' AND w.s = 2 AND p.more + p.after[4] = p.now[w.s + 1])) THEN 'K' ELSE 'R' END AS l
    FROM walk w JOIN steps p ON p.conv IS NOT DISTINCT FROM w.conv AND p.i = w.i
    WHERE p.after IS NOT NULL OR w.s IN (1, 2))),
told AS (
  SELECT w.*, count(*) FILTER (letter <> 'D') OVER (PARTITION BY w.conv) AS m,
    count(*) FILTER (letter <> 'D') OVER (PARTITION BY w.conv ORDER BY t) - 1 AS j, r.role, r.text
  FROM walk w LEFT JOIN rows r ON r.conv IS NOT DISTINCT FROM w.conv AND r.i = w.used AND letter IN ('K', 'R') WHERE t > 0),
done AS (
  SELECT conv, string_agg(letter, '' ORDER BY t) AS audit, sha256(coalesce(string_agg(
    CASE WHEN letter = 'K' THEN role WHEN (j - m % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10)
    ORDER BY t) FILTER (letter <> 'D'), '')) AS sha FROM told GROUP BY conv),
pairs AS (SELECT conv, ini AS b, lag(ini) OVER (PARTITION BY conv ORDER BY i) AS a, i FROM rows),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM rows GROUP BY conv),
bad AS (SELECT conv, count(*) FILTER (i > 1 AND a || b NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
  coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv IS NOT DISTINCT FROM o.conv_id
LEFT JOIN bad ON bad.conv IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv IS NOT DISTINCT FROM o.conv_id
LEFT JOIN back k ON k.conv IS NOT DISTINCT FROM o.conv_id AND k.i = 1
""")
def op12_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_digest(table(spark, folder, "conversations"))


@query("op13_prefix_trie", f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, count(*) AS n, {CRC_BRIEF.format("CAST(c AS VARCHAR)")} % 6 AS h, c - c % 100 AS base FROM t GROUP BY c),
rebuilt AS (
  SELECT v.c, p AS i, role, text FROM convs v JOIN t ON t.c = v.base AND p < h
  UNION ALL
  SELECT v.c, least(v.h, coalesce(b.n, 0)) + p - v.h, role, text FROM convs v JOIN t ON t.c = v.c AND p >= v.h
  LEFT JOIN convs b ON b.c = v.base),
members AS (
  SELECT c, i + 1 AS d, length(text) AS chars,
    string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY c ORDER BY i) AS k FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (SELECT k, d, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs FROM members GROUP BY k, d),
ends AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha FROM (
  SELECT c, arg_max(k, d) AS k FROM members GROUP BY c) GROUP BY k),
kids AS (SELECT substr(k, 1, 32 * (d - 1)) AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
valued AS (SELECT nodes.*, coalesce(n, 0) AS n_children, (n_convs - 1) * chars AS saved FROM nodes LEFT JOIN kids USING (k)),
below AS (
  SELECT substr(k, 1, 32 * a) AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM valued) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens,
  coalesce(sha, sha256('')) AS ends_sha256
FROM valued v JOIN below ON below.k = v.k LEFT JOIN ends ON ends.k = v.k
LEFT JOIN nodes o ON v.d > 0 AND o.d = v.d - 1 AND o.k = substr(v.k, 1, 32 * (v.d - 1))
""")
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.conversation_trie(table(spark, folder, "conversations"))
