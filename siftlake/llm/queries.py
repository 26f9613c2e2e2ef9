"""Registered queries of the operators and, where SQL can express them, their comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftlake.llm import (bpe, chat, clustering, exact_dedup, hard_negatives, html_text, licenses, mixing, near_dedup, neighbours, sharding,
                          toxicity, warc)
from siftlake.llm.common import SPACE, read, text_of
from siftlake.session import fresh_path

SHARDS = 24


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(read(spark, sf_dir, "documents"), SHARDS)
    return rows.select(
        "doc_id", sharding.record_size().alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (exact_dedup.duplicate_groups(read(spark, sf_dir, "documents"))
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def vocabulary_path() -> str:
    """The public vocabulary that the contract names; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, vocabulary_path(), decoded="decoded"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mixing.mix(read(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100, against all rows."""
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)],
                                  "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.windows(turns))
    return back.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is wrong, as the contract has it; anchors are the rows whose id is divisible by 100."""
    label = F.col("label").cast("long")
    rows = read(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(rows, rows.where(F.col("vec_id") % 100 == 0))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to the shared folder and read back by ranges."""
    path = fresh_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payloads=False).select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of("refers_to").alias("refers_to"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(read(spark, sf_dir, "embeddings"), k=8, rounds=10, dimensions=64, scale=1024.0, seed="3")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_html": op2_html,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_licenses": op6_licenses,
    "op7_bpe": op7_bpe,
    "op8_mixing": op8_mixing,
    "op9_neighbours": op9_neighbours,
    "op10_chat": op10_chat,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_warc": op12_warc,
    "op13_clustering": op13_clustering,
}

_OP3 = f"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '{SPACE}+', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r"""

_WORDS = f"len(string_split_regex(trim(regexp_replace(coalesce(%s, ''), '{SPACE}+', ' ', 'g'), ' '), ' '))"
_COUNT = ("CASE WHEN trim(regexp_replace(coalesce(%s, ''), '" + SPACE + "+', ' ', 'g'), ' ') = '' THEN 0 ELSE "
          + _WORDS + " END")

_OP8 = f"""
WITH d AS (
  SELECT doc_id, source, ({_COUNT % ('text', 'text')})::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, cap::DOUBLE / weight AS room FROM w),
l AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (
             ORDER BY room, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY room, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level,
         row_number() OVER (ORDER BY room, place) AS nth
  FROM o),
f AS (SELECT min(nth) AS first_free, arg_min(level, nth) AS share FROM l WHERE room >= level),
t AS (
  SELECT source, source_size,
         CASE WHEN first_free IS NULL OR nth < first_free THEN cap::DOUBLE ELSE weight * share END AS target
  FROM l, f),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS amount FROM d GROUP BY source, h),
u AS (
  SELECT source, h, amount, (sum(amount) OVER (PARTITION BY source ORDER BY h)) AS upto FROM g),
x AS (
  SELECT u.source, u.h, CASE WHEN upto - amount / 2.0 <= target - times * source_size THEN 1 ELSE 0 END AS more
  FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, b.source_size, b.target, d.size * (b.times + x.more) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h"""

_TURNS = ("SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL "
          "SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL "
          "SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'")


def _escaped(column: str) -> str:
    out = f"replace({column}, '&', '&amp;')"
    for control in chat.CONTROLS:
        mark = {"<": "&#60;", "[": "&#91;"}[control[0]] + control[1:]
        out = f"replace({out}, '{control}', '{mark}')"
    return out


_OP10 = f"""
WITH c AS ({_TURNS}),
n AS (
  SELECT *, greatest({_COUNT % ('text', 'text')}, 1) AS tokens,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n
  FROM c),
p AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY n
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM n),
w AS (SELECT *, (before // {chat.BUDGET})::BIGINT AS win, n = 1 AND role = 'system' AS system FROM p),
s AS (
  SELECT conv_id, win, lead(win) OVER v AS later, lead(start) OVER v AS next_start
  FROM (SELECT conv_id, win, min(before) AS start FROM w GROUP BY conv_id, win)
  WINDOW v AS (PARTITION BY conv_id ORDER BY win)),
a AS (
  SELECT conv_id, role, text FROM w
  UNION ALL
  SELECT w.conv_id, role, text FROM w JOIN s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.win = s.win
  WHERE NOT system AND later IS NOT NULL AND next_start - before <= {chat.HISTORY}
  UNION ALL
  SELECT w.conv_id, role, text FROM w JOIN s ON w.conv_id IS NOT DISTINCT FROM s.conv_id
  WHERE system AND later IS NOT NULL),
f AS (
  SELECT conv_id, sum({len(chat.TURN) + len(chat.END) + 1} + length(replace({_escaped('role')}, chr(10), '&#10;'))
                      + length({_escaped('text')}))::BIGINT AS formatted_chars
  FROM a GROUP BY conv_id),
r AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM n GROUP BY conv_id)
SELECT r.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars
FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id"""

_FINE = "{0} IS NOT NULL AND len(list_filter({0}, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_OP11 = f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_FINE.format('embedding')}),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""

_OP12 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest AS digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON payload_digest = digest"""



def _op13(k: int = 8, rounds: int = 10) -> str:
    """One CTE for each assignment and each move of the centroids."""
    apart = "list_sum(list_transform(list_zip(p.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
    parts = [f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND {_FINE.format('embedding')}),
e AS MATERIALIZED (SELECT row, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM k),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM k
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (SELECT row, min({apart} * {k} + c) AS best FROM k p, c{r} m GROUP BY row)""")
        parts.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT m.c, coalesce(w.v, m.v) AS v FROM c{r} m LEFT JOIN (
    SELECT c, list(x ORDER BY pos) AS v FROM (
      SELECT c, pos, {floor} AS x FROM (
        SELECT best % {k} AS c, pos, sum(x) AS s, count(*) AS n FROM a{r} JOIN e USING (row) GROUP BY 1, 2)) GROUP BY c
  ) w ON m.c = w.c)""")
    return ",".join(parts[:-1]) + f"""
SELECT vec_id, (best % {k})::INTEGER AS cluster, (best // {k})::BIGINT AS distance,
       (sum(best // {k}) OVER (PARTITION BY best % {k}))::BIGINT AS cluster_inertia, (sum(best // {k}) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN k USING (row) JOIN c{rounds} m ON m.c = best % {k}"""


SQL = {"op3_exact_dedup": _OP3, "op8_mixing": _OP8, "op10_chat": _OP10, "op11_hard_negatives": _OP11,
       "op12_warc": _OP12, "op13_clustering": _op13()}
