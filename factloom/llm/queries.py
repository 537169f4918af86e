"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_text, line_dedup, mixing, neighbours, ngram_join, sharding, toxicity, warc
from .common import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = ngram_join.jaccard_components(docs, width=4, num=85, den=100)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS items
  FROM w),
n AS (SELECT doc_id, len(items) AS n FROM s),
e AS (SELECT doc_id, unnest(items) AS item FROM s),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM e x JOIN e y ON x.item = y.item AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id, CAST(coalesce(k.links, 0) AS BIGINT) AS n_links
FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = n.doc_id
LEFT JOIN (SELECT a, count(*) AS links FROM links GROUP BY a) k ON k.a = n.doc_id
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[%(p)s]', ' ', 'g'), '[^\x00-\x2f:-@\[-`{-\x7f]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[%(p)s]', ' ', 'g'), '[^\x00-\x2f:-@\[-`{-\x7f]+') AS ws FROM benchmark),
bk AS (SELECT item_id, ws, least(len(ws), 5) AS k FROM b WHERE len(ws) > 0),
bs AS (SELECT DISTINCT item_id, k, array_to_string(ws[i : i + k - 1], ' ') AS item FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM bk)),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM bk),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(ws[i : i + k - 1], ' ') AS item FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k))
SELECT doc_id, bs.item_id, CAST(any_value(n) AS BIGINT) AS item_shingles, CAST(count(*) AS BIGINT) AS common_shingles, CAST(count(*) AS DOUBLE) / any_value(n) AS containment
FROM ds JOIN bs ON ds.item = bs.item AND ds.k = bs.k JOIN bn ON bn.item_id = bs.item_id
GROUP BY doc_id, bs.item_id HAVING 100 * count(*) >= 80 * any_value(n)
""" % {"p": decontaminate.PUNCTUATION}


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, keep=["page_id", "url"])


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], rows.schema)
    return chat.digests(chat.read_turns(chat.format_turns(rows.unionByName(planted))))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # law `rows`: a uniform shuffle cannot keep groups of equal texts together; texts travel, and are measured where they arrive
    # whole rows wait in the JVM while their cells are drawn: few at a time
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_kept", "dropped_lines")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.mix(docs, repetition_limit=1.5)
    return out.select("doc_id", "source", mixing.n_tokens(F.col("text")).alias("n_tokens"), "epoch", "mix_weight", "mix_position")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % toxicity.HELD_OUT_OF == 0, F.lit(False))
    return toxicity.score(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, relax=1.0)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


def queries() -> dict:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_decontamination": op2_decontamination,
        "op3_html_text": op3_html_text,
        "op4_chat_format": op4_chat_format,
        "op5_sharding": op5_sharding,
        "op6_line_dedup": op6_line_dedup,
        "op7_mixing": op7_mixing,
        "op8_toxicity": op8_toxicity,
        "op9_neighbours": op9_neighbours,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": OP1_SQL,
        "op2_decontamination": OP2_SQL,
    }
