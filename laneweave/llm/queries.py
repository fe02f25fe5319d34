"""The ``opN_*`` queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, mixing, order_minhash, pii, progressive_jpeg, quality_rules, secrets, token_files, toxicity
from .common import held_out, read_table, small_batches


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    media = progressive_jpeg.store(docs, "text", "media").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media"
    )
    read = progressive_jpeg.load(media, "media", "picture")
    payload = F.col("picture.payload")
    size = F.octet_length(payload)
    return read.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, size - 63, F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.lit("rgb8"), "picture.height", "picture.width", F.crc32("picture.rgb")).alias("feature"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.plan(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    sources = mix.sources.select("source_no", "source_size", "target")
    return mix.taken().join(sources, "source_no").select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return token_files.encode_and_read(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spans.select(
        F.col("id").alias("doc_id"),
        *[secrets.counted(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.rendered(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.rendered(F.col("spans")).alias("spans"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    scored = toxicity.score(docs, model, "text", "score")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, read_table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    scored = quality_rules.score(docs, model, "text", "score")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs), "text", "personal")
    spans = F.col("personal")
    return found.select(
        "doc_id",
        *[pii.counted(spans, k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.rendered(pii.base_only(spans)).cast("binary"), 256).alias("base_sha256"),
        pii.rendered(spans).alias("spans"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.learn_profiles(docs.filter(~held_out("doc_id", 4, 2)))
    told = language_id.identify(docs.select("doc_id", "text"), profiles, "text", "language")
    return told.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    blocks = decontaminate.automata(read_table(spark, sf_dir, "benchmark"))
    marked = decontaminate.mark(read_table(spark, sf_dir, "documents").select("doc_id", "text"), blocks, "text", "hits")
    return marked.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hits.items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = order_minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "class_texts")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_progressive_jpeg": op1_progressive_jpeg,
        "op2_mixing": op2_mixing,
        "op3_token_files": op3_token_files,
        "op4_secrets": op4_secrets,
        "op5_toxicity": op5_toxicity,
        "op6_quality_rules": op6_quality_rules,
        "op7_pii": op7_pii,
        "op8_language_id": op8_language_id,
        "op9_decontaminate": op9_decontaminate,
        "op10_order_minhash": op10_order_minhash,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM m)) GROUP BY r),
its AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hits.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.items, '')) AS items_sha256,
  coalesce(hits.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.r = hits.r LEFT JOIN its ON d.r = its.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.oracle_sql(), "op9_decontaminate": OP9_SQL}
