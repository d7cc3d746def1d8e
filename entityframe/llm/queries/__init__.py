"""The registered queries of the ten operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ann, bpe, common, language_id, media_ogg, mixing, ngram_join, suffix_dedup, token_store, toxicity, url_rules

#: Place of the public tokenizer file; a parameter of the operators.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mixed.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ogg.read_media(common.stored(media_ogg.write_media(table(spark, sf_dir, "documents")), "media"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), length=200)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(common.crc32_of("doc_id") % 3 != 1))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (common.crc32_of("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: host, path, verdict of the query's rules.
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules, default="allow")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read(token_store.write(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path()))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = common.crc32_of("doc_id") % 4 == 2
    found = language_id.predict(docs, language_id.fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ann_search, op2_source_mix, op3_ogg_media, op4_suffix_dedup, op5_toxicity, op6_url_filter, op7_ngram_join, op8_token_store, op9_bpe, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    """SQL where SQL can express the result; the others are tested against brute force in ``tests/llm``."""
    return {
        "op6_url_filter": """
            WITH p AS (
              SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
            u AS (
              SELECT page_id, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                     coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
            rules(h, q, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
            fit AS (
              SELECT page_id, h || q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC, length(h) DESC) AS n
              FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
            SELECT u.page_id, host, path, fit.rule, coalesce(fit.v, 'allow') AS verdict
            FROM u LEFT JOIN fit ON u.page_id = fit.page_id AND n = 1""",
    }
