"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, mjpeg, packing, pii, quality, simhash, toxicity, url_filter
from .common import table

#: The rules that the query on pages applies: (verdict, host, path).
PAGE_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = url_filter.UrlPolicy(rules=PAGE_RULES)
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), "page_id", "url", policy)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=20, top=20)


def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = mjpeg.store_media(table(spark, sf_dir, "documents"), "doc_id", "text")
    return mjpeg.media_digest(media).withColumnRenamed("id", "doc_id")


#: Lengths in UTF-8 bytes that a packed sequence may have.
BYTE_CAPACITIES = (2048, 4096, 8192, 16384)


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as bytes: start and length of a piece are places in its text's UTF-8 bytes."""
    return packing.pack(table(spark, sf_dir, "documents"), length=F.octet_length("text"), capacities=BYTE_CAPACITIES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.token_digest(
        table(spark, sf_dir, "documents"), "doc_id", "text",
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
    ).withColumnRenamed("id", "doc_id")


def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_verdicts,
    "op2_weak_pii": personal_data,
    "op3_graph_ann": nearest_vectors,
    "op4_mjpeg_media": media_columns,
    "op5_fm_toxicity": toxicity_scores,
    "op6_best_fit_packing": packed_sequences,
    "op7_tree_bpe": token_ids,
    "op8_qda_quality": quality_scores,
    "op9_simhash_dedup": near_duplicate_documents,
    "op10_cnn_langid": languages,
    "pipeline": pipeline,
}


def _url_oracle() -> str:
    hits = {
        kind: " + ".join(f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN 1 ELSE 0 END" for t in terms)
        for kind, terms in (("strict", url_filter.STRICT_TERMS), ("soft", url_filter.SOFT_TERMS))
    }
    fits = "\n".join(
        f"UNION ALL SELECT page_id, '{host}{path}' AS rule, '{verdict}' AS verdict FROM p "
        f"WHERE (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        for verdict, host, path in PAGE_RULES
    ).removeprefix("UNION ALL ")
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH p AS (
  SELECT page_id, {low.format("coalesce(url, '')")} AS u,
         {low.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
fits AS ({fits}),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY page_id),
counts AS (SELECT page_id, host, path, {hits["strict"]} AS strict_kinds, {hits["soft"]} AS soft_kinds FROM p)
SELECT c.page_id, c.host, c.path, b.rule,
       coalesce(b.verdict, CASE WHEN strict_kinds > 0 OR soft_kinds >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM counts c LEFT JOIN best b USING (page_id)"""


ORACLES: dict[str, str] = {"op1_url_filter": _url_oracle()}
