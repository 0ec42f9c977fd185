"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of documents, further columns included, whatever their names.

Nulls: a null text has no language and goes in the first stage; other columns may be
null anywhere (a null doc_id is never learned from and yields to rows with one among
near-duplicates). Empty texts go with the null ones. Very long texts are read whole and
cut into pieces only by the last stage. Repeated rows are judged alike, and one of each
group stays. Ties: see the operators. An empty table passes through empty.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, jaccard, langid, packing, pii, toxicity
from tracewell.llm.common import durable, shared_folder, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the network places in no language it learned (null texts and texts without a letter among them)."""
    return langid.in_known_language(docs, langid.train(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model).where(F.col("score") < 0.5).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates.

    SimHash over runs of five words proposes links, exact similarity of 0.8 or more
    verifies them and finds those that fingerprints miss.
    """
    return jaccard.keep_first(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the new text."""
    return pii.masked(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence; lengths and places count byte-pair tokens."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    # Tokens are counted once; the packing reads the counts several times.
    counted = durable(bpe.count_tokens(docs.select("doc_id", "text"), "text", ranks, pattern).select("row.doc_id", "n_tokens"))
    return packing.pack(counted, length=F.col("n_tokens"))


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Trained models decide which documents stay, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the documents of sf_dir."""
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = os.path.join(place, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
