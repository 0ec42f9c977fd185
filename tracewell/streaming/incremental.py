"""Incremental scans: a stream of source files whose findings are appended as files arrive.

An addition to batch scans: each file is parsed on its own, so a stream of new or
changed files needs no state. A micro-batch is written under its batch id, so a
batch that is run again after a failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators.contract import Contract
from tracewell.plans.scan import analyse


def arriving(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """(path, content) of .java files as they appear under folder; whole files, one row each."""
    lines = (
        spark.readStream.format("text").schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.java").option("maxFilesPerTrigger", per_batch).load(folder))
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def scan_stream(sources: DataFrame, out: str, checkpoint: str, rules: Contract | None = None, **trigger) -> StreamingQuery:
    """Append the findings of arriving files to a Parquet folder, partitioned by batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        analyse(batch, rules).findings.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return sources.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
