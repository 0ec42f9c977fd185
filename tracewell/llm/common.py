"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder if the session is local, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="tracewell-")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of df in the cluster's shared checkpoint folder.

    The folder is spark.checkpoint.dir; see shared_folder().
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def marks(df: DataFrame) -> list[Column]:
    """Two hashes of a whole row, `mark` and `mark2`; nulls are told apart by their place."""
    parts = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(*parts).alias("mark"), F.hash(*parts).alias("mark2")]


def keep_marked(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of docs whose marks are in first (mark, mark2), one for each pair of marks.

    The texts move once: rows that agree in both marks meet in the join's own partitions.
    """
    names = {"mark": "_mark", "mark2": "_mark2"}
    own = docs.select("*", *(m.alias(names[k]) for k, m in zip(names, marks(docs))))
    want = first.select(*[F.col(k).alias(v) for k, v in names.items()])
    return own.join(want, list(names.values()), "left_semi").dropDuplicates(list(names.values())).select(*[F.col(f"`{c}`") for c in docs.columns])


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids have no fold."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod))


def held_out(id_col: str, mod: int, part: int) -> Column:
    """Whether a row is kept from training. Rows with a null id are never learned from."""
    return F.coalesce(fold(id_col, mod) == part, F.lit(True))


def labelled_ids(labels: DataFrame, label: str, mod: int, part: int, limit: int) -> DataFrame:
    """Up to limit (doc_id, label) rows outside the held-out fold.

    The sample is the rows with the smallest hash of doc_id, so it does not
    depend on the order of the input. A doc_id that occurs more than once counts
    once, with its largest label; labels that are neither 0 nor 1 are left out.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id", mod, part))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, mod: int, part: int, limit: int) -> DataFrame:
    """(doc_id, text, label): one text for each of labelled_ids(), its smallest where a doc_id stands for several."""
    ids = labelled_ids(labels, label, mod, part, limit)
    # At most limit ids; repeats of an id are folded on both sides of the exchange.
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return some.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("text").alias("text"), F.max("label").alias("label"))


#: Bytes of an Arrow batch sent to a Python worker, and the setting that bounds them.
BATCH_BYTES, _BATCH_SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, unless it sets a bound of its own.

    A batch is held several times over, by the executor and by the worker, and Spark's
    own bounds (rows, and 64 MB) let it grow with the texts. Results do not depend on it.
    """
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def map_batches(
    df: DataFrame, columns: list, process: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Run process over Arrow batches of the columns, on the executors."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from process(batch)

    return df.select(*columns).mapInArrow(run, schema)


def row_type(df: DataFrame) -> str:
    """DDL of a struct of all of df's columns."""
    return df.schema.simpleString()


def whole_rows(df: DataFrame) -> Column:
    """All of df's columns as one column, `row`, so that no name can clash with a new column."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def batch_of(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in types.items()], names=list(types))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """Parts of a batch in which the column holds about most_bytes at most (or one row)."""
    sizes = batch.column(column).nbytes
    rows = batch.num_rows
    step = rows if sizes <= most_bytes else max(1, rows * most_bytes // sizes)
    for start in range(0, rows, step):
        yield batch.slice(start, step)


def few_rows(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows, so that what is made of their texts stays small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
