"""A second rendered corpus: every part is a small Java file of one of the cases below.

A case states its code and, by hand, what must be found in it. The queries run the whole
analysis over the rendered files; the checking SQL repeats the stated results for each part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.plans.scan import Analysis, analyse
from tracewell.sources.corpus import dealt

HEAD = "package a.b;\nimport org.apache.spark.sql.*;\n"


def _run(code: str) -> str:
    """The code begins on line 5."""
    return HEAD + "class T {\n  void run(Dataset<Row> in) {\n" + code + "\n  }\n}\n"


#: Single calls on line 5 and the label each must get.
CALLS = (
    ("SparkSession.builder().getOrCreate();", "JOB_START"), ("new JavaSparkContext(conf);", "JOB_START"),
    ('spark.table("t");', "DATASET_READ"), ("in.write().csv(p);", "DATASET_WRITE"), ("in.save();", "DATASET_WRITE"),
    ("in.join(b);", "JOIN"), ("in.crossJoin(b);", "JOIN"), ("in.where(c);", "FILTER"), ("in.filter(c);", "FILTER"),
    ("in.groupBy(c);", "GROUP_BY"), ("in.groupByKey(f);", "GROUP_BY"), ("in.rollup(c);", "GROUP_BY"), ("in.cube(c);", "GROUP_BY"),
    ("in.agg(c);", "AGGREGATION"), ("in.reduceByKey(f);", "AGGREGATION"), ("in.reduce(f);", "AGGREGATION"),
    ("in.dropDuplicates();", "DEDUPLICATION"), ("in.distinct();", "DEDUPLICATION"),
    ("in.repartition(8);", "REPARTITION"), ("in.coalesce(1);", "REPARTITION"), ("in.orderBy(c);", "SORT"), ("in.sort(c);", "SORT"),
    ("in.unionByName(b);", "UNION"), ("in.union(b);", "UNION"), ("in.mapPartitions(f);", "MAP"), ("in.map(f);", "MAP"), ("in.flatMap(f);", "MAP"),
    ("in.withColumn(a, b);", "WITH_COLUMN"), ("in.withColumnRenamed(a, b);", "WITH_COLUMN"),
    ("in.selectExpr(a);", "SELECT"), ("in.select(a);", "SELECT"), ("in.drop(a);", "SELECT"),
    ("in.count();", "SPARK_ACTION"), ("in.collect();", "SPARK_ACTION"), ("in.first();", "SPARK_ACTION"), ("in.take(3);", "SPARK_ACTION"),
    ("in.show();", "SPARK_ACTION"), ("in.foreach(f);", "SPARK_ACTION"), ("in.saveAsTextFile(p);", "SPARK_ACTION"),
    ("spark.read().parquet(a);", "PARQUET_READ"), ('spark.read().format("parquet").load(a);', "PARQUET_READ"),
    ("in.write().mode(m).parquet(a);", "PARQUET_WRITE"), ('in.write().mode(m).format("parquet").save(b);', "PARQUET_WRITE"),
    ("Connection k = DriverManager.getConnection(u);", "EXTERNAL_IO"), ("producer.send(topic, x);", "EXTERNAL_IO"),
    ("new FileInputStream(p);", "EXTERNAL_IO"), ("Files.readString(p);", "EXTERNAL_IO"),
    ('String s = ".join( .groupBy(";', None), ("// a.join(b)", None), ("/* a.groupBy( */", None),
    ("List<String> x = names.stream().filter(a -> a.isEmpty()).map(a -> a).distinct().collect(toList());", None),
)

#: (code, logs as line, level, structured, sensitive)
LOGS = (
    ('logger.warning("left={} right={}", l, r);', (5, "WARN", True, False)), ("LOG.severe(message, patientId);", (5, "ERROR", True, False)),
    ('log.info("patient={}", patient);', (5, "INFO", True, True)), ('auditLog.finest("' + "x" * 90 + '");', (5, "TRACE", False, False)),
    ('log.debug("a=" + f(b, (c)), d);', (5, "DEBUG", True, False)), ('log.info("done", response);', (5, "INFO", False, True)),
)

#: (java, exception boundaries as kind, start_line, end_line, has_error_logging)
BOUNDARIES = (
    (HEAD + 'class A {\n  void f() throws IOException {\n    try { g(); } catch (A e) { log.error("x"); }\n    try { g(); } catch (B e) {\n'
            "      e.printStackTrace();\n    }\n    try { g(); } catch (C e) { h(); }\n    throw new X();\n  }\n}\n",
     (("TRY_CATCH", 5, 5, True), ("TRY_CATCH", 6, 8, True), ("TRY_CATCH", 9, 9, False), ("THROW", 10, 10, True), ("THROWS", 4, 4, True))),
    (HEAD + "class A {\n  void f() throws IOException { g(); }\n}\n", (("THROWS", 4, 4, False),)),
)

#: (code, operations as label, line, lazy, materialized_at)
FLOWS = (
    ("    Dataset<Row> j = in.join(b);\n    Dataset<Row> f = j.filter(x);\n    Dataset<Row> s = f.orderBy(y);\n    s.count();",
     (("JOIN", 5, True, 8), ("FILTER", 6, True, 8), ("SORT", 7, True, 8), ("SPARK_ACTION", 8, False, 8))),
    ("    a = b.join(c);\n    b = a.join(c);\n    a.count();", (("JOIN", 5, True, 7), ("JOIN", 6, True, 7), ("SPARK_ACTION", 7, False, 7))),
    ("    return in.filter(a).join(b);", (("FILTER", 5, True, None), ("JOIN", 5, True, None))),
)

#: (folder, java, findings as category, line)
CONTRACT = (
    ("app/src/test/java", _run("    in.join(b);"), ()),
    ("src/main/java", HEAD + "class A {\n  void f() throws IOException { g(); }\n}\n", (("EXCEPTION", 4),)),
    ("src/main/java", HEAD + 'class A {\n  void f() throws IOException { log.warn("x"); }\n}\n', ()),
    ("src/main/java", _run("    in.join(b);"), (("JOIN", 5),)),
    ("src/main/java", _run("    SparkSession.builder().getOrCreate();"), (("JOB_START", 5), ("JOB_COMPLETION", 6))),
)


def _corpus(spark: SparkSession, sf_dir: str, cases: list[tuple[str, str]]) -> Analysis:
    """A file for each part: the case of the remainder of its key."""
    k = (F.col("p_partkey") % len(cases)).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(c[i]) for c in cases]), k)
    parts = dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), "p_partkey")
    return analyse(parts.select(F.concat(pick(0), F.lit("/P"), F.col("p_partkey").cast("string"), F.lit(".java")).alias("path"), pick(1).alias("content")))


def _key():
    return F.regexp_extract("path", r"P(\d+)\.java$", 1).cast("long").alias("p_partkey")


def _literal(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"


def _sql(columns: str, rows: list[tuple], cases: int) -> str:
    """Each part joined to the stated rows (case number first) of its case."""
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"SELECT p_partkey, {columns} FROM part JOIN (VALUES {values}) v(k, {columns}) ON p_partkey % {cases} = k"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _corpus(spark, sf_dir, [("src/main/java", _run("    " + c)) for c, _ in CALLS])
    return T.unfold(found.methods, ["path"], "ops").select(_key(), F.col("x.operation_type").alias("operation_type"), F.col("x.line").alias("line"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _corpus(spark, sf_dir, [("src/main/java", _run("    " + c)) for c, _ in LOGS])
    return T.unfold(found.methods, ["path"], "logs").select(_key(), *[F.col(f"x.{c}").alias(c) for c in ("line", "level", "structured", "sensitive")])


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _corpus(spark, sf_dir, [("src/main/java", c) for c, _ in BOUNDARIES])
    return T.unfold(found.methods, ["path"], "exceptions").select(
        _key(), *[F.col(f"x.{c}").alias(c) for c in ("kind", "start_line", "end_line", "has_error_logging")])


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _corpus(spark, sf_dir, [("src/main/java", _run(c)) for c, _ in FLOWS])
    return T.unfold(found.methods, ["path"], "ops").select(_key(), *[F.col(f"x.{c}").alias(c) for c in ("operation_type", "line", "lazy", "materialized_at")])


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir, [(f, c) for f, c, _ in CONTRACT]).findings.select(_key(), "category", "line")


QUERIES = {"taxonomy_calls": calls, "taxonomy_logs": logs, "taxonomy_boundaries": boundaries, "taxonomy_flows": flows, "taxonomy_findings": findings}
ORACLES = {
    "taxonomy_calls": _sql("operation_type, line", [(k, label, 5) for k, (_, label) in enumerate(CALLS) if label], len(CALLS)),
    "taxonomy_logs": _sql("line, level, structured, sensitive", [(k, *found) for k, (_, found) in enumerate(LOGS)], len(LOGS)),
    "taxonomy_boundaries": _sql("kind, start_line, end_line, has_error_logging", [(k, *r) for k, (_, rs) in enumerate(BOUNDARIES) for r in rs], len(BOUNDARIES)),
    "taxonomy_flows": _sql("operation_type, line, lazy, materialized_at", [(k, *r) for k, (_, rs) in enumerate(FLOWS) for r in rs], len(FLOWS)),
    "taxonomy_findings": _sql("category, line", [(k, *r) for k, (_, _, rs) in enumerate(CONTRACT) for r in rs], len(CONTRACT)),
}
