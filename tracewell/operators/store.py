"""The store: scans as Parquet tables partitioned by scan, and the queries over them.

Tables are append-only. A finding's status is what its last event says, so nothing
is updated in place; a project's row is the latest written for its path.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tracewell.functions import text as X
from tracewell.operators import contract as C

DECIDED = ("ACCEPTED", "REJECTED", "FALSE_POSITIVE")
STATUSES = ("OPEN", "REVIEWED", "ACCEPTED", "REJECTED", "IMPLEMENTED", "FALSE_POSITIVE")

# --- queries -------------------------------------------------------------------


def history(scans: DataFrame, projects: DataFrame, limit: int = 50) -> DataFrame:
    """The newest scans with their projects' names. The limit is applied to the scans' ids first where each has a project."""
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    more = [c for c in ("findings_count", "llm_model") if c in scans.columns]
    return scans.join(p, "project_id").orderBy(F.desc("id")).limit(limit).select(F.col("id").alias("scan_id"), "started_at", "score", *more, "project")


def scan_row(scans: DataFrame, scan_id: int) -> DataFrame:
    return scans.where(F.col("id") == scan_id)


def latest_scan(scans: DataFrame) -> DataFrame:
    return scans.agg(F.max("id").alias("scan_id"))


def priority_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scan_id", "priority").agg(F.count("*").alias("n"))


def list_findings(findings: DataFrame, scan_id: int | None = None, priority: str | None = None) -> DataFrame:
    """Findings of a scan (by default the latest), HIGH first, then by id."""
    if scan_id is None:
        last = findings.agg(F.max("scan_id").alias("scan_id"))  # one row
        findings = findings.join(F.broadcast(last), "scan_id", "left_semi")
    else:
        findings = findings.where(F.col("scan_id") == scan_id)
    if priority:
        findings = findings.where(F.col("priority") == priority.upper())
    return findings.orderBy(F.desc(C.rank(F.col("priority"))), "id")


def carry_status(new: DataFrame, old: DataFrame, order: str | Column = "id") -> DataFrame:
    """new with status: that of the latest old finding (by order) of the same project and fingerprint that was decided, else OPEN."""
    decided = old.where(F.col("status").isin(*DECIDED) & F.col("fingerprint").isNotNull())
    last = decided.groupBy("project_id", "fingerprint").agg(F.max_by("status", order).alias("status"))
    return new.drop("status").join(last, ["project_id", "fingerprint"], "left").withColumn("status", F.coalesce("status", F.lit("OPEN")))


def with_status(findings: DataFrame, events: DataFrame) -> DataFrame:
    """findings with the status of their last event (by ts, then seq), else their own."""
    last = events.groupBy("finding_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("now"))
    joined = findings.join(last.withColumnRenamed("finding_id", "id"), "id", "left")
    return joined.withColumn("status", F.coalesce("now", "status")).drop("now")


def compare(findings: DataFrame, scores: DataFrame, before: int, after: int) -> DataFrame:
    """Findings by priority in two scans, and the score's improvement."""
    both = findings.where(F.col("scan_id").isin(before, after)).groupBy("priority").agg(
        F.count_if(F.col("scan_id") == before).alias("before"), F.count_if(F.col("scan_id") == after).alias("after"))
    of = lambda s: F.max(F.when(F.col("scan_id") == s, F.coalesce("score", F.lit(0.0))))
    change = scores.where(F.col("scan_id").isin(before, after)).agg(F.bround(of(after) - of(before), 1).alias("improvement"))
    return both.join(F.broadcast(change))  # one row


def with_latest(findings: DataFrame, rows: DataFrame, order: str | Column, columns: list[str]) -> DataFrame:
    """findings with the columns of their latest row in rows (finding_id), or nulls."""
    last = rows.groupBy("finding_id").agg(F.max_by(F.struct(*columns), order).alias("last"))
    return findings.join(last.withColumnRenamed("finding_id", "id"), "id", "left").select(findings.columns + [f"last.{c}" for c in columns])


def _stats() -> list:
    timed = F.when((F.col("status") != "CACHE_HIT") & (F.col("duration_ms") > 0), F.col("duration_ms"))
    return [
        F.count("*").alias("runs"), F.count_if(F.col("status") == "OK").alias("ok"),
        F.count_if(F.col("status") == "LLM_ANALYSIS_FAILED").alias("failed"), F.count_if(F.col("status") == "CACHE_HIT").alias("cache_hits"),
        F.coalesce(F.bround(F.avg(timed), 1), F.lit(0.0)).alias("avg_ms"),
        F.coalesce(F.sum(F.coalesce("input_tokens", F.lit(0))), F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce(F.sum(F.coalesce("output_tokens", F.lit(0))), F.lit(0)).cast("long").alias("output_tokens"),
    ]


def run_stats(runs: DataFrame) -> DataFrame:
    return runs.agg(*_stats())


def model_benchmark(runs: DataFrame) -> DataFrame:
    got = runs.groupBy("model").agg(*_stats())
    return got.withColumn("structured_output_rate", F.bround(F.try_divide(F.col("ok"), F.col("ok") + F.col("failed")), 3))


def band_join(ops: DataFrame, logs: DataFrame, width: int) -> DataFrame:
    """For each operation (method_id, line), the logs of its method at most width lines away, itself left out.

    The equality on method_id carries the join; lines are bucketed by width as well,
    so that a method with very many rows is compared with its neighbourhood only.
    """
    size = width + 1
    left = ops.withColumn("b", F.explode(F.sequence(F.floor(F.col("line") / size) - 1, F.floor(F.col("line") / size) + 1)))
    right = logs.select("method_id", F.col("line").alias("at"), "structured", F.floor(F.col("line") / size).alias("b"))
    near = (F.abs(F.col("at") - F.col("line")) <= width) & (F.col("at") != F.col("line"))
    return left.join(right, ["method_id", "b"], "left").groupBy("method_id", "line").agg(
        F.count_if(near).alias("logs"), F.coalesce(F.bool_or(F.col("structured") & near), F.lit(False)).alias("structured"))


def resolve_method(found: DataFrame, spans: DataFrame, key: str, equal: list[str]) -> DataFrame:
    """found with the least method_id among spans that share the equal columns and hold its line, or null."""
    s = spans.alias("s")
    cond = F.col("f.line").between(F.col("s.start_line"), F.col("s.end_line"))
    for c in equal:
        cond = cond & (F.col(f"f.{c}") == F.col(f"s.{c}"))
    return found.alias("f").join(s, cond, "left").groupBy(F.col(f"f.{key}").alias(key)).agg(F.min("s.method_id").alias("method_id"))


def least_reached(edges: DataFrame, actions: DataFrame) -> DataFrame:
    """(line, action_line): for every line that an action reaches over edges a -> b, the least such action.

    Each round passes improved lines on only, so cycles end and paths are never listed; the rounds end when none improves.
    """
    best = actions.select(F.col("action").alias("line"), F.col("action").alias("action_line"))
    new = best
    while True:
        step = new.join(edges, new.line == edges.a).select(F.col("b").alias("line"), "action_line")
        after = best.union(step).groupBy("line").agg(F.min("action_line").alias("action_line"))
        after = durable(after)
        old = best.withColumnRenamed("action_line", "was")
        new = after.join(old, "line", "left").where(F.col("was").isNull() | (F.col("action_line") < F.col("was"))).select("line", "action_line")
        best = after
        if new.isEmpty():
            break
    return best


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of spark.checkpoint.dir; where none is set, in a temporary one if the session is local, else an error."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tracewell-"))
    return df.checkpoint()


# --- tables --------------------------------------------------------------------

_S, _L, _I, _D, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
_A = T.ArrayType(T.StringType())


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


TABLES: dict[str, T.StructType] = {
    "projects": _schema(project_id=_L, name=_S, path=_S, language=_S, project_type=_S, frameworks=_A, build_system=_S, java_version=_S,
                        spark_version=_S, logging_frameworks=_A, java_files=_I, test_files=_I, updated_at=_TS),
    "scans": _schema(id=_L, project_id=_L, started_at=_TS, completed_at=_TS, status=_S, files_scanned=_L, classes_scanned=_L, methods_scanned=_L,
                     spark_operations=_L, existing_logs=_L, findings_count=_L, llm_enabled=_B, llm_provider=_S, llm_model=_S, score=_D, rule_version=_S, scanner_version=_S),
    "source_files": _schema(scan_id=_L, path=_S, file_hash=_S, package=_S, imports=_A, classes=_A, interfaces=_A, line_count=_I, is_test=_B),
    "methods": _schema(scan_id=_L, path=_S, method_ord=_I, name=_S, class_name=_S, start_line=_I, end_line=_I, return_type=_S, parameters=_A, annotations=_A, is_test=_B),
    "spark_operations": _schema(scan_id=_L, path=_S, method_ord=_I, line=_I, operation_type=_S, priority=_S, snippet=_S, is_action=_B, lazy=_B, materialized_at=_I),
    "existing_logs": _schema(scan_id=_L, path=_S, method_ord=_I, line=_I, log_ord=_I, level=_S, logger_type=_S, message_pattern=_S, structured=_B, sensitive=_B),
    "exception_boundaries": _schema(scan_id=_L, path=_S, method_ord=_I, start_line=_I, exc_ord=_I, kind=_S, end_line=_I, has_error_logging=_B),
    "findings": _schema(scan_id=_L, id=_L, finding_no=_I, project_id=_L, path=_S, method_ord=_I, category=_S, class_name=_S, method=_S, line=_I, priority=_S,
                        existing_logging=_B, logging_quality=_S, required_fields=_A, rule_id=_S, snippet=_S, execution_line=_I, status=_S, llm_status=_S, fingerprint=_S),
    "scores": _schema(scan_id=_L, **{k: _D for k in ("job_lifecycle", "input_visibility", "transformation_visibility", "join_visibility", "output_visibility",
                      "exception_visibility", "structured_logging", "run_correlation", "overall_score")}, not_applicable=_A),
    "recommendations": _schema(scan_id=_L, finding_no=_I, recommend=_B, priority=_S, category=_S, reason=_S, recommended_fields=_A, do_not_log=_A, ai_usefulness=_S,
                               ai_use_cases=_A, deterministic_recommendation_reasonable=_B, model=_S, prompt_version=_S),
    "llm_runs": _schema(scan_id=_L, finding_no=_I, fingerprint=_S, provider=_S, model=_S, rule_id=_S, started_at=_TS, completed_at=_TS, status=_S, cache_hit=_B,
                        duration_ms=_L, input_tokens=_L, output_tokens=_L, error_type=_S, prompt_hash=_S, cache_key=_S),
    "status_events": _schema(finding_id=_L, status=_S, ts=_TS, seq=_L),
}
#: An id joins scan and number: scan * ID_SPAN + number, as in earlier stores, while the number is below ID_SPAN;
#: WIDE + scan * 2**31 + number from there on (numbers are ints). A scan past either range fails by overflow.
ID_SPAN, WIDE = 10_000_000, 1 << 62


def id_of(scan: Column, number: Column) -> Column:
    """The id of a scan's finding of that number."""
    scan = scan.cast("long")
    return F.when(number < ID_SPAN, scan * ID_SPAN + number).otherwise(F.lit(WIDE) + scan * (1 << 31) + number)


def scan_of(finding_id: int) -> int:
    """The scan that a finding's id names."""
    return (finding_id - WIDE) >> 31 if finding_id >= WIDE else finding_id // ID_SPAN


def now() -> datetime:
    return datetime.now(timezone.utc).replace(microsecond=0)


class Store:
    """A folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def read(self, table: str) -> DataFrame:
        """The table, empty if it was never written. Columns it lacks (older files) are null."""
        schema = TABLES[table]
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table))

    def append(self, table: str, df: DataFrame) -> None:
        names = TABLES[table].fieldNames()
        out = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(TABLES[table][c].dataType).alias(c) for c in names])
        out = out.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table]])
        writer = out.write.mode("append")
        (writer.partitionBy("scan_id") if "scan_id" in names else writer).parquet(self.path(table))

    # -- projects and statuses

    def projects(self) -> DataFrame:
        """The latest row of each project."""
        latest = W.partitionBy("project_id").orderBy(F.desc("updated_at"))
        return self.read("projects").withColumn("r", F.row_number().over(latest)).where("r = 1").drop("r")

    def findings(self) -> DataFrame:
        return with_status(self.read("findings"), self.read("status_events"))

    def set_status(self, finding_id: int, status: str) -> bool:
        """Append a status event; False if there is no such finding."""
        if status not in STATUSES:
            raise ValueError(f"unknown status {status}")
        if self.read("findings").where((F.col("scan_id") == scan_of(finding_id)) & (F.col("id") == finding_id)).isEmpty():
            return False
        seq = self.read("status_events").where(F.col("finding_id") == finding_id).count()
        self.append("status_events", self.spark.createDataFrame([(finding_id, status, now(), seq)], TABLES["status_events"]))
        return True

    # -- scans

    def save(self, analysis, project: DataFrame, *, advice=None, scanner_version: str = "") -> int:
        """Write one scan's tables; its id. project is one row as from project_info(); advice is Advice or None.

        Child tables come first and the scan's own row last, so that a scan is
        seen only when it is whole.
        """
        spark = self.spark
        info = project.first()
        scan_id = (latest_scan(self.read("scans")).first()["scan_id"] or 0) + 1
        known = self.projects().where(F.col("path") == info["path"]).first()
        project_id = known["project_id"] if known else (self.read("projects").agg(F.max("project_id").alias("m")).first()["m"] or 0) + 1
        started = now()
        self.append("projects", project.withColumn("project_id", F.lit(project_id)).withColumnRenamed("project_name", "name").withColumn("updated_at", F.lit(started)))

        mine = lambda df: df.withColumn("scan_id", F.lit(scan_id).cast("long"))
        self.append("source_files", mine(analysis.files))
        methods = durable(analysis.methods.drop("body", "masked_body"))
        self.append("methods", mine(methods))
        for table, column in (("spark_operations", "ops"), ("existing_logs", "logs"), ("exception_boundaries", "exceptions")):
            self.append(table, mine(X.unfold(methods, ["path", "method_ord"], column).select("path", "method_ord", "x.*")))
        found = C.numbered(C.findings(methods, analysis.contract)).withColumn("project_id", F.lit(project_id))
        if advice is not None:
            found = found.drop("llm_status").join(advice.statuses, "finding_no", "left").withColumn("llm_status", F.coalesce("llm_status", F.lit("NOT_RUN")))
            self.append("recommendations", mine(advice.recommendations))
            self.append("llm_runs", mine(advice.runs))
        found = mine(found).withColumn("id", id_of(F.lit(scan_id), F.col("finding_no")))
        prior = self.findings().where((F.col("project_id") == project_id) & (F.col("scan_id") < scan_id))
        self.append("findings", carry_status(found, prior, F.struct("scan_id", "id")))
        score = durable(C.scores(found, methods, info["project_type"]))
        self.append("scores", mine(score))

        from tracewell.operators.report import counters

        c = counters(analysis.files, methods).first()
        n = self.read("findings").where(F.col("scan_id") == scan_id).count()
        row = spark.createDataFrame([(
            scan_id, project_id, started, now(), "COMPLETED", c["files_scanned"], c["classes_scanned"], c["methods_scanned"], c["spark_operations"],
            c["existing_logs"], n, advice is not None, advice.provider if advice else None, advice.model if advice else None,
            score.first()["overall_score"], analysis.contract.version, scanner_version)], TABLES["scans"])
        self.append("scans", row)
        return scan_id

    def scan(self, scan_id: int) -> dict[str, DataFrame]:
        """All tables of one scan; partitions of others are not read."""
        out = {t: self.read(t).where(F.col("scan_id") == scan_id) for t in TABLES if "scan_id" in TABLES[t].fieldNames()}
        out["findings"] = with_status(out["findings"], self.read("status_events"))
        out["scan"] = scan_row(self.read("scans"), scan_id)
        out["project"] = self.projects().join(out["scan"].select("project_id"), "project_id", "left_semi")
        methods = out["methods"]
        for table, column in (("spark_operations", "ops"), ("existing_logs", "logs"), ("exception_boundaries", "exceptions")):
            names = [f for f in TABLES[table].fieldNames() if f not in ("scan_id", "path", "method_ord")]
            lists = out[table].groupBy("path", "method_ord").agg(F.array_sort(F.collect_list(F.struct(*names))).alias(column))
            empty = F.array().cast(T.ArrayType(_schema(**{n: TABLES[table][n].dataType for n in names})))
            methods = methods.join(lists, ["path", "method_ord"], "left").withColumn(column, F.coalesce(column, empty))
        out["methods"] = methods
        return out

    def finding(self, finding_id: int) -> dict | None:
        """A finding with its latest recommendation and run, or None."""
        scan_id = scan_of(finding_id)
        mine = self.findings().where((F.col("scan_id") == scan_id) & (F.col("id") == finding_id))
        f = mine.first()
        if f is None:
            return None

        def latest(table: str, order: str) -> dict | None:
            rows = self.read(table).where((F.col("scan_id") == scan_id) & (F.col("finding_no") == f["finding_no"])).withColumn("finding_id", F.lit(finding_id))
            got = with_latest(mine.select("id"), rows, order, TABLES[table].fieldNames()).drop("id").first().asDict(True)
            return got if got["scan_id"] is not None else None

        # A finding has one recommendation in its scan.
        return f.asDict(True) | {"recommendation": latest("recommendations", "finding_no"), "llm_run": latest("llm_runs", "completed_at")}
