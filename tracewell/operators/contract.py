"""The logging contract: rules, findings, scores and roll-ups."""

from __future__ import annotations

from dataclasses import dataclass, field
from importlib import resources

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell import patterns as P
from tracewell.functions import text as T


@dataclass(frozen=True)
class Contract:
    version: str
    proximity: int
    rules: dict[str, dict] = field(hash=False)

    @classmethod
    def load(cls, path: str | None = None) -> "Contract":
        if path is None:
            text = resources.files("tracewell").joinpath("resources/rules.yaml").read_text("utf-8")
        else:
            with open(path, encoding="utf-8") as f:
                text = f.read()
        data = yaml.safe_load(text)
        return cls(str(data.get("version", "1")), int(data.get("proximity_lines", 8)), data["rules"])

    def by_operation(self) -> dict[str, str]:
        return {op: rule for rule, spec in self.rules.items() for op in spec.get("spark_ops", [])}

    def _map(self, of) -> Column:
        return F.create_map(*[x for name, spec in self.rules.items() for x in (F.lit(name), of(spec))])

    def priorities(self) -> Column:
        return self._map(lambda spec: F.lit(P.RANKS[spec.get("priority", "low").upper()]))

    def fields(self) -> Column:
        return self._map(lambda spec: F.array(*map(F.lit, spec.get("fields", []))).cast("array<string>"))


def rank(c: Column) -> Column:
    return F.when(c == "HIGH", 2).when(c == "MEDIUM", 1).otherwise(0)


def unrank(c: Column) -> Column:
    return F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), c + 1)


_POINT = "array<struct<emit:int,sub:int,category:string,rule:string,line:int,priority:string,snippet:string,execution_line:int>>"


def _points(contract: Contract) -> Column:
    """Places of a method that the contract speaks about, in the order in which they are found."""
    index = contract.by_operation()
    rule_of = F.create_map(*[F.lit(x) for kv in index.items() for x in kv])
    ops = F.transform(F.filter("ops", lambda o: o["operation_type"].isin(*index)), lambda o, i: F.struct(
        F.lit(0).alias("emit"), i.alias("sub"), o["operation_type"].alias("category"), F.element_at(rule_of, o["operation_type"]).alias("rule"),
        o["line"].alias("line"), o["priority"].alias("priority"), o["snippet"].alias("snippet"), o["materialized_at"].alias("execution_line")))
    none = F.lit(None).cast("int")
    logged_end = F.exists("logs", lambda x: x["structured"] & (F.abs(x["line"] - F.col("end_line")) <= contract.proximity))
    starts = F.exists("ops", lambda o: o["operation_type"] == "JOB_START")
    end = F.struct(
        F.lit(1).alias("emit"), F.lit(0).alias("sub"), F.lit("JOB_COMPLETION").alias("category"), F.lit("job.completion").alias("rule"),
        F.col("end_line").alias("line"), F.lit("HIGH").alias("priority"),
        F.concat(F.lit("end of job method "), F.col("name"), F.lit("()")).alias("snippet"), none.alias("execution_line"))
    has_rule = "job.completion" in contract.rules
    job = F.when(starts & ~logged_end & F.lit(has_rule), F.array(end)).otherwise(F.array().cast(_POINT))
    open_ = F.filter("exceptions", lambda x: ~x["has_error_logging"] & x["kind"].isin("TRY_CATCH", "THROWS"))
    exc = F.transform(open_, lambda x, i: F.struct(
        F.lit(2).alias("emit"), i.alias("sub"), F.lit("EXCEPTION").alias("category"), F.lit("exception").alias("rule"), x["start_line"].alias("line"),
        F.lit("HIGH").alias("priority"),
        F.when(x["kind"] == "TRY_CATCH", F.concat(F.lit("catch block at line "), x["start_line"].cast("string")))
        .otherwise(F.concat(F.lit("method "), F.col("name"), F.lit("() declares checked exceptions, no error logging"))).alias("snippet"),
        none.alias("execution_line")))
    return F.concat(ops.cast(_POINT), job.cast(_POINT), exc.cast(_POINT))


def findings(methods: DataFrame, contract: Contract) -> DataFrame:
    """One row per finding of methods outside tests. Logs near a place are looked up within its method's row."""
    keys = [c for c in ("scan_id", "path") if c in methods.columns]
    kept = [*keys, "method_ord", "class_name", F.col("name").alias("method"), "logs"]
    rows = T.unfold(methods.where(~F.col("is_test")), kept, _points(contract), "p")
    near = lambda x, line: F.abs(x["line"] - line) <= contract.proximity
    at, run = F.col("p.line"), F.col("p.execution_line")
    moved = F.coalesce(run != at, F.lit(False))
    around = F.concat(
        F.filter("logs", lambda x: near(x, at)),
        F.filter("logs", lambda x: moved & near(x, run) & ~near(x, at)))
    rows = rows.withColumn("near", around).withColumn("required_fields", F.element_at(contract.fields(), F.col("p.rule")))
    blob = T.letters_only(F.array_join(F.transform("near", lambda x: x["message_pattern"]), " "))
    rows = rows.withColumn("_blob", blob)
    hits = F.size(F.filter("required_fields", lambda f: F.contains(F.col("_blob"), T.letters_only(f))))
    need = F.greatest(F.lit(2), F.floor(F.size("required_fields") / 2).cast("int"))
    quality = (
        F.when(F.size("near") == 0, "MISSING")
        .when(~F.exists("near", lambda x: x["structured"]), "WEAK")
        .when(hits >= need, "GOOD").otherwise("PARTIAL"))
    flat = F.lower(F.regexp_replace("p.snippet", F.lit(r"(?U)\s+"), F.lit("")))
    return rows.select(
        *keys, "method_ord", F.col("p.emit").alias("emit"), F.col("p.sub").alias("sub"),
        F.col("p.category").alias("category"), "class_name", "method", at.alias("line"),
        unrank(F.greatest(F.element_at(contract.priorities(), F.col("p.rule")), rank(F.col("p.priority")))).alias("priority"),
        (F.size("near") > 0).alias("existing_logging"), quality.alias("logging_quality"), "required_fields",
        F.concat(F.col("p.rule"), F.lit(f"@{contract.version}")).alias("rule_id"),
        F.col("p.snippet").alias("snippet"), run.alias("execution_line"),
        F.lit("OPEN").alias("status"), F.lit("NOT_RUN").alias("llm_status"),
        F.substring(F.sha1(F.concat_ws("|", "path", "class_name", "method", "p.category", "p.rule", flat)), 1, 16).alias("fingerprint"))


def covered() -> Column:
    return F.col("existing_logging") & F.col("logging_quality").isin("PARTIAL", "GOOD")


def numbered(found: DataFrame) -> DataFrame:
    """Findings with finding_no, from 1 within each scan: by priority, file, line, then as found.

    Findings are dealt out by ranges of that order and numbered within each part; a part's
    first number follows from the counts of the parts before it, so no task holds a scan.
    """
    from tracewell.operators.store import durable

    scan = ["scan_id"] if "scan_id" in found.columns else []
    order = [*scan, F.desc("_rank"), "path", "line", "method_ord", "emit", "sub"]
    # Ranges are found by a sample, so what an analysis gives is shuffled once before it instead of made twice
    # (the column between keeps the optimizer from merging both).
    dealt = found.repartition(*scan, "path", "line", "method_ord", "emit", "sub").withColumn("_rank", rank(F.col("priority")))
    # The parts must not be dealt anew, so they are written once.
    parts = durable(dealt.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    # A row for each part (and scan); a scan's parts follow each other.
    sizes = parts.groupBy(*scan, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*(scan or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*scan, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = W.partitionBy(*scan, "_part").orderBy(*order[len(scan):])
    ranked = parts.withColumn("_no", F.row_number().over(here)).join(offsets, [*scan, "_part"])
    return ranked.withColumn("finding_no", (F.col("_no") + F.col("_before")).cast("int")).select(*found.columns, "finding_no")


def scores(found: DataFrame, methods: DataFrame, project_type: str = "java-spark") -> DataFrame:
    """One row with the eight parts of the score, the overall score and the parts that do not apply.

    All methods' logs count, those of tests as well.
    """
    parts = []
    for bucket, categories in P.BUCKETS.items():
        here = F.col("category").isin(*categories)
        full = float(P.WEIGHTS[bucket])
        ratio = F.when(F.sum(F.when(here, 1).otherwise(0)) > 0, F.try_divide(F.sum(F.when(here & covered(), 1).otherwise(0)), F.sum(F.when(here, 1).otherwise(0))))
        parts.append(F.coalesce(F.bround(full * ratio, 1), F.lit(full)).alias(bucket))
    by_finding = found.agg(*parts)
    logs = T.unfold(methods, [], "logs").agg(
        F.coalesce(F.bround(P.WEIGHTS["structured_logging"] * F.avg(F.col("x.structured").cast("int")), 1), F.lit(0.0)).alias("structured_logging"),
        F.when(F.coalesce(F.bool_or(F.rlike("x.message_pattern", F.lit(T.unicode(P.RUN_ID)))), F.lit(False)), float(P.WEIGHTS["run_correlation"]))
        .otherwise(0.0).alias("run_correlation"))
    # Both sides are one row.
    both = by_finding.withColumn("k", F.lit(1)).join(logs.withColumn("k", F.lit(1)), "k").drop("k")
    left_out = P.SPARK_ONLY if project_type == "java" else ()
    applies = [k for k in P.WEIGHTS if k not in left_out]
    got = sum((F.col(k) for k in applies), F.lit(0.0))
    return both.select(
        *P.WEIGHTS, F.bround(100 * got / sum(P.WEIGHTS[k] for k in applies), 1).alias("overall_score"),
        F.array(*map(F.lit, left_out)).cast("array<string>").alias("not_applicable"))


def risk_weight() -> Column:
    return F.when(F.col("priority") == "HIGH", 3).when(F.col("priority") == "MEDIUM", 2).otherwise(1)


def readiness(found: DataFrame, *keys: str) -> DataFrame:
    """ai_readiness, risk and counts for each group of findings, one aggregation."""
    w = risk_weight()
    open_rank = F.max(F.when(~covered(), rank(F.col("priority"))))
    return found.groupBy(*keys).agg(
        F.bround(100.0 * F.sum(F.when(covered(), w).otherwise(0)) / F.sum(w), 1).alias("ai_readiness"),
        F.when(open_rank == 2, "HIGH").when(open_rank == 1, "MEDIUM").otherwise("LOW").alias("risk"),
        F.sum(w).alias("risk_weight"),
        *[F.count_if(F.col("priority") == p).alias(p.lower()) for p in P.RISK],
    )


def detection_matrix(methods: DataFrame) -> DataFrame:
    """Nine yes-or-no facts about each method."""
    has = lambda *kinds: F.exists("ops", lambda o: o["operation_type"].isin(*kinds))
    keys = [c for c in ("scan_id", "path", "method_ord", "name", "class_name", "start_line") if c in methods.columns]
    return methods.select(
        *keys, has("DATASET_READ", "PARQUET_READ").alias("input"), has("JOIN").alias("join"), has("FILTER").alias("filter"),
        has("GROUP_BY", "AGGREGATION").alias("aggregation"), has("DATASET_WRITE", "PARQUET_WRITE").alias("output"),
        has("EXTERNAL_IO").alias("external_io"), F.exists("logs", lambda x: x["structured"]).alias("structured_logging"),
        ((F.size("exceptions") > 0) & F.forall("exceptions", lambda x: x["has_error_logging"])).alias("exception_context"),
        F.exists("logs", lambda x: F.rlike(x["message_pattern"], F.lit(T.unicode(P.RUN_ID)))).alias("run_correlation"))
