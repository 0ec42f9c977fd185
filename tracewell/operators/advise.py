"""Pass 2: recommendations for the most important findings from a language model.

The provider is the one step outside Spark's own functions: findings without a
cached answer go to mapInPandas, whose rows are written to the cache table before
they are used, so that a retried task or a lost executor never asks twice for
what is stored. Everything else (selection, context, keys, parsing, repair,
validation, merging) is made of columns.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import patterns as P
from tracewell.functions import text as T
from tracewell.operators import contract as C

PROMPT_VERSION = "1"
LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "host.docker.internal")
SYSTEM = (
    "You review Java and Spark code for gaps in its logging and say where structured logs would help later monitoring and "
    "root-cause analysis. State nothing about runtime behaviour as a fact. Never recommend personal or health data, whole "
    "request or response bodies, credentials or secrets; recommend counts, durations, types and names of fields. "
    "Answer with one JSON object only."
)
KEYS = ("recommend", "priority", "category", "reason", "recommended_fields", "do_not_log", "ai_usefulness", "ai_use_cases",
        "deterministic_recommendation_reasonable")
ANSWER = ("struct<recommend:boolean,priority:string,category:string,reason:string,recommended_fields:array<string>,do_not_log:array<string>,"
          "ai_usefulness:string,ai_use_cases:array<string>,deterministic_recommendation_reasonable:boolean>")
USE_CASES = ("pipeline_monitoring", "anomaly_detection", "root_cause_analysis")


# --- providers -----------------------------------------------------------------


class TransportError(RuntimeError):
    """The provider could not be reached or did not answer."""


@dataclass
class Answer:
    text: str
    prompt_tokens: int = 0
    output_tokens: int = 0
    total_ms: int = 0


class Provider(ABC):
    """What answers prompts. Instances are pickled to the executors."""

    name = "provider"

    @abstractmethod
    def is_available(self) -> bool: ...

    @abstractmethod
    def list_models(self) -> list[str]: ...

    def has_model(self, model: str) -> bool:
        """A model counts as present under any tag of its name."""
        return any(m == model or m.split(":")[0] == model.split(":")[0] for m in self.list_models())

    @abstractmethod
    def generate(self, model: str, prompt: str, system: str = "", temperature: float = 0.1, json_format: bool = True) -> Answer: ...


class OllamaProvider(Provider):
    """A server with the Ollama HTTP interface."""

    name = "ollama"

    def __init__(self, host: str = "http://localhost:11434", timeout: int = 120):
        self.host, self.timeout = host.rstrip("/"), timeout

    def _call(self, path: str, payload: dict | None = None) -> dict:
        data = None if payload is None else json.dumps(payload).encode()
        request = urllib.request.Request(self.host + path, data, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return json.loads(r.read())
        except (OSError, ValueError, urllib.error.URLError) as e:
            raise TransportError(f"{self.host}{path}: {e}") from e

    def is_available(self) -> bool:
        try:
            self._call("/api/tags")
            return True
        except TransportError:
            return False

    def list_models(self) -> list[str]:
        return [m.get("name", "") for m in self._call("/api/tags").get("models", [])]

    def generate(self, model, prompt, system="", temperature=0.1, json_format=True):
        got = self._call("/api/generate", {"model": model, "prompt": prompt, "system": system, "stream": False,
                                           "options": {"temperature": temperature}} | ({"format": "json"} if json_format else {}))
        return Answer(got.get("response", ""), got.get("prompt_eval_count", 0) or 0, got.get("eval_count", 0) or 0, (got.get("total_duration", 0) or 0) // 1_000_000)


def check_endpoint(host: str, allow_external: bool) -> None:
    name = urlparse(host).hostname or ""
    if not allow_external and name not in LOCAL_HOSTS:
        raise ValueError(f"the model host {name!r} is not local and external hosts are not allowed")


# --- selection, keys, prompts ----------------------------------------------------


def select(findings: DataFrame, min_priority: str = "high", limit: int = 0) -> DataFrame:
    """Findings of the priority or above, most important first, at most limit (0: all)."""
    floor = P.RANKS.get(min_priority.upper(), 2)
    chosen = findings.where(C.rank(F.col("priority")) >= floor).orderBy(F.desc(C.rank(F.col("priority"))), "path", "line")
    return chosen.limit(limit) if limit > 0 else chosen


def cache_key(file_hash: Column, code: Column, rule_id: Column, prompt_version: Column, model: Column) -> Column:
    return F.sha2(F.concat(file_hash, F.sha2(code, 256), rule_id, prompt_version, model), 256)


def prompt(project: dict) -> Column:
    """The prompt of a finding joined with its method; project has project_name, frameworks, logging_frameworks."""
    listed = lambda c, none: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(none)
    log_lines = F.transform("logs", lambda x: F.concat(
        F.lit("- "), x["level"], F.lit(" at line "), x["line"].cast("string"),
        F.when(x["structured"], " (structured)").otherwise(" (unstructured)"), F.when(x["sensitive"], " [SENSITIVE?]").otherwise("")))
    moved = F.col("execution_line").isNotNull() & (F.col("execution_line") != F.col("line"))
    boundary = (
        F.when(moved, F.concat(F.lit("runs lazily at line "), F.col("execution_line").cast("string"), F.lit("; its metrics belong to the log at that action")))
        .when(F.col("execution_line").isNull() & ~F.col("category").isin("EXCEPTION", "JOB_START", "JOB_COMPLETION"), "no action in this method; it may run elsewhere")
        .otherwise("runs where defined"))
    kinds = F.array_sort(F.array_distinct(F.transform("ops", lambda o: o["operation_type"])))
    return F.concat_ws(
        "\n",
        F.lit(f"Project: {project['project_name']}"), F.lit(f"Technology: Java, {', '.join(project['frameworks']) or 'no Spark'}"),
        F.lit(f"Logging: {', '.join(project['logging_frameworks']) or 'unknown'}"), F.lit(""),
        F.concat(F.lit("File: "), "path"), F.concat(F.lit("Class: "), "class_name"),
        F.concat(F.lit("Method: "), "method", F.lit("("), F.array_join("parameters", ", "), F.lit(") -> "), "return_type"),
        F.concat(F.lit("Lines: "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")), F.lit(""),
        F.concat(F.lit("Finding: "), "category", F.lit(" at line "), F.col("line").cast("string"), F.lit(", priority "), "priority"),
        F.concat(F.lit("Logging nearby: "), F.col("existing_logging").cast("string"), F.lit(", quality "), "logging_quality"),
        F.concat(F.lit("Execution: "), boundary), F.concat(F.lit("Operations of the method: "), listed(kinds, "none")),
        F.lit("Logs of the method:"), F.when(F.size("logs") > 0, F.array_join(log_lines, "\n")).otherwise("- none"),
        F.concat(F.lit("Rule "), "rule_id", F.lit(" asks for: "), F.array_join("required_fields", ", ")), F.lit(""),
        F.lit("Code (secrets masked):"), F.lit("```java"), T.code_window(F.col("source"), F.col("start_line"), F.col("end_line"), F.col("line")), F.lit("```"), F.lit(""),
        F.lit("Is a log here important, which fields should it have, what must it not have, and is the finding reasonable?"),
        F.lit("Return JSON with the keys " + ", ".join(KEYS) + "; priorities are HIGH, MEDIUM or LOW."), F.lit(f"prompt_version={PROMPT_VERSION}"))


# --- answers -----------------------------------------------------------------------


def json_blob(c: Column) -> Column:
    """The first balanced {...} of an answer, without code fences; null if there is none."""
    bare = T.strip(c)
    bare = F.when(F.startswith(bare, F.lit("```")), T.strip(F.regexp_replace(bare, F.lit(r"\A```[a-zA-Z]*\n?|\n?```\z"), F.lit("")))).otherwise(bare)
    start = F.locate("{", bare)
    tail = F.substring(bare, start, F.char_length(bare))
    end = T.closing(tail, "{}")
    whole = F.left(tail, end + 1)
    balanced = newlines_free_depth(whole) == 0
    return F.when((start > 0) & balanced, whole)


def newlines_free_depth(c: Column) -> Column:
    """Opening minus closing braces."""
    count = lambda x: F.char_length(c) - F.char_length(F.replace(c, F.lit(x), F.lit("")))
    return count("{") - count("}")


_RAW = "map<string,string>"


def parse_answer(c: Column) -> Column:
    """An answer as ANSWER, or null where no JSON object can be read; trailing commas are repaired and values coerced."""
    blob = json_blob(c)
    read = lambda b: F.from_json(b, _RAW, {"mode": "PERMISSIVE"})
    repaired = F.regexp_replace(blob, F.lit(r",\s*([}\]])"), F.lit("$1"))
    valid = lambda b: F.json_object_keys(b).isNotNull()
    got = F.when(valid(blob), read(blob)).when(valid(repaired), read(repaired))
    level = lambda k: F.when(F.upper(got[k]).isin(*P.RANKS), F.upper(got[k])).otherwise("MEDIUM")
    flag = lambda k: F.when(F.lower(got[k]).isin("false", "0", "no"), False).otherwise(True)

    def names(k: str) -> Column:
        listed = F.from_json(got[k], "array<string>")
        plain = F.filter(F.transform(F.split(got[k], r"[,\n;]", -1), T.strip), lambda x: x != "")
        empty = F.array().cast("array<string>")
        value = T.strip(got[k])
        return (F.when(value.isNull() | (value == "null"), empty).when(F.startswith(value, F.lit("[")), F.coalesce(listed, empty))
                .when(F.startswith(value, F.lit("{")), empty).otherwise(plain))

    return F.when(got.isNotNull(), F.struct(
        flag("recommend").alias("recommend"), level("priority").alias("priority"), F.coalesce(got["category"], F.lit("")).alias("category"),
        F.coalesce(got["reason"], F.lit("")).alias("reason"), names("recommended_fields").alias("recommended_fields"), names("do_not_log").alias("do_not_log"),
        level("ai_usefulness").alias("ai_usefulness"), names("ai_use_cases").alias("ai_use_cases"),
        flag("deterministic_recommendation_reasonable").alias("deterministic_recommendation_reasonable")).cast(ANSWER))


def looks_like_json(text: str) -> bool:
    """Whether parse_answer() will read an answer; decides on another attempt on the executor."""
    text = re.sub(r"\A```[a-zA-Z]*\n?|\n?```\Z", "", text.strip()).strip()
    start, depth = text.find("{"), 0
    for i in range(max(start, 0), len(text) if start >= 0 else 0):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            blob = text[start : i + 1]
            for candidate in (blob, re.sub(r",\s*([}\]])", r"\1", blob)):
                try:
                    return isinstance(json.loads(candidate), dict)
                except ValueError:
                    continue
            return False
    return False


@dataclass
class Advice:
    """statuses (finding_no, llm_status), recommendations and runs, each by finding_no."""

    statuses: DataFrame
    recommendations: DataFrame
    runs: DataFrame
    provider: str
    model: str


def _asker(provider: Provider, model: str, temperature: float, retries: int):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf.cache_key, pdf.prompt):
                raw, error, ms, tokens_in, tokens_out, calls = None, None, 0, 0, 0, 0
                began, current = pd.Timestamp.now(tz="UTC"), text
                while calls <= retries and raw is None:
                    calls += 1
                    try:
                        answer = provider.generate(model, current, system=SYSTEM, temperature=temperature, json_format=True)
                        ms, tokens_in, tokens_out = ms + answer.total_ms, tokens_in + answer.prompt_tokens, tokens_out + answer.output_tokens
                        if looks_like_json(answer.text):
                            raw, error = answer.text, None
                        else:
                            error = "invalid_json"
                    except TransportError:
                        error = "transport"
                    current = text + "\n\nThe last answer was not one JSON object. Answer with the JSON object only."
                rows.append((key, raw, error, ms, tokens_in, tokens_out, calls, began, pd.Timestamp.now(tz="UTC")))
            yield pd.DataFrame(rows, columns=["cache_key", "raw", "error_type", "duration_ms", "input_tokens", "output_tokens", "calls", "started_at", "completed_at"])

    return ask


_ASKED = "cache_key string, raw string, error_type string, duration_ms long, input_tokens long, output_tokens long, calls int, started_at timestamp, completed_at timestamp"


def advise(findings: DataFrame, methods: DataFrame, sources: DataFrame, project: dict, provider: Provider, model: str, *,
           min_priority: str = "high", limit: int = 0, temperature: float = 0.1, retries: int = 1, cache: str | None = None,
           asked_at: str | None = None) -> Advice:
    """Ask for the selected findings (with finding_no). cache is a folder of answers by key, or None for none.

    Answers of this pass are written to the cache, or to asked_at, before they are used.
    """
    from tracewell.operators.store import durable

    spark = findings.sparkSession
    chosen = select(findings, min_priority, limit)
    parts = ("start_line", "end_line", "parameters", "return_type", "ops", "logs")
    # New names for all columns, as the findings come from the same methods.
    held = methods.select(F.col("path").alias("h_path"), F.col("name").alias("h_name"), F.col("method_ord").alias("h_ord"), *[F.col(c).alias(f"h_{c}") for c in parts])
    places = chosen.select(F.col("finding_no").alias("c_no"), F.col("path").alias("c_path"), F.col("method").alias("c_method"), F.col("line").alias("c_line"))
    inside = (F.col("c_path") == F.col("h_path")) & (F.col("c_method") == F.col("h_name")) & F.col("c_line").between(F.col("h_start_line"), F.col("h_end_line"))
    # The first method of that name which holds the line.
    best = places.join(held, inside).groupBy(F.col("c_no").alias("finding_no")).agg(
        F.min_by(F.struct(*[F.col(f"h_{c}").alias(c) for c in parts]), "h_ord").alias("m"))
    src = sources.select("path", F.col("content").alias("source"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("file_hash"))
    ctx = chosen.drop("logs").join(best.select("finding_no", "m.*"), "finding_no", "left").join(src, "path", "left")
    code = F.array_join(F.slice(F.split("source", r"(?<=\n)", -1), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "")
    known = F.col("start_line").isNotNull() & (F.coalesce("source", F.lit("")) != "")
    ctx = ctx.withColumn("known", known).withColumn("cache_key", F.when(known, cache_key(
        F.col("file_hash"), F.concat(code, "snippet"), F.col("rule_id"), F.lit(PROMPT_VERSION), F.lit(model))))
    ctx = durable(ctx.withColumn("prompt", F.when(known, prompt(project))).drop("source", "ops", "logs", "parameters", "return_type", "start_line", "end_line", "file_hash"))

    stored = spark.createDataFrame([], "cache_key string, raw string")
    if cache:
        path = spark._jvm.org.apache.hadoop.fs.Path(cache)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            stored = durable(spark.read.schema("cache_key string, raw string").parquet(cache).dropDuplicates(["cache_key"]))
    todo = ctx.where(F.col("known")).dropDuplicates(["cache_key"]).join(stored, "cache_key", "left_anti").select("cache_key", "prompt")
    asked = durable(todo.mapInPandas(_asker(provider, model, temperature, retries), _ASKED))
    if cache:
        asked.where("raw is not null").select("cache_key", "raw").write.mode("append").parquet(cache)

    hits = stored.select("cache_key", F.col("raw").alias("hit"))
    all_ = ctx.join(hits, "cache_key", "left").join(asked, "cache_key", "left")
    all_ = all_.withColumn("answer", parse_answer(F.coalesce("hit", "raw"))).withColumn(
        "llm_status", F.when(F.col("hit").isNotNull(), "CACHE_HIT").when(F.col("answer").isNotNull(), "OK").otherwise("LLM_ANALYSIS_FAILED"))
    all_ = durable(all_)
    a, ok = F.col("answer"), F.col("answer").isNotNull()
    safe = T.safe_fields(a["recommended_fields"])
    why = F.when(F.col("known"), "LLM unavailable or invalid JSON").otherwise("method context unavailable")
    listed = F.array(*map(F.lit, P.DO_NOT_LOG))
    recs = all_.select(
        "finding_no", F.when(ok, a["recommend"]).otherwise(F.col("priority").isin("HIGH", "MEDIUM")).alias("recommend"),
        F.when(ok, a["priority"]).otherwise(F.col("priority")).alias("priority"),
        F.when(ok & (a["category"] != ""), a["category"]).otherwise(F.col("category")).alias("category"),
        F.when(ok, a["reason"]).otherwise(F.concat(F.lit("[deterministic only] "), why)).alias("reason"),
        F.when(ok & (F.size(safe) > 0), safe).otherwise(F.col("required_fields")).alias("recommended_fields"),
        F.when(ok, T.do_not_log(a["do_not_log"], T.rejected_fields(a["recommended_fields"]))).otherwise(listed).alias("do_not_log"),
        F.when(ok, a["ai_usefulness"]).when(F.col("priority") == "HIGH", "HIGH").otherwise("MEDIUM").alias("ai_usefulness"),
        F.when(ok, a["ai_use_cases"]).otherwise(F.array(*map(F.lit, USE_CASES))).alias("ai_use_cases"),
        F.when(ok, a["deterministic_recommendation_reasonable"]).otherwise(True).alias("deterministic_recommendation_reasonable"),
        F.lit(model).alias("model"), F.lit(PROMPT_VERSION).alias("prompt_version"))
    zero = F.lit(0)
    asked_now = F.col("llm_status") != "CACHE_HIT"
    runs = all_.select(
        "finding_no", "fingerprint", F.lit(provider.name).alias("provider"), F.lit(model).alias("model"), "rule_id",
        F.coalesce("started_at", F.current_timestamp()).alias("started_at"), F.coalesce("completed_at", F.current_timestamp()).alias("completed_at"),
        F.col("llm_status").alias("status"), (~asked_now).alias("cache_hit"),
        *[F.when(asked_now, F.coalesce(c, zero)).otherwise(zero).alias(c) for c in ("duration_ms", "input_tokens", "output_tokens")],
        F.when(~F.col("known"), "no_context").when(ok, F.lit(None)).otherwise(F.coalesce("error_type", F.lit("invalid_json"))).alias("error_type"),
        F.when(asked_now, F.substring(F.sha2("prompt", 256), 1, 16)).alias("prompt_hash"), "cache_key", F.when(asked_now, F.coalesce("calls", zero)).otherwise(zero).alias("calls"))
    return Advice(all_.select("finding_no", "llm_status"), recs, runs, provider.name, model)


def llm_cache_rows(runs: DataFrame) -> DataFrame:
    """Runs that had a cache key, as rows of a cache log."""
    return runs.where(F.col("cache_key").isNotNull()).select(
        "finding_no", "cache_key", "model", F.lit(PROMPT_VERSION).alias("prompt_version"), "rule_id", F.col("cache_hit").alias("hit"))


def benchmark(findings: DataFrame, methods: DataFrame, sources: DataFrame, project: dict, provider: Provider, models: list[str], **options) -> list[dict]:
    """One row of figures for each model; the cache is left out so that times are fair."""
    from tracewell.operators.store import model_benchmark

    out = []
    for model in filter(None, (m.strip() for m in models)):
        if not (provider.is_available() and provider.has_model(model)):
            out.append({"model": model, "available": False})
            continue
        began = time.monotonic()
        advice = advise(findings, methods, sources, project, provider, model, cache=None, **options)
        row = model_benchmark(advice.runs).first()
        wanted = advice.recommendations.where("recommend").count()
        calls = advice.runs.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("n")).first()["n"]
        got = row.asDict() if row else dict(runs=0, ok=0, failed=0, avg_ms=0.0, input_tokens=0, output_tokens=0, structured_output_rate=None)
        out.append({"model": model, "available": True, "analysed": got["runs"], "llm_calls": calls, "ok": got["ok"], "failed": got["failed"],
                    "structured_output_rate": got["structured_output_rate"] or 0.0, "avg_response_ms": got["avg_ms"], "total_analysis_s": round(time.monotonic() - began, 1),
                    "input_tokens": got["input_tokens"], "output_tokens": got["output_tokens"], "recommendation_count": wanted})
    return out


# --- evaluation --------------------------------------------------------------------


def _class(body: str) -> str:
    return f"package eval;\nimport org.apache.spark.sql.*;\nclass Sample {{\n{body}\n}}\n"


#: (id, category, code, recommend, least and most priority, accepted usefulness)
EVAL_CASES = (
    ("join", "JOIN", _class('  Dataset<Row> run(Dataset<Row> a, Dataset<Row> b) {\n    Dataset<Row> j = a.join(b, "k");\n    j.write().parquet("/o");\n    return j;\n  }'), True, "HIGH", "HIGH", ("HIGH",)),
    ("filter", "FILTER", _class('  Dataset<Row> run(Dataset<Row> a) {\n    Dataset<Row> f = a.filter("x = 1");\n    f.write().parquet("/o");\n    return f;\n  }'), True, "MEDIUM", "HIGH", ("MEDIUM", "HIGH")),
    ("aggregation", "AGGREGATION", _class('  Dataset<Row> run(Dataset<Row> a) {\n    Dataset<Row> g = a.groupBy("d").agg(functions.count("id"));\n    g.write().parquet("/o");\n    return g;\n  }'), True, "HIGH", "HIGH", ("HIGH",)),
    ("parquet_write", "PARQUET_WRITE", _class('  void run(Dataset<Row> a) {\n    a.write().mode("overwrite").parquet("/o");\n  }'), True, "HIGH", "HIGH", ("HIGH",)),
    ("spark_read", "PARQUET_READ", _class('  Dataset<Row> run(SparkSession spark) {\n    return spark.read().parquet("/i");\n  }'), True, "MEDIUM", "HIGH", ("MEDIUM", "HIGH")),
    ("exception", "EXCEPTION", _class('  void run(Dataset<Row> a) {\n    try { a.write().parquet("/o"); }\n    catch (Exception e) { a.count(); }\n  }'), True, "HIGH", "HIGH", ("MEDIUM", "HIGH")),
    ("simple_select", "SELECT", _class('  Dataset<Row> run(Dataset<Row> a) {\n    Dataset<Row> s = a.select("x");\n    s.write().parquet("/o");\n    return s;\n  }'), False, "LOW", "LOW", ("LOW", "MEDIUM")),
)
CHECKS = ("finding_detected", "structured_output", "recommend_flag", "priority_band", "ai_usefulness", "no_sensitive_fields")


def eval_cases(spark) -> DataFrame:
    return spark.createDataFrame(list(EVAL_CASES), "id string, category string, content string, want boolean, least string, most string, useful array<string>")


def eval_checks(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Six checks for each case, null where they were not run. answers: id, detected, llm_status and recommendation columns, at most a row a case."""
    r = cases.join(answers.withColumnRenamed("priority", "got_priority").withColumnRenamed("ai_usefulness", "got_useful"), "id", "left")
    has = F.coalesce("detected", F.lit(False))
    rec = has & F.col("recommend").isNotNull()
    return r.select(
        "id", "category", has.alias("finding_detected"),
        F.when(has, F.coalesce(rec & F.col("llm_status").isin("OK", "CACHE_HIT"), F.lit(False))).alias("structured_output"),
        F.when(rec, F.col("recommend") == F.col("want")).alias("recommend_flag"),
        F.when(rec, C.rank(F.col("got_priority")).between(C.rank(F.col("least")), C.rank(F.col("most")))).alias("priority_band"),
        F.when(rec, F.array_contains("useful", F.col("got_useful"))).alias("ai_usefulness"),
        F.when(rec, F.size(T.sensitive_terms(F.array_join("recommended_fields", " "))) == 0).alias("no_sensitive_fields"))


def eval_summary(checks: DataFrame) -> DataFrame:
    each = F.array(*map(F.col, CHECKS))
    counted = checks.select(F.size(F.filter(each, lambda x: x.isNotNull())).alias("ran"), F.size(F.filter(each, lambda x: x)).alias("passed"),
                            F.exists(each, lambda x: ~x).alias("bad"))
    return counted.agg(
        F.count("*").alias("cases"), F.sum("ran").alias("checks_run"), F.sum("passed").alias("checks_passed"),
        F.coalesce(F.bround(F.try_divide(F.sum("passed"), F.sum("ran")), 3), F.lit(0.0)).alias("pass_rate"),
        F.count_if(~F.coalesce("bad", F.lit(False))).alias("clean_cases"))


def run_eval(spark, provider: Provider, model: str, temperature: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(checks, summary) of a model over EVAL_CASES; each case is a file of its own."""
    from tracewell.plans.scan import analyse
    from tracewell.operators.store import durable

    cases = eval_cases(spark)
    sources = cases.select(F.concat("id", F.lit(".java")).alias("path"), "content")
    a = analyse(sources)
    found = C.numbered(a.findings).join(cases.select(F.concat("id", F.lit(".java")).alias("path"), "category", "id"), ["path", "category"])
    # The first finding of the case's category.
    first = durable(found.groupBy("id").agg(F.min_by(F.struct(*[c for c in found.columns if c != "id"]), "finding_no").alias("f")).select("id", "f.*"))
    project = {"project_name": "eval", "frameworks": ["Apache Spark"], "logging_frameworks": []}
    advice = advise(first.drop("id"), a.methods, sources, project, provider, model, min_priority="low", temperature=temperature)
    answers = first.select("id", "finding_no").join(advice.recommendations, "finding_no", "left").join(advice.statuses, "finding_no", "left").select(
        "id", F.lit(True).alias("detected"), "llm_status", "recommend", "priority", "ai_usefulness", "recommended_fields")
    checks = durable(eval_checks(cases, answers))
    return checks, eval_summary(checks)
