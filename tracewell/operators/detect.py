"""Detectors: what a method does and logs, as array columns on its row.

All work is inside the row: no join and no shuffle. Places are counted in the
method's body, whose first line is body_line of the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import patterns as P
from tracewell.functions import text as T

OP = "array<struct<line:int,is_io:boolean,operation_type:string,priority:string,snippet:string>>"


_HIT = "array<struct<line:int,label:string,priority:string>>"


def _hits(body: str, table: tuple, keep: str = "true", dense: str | None = None) -> str:
    """SQL: (line, label, priority) of every match m of every pattern in table for which keep holds."""
    each = [
        f"transform(filter({T.places_sql(body, T.unicode(pattern), dense)}, m -> {keep}), m -> named_struct('line', m.line, 'label', '{label}', 'priority', '{priority}'))"
        for label, pattern, priority in table
    ]
    return f"concat({', '.join(each)})"


def with_operations(df: DataFrame) -> DataFrame:
    """df with ops: Spark operations and external IO, by line."""
    body = F.col("body")
    # No text that speaks against Spark in the 80 characters before the call.
    before = "substr(masked_body, greatest(0, m.at - 80) + 1, m.at - greatest(0, m.at - 80))"
    ambiguous = _hits("masked_body", P.AMBIGUOUS, f"NOT {before} RLIKE {T.raw(T.unicode(P.OTHER_RECEIVERS))}", "_dense")
    in_sight = f"spark_import OR masked_body RLIKE {T.raw(T.unicode(P.SPARK_TYPES))}"
    io = [
        f"transform({T.places_sql('masked_body', T.unicode(pattern), '_dense')}, m -> named_struct('line', m.line, 'k', {k}, 'kind', '{kind}'))"
        for k, (kind, pattern) in enumerate(P.EXTERNAL_IO)
    ]
    df = df.withColumn("_dense", F.expr(T.dense("masked_body"))).withColumns({
        "_hits": F.expr(f"concat({_hits('masked_body', P.STRONG, dense='_dense')}, CASE WHEN {in_sight} THEN {ambiguous} ELSE CAST(array() AS {_HIT}) END, {_hits('body', P.FORMATS)})"),
        "_io": F.expr(f"array_sort(concat({', '.join(io)}))"),
    })

    def special(x: Column) -> Column:
        out = F.lit(False)
        for general, format_ in P.REPLACES.items():
            out = out | ((x["label"] == general) & F.exists("_hits", _same(x, format_)))
        return out

    first_of_line = F.filter("_io", lambda x, i: (i == 0) | (F.get("_io", i - 1)["line"] != x["line"]))
    spark_ops = F.transform(F.filter(F.array_distinct("_hits"), lambda x: ~special(x)), lambda x: F.struct(
        (F.col("body_line") + x["line"]).alias("line"), F.lit(False).alias("is_io"), x["label"].alias("operation_type"),
        x["priority"].alias("priority"), T.snippet(body, x["line"]).alias("snippet")))
    io_ops = F.transform(first_of_line, lambda x: F.struct(
        (F.col("body_line") + x["line"]).alias("line"), F.lit(True).alias("is_io"), F.lit("EXTERNAL_IO").alias("operation_type"),
        F.lit("MEDIUM").alias("priority"), F.concat(F.lit("["), x["kind"], F.lit("] "), T.snippet(body, x["line"])).alias("snippet")))
    return df.withColumn("ops", F.array_sort(F.concat(spark_ops, io_ops)).cast(OP)).drop("_dense", "_hits", "_io")


def _same(x: Column, label: str):
    return lambda y: (y["label"] == label) & (y["line"] == x["line"])


def with_logs(df: DataFrame) -> DataFrame:
    """df with logs: (line, log_ord, level, logger_type, message_pattern, structured, sensitive)."""
    body, masked = F.col("body"), F.col("masked_body")
    call = T.unicode(P.LOGGER_CALL, r"[a-zA-Z_]++\s*+\.")
    levels = F.create_map(*[F.lit(x) for kv in P.LEVELS.items() for x in kv])

    # In steps, so that each text is searched once.
    def opened(m: Column) -> Column:
        paren = m["at"] + F.char_length(T.extract(m["part"], F.lit(call), F.lit(0))) - 1
        return F.struct(m["line"].alias("line"), T.extract(m["part"], F.lit(call), F.lit(1)).alias("verb"), paren.alias("paren"))

    def ahead(x: Column) -> Column:
        return F.struct(x["line"].alias("line"), x["verb"].alias("verb"), x["paren"].alias("paren"),
                        F.substring(masked, x["paren"] + 1, F.char_length(masked)).alias("rest"))

    def read(x: Column) -> Column:
        return F.struct(x["line"].alias("line"), x["verb"].alias("verb"),
                        F.substring(body, x["paren"] + 2, F.greatest(F.lit(0), T.closing(x["rest"], "()") - 1)).alias("args"))

    def lead(x: Column) -> Column:
        return F.struct(x["line"].alias("line"), x["verb"].alias("verb"), x["args"].alias("args"),
                        T.extract(x["args"], F.lit(rf"(?U)\A\s*({P.STRING})"), F.lit(0)).alias("lead"))

    def message(x: Column) -> Column:
        plain = F.coalesce(F.get(F.split(T.strip(x["args"]), ",", -1), F.lit(0)), F.lit(""))
        return F.struct(
            x["line"].alias("line"), x["verb"].alias("verb"), x["args"].alias("args"),
            F.when(x["lead"] != "", F.regexp_replace(x["lead"], F.lit(r"(?U)\A\s+"), F.lit(""))).otherwise(plain).alias("message"),
            F.when(x["lead"] != "", F.substring(x["args"], F.char_length(x["lead"]) + 1, F.char_length(x["args"]))).otherwise("").alias("rest"))

    def judged(x: Column, i: Column) -> Column:
        structured = (
            F.contains(x["message"], F.lit("{}")) | F.rlike(x["message"], F.lit(T.unicode(P.KEY_VALUE)))
            | F.rlike(x["args"], F.lit(T.unicode(P.STRUCTURED_ARGS))))
        short = F.regexp_replace(x["message"], F.lit(P.LONG_STRING), F.lit('"..."'))
        return F.struct(
            (F.col("body_line") + x["line"]).alias("line"), i.alias("log_ord"), F.coalesce(F.get(F.array(F.element_at(levels, x["verb"])), F.lit(0)), F.lit("INFO")).alias("level"),
            F.lit("unknown").alias("logger_type"), F.left(short, F.lit(200)).alias("message_pattern"),
            structured.alias("structured"), T.is_sensitive_log(x["message"], x["rest"]).alias("sensitive"))

    calls = T.places("masked_body", call)
    for step in (opened, ahead, read, lead, message):
        calls = F.transform(calls, step)
    kind = "array<struct<line:int,log_ord:int,level:string,logger_type:string,message_pattern:string,structured:boolean,sensitive:boolean>>"
    return df.withColumn("logs", F.transform(calls, judged).cast(kind))


def with_exceptions(df: DataFrame) -> DataFrame:
    """df with exceptions: catch blocks, throws and throws clauses, as (start_line, exc_ord, kind, end_line, has_error_logging)."""
    body, masked = F.col("body"), F.col("masked_body")
    kind = "array<struct<at:int,line:int,kind:string,end:int,logged:boolean>>"

    # In steps, so that each text is searched once.
    def opened(m: Column) -> Column:
        return F.struct(m["at"].alias("at"), m["line"].alias("line"),
                        (m["at"] + F.char_length(T.extract(m["part"], F.lit(T.unicode(P.CATCH)), F.lit(0))) - 1).alias("brace"))

    def ahead(x: Column) -> Column:
        return F.struct(x["at"].alias("at"), x["line"].alias("line"), x["brace"].alias("brace"),
                        F.substring(masked, x["brace"] + 1, F.char_length(masked)).alias("rest"))

    def closed(x: Column) -> Column:
        return F.struct(x["at"].alias("at"), x["line"].alias("line"), x["brace"].alias("brace"), (x["brace"] + T.closing(x["rest"], "{}")).alias("close"))

    def block(x: Column) -> Column:
        return F.struct(x["at"].alias("at"), x["line"].alias("line"), x["close"].alias("close"),
                        F.substring(body, x["brace"] + 1, x["close"] - x["brace"] + 1).alias("block"))

    def caught(x: Column) -> Column:
        logged = F.contains(x["block"], F.lit("printStackTrace")) | F.rlike(x["block"], F.lit(T.unicode(P.ERROR_LOG)))
        return F.struct(x["at"].alias("at"), x["line"].alias("line"), F.lit("TRY_CATCH").alias("kind"),
                        T.newlines(F.left(masked, x["close"])).alias("end"), logged.alias("logged"))

    def thrown(m: Column) -> Column:
        lo = F.greatest(F.lit(0), m["at"] - 200)
        logged = F.rlike(F.substring(body, lo + 1, m["at"] - lo), F.lit(T.unicode(P.ERROR_LOG)))
        return F.struct(m["at"].alias("at"), m["line"].alias("line"), F.lit("THROW").alias("kind"), m["line"].alias("end"), logged.alias("logged"))

    def found_of(pattern: str, first: str, *steps) -> Column:
        found = T.places("masked_body", T.unicode(pattern, first))
        for step in steps:
            found = F.transform(found, step)
        return found.cast(kind)

    # By line; on one line catch blocks come before throws.
    found = F.concat(found_of(P.CATCH, "c", opened, ahead, closed, block, caught), found_of(P.THROW, "t", thrown))
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(
        (F.col("body_line") + x["line"]).alias("start_line"), (x["kind"] == "THROW").cast("int").alias("k"), x["at"].alias("at"), x["kind"].alias("kind"),
        (F.col("body_line") + x["end"]).alias("end_line"), x["logged"].alias("logged"))))
    plain = F.transform(ordered, lambda x, i: F.struct(
        x["start_line"].alias("start_line"), i.alias("exc_ord"), x["kind"].alias("kind"), x["end_line"].alias("end_line"), x["logged"].alias("has_error_logging")))
    df = df.withColumn("exceptions", plain)
    covered = F.exists("logs", lambda x: x["level"].isin("ERROR", "WARN")) | F.exists("exceptions", lambda x: x["has_error_logging"])
    clause = F.struct(F.col("start_line").alias("start_line"), F.size("exceptions").alias("exc_ord"), F.lit("THROWS").alias("kind"),
                      F.col("start_line").alias("end_line"), covered.alias("has_error_logging"))
    return df.withColumn("exceptions", F.when(F.col("throws"), F.concat("exceptions", F.array(clause))).otherwise(F.col("exceptions")))


def detected(df: DataFrame) -> DataFrame:
    """Methods with ops, logs and exceptions."""
    return with_exceptions(with_logs(with_operations(df)))
