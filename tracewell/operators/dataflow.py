"""Where lazy operations run: statements, assignments and the reach of actions.

Statements are split natively. The closure over a method's assignments is a walk
over a small graph that belongs to one row; it is an Arrow-batched function on
the arrays of the row (no shuffle), called for methods that have an action.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from tracewell import patterns as P
from tracewell.functions import text as T

_STMT = "array<struct<at:int,text:string>>"


def statements(masked: Column, acts: Column) -> Column:
    """Statements of a method body: array of (line from 0, text, has_action); acts says whether the body holds an action at all."""
    parts = F.split(masked, r"(?=[(){};])", -1)
    start = F.struct(F.lit(0).alias("round"), F.lit(0).alias("brace"), F.lit(0).alias("at"), F.lit(0).alias("line"), F.lit(0).alias("from"),
                     F.lit("").alias("text"), F.array().cast("array<struct<line:int,text:string>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        c = F.left(p, F.lit(1))
        round_ = s["round"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        brace = s["brace"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        cut = (c == ";") & (s["round"] <= 0) & (s["brace"] <= 1)
        return F.struct(
            round_.alias("round"), brace.alias("brace"), (s["at"] + F.char_length(p)).alias("at"), (s["line"] + T.newlines(p)).alias("line"),
            F.when(cut, s["line"]).otherwise(s["from"]).alias("from"),
            F.when(cut, F.substring(p, F.lit(2), F.char_length(p))).otherwise(F.concat(s["text"], p)).alias("text"),
            F.when(cut, F.concat(s["out"], F.array(F.struct(s["from"].alias("line"), s["text"].alias("text"))))).otherwise(s["out"]).alias("out"))

    pieces = F.aggregate(parts, start, step, lambda s: F.concat(s["out"], F.array(F.struct(s["from"].alias("line"), s["text"].alias("text")))))

    def trimmed(x: Column) -> Column:
        text = F.ltrim(x["text"], F.lit(" \t\r\n{}"))
        skipped = F.left(x["text"], F.char_length(x["text"]) - F.char_length(text))
        return F.struct((x["line"] + T.newlines(skipped)).alias("line"), T.strip(F.ltrim(T.strip(text), F.lit("{}"))).alias("text"))

    def read(x: Column) -> Column:
        return F.struct(x["line"].alias("line"), x["text"].alias("text"), F.when(acts, F.rlike(x["text"], F.lit(T.unicode(P.ACTION)))).otherwise(False).alias("has_action"))

    return F.transform(F.filter(F.transform(pieces, trimmed), lambda x: x["text"] != ""), read)


def assignments(stmts: Column) -> Column:
    """Statements as nodes of a graph: array of (line, lhs or null, refs, has_action)."""
    def read(x: Column) -> Column:
        lhs = F.when(F.contains(x["text"], F.lit("=")), T.extract(x["text"], F.lit(T.unicode(P.ASSIGNMENT)), F.lit(1))).otherwise("")
        return F.struct(x["line"].alias("line"), lhs.alias("lhs"), x["text"].alias("text"), x["has_action"].alias("has_action"))

    def node(x: Column) -> Column:
        rhs = F.when(x["lhs"] != "", T.extract(x["text"], F.lit(T.unicode(P.ASSIGNMENT)), F.lit(2))).otherwise(x["text"])
        return F.struct(
            x["line"].alias("line"), F.nullif(x["lhs"], F.lit("")).alias("lhs"),
            F.array_distinct(F.regexp_extract_all(rhs, F.lit(T.unicode(P.IDENTIFIER)), F.lit(0))).alias("refs"), x["has_action"].alias("has_action"))

    return F.transform(F.transform(stmts, read), node)


def reached(stmts: list) -> list[tuple[int, int]]:
    """(line, least line of an action that its value reaches) for the lines that reach one.

    A line passes its value on through its first statement; a name means its last assignment.
    """
    assigned = {s["lhs"]: int(s["line"]) for s in stmts if s["lhs"]}
    first: dict[int, dict] = {}
    for s in stmts:
        first.setdefault(int(s["line"]), s)
    least: dict[int, int] = {}
    # Actions by rising line: the first that reaches a line is the least, so each line is walked once.
    for s in sorted((s for s in stmts if s["has_action"]), key=lambda s: int(s["line"])):
        line, todo = int(s["line"]), [(int(s["line"]), s)]
        least.setdefault(line, line)
        while todo:
            at, stmt = todo.pop()
            for src in {assigned[r] for r in stmt["refs"] if r in assigned} - {at}:
                if src not in least:
                    least[src] = line
                    todo.append((src, first[src]))
    return sorted(least.items())


_REACH = types.ArrayType(types.StructType([types.StructField("line", types.IntegerType()), types.StructField("action", types.IntegerType())]))


@F.pandas_udf(_REACH)
def _reached_of(stmts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in stmts:
        yield batch.map(lambda s: [] if s is None else [{"line": a, "action": b} for a, b in reached(list(s))])


# Declared nondeterministic only so that the optimizer neither repeats it nor moves it into other operators.
_reached = _reached_of.asNondeterministic()


def annotated(df: DataFrame) -> DataFrame:
    """df whose ops also have is_action, lazy and materialized_at."""
    df = df.withColumn("_acts", F.expr(T.may_match("masked_body", P.ACTION)) & F.rlike("masked_body", F.lit(T.unicode(P.ACTION))))
    df = df.withColumn("stmts", F.when(F.exists("ops", lambda o: ~o["is_io"]), statements(F.col("masked_body"), F.col("_acts"))))
    # Only statements that matter are read further and cross to Python.
    df = df.withColumn("_graph", F.when(F.exists("stmts", lambda s: s["has_action"]), assignments(F.col("stmts"))))
    df = df.withColumn("_reach", _reached("_graph"))

    def place(o: Column) -> Column:
        rel = o["line"] - F.col("body_line")
        hosts = F.filter("stmts", lambda s: s["line"] <= rel)
        line = F.array_max(F.transform(hosts, lambda s: s["line"]))
        host = F.get(F.filter(hosts, lambda s: s["line"] == line), F.lit(0))
        at = F.get(F.transform(F.filter("_reach", lambda r: r["line"] == line), lambda r: r["action"]), F.lit(0))
        is_action, is_read = o["operation_type"].isin(*P.ACTIONS), o["operation_type"].isin(*P.READS)
        lazy = ~is_action & ~is_read & host.isNotNull()
        return F.struct(
            o["line"].alias("line"), o["is_io"].alias("is_io"), o["operation_type"].alias("operation_type"), o["priority"].alias("priority"), o["snippet"].alias("snippet"),
            is_action.alias("is_action"), F.coalesce(lazy, F.lit(False)).alias("lazy"),
            F.when(is_action, o["line"]).when(lazy, F.col("body_line") + F.when(host["has_action"], line).otherwise(at)).alias("materialized_at"))

    return df.withColumn("ops", F.transform("ops", place)).drop("_acts", "_graph", "_reach", "stmts")
