"""Control characters in a text are ordinary characters."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.java import parsed
from tracewell.functions import text as T
from tracewell.operators import structure


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="a{}\n\u0001\u0002é😀", max_size=30), min_size=1, max_size=60))
def test_places_of_texts_with_any_characters(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: [(m["at"], m["line"], m["part"]) for m in r.m] for r in df.select("k", T.places("t", r"\{").alias("m")).collect()}
    for k, t in enumerate(texts):
        at = [m.start() for m in re.finditer(r"\{", t)]
        assert got[k] == [(i, t[:i].count("\n"), t[i:j]) for i, j in zip(at, [*at[1:], len(t)])]


def test_hashes_are_of_the_untouched_content(spark):
    df = spark.createDataFrame([("a.java", "class A {}"), ("b.java", "class \u0001A {}")], "path string, content string")
    assert structure.files(df).select("file_hash").distinct().count() == 2


def test_numbers_are_those_of_one_sort(spark):
    body = "\n".join(f"df{k}.join(x);" for k in range(30))
    java = "import org.apache.spark.sql.Dataset;\nclass A {{ void run{0}() {{\n{1}\n}} }}"
    from tracewell.operators.contract import numbered

    found = parsed(spark, *[(f"F{k}.java", java.format(k, body)) for k in range(6)]).findings
    rows = numbered(found).orderBy("finding_no").collect()
    rank = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
    keys = [(rank[r.priority], r.path, r.line, r.method_ord, r.emit, r.sub) for r in rows]
    assert [r.finding_no for r in rows] == list(range(1, len(rows) + 1)) and keys == sorted(keys) and len(rows) >= 180
    two = found.withColumn("scan_id", F.lit(1)).union(found.withColumn("scan_id", F.lit(2)))
    got = numbered(two).groupBy("scan_id").agg(F.min("finding_no").alias("a"), F.max("finding_no").alias("b"), F.count_distinct("finding_no").alias("n")).collect()
    assert all((r.a, r.b, r.n) == (1, len(rows), len(rows)) for r in got)
