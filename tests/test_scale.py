"""Plans and work that must keep pace with the input."""

import pytest
from pyspark.sql import functions as F

from tests.java import body
from tracewell.operators.contract import numbered
from tracewell.operators.report import deferred, orphans
from tracewell.plans import taxonomy
from tracewell.plans.scan import analyse

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(taxonomy.QUERIES))
def test_taxonomy_is_dealt_out(spark, name):
    """A table of one file is not one task's work (findings F1, F2, F3, F6, F8 of round 3)."""
    assert taxonomy.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4


def _reads(spark, query) -> int:
    """How many rows of sources the query's tasks read in all."""
    seen = spark.sparkContext.accumulator(0)

    def once(text):
        seen.add(1)
        return text

    rows = [(f"src/P{k}.java", body("    in.join(b);\n    Dataset<Row> a = in.filter(x);\n    a.count();")) for k in range(40)]
    sources = spark.createDataFrame(rows, "path string, content string").repartition(4)
    # Nondeterministic, so that it's neither repeated within a pass nor left out.
    counted = sources.withColumn("content", F.udf(once).asNondeterministic()("content"))
    query(analyse(counted)).write.format("noop").mode("overwrite").save()
    return seen.value


@pytest.mark.parametrize("query", [lambda a: orphans(a.methods), lambda a: deferred(a.methods), lambda a: numbered(a.findings)], ids=["orphans", "deferred", "numbered"])
def test_order_does_not_double_the_analysis(spark, query):
    """A range partitioning samples its input; the analysis must not run for the sample as well (findings F4, F5, F9 of round 3)."""
    assert _reads(spark, query) == 40
