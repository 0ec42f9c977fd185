import pytest
from pyspark.sql import functions as F

from tests.java import PIPELINE, SPARK, body, finding_rows, parsed
from tracewell.operators import contract as C


def test_priorities_quality_and_order(spark):
    got = [(f["priority"], f["category"], f["line"], f["logging_quality"], f["execution_line"]) for f in finding_rows(spark, PIPELINE)]
    assert got == [
        ("HIGH", "PARQUET_READ", 10, "WEAK", None), ("HIGH", "PARQUET_READ", 11, "WEAK", None), ("HIGH", "FILTER", 12, "WEAK", 14),
        ("HIGH", "JOIN", 13, "WEAK", 14), ("HIGH", "PARQUET_WRITE", 15, "WEAK", 15), ("HIGH", "EXCEPTION", 16, "WEAK", None),
        ("HIGH", "EXCEPTION", 25, "MISSING", None), ("MEDIUM", "SPARK_ACTION", 22, "MISSING", 22)]


@pytest.mark.parametrize("gap, quality", [(7, "WEAK"), (8, "MISSING")])
def test_logs_count_within_eight_lines(spark, gap, quality):
    code = '    log.info("x");\n' + "\n" * gap + "    in.join(b);"
    assert finding_rows(spark, body(code))[0]["logging_quality"] == quality


def test_good_quality_needs_half_of_the_fields(spark):
    log = '    log.info("run_id={} left_count={} right_count={} output_count={}", a);\n'
    assert finding_rows(spark, body(log + "    in.join(b);"))[0]["logging_quality"] == "GOOD"
    assert finding_rows(spark, body('    log.info("run_id={} left_count={}", a);\n    in.join(b);'))[0]["logging_quality"] == "PARTIAL"


def test_logs_near_the_execution_count(spark):
    code = "    Dataset<Row> j = in.join(b);\n" + "\n" * 20 + '    j.count();\n    log.info("n={}", n);'
    assert [f["logging_quality"] for f in finding_rows(spark, body(code))] == ["PARTIAL", "PARTIAL"]


def test_job_completion(spark):
    code = SPARK + 'class M {\n  static void main(String[] a) {\n    SparkSession s = SparkSession.builder().getOrCreate();\n' + "\n" * 12 + "{}  }}\n}}\n"
    kinds = lambda end: {(f["category"], f["priority"]) for f in finding_rows(spark, code.replace("{}  }}\n}}", end + "  }\n}"))}
    assert kinds("") == {("JOB_START", "HIGH"), ("JOB_COMPLETION", "HIGH")}
    assert kinds('    log.info("status={}", x);\n') == {("JOB_START", "HIGH")}


def test_fingerprints_ignore_white_space_and_case(spark):
    a, b = (finding_rows(spark, ("p/A.java", body(c)))[0]["fingerprint"] for c in ("    in.join(b);", "    IN . JOIN".replace("JOIN", "join") + "( b );"))
    assert len(a) == 16 and a == b


def test_scores(spark):
    s = parsed(spark, PIPELINE).scores().first()
    assert (s.job_lifecycle, s.input_visibility, s.transformation_visibility, s.join_visibility, s.output_visibility) == (15.0, 0.0, 0.0, 0.0, 0.0)
    assert (s.exception_visibility, s.structured_logging, s.run_correlation, s.overall_score) == (0.0, 0.0, 0.0, 15.0)


def test_plain_java_leaves_spark_parts_out(spark):
    s = parsed(spark, 'class A { void f() { log.info("run_id={}", x); } }').scores("java").first()
    assert list(s.not_applicable) == ["input_visibility", "job_lifecycle", "join_visibility", "transformation_visibility"]
    assert s.overall_score == 100.0


def test_nothing_at_all(spark):
    a = parsed(spark, ("a.java", ""))
    assert a.findings.count() == 0
    assert a.scores().first().overall_score == 85.0


def test_readiness_and_risk(spark):
    rows = [("a", "HIGH", True, "GOOD"), ("a", "LOW", False, "MISSING"), ("b", "HIGH", True, "WEAK"), ("c", "MEDIUM", True, "PARTIAL")]
    df = spark.createDataFrame(rows, "path string, priority string, existing_logging boolean, logging_quality string")
    got = {r.path: (r.ai_readiness, r.risk) for r in C.readiness(df, "path").collect()}
    assert got == {"a": (75.0, "LOW"), "b": (0.0, "HIGH"), "c": (100.0, "LOW")}


def test_own_contract(spark, tmp_path):
    p = tmp_path / "rules.yaml"
    p.write_text('version: "7"\nproximity_lines: 0\nrules:\n  only.join: {priority: low, spark_ops: [JOIN], fields: [a]}\n')
    from tracewell.plans.scan import analyse

    df = spark.createDataFrame([("A.java", body('    log.info("x");\n    in.join(b);\n    in.count();'))], "path string, content string")
    f = analyse(df, C.Contract.load(str(p))).findings.collect()
    assert [(x.category, x.rule_id, x.priority, x.logging_quality) for x in f] == [("JOIN", "only.join@7", "HIGH", "MISSING")]


def test_detection_matrix(spark):
    m = C.detection_matrix(parsed(spark, PIPELINE).methods).where(F.col("name") == "load").first()
    assert (m.input, m.join, m.filter, m.aggregation, m.output, m.external_io, m.structured_logging, m.exception_context, m.run_correlation) == (
        True, True, True, False, True, False, False, False, False)
