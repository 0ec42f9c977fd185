from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_secrets(spark):
    assert one(spark, 'password = "abc", api_key: zzz; TOKEN=1', T.mask_secrets) == 'password=***MASKED***", api_key=***MASKED***; TOKEN=***MASKED***'
    assert one(spark, "AKIA" + "A1" * 8 + " jdbc:pg://h/d?user=me&x=1", T.mask_secrets) == "***MASKED_AWS_KEY*** jdbc:pg://h/d?user=***MASKED***&x=1"
    assert one(spark, None, T.mask_secrets) is None


def test_sensitive_terms(spark):
    assert one(spark, "Patient emails e_mail SSN ssn filter_name", T.sensitive_terms) == ["e_mail", "patient", "ssn"]
    assert one(spark, None, T.sensitive_terms) == []


def test_fields(spark):
    df = spark.createDataFrame([(["run_id", "patient_name", "left_count", "diagnosis"],)], "f array<string>")
    r = df.select(T.safe_fields(F.col("f")).alias("s"), T.rejected_fields(F.col("f")).alias("r")).first()
    assert (r.s, r.r) == (["run_id", "left_count"], ["patient_name", "diagnosis"])


def test_do_not_log_is_capped_and_distinct(spark):
    df = spark.createDataFrame([(["A", " a ", "", "b", "c", "d"], ["e"])], "x array<string>, y array<string>")
    assert df.select(T.do_not_log(F.col("x"), F.col("y")).alias("d")).first().d[5:] == ["A", "b", "c"]


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab.\né😀", max_size=20), min_size=1, max_size=20))
def test_places_are_those_of_a_regex_iterator(spark, texts):
    import re

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.places("t", r"a+\.?").alias("p"))
    for r in df.collect():
        assert [(p.at, p.line) for p in r.p] == [(m.start(), r.t.count("\n", 0, m.start())) for m in re.finditer(r"a+\.?", r.t)]


def test_needed_texts_are_in_every_match():
    assert T.needed(r"(?U)\.\s*join\s*\(|\.\s*crossJoin\s*\(") == ("join", "crossJoin")
    assert T.needed(r"\bthrow\s+new\b|\bthrow\s+\w+\s*;") == ("throw",)
    assert T.needed(r"\b(?:Kafka|Jms)Template\b\s*\.\s*\w+\s*\(") == ("Template",)
    assert T.needed(r"(?:ab|c)?x*") == () and T.needed(r"(?i)abc") == () and T.needed(r"(?i:abc)") == () and T.needed(r"ab|[cd]") == ()
