import json

import pytest
from pyspark.sql import functions as F

from tests.java import PIPELINE
from tracewell import cli
from tracewell.config import Config
from tracewell.operators import advise, store
from tracewell.sources import corpus
from tracewell.streaming.incremental import arriving, scan_stream


class Scripted(advise.Provider):
    """Answers as told; the last answer repeats."""

    name = "scripted"

    def __init__(self, *answers):
        self.answers = answers

    def is_available(self):
        return True

    def list_models(self):
        return ["m:1"]

    def generate(self, model, prompt, system="", temperature=0.1, json_format=True):
        n = 1 if "was not one JSON object" in prompt else 0
        text = self.answers[min(n, len(self.answers) - 1)]
        if text is None:
            raise advise.TransportError("down")
        return advise.Answer(text, 12, 7, 33)


GOOD = json.dumps({"recommend": True, "priority": "high", "reason": "r", "recommended_fields": ["run_id", "patient_name"], "do_not_log": "x; y", "ai_usefulness": "HIGH", "ai_use_cases": None})


@pytest.fixture
def project(tmp_path):
    for path, text in {
        "src/main/java/a/Visits.java": PIPELINE, "x/src/test/java/a/VisitsTest.java": PIPELINE, "target/Gone.java": PIPELINE, ".github/Gone.java": PIPELINE,
        "pom.xml": "<maven.compiler.source>17</maven.compiler.source><spark.version>3.5.1</spark.version> spark-sql slf4j-api",
    }.items():
        p = tmp_path / "proj" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path


def config(tmp_path, llm=False):
    c = Config()
    c.data["database"]["path"], c.data["output"]["dir"], c.data["cache"]["dir"] = (str(tmp_path / x) for x in ("store", "report", "cache"))
    c.data["llm"].update(enabled=llm, model="m:1")
    return c


def test_sources_and_project(spark, project):
    src = corpus.read_tree(spark, str(project / "proj"))
    assert [r.path for r in src.orderBy("path").collect()] == ["src/main/java/a/Visits.java", "x/src/test/java/a/VisitsTest.java"]
    assert corpus.read_tree(spark, str(project / "proj"), include=("src/**",), exclude=("**/b/*.java",)).count() == 1
    info = corpus.project_info(src, corpus.read_build(spark, str(project / "proj")), "proj", "/p").first()
    assert (info.build_system, info.java_version, info.spark_version, info.project_type) == ("Maven", "17", "3.5.1", "java-spark")
    assert (list(info.frameworks), list(info.logging_frameworks), info.java_files, info.test_files) == (["Apache Spark", "Spark SQL"], ["SLF4J"], 2, 1)


def test_scan_store_and_carry_forward(spark, project):
    cfg = config(project)
    one, paths = cli.scan(spark, str(project / "proj"), cfg)
    s = store.Store(spark, cfg.database["path"])
    found = s.findings().orderBy("finding_no").collect()
    assert len(found) == 8 and {f.status for f in found} == {"OPEN"}
    join = next(f for f in found if f.category == "JOIN")
    assert s.set_status(join.id, "ACCEPTED") and not s.set_status(99, "ACCEPTED")
    with pytest.raises(ValueError):
        s.set_status(join.id, "WHATEVER")
    two, _ = cli.scan(spark, str(project / "proj"), cfg)
    again = s.findings().where(F.col("scan_id") == two).collect()
    assert [f.category for f in again if f.status == "ACCEPTED"] == ["JOIN"] and s.projects().count() == 1
    doc = json.loads(open(paths[1]).read())
    assert [f["id"] for f in doc["findings"]] == list(range(1, 9)) and doc["summary"]["findings_count"] == 8
    held = {i for f in doc["files"] for c in f["classes"] for m in c["methods"] for i in m["finding_ids"]}
    assert held == set(range(1, 9)) and doc["files"][0]["counts"] == {"HIGH": 7, "MEDIUM": 1, "LOW": 0}
    page = open(paths[2]).read()
    assert "http" not in page.split("<script type")[0] and "<Row>" not in page.split('id="data">')[1].split("</script>")[0]


def test_commands(spark, project, capsys):
    db, out = str(project / "s"), str(project / "r")
    run = lambda *a: cli.main([*a, "--database", db], spark)
    assert run("init") == 0
    assert run("history") == 0 and "No scans" in capsys.readouterr().out
    assert run("scan", "--project", str(project / "proj"), "--no-llm", "--output", out) == 0
    assert "Observability score: 15.0/100" in capsys.readouterr().out
    assert run("findings", "--priority", "medium") == 0 and "SPARK_ACTION" in capsys.readouterr().out
    assert run("finding", "reject", "10000004") == 0 and run("finding", "show", "10000004") == 0
    assert "(REJECTED)" in capsys.readouterr().out
    assert run("compare", "--scan", "1") == 2 and run("compare", "--scan", "1", "--scan", "9") == 2
    assert run("report", "--scan", "1", "--output", out) == 0 and run("report", "--scan", "5", "--output", out) == 2
    assert run("scan", "--project", "/nowhere", "--no-llm") == 2
    assert run("scan", "--project", str(project / "proj"), "--host", "http://example.com:1") == 2


def test_model_pass_cache_and_runs(spark, project):
    cfg = config(project, llm=True)
    one, _ = cli.scan(spark, str(project / "proj"), cfg, Scripted("no json", "```json\n" + GOOD[:-1] + ",}\n```"))
    s = store.Store(spark, cfg.database["path"])
    stats = store.run_stats(s.read("llm_runs").where(F.col("scan_id") == one)).first()
    # Seven HIGH findings; each took two attempts, of which both count.
    assert (stats.runs, stats.ok, stats.failed, stats.cache_hits, stats.avg_ms, stats.input_tokens, stats.output_tokens) == (7, 7, 0, 0, 66.0, 168, 98)
    rec = s.finding(one * store.ID_SPAN + 1)["recommendation"]
    assert rec["recommended_fields"] == ["run_id"] and rec["priority"] == "HIGH" and rec["ai_use_cases"] == []
    assert rec["do_not_log"][5:] == ["x", "y", "patient_name"]
    two, _ = cli.scan(spark, str(project / "proj"), cfg, Scripted(None))
    runs = s.read("llm_runs").where(F.col("scan_id") == two)
    assert {r.status for r in runs.collect()} == {"CACHE_HIT"} and advise.llm_cache_rows(runs).count() == 7


def test_model_failures_fall_back(spark, project):
    cfg = config(project, llm=True)
    cfg.data["llm"]["cache_enabled"] = False
    for provider, error in ((Scripted(None), "transport"), (Scripted("nothing"), "invalid_json")):
        n, _ = cli.scan(spark, str(project / "proj"), cfg, provider)
        s = store.Store(spark, cfg.database["path"])
        runs = s.read("llm_runs").where(F.col("scan_id") == n).collect()
        assert {(r.status, r.error_type) for r in runs} == {("LLM_ANALYSIS_FAILED", error)}
        assert s.finding(n * store.ID_SPAN + 1)["recommendation"]["reason"].startswith("[deterministic only]")


@pytest.mark.parametrize("text, want", [
    ('noise {"priority": "weird", "recommended_fields": "a, b;c", "do_not_log": null,} tail', ("MEDIUM", ["a", "b", "c"], [])),
    ('{"priority": "low", "recommended_fields": ["x", "y"], "do_not_log": {}}', ("LOW", ["x", "y"], [])),
    ("no object", None), ("{broken", None), (None, None), ("[1]", None),
])
def test_answers(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(advise.parse_answer(F.col("t")).alias("a")).first().a
    assert (r and (r.priority, list(r.recommended_fields), list(r.do_not_log))) == want
    assert advise.looks_like_json(text or "") == (want is not None)


def test_evaluation(spark):
    checks, summary = advise.run_eval(spark, Scripted(GOOD), "m:1")
    got = summary.first()
    # Every case is found; the one that should not be recommended fails.
    assert checks.where("finding_detected").count() == 7 and got.cases == 7 and got.clean_cases == 6 and got.checks_run == 42


def test_benchmark(spark, project):
    from tracewell.operators.contract import numbered

    info, analysis, sources = cli.pass_one(spark, str(project / "proj"), config(project))
    rows = advise.benchmark(numbered(analysis.findings), analysis.methods, sources, info.first().asDict(), Scripted(GOOD), ["m:1", "gone:2"])
    assert rows[1] == {"model": "gone:2", "available": False}
    assert (rows[0]["analysed"], rows[0]["ok"], rows[0]["structured_output_rate"], rows[0]["avg_response_ms"], rows[0]["llm_calls"]) == (7, 7, 1.0, 33.0, 7)


def test_incremental_scan(spark, project, tmp_path):
    out = str(tmp_path / "found")
    for _ in range(2):
        scan_stream(arriving(spark, str(project / "proj" / "src")), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 8


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("llm: {model: a, host: 'http://10.0.0.1:1'}\n")
    c = Config.load(str(p))
    c.override(model="b", llm_limit=3, exclude=["gen", "**/x/*"])
    assert c.llm["model"] == "b" and c.llm["limit"] == 3 and c.llm["temperature"] == 0.1
    assert c.scan["ignore_dirs"][-1] == "gen" and c.scan["exclude_globs"] == ["**/x/*"]
    with pytest.raises(ValueError):
        c.check_endpoint()
    c.data["privacy"]["allow_external_llm"] = True
    c.check_endpoint()
