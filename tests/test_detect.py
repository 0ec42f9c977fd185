from tests.java import PIPELINE, SPARK, body, finding_rows, method_rows, ops, parsed


def test_literals_and_comments_are_no_operations(spark):
    assert ops(spark, '    String s = ".join( .groupBy(";\n    // a.join(b)\n    /* a.groupBy( */') == []


def test_jdk_streams_are_no_operations(spark):
    code = '    List<String> x = names.stream().filter(a -> a.isEmpty()).map(a -> a).distinct().collect(toList());'
    assert ops(spark, code) == []


def test_ambiguous_calls_need_spark(spark):
    code = "class R {\n  void f(Repo repository, Order o) { repository.save(); orders.filter(o); }\n}\n"
    assert method_rows(spark, code)[0]["ops"] == []
    assert {x for x, _ in ops(spark, "    in.filter(a);\n    in.save();")} == {"FILTER", "DATASET_WRITE"}


def test_strong_calls_need_no_context(spark):
    code = "class R {\n  void f(D a) {\n    a.join(b);\n    a.groupBy(c);\n    a.dropDuplicates();\n  }\n}\n"
    assert [o["operation_type"] for o in method_rows(spark, code)[0]["ops"]] == ["JOIN", "GROUP_BY", "DEDUPLICATION"]


def test_every_label(spark):
    calls = {
        "JOB_START": "SparkSession.builder().getOrCreate();", "DATASET_READ": 'spark.table("t");', "DATASET_WRITE": "in.write().csv(p);", "JOIN": "in.crossJoin(b);",
        "FILTER": "in.where(c);", "GROUP_BY": "in.rollup(c);", "AGGREGATION": "in.agg(c);", "DEDUPLICATION": "in.distinct();", "REPARTITION": "in.coalesce(1);",
        "SORT": "in.sort(c);", "UNION": "in.unionByName(b);", "MAP": "in.flatMap(f);", "WITH_COLUMN": "in.withColumnRenamed(a, b);", "SELECT": "in.drop(c);",
        "SPARK_ACTION": "in.show();", "EXTERNAL_IO": "new FileInputStream(p);",
    }
    for label, (found, line) in zip(calls, ops(spark, "\n".join("    " + c for c in calls.values()))):
        assert found == label, (found, label)


def test_parquet_replaces_the_general_label(spark):
    code = '    spark.read().parquet(a);\n    in.write().mode(m).format("parquet").save(b);'
    assert ops(spark, code) == [("PARQUET_READ", 5), ("PARQUET_WRITE", 6)]


def test_one_external_io_for_a_line(spark):
    code = '    Connection c = DriverManager.getConnection(u); InputStream i = new FileInputStream(f);\n    producer.send(topic, x);\n    Files.readString(p);'
    m = method_rows(spark, body(code))[0]
    io = [(o["line"], o["snippet"].split("]")[0]) for o in m["ops"] if o["operation_type"] == "EXTERNAL_IO"]
    assert io == [(5, "[jdbc"), (6, "[messaging"), (7, "[file")]


def test_logs(spark):
    code = (
        '    logger.warning("left={} right={}", l, r);\n    LOG.severe(message, patientId);\n    log.info("patient={}", patient);\n'
        '    auditLog.finest("' + "x" * 90 + '");\n    log.debug("a=" + f(b, (c)), d);\n    log.info("done", response);'
    )
    logs = method_rows(spark, body(code))[0]["logs"]
    assert [(x["line"], x["level"], x["structured"], x["sensitive"]) for x in logs] == [
        (5, "WARN", True, False), (6, "ERROR", True, False), (7, "INFO", True, True), (8, "TRACE", False, False), (9, "DEBUG", True, False), (10, "INFO", False, True)]
    assert [x["message_pattern"] for x in logs][:4] == ['"left={} right={}"', "message", '"patient={}"', '"..."']


def test_exceptions(spark):
    code = SPARK + """class A {
  void f() throws IOException {
    try { g(); } catch (A e) { log.error("x"); }
    try { g(); } catch (B e) {
      e.printStackTrace();
    }
    try { g(); } catch (C e) { h(); }
    throw new X();
  }
}
"""
    e = method_rows(spark, code)[0]["exceptions"]
    assert [(x["kind"], x["start_line"], x["end_line"], x["has_error_logging"]) for x in e] == [
        ("TRY_CATCH", 5, 5, True), ("TRY_CATCH", 6, 8, True), ("TRY_CATCH", 9, 9, False), ("THROW", 10, 10, True), ("THROWS", 4, 4, True)]


def test_throws_without_logs_is_a_finding(spark):
    code = SPARK + "class A {\n  void f() throws IOException { g(); }\n}\n"
    assert [(f["category"], f["snippet"]) for f in finding_rows(spark, code)] == [("EXCEPTION", "method f() declares checked exceptions, no error logging")]
    logged = SPARK + 'class A {\n  void f() throws IOException { log.warn("x"); }\n}\n'
    assert finding_rows(spark, logged) == []


def test_lazy_operations_run_at_the_action(spark):
    m = method_rows(spark, PIPELINE)[0]
    got = {o["operation_type"]: (o["line"], o["lazy"], o["materialized_at"]) for o in m["ops"]}
    # The action's statement begins at the try block.
    assert got["JOIN"] == (13, True, 14) and got["FILTER"] == (12, True, 14)
    assert got["PARQUET_READ"][1:] == (False, None) and got["PARQUET_WRITE"] == (15, False, 15)


def test_orphans_and_cycles(spark):
    orphan = method_rows(spark, body("    return in.filter(a).join(b);"))[0]["ops"]
    assert [(o["lazy"], o["materialized_at"]) for o in orphan] == [(True, None)] * 2
    cycle = method_rows(spark, body("    a = b.join(c);\n    b = a.join(c);\n    a.count();"))[0]["ops"]
    assert {(o["line"], o["materialized_at"]) for o in cycle} == {(5, 7), (6, 7), (7, 7)}


def test_first_action_wins(spark):
    code = "    Dataset<Row> j = in.join(b);\n    j.count();\n    j.write().parquet(p);"
    assert method_rows(spark, body(code))[0]["ops"][0]["materialized_at"] == 6


def test_no_shuffle_before_the_findings(spark):
    plan = parsed(spark, PIPELINE).findings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
