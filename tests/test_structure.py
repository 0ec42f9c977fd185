import random

from pyspark.sql import functions as F

from tests.java import PIPELINE, SPARK, method_rows, parsed
from tracewell.functions import text as T


def mask_by_hand(src):
    """Independent of the patterns: one state for each kind of literal."""
    out, state, i = [], "", 0
    ends = {"line": "\n", "block": "*/", "text": '"""', "str": '"', "chr": "'"}
    while i < len(src):
        if not state:
            for name, opening in (("line", "//"), ("block", "/*"), ("text", '"""'), ("str", '"'), ("chr", "'")):
                if src.startswith(opening, i):
                    state, step = name, len(opening)
                    break
            else:
                out.append(src[i])
                i += 1
                continue
            out.append(" " * step)
            i += step
        elif state == "line" and src[i] == "\n":
            state = ""
        elif state in ("str", "chr") and src[i] == "\\":
            out.append("".join(c if c == "\n" else " " for c in src[i : i + 2]))
            i += 2
        elif state != "line" and src.startswith(ends[state], i):
            out.append(" " * len(ends[state]))
            i += len(ends[state])
            state = ""
        else:
            out.append("\n" if src[i] == "\n" else " ")
            i += 1
    return "".join(out)


def test_mask_equals_a_state_machine(spark):
    rng = random.Random(3)
    pieces = ['"', "'", "\\", "//", "/*", "*/", '"""', "\n", "a", "{", "é", "😀", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    # A backslash before a line feed keeps the line feed in both.
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.mask_literals(F.col("t")).alias("m"))
    for r in df.collect():
        assert r.m == mask_by_hand(r.t), repr(r.t)


def test_brace_pairs_equal_a_stack(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("{}a\n") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.places("t", r"\{").alias("p"))
    df = df.select("t", F.transform("p", lambda m: F.struct(m["at"].alias("at"), (m["at"] + T.closing(F.substring("t", m["at"] + 1, F.length("t")), "{}")).alias("c"))).alias("p"))
    for r in df.collect():
        want, open_ = {}, []
        for i, c in enumerate(r.t):
            if c == "{":
                open_.append(i)
            elif c == "}" and open_:
                want[open_.pop()] = i
        assert {p.at: p.c for p in r.p} == {i: want.get(i, len(r.t) - 1) for i, c in enumerate(r.t) if c == "{"}


def test_methods_types_and_signatures(spark):
    a = parsed(spark, PIPELINE)
    f = a.files.first()
    assert (f["package"], f["imports"], f["classes"], f["is_test"]) == ("a.b", ["org.apache.spark.sql.*"], ["Visits", "Inner"], False)
    assert f["line_count"] == PIPELINE.count("\n") + 1
    got = [(m["name"], m["class_name"], m["return_type"], m["parameters"]) for m in method_rows(spark, PIPELINE)]
    # Parameters are split at commas before which no bracket closes; nested type arguments are cut.
    assert got == [
        ("load", "Visits", "Dataset<Row>", ["SparkSession spark", "String path"]),
        ("size", "Visits", "long", ["Dataset<Row> df"]),
        ("Inner", "Inner", "<constructor>", ["int x", "Map<String", "List<Integer>> m"]),
    ]


def test_lines_of_a_long_signature(spark):
    code = SPARK + "class A {\n  @Override\n  public void run(\n      Dataset<Row> a,\n      Dataset<Row> b)\n  {\n    a.join(b);\n    log.info(\"x\");\n  }\n}\n"
    m = method_rows(spark, code)[0]
    assert (m["start_line"], m["end_line"], m["body_line"], m["annotations"]) == (5, 11, 8, ["Override"])
    assert [(o["operation_type"], o["line"], o["snippet"]) for o in m["ops"]] == [("JOIN", 9, "a.join(b);")]
    assert [x["line"] for x in m["logs"]] == [10]


def test_odd_white_space_keeps_lines(spark):
    code = SPARK + "class A {\n  void run(Dataset<Row> a) {\r\n    int x = 1;\f\x0b\r\n    a.join(a);\r\n  }\n}\n"
    o = method_rows(spark, code)[0]["ops"]
    assert [(x["line"], x["snippet"]) for x in o] == [(6, "a.join(a);")]


def test_not_methods(spark):
    code = "class A {\n  int x = f(1);\n  void a() { if (x) { g(); } for (;;) { } while (y) { } switch (z) { } synchronized (q) { } }\n  abstract void b();\n}\n"
    assert [m["name"] for m in method_rows(spark, code)] == ["a"]


def test_broken_and_empty_sources(spark):
    rows = [("a.java", None), ("b.java", ""), ("c.java", "class A { void f( { } } } ) ("), ("d.java", "class A { void f() { x.join(y);"), ("e.java", '"')]
    a = parsed(spark, *rows)
    assert a.files.count() == 5
    got = {m["path"]: m for m in (r.asDict(True) for r in a.methods.collect())}
    assert got["d.java"]["name"] == "f" and [o["operation_type"] for o in got["d.java"]["ops"]] == ["JOIN"]


def test_test_sources(spark):
    a = parsed(spark, ("src/test/java/Helper.java", PIPELINE), ("x/src/test/java/Helper.java", PIPELINE), ("x/VisitsTest.java", PIPELINE))
    assert [r.is_test for r in a.files.orderBy("path").collect()] == [False, True, True]
    assert {r.path for r in a.findings.select("path").distinct().collect()} == {"src/test/java/Helper.java"}
