"""Small Java sources and helpers for the tests."""

from tracewell.operators.contract import numbered
from tracewell.plans.scan import analyse

SPARK = "package a.b;\nimport org.apache.spark.sql.*;\n"

PIPELINE = SPARK + """
public class Visits {
    private static final Logger log = LoggerFactory.getLogger(Visits.class);

    /** joins .join( and filters { */
    public Dataset<Row> load(SparkSession spark, String path) {
        log.info("Starting patient load");
        Dataset<Row> a = spark.read().parquet("/in");
        Dataset<Row> b = spark.read().format("parquet").load(path);
        Dataset<Row> c = a.filter(a.col("s").equalTo("x.join(y)"));
        Dataset<Row> d = c.join(b, "id");
        try {
            d.write().mode("overwrite").parquet("/out");
        } catch (Exception e) {
            d = c;
        }
        return d;
    }

    long size(Dataset<Row> df) { return df.count(); }

    class Inner {
        public Inner(final int x, Map<String, List<Integer>> m) throws IOException { this.x = x; }
    }
}
"""


def parsed(spark, *sources):
    """Analysis of sources given as text or (path, text)."""
    rows = [s if isinstance(s, tuple) else (f"src/main/java/S{k}.java", s) for k, s in enumerate(sources)]
    return analyse(spark.createDataFrame(rows, "path string, content string"))


def method_rows(spark, *sources):
    return [r.asDict(True) for r in parsed(spark, *sources).methods.orderBy("path", "method_ord").collect()]


def finding_rows(spark, *sources):
    return [r.asDict(True) for r in numbered(parsed(spark, *sources).findings).orderBy("finding_no").collect()]


def body(code, spark_import=True):
    return (SPARK if spark_import else "") + "class T {\n  void run(Dataset<Row> in) {\n" + code + "\n  }\n}\n"


def ops(spark, code, spark_import=True):
    return [(o["operation_type"], o["line"]) for m in method_rows(spark, body(code, spark_import)) for o in m["ops"]]
