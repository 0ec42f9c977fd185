"""Sources: directories of source files, build files, and corpora rendered from tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell import patterns as P

IGNORED = (".git", "target", "build", ".idea", ".vscode", "node_modules", ".venv", "logs", "generated")
SAMPLE = 40


def _glob(pattern: str) -> str:
    """A regular expression for a path glob: ** over folders, * and ? within one."""
    out = ""
    for piece in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece) or re.escape(piece)
    return rf"\A{out}\z"


def read_tree(spark: SparkSession, root: str, ignore: tuple[str, ...] = IGNORED, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of the .java files under root; path is relative to it.

    Folders named in ignore, or whose names begin with .git, are left out, and so
    is what include globs miss or exclude globs hit. Bytes that are not UTF-8
    become replacement characters. Only path columns are read for what is left out.
    """
    return _under(spark, root, "*.java", ignore, include, exclude).select("path", F.decode(F.col("content"), "UTF-8").alias("content"))


def _under(spark: SparkSession, root: str, glob: str, ignore: tuple[str, ...], include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")  # malformed bytes are replaced, not an error
    base = re.sub(r"^file:/+", "/", root).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    clean = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^file:/+", "/")
    rel = F.substring(clean, F.locate(base + "/", clean) + len(base) + 1, 1 << 20)
    folders = F.slice(F.split("rel", "/"), 1, F.size(F.split("rel", "/")) - 1)
    files = files.withColumn("rel", rel).where(~F.exists(folders, lambda d: d.isin(*ignore) | F.startswith(d, F.lit(".git"))))
    for patterns, keep in ((include, True), (exclude, False)):
        if patterns:
            hit = F.lit(False)
            for p in patterns:
                hit = hit | F.rlike("rel", F.lit(_glob(p)))
            files = files.where(hit if keep else ~hit)
    return files.select(F.col("rel").alias("path"), "content")


def read_build(spark: SparkSession, root: str) -> DataFrame:
    """(build_system, build_text): one row; the first build file of the root by precedence, or nulls."""
    found = _under(spark, root, "{pom.xml,build.gradle,build.gradle.kts}", IGNORED).where(F.col("path").isin(*[n for n, _ in P.BUILD_FILES]))
    order = F.create_map(*[F.lit(x) for k, (n, _) in enumerate(P.BUILD_FILES) for x in (n, k)])
    system = F.create_map(*[F.lit(x) for kv in P.BUILD_FILES for x in kv])
    return found.agg(F.min_by(F.struct(F.element_at(system, F.col("path")).alias("s"), F.decode(F.col("content"), "UTF-8").alias("t")), F.element_at(order, F.col("path"))).alias("b")).select(
        F.col("b.s").alias("build_system"), F.coalesce("b.t", F.lit("")).alias("build_text"))


def first_group(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first group of the first pattern that matches, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def is_test_path(path: Column) -> Column:
    """Whether discovery counts a file as a test (absolute paths; findings use another rule)."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.contains(p, F.lit("/src/test/")) | F.endswith(p, F.lit("test.java")) | F.endswith(p, F.lit("tests.java")) | F.contains(p, F.lit("/test/"))


def project_info(sources: DataFrame, build: DataFrame, name: str, root: str) -> DataFrame:
    """One row about the project. Markers are looked for in the build file and the first SAMPLE sources by path."""
    counts = sources.select("path").agg(
        F.count("*").cast("int").alias("java_files"),
        F.count_if(is_test_path(F.concat(F.lit(root.rstrip("/") + "/"), "path"))).cast("int").alias("test_files"))
    # A fixed number of sources.
    sample = sources.orderBy("path").limit(SAMPLE).agg(F.array_join(F.array_sort(F.collect_list(F.struct("path", "content")))["content"], "\n").alias("sample"))
    one = lambda df: df.withColumn("k", F.lit(1))
    row = one(build).join(one(counts), "k").join(one(sample), "k")
    text = F.concat_ws("\n", "build_text", "sample")
    spark_version = first_group(F.col("build_text"), P.SPARK_VERSION)
    spark = F.coalesce(spark_version.isNotNull(), F.lit(False)) | F.rlike(text, F.lit(P.SPARK_MARKER))
    frameworks = F.filter(F.array(F.when(spark, "Apache Spark"), F.when(F.rlike(text, F.lit(P.SPARK_SQL_MARKER)), "Spark SQL")), lambda x: x.isNotNull())
    logging = F.filter(F.array(*[F.when(F.rlike(text, F.lit(m)), n) for n, m in P.LOGGING_MARKERS]), lambda x: x.isNotNull())
    return row.select(
        F.lit(name).alias("project_name"), F.lit(root).alias("path"), F.lit("Java").alias("language"),
        F.when(spark, "java-spark").otherwise("java").alias("project_type"), frameworks.alias("frameworks"), "build_system",
        F.replace(first_group(F.col("build_text"), P.JAVA_VERSION), F.lit("_"), F.lit(".")).alias("java_version"),
        spark_version.alias("spark_version"), logging.alias("logging_frameworks"), "java_files", "test_files")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Small rows dealt out before they become text, so that a table of one file is not one task's work."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


#: What the rendered class of a part does, by p_partkey % 6; the last is plain Java.
CALLS = ('in.join(other, "k")', 'in.filter("x > 1")', 'in.dropDuplicates("id")', 'in.orderBy("id")', 'in.withColumn("c", other)',
         "names.stream().filter(x -> true).distinct().toList()")
INFO_LOG = 'log.info("run_id={} left_count={} right_count={} output_count={} join_type={}", id, l, r, o, t);'


def rendered_corpus(part: DataFrame) -> DataFrame:
    """(path, content): one Java class for each row of part, written from its attributes.

    The operation follows p_partkey % 6, the log before it p_size % 3, its distance
    p_partkey % 12, the action after it p_partkey % 2 and the catch block p_partkey % 4.
    Comments and literals hold calls that must not be found.
    """
    k = F.col("p_partkey")
    key = k.cast("string")
    call = F.element_at(F.array(*map(F.lit, CALLS)), (k % 6 + 1).cast("int"))
    log = F.when(F.col("p_size") % 3 == 0, "// no log.info(").when(F.col("p_size") % 3 == 1, 'log.info("processing");').otherwise(INFO_LOG)
    pad = F.array_join(F.array_repeat(F.lit("    // .join( .groupBy( { ( \" '\n"), (k % 12).cast("int")), "")
    kind = F.when(k % 6 == 5, "List<String> s = ").otherwise("Dataset<Row> s = ")
    action = F.when((k % 2 == 0) & (k % 6 != 5), "s.count();").otherwise("int z = 1;")
    caught = F.when(k % 4 < 2, 'log.error("failed run_id={}", id);').otherwise("int y = 2;")
    content = F.concat(
        F.lit("package gen.p"), key, F.lit(";\nimport org.apache.spark.sql.*;\n\npublic class Part"), key, F.lit(" {\n"),
        F.lit("  private static final Logger log = LoggerFactory.getLogger(Part"), key, F.lit(".class);\n"),
        F.lit("  public void run(Dataset<Row> in, Dataset<Row> other) {\n    "), log, F.lit("\n"), pad,
        F.lit("    "), kind, call, F.lit(";\n    String q = \".join( .groupBy(\\\" {\";\n    try {\n      "), action,
        F.lit("\n    } catch (Exception e) {\n      "), caught, F.lit("\n    }\n  }\n}\n"))
    return part.select(F.concat(F.lit("gen/Part"), key, F.lit(".java")).alias("path"), content.alias("content"))
