"""Registered queries and the SQL that checks them.

Three groups: text operators on text tables; store queries on business tables
that stand in for the store (each docstring or comment names the roles); and a
corpus rendered from `part`, whose expected results the SQL derives from the
attributes, not from the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell import patterns as P
from tracewell.functions import text as T
from tracewell.operators import contract, detect, store
from tracewell.plans import taxonomy
from tracewell.plans.scan import Analysis, analyse
from tracewell.sources.corpus import dealt, rendered_corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(taxonomy.QUERIES)
ORACLES: dict[str, str] = dict(taxonomy.ORACLES)


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text operators ----------------------------------------------------------


def _sql_secrets(column: str) -> str:
    out = column
    for pattern, new in P.SECRETS:
        plain, flags = (pattern[4:], "gi") if pattern.startswith("(?i)") else (pattern, "g")
        out = "regexp_replace({}, '{}', '{}', '{}')".format(out, plain.replace("'", "''"), new.replace("$1", r"\1"), flags)
    return out


@query("sec_mask_secrets", f"SELECT doc_id, sha256({_sql_secrets('text')}) AS masked_sha256, length({_sql_secrets('text')}) AS masked_length FROM documents")
def mask_secrets(spark, sf_dir):
    masked = T.mask_secrets(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2(masked, 256).alias("masked_sha256"), F.char_length(masked).cast("long").alias("masked_length"))


#: The tests that Unicode word boundaries need, in ASCII patterns: no word character of any script beside the term.
_TERMS = "|".join(P.SENSITIVE_TERMS)
_W = r"[\p{L}\p{N}\p{M}_]"
_SQL_TERMS = (
    f"list_sort(list_distinct(list_transform(regexp_extract_all(' ' || regexp_replace(coalesce(text, ''), '({_W}+)', ' \\1 ', 'g') || ' ', "
    f"'(?i) ({_TERMS}) ', 1), lambda x: lower(x))))"
)


@query("sec_sensitive_terms", f"SELECT doc_id, array_to_string({_SQL_TERMS}, ',') AS terms FROM documents")
def sensitive_terms(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.sensitive_terms(F.col("text")), ",").alias("terms"))


@query("sec_sensitive_by_role", f"SELECT role, count(*) AS turns, sum(len({_SQL_TERMS}))::BIGINT AS terms FROM conversations GROUP BY role")
def sensitive_by_role(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count("*").alias("turns"), F.sum(F.size(T.sensitive_terms(F.col("text")))).alias("terms"))


@query("sec_sanitize_fields", f"""
SELECT doc_id,
  len(list_filter(w, lambda x: NOT regexp_full_match(x, '(?i){_TERMS}'))) AS safe,
  len(list_filter(w, lambda x: regexp_full_match(x, '(?i){_TERMS}'))) AS rejected
FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[a-z_]+') AS w FROM documents)""")
def sanitize_fields(spark, sf_dir):
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z_]+"), F.lit(0))
    return _read(spark, sf_dir, "documents").withColumn("w", words).select(
        "doc_id", F.size(T.safe_fields(F.col("w"))).cast("long").alias("safe"), F.size(T.rejected_fields(F.col("w"))).cast("long").alias("rejected"))


@query("text_line_metrics", """
SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count, sha256(text) AS file_hash FROM documents""")
def line_metrics(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", (T.newlines(F.col("text")) + 1).cast("long").alias("line_count"), F.sha2("text", 256).alias("file_hash"))


@query("text_mask_literals", """
SELECT page_id, length(html) AS chars, length(html) - length(replace(html, chr(10), '')) AS newlines FROM pages""")
def mask_literals(spark, sf_dir):
    """Masking keeps the length and the lines of a text."""
    masked = T.mask_literals(F.col("html"))
    return _read(spark, sf_dir, "pages").select("page_id", F.char_length(masked).cast("long").alias("chars"), T.newlines(masked).cast("long").alias("newlines"))


_MASKED_SQL = """
WITH g AS (SELECT page_id, regexp_split_to_array(html, '{p}') AS gaps, regexp_extract_all(html, '{p}') AS found FROM pages)
SELECT page_id, sha256(array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(regexp_replace(found[i], '[^\n]', ' ', 'g'), '')), '')) AS masked_sha256
FROM g""".replace("{p}", P.LITERALS.replace("*+", "*").replace("?+", "?").replace("'", "''"))


@query("text_masked_literals", _MASKED_SQL)
def masked_literals(spark, sf_dir):
    """The masked text itself."""
    return _read(spark, sf_dir, "pages").select("page_id", F.sha2(T.mask_literals(F.col("html")), 256).alias("masked_sha256"))


@query("struct_brace_pairs", r"""
WITH parts AS (
  SELECT page_id, unnest(regexp_extract_all(html, '[{}]|[^{}]+')) AS part, generate_subscripts(regexp_extract_all(html, '[{}]|[^{}]+'), 1) AS i FROM pages),
placed AS (
  SELECT page_id, part, i, sum(length(part)) OVER (PARTITION BY page_id ORDER BY i) - length(part) AS pos,
         sum(CASE part WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS depth
  FROM parts),
opens AS (SELECT page_id, pos, depth FROM placed WHERE part = '{'),
ends AS (SELECT o.page_id, o.pos, min(c.pos) AS close FROM opens o LEFT JOIN placed c
         ON c.page_id = o.page_id AND c.part = '}' AND c.pos > o.pos AND c.depth = o.depth - 1 GROUP BY ALL)
SELECT e.page_id, e.pos::BIGINT AS open_at, coalesce(e.close, length(p.html) - 1)::BIGINT AS close_at FROM ends e JOIN pages p USING (page_id)""")
def brace_pairs(spark, sf_dir):
    """Each opening brace of a page with the one that closes it."""
    def with_close(m):
        return F.struct(m["at"].alias("at"), (m["at"] + T.closing(F.substring("html", m["at"] + 1, F.char_length("html")), "{}")).alias("close"))

    return _read(spark, sf_dir, "pages").select("page_id", "html", F.explode(T.places("html", r"\{")).alias("m")).select(
        "page_id", with_close(F.col("m")).alias("p")).select("page_id", F.col("p.at").cast("long").alias("open_at"), F.col("p.close").cast("long").alias("close_at"))


@query("text_code_window", f"""
WITH w AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
n AS (SELECT doc_id, lines, unnest(range(greatest(1, doc_id % 7 + 1 - 12), least(len(lines), doc_id % 7 + 1 + 12) + 1)) AS n FROM w),
t AS (SELECT doc_id, string_agg(lpad(n::VARCHAR, 5, ' ') || '| ' || lines[n], chr(10) ORDER BY n) AS code FROM n GROUP BY doc_id)
SELECT doc_id, sha256({_sql_secrets('code')}) AS code_sha256 FROM t""")
def code_window(spark, sf_dir):
    """Twelve lines around a line of each document, numbered and masked."""
    docs = _read(spark, sf_dir, "documents")
    code = T.code_window(F.col("text"), F.lit(1), F.size(F.split("text", "\n", -1)), (F.col("doc_id") % 7 + 1).cast("int"))
    return docs.select("doc_id", F.sha2(code, 256).alias("code_sha256"))


@query("det_match_lines", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, n::BIGINT AS line, len(regexp_extract_all(line, 'token\s*='))::BIGINT AS hits FROM l WHERE regexp_matches(line, 'token\s*=')""")
def match_lines(spark, sf_dir):
    """Lines of the matches of a pattern, by the rule that all detectors share."""
    found = _read(spark, sf_dir, "documents").select("doc_id", F.explode(T.places("text", r"token[ \t]*=")).alias("m"))
    return found.groupBy("doc_id", (F.col("m.line") + 1).cast("long").alias("line")).agg(F.count("*").alias("hits"))


def document_keys(docs: DataFrame) -> DataFrame:
    """Cache key, prompt hash and fingerprint of every document, whatever its characters."""
    from tracewell.operators.advise import cache_key

    return docs.select(
        "doc_id", cache_key(F.sha2("text", 256), F.concat("text", "source"), F.lit("join@1"), F.lit("p1"), F.lit("m")).alias("cache_key"),
        F.substring(F.sha2("text", 256), 1, 16).alias("prompt_hash"),
        F.substring(F.sha1(F.concat_ws("|", "source", "lang", "doc_id", F.lit("JOIN"), F.lit("join"), F.lower(F.regexp_replace("text", F.lit(r"\s+"), F.lit(""))))), 1, 16).alias("fingerprint"))


@query("hash_cache_keys_all", """
SELECT doc_id, sha256(sha256(text) || sha256(text || source) || 'join@1' || 'p1' || 'm') AS cache_key, substr(sha256(text), 1, 16) AS prompt_hash FROM documents""")
def cache_keys_all(spark, sf_dir):
    """Cache key and prompt hash of every document; a test holds the fingerprints, which depend on case, against brute force."""
    return document_keys(_read(spark, sf_dir, "documents")).drop("fingerprint")


# --- store queries: orders as scans or findings, customers as projects --------


def _scans(spark, sf_dir) -> DataFrame:
    """orders as scans: o_orderkey the id, o_custkey the project, o_totalprice the score."""
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("started_at"), F.col("o_totalprice").alias("score"))


def _projects(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


_SQL_PRIORITY = "CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'HIGH' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'MEDIUM' ELSE 'LOW' END"


def _findings(spark, sf_dir) -> DataFrame:
    """orders as findings: o_orderkey the id, the year the scan, o_orderpriority the priority, o_orderstatus the status."""
    p = F.substring("o_orderpriority", 1, 1)
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("scan_id"), F.col("o_custkey").alias("project_id"),
        F.when(p.isin("1", "2"), "HIGH").when(p == "3", "MEDIUM").otherwise("LOW").alias("priority"),
        F.element_at(F.create_map(F.lit("F"), F.lit("ACCEPTED"), F.lit("O"), F.lit("OPEN"), F.lit("P"), F.lit("REJECTED")), F.col("o_orderstatus")).alias("status"),
        F.col("o_orderpriority").alias("fingerprint"), F.col("o_totalprice").alias("score"))


@query("qry_history", """
SELECT o_orderkey AS scan_id, o_orderdate AS started_at, o_totalprice AS score, c_name AS project
FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey DESC LIMIT 50""")
def history(spark, sf_dir):
    return store.history(_scans(spark, sf_dir), _projects(spark, sf_dir), 50)


@query("qry_scan_row", "SELECT o_orderkey AS id, o_custkey AS project_id, o_orderdate AS started_at, o_totalprice AS score FROM orders WHERE o_orderkey = 7")
def scan_row(spark, sf_dir):
    return store.scan_row(_scans(spark, sf_dir), 7)


@query("qry_latest_scan", "SELECT max(o_orderkey) AS scan_id FROM orders")
def latest_scan(spark, sf_dir):
    return store.latest_scan(_scans(spark, sf_dir))


@query("qry_priority_counts", f"SELECT year(o_orderdate)::INT AS scan_id, {_SQL_PRIORITY} AS priority, count(*) AS n FROM orders GROUP BY ALL")
def priority_counts(spark, sf_dir):
    return store.priority_counts(_findings(spark, sf_dir))


@query("qry_list_findings", f"""
SELECT o_orderkey AS id, {_SQL_PRIORITY} AS priority FROM orders
WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) AND {_SQL_PRIORITY} = 'HIGH'""")
def list_findings(spark, sf_dir):
    return store.list_findings(_findings(spark, sf_dir), priority="HIGH").select("id", "priority")


@query("qry_carry_forward", """
WITH prior AS (
  SELECT o_custkey, o_orderpriority, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' ELSE 'REJECTED' END AS status
  FROM orders WHERE o_orderstatus IN ('F', 'P') AND year(o_orderdate) < (SELECT max(year(o_orderdate)) FROM orders))
SELECT o.o_orderkey AS id, coalesce((SELECT arg_max(p.status, p.o_orderkey) FROM prior p
  WHERE p.o_custkey = o.o_custkey AND p.o_orderpriority = o.o_orderpriority), 'OPEN') AS status
FROM orders o WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)""")
def carry_forward(spark, sf_dir):
    """New findings (the last year) take the latest decided status of the same project and fingerprint."""
    f = _findings(spark, sf_dir)
    last = f.agg(F.max("scan_id").alias("last"))
    new = f.join(F.broadcast(last), f.scan_id == last.last).drop("last", "status")
    old = f.join(F.broadcast(last), f.scan_id < last.last).drop("last")
    return store.carry_status(new, old).select("id", "status")


@query("qry_compare_scans", f"""
WITH f AS (SELECT year(o_orderdate) AS y, {_SQL_PRIORITY} AS priority, o_totalprice FROM orders)
SELECT priority, count_if(y = 1995) AS before, count_if(y = 1996) AS after,
       round_even((SELECT avg(o_totalprice) FROM f WHERE y = 1996) - (SELECT avg(o_totalprice) FROM f WHERE y = 1995), 1) AS improvement
FROM f WHERE y IN (1995, 1996) GROUP BY priority""")
def compare_scans(spark, sf_dir):
    f = _findings(spark, sf_dir)
    scores = f.groupBy("scan_id").agg(F.avg("score").alias("score"))
    return store.compare(f, scores, 1995, 1996)


@query("qry_finding_detail", """
SELECT o_orderkey AS id, c_name AS project, l.l_linenumber AS run_id, l.l_quantity AS duration
FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC) AS r FROM lineitem) l ON l.l_orderkey = o_orderkey AND l.r = 1""")
def finding_detail(spark, sf_dir):
    """Findings (orders) with their project and their latest run (line items)."""
    runs = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), F.col("l_linenumber").alias("run_id"), F.col("l_quantity").alias("duration"))
    f = _findings(spark, sf_dir).join(_projects(spark, sf_dir).withColumnRenamed("id", "project_id").withColumnRenamed("name", "project"), "project_id")
    return store.with_latest(f.select("id", "project"), runs, F.struct("run_id", "duration"), ["run_id", "duration"])


@query("qry_status_events", """
WITH e AS (SELECT o_custkey AS finding_id, o_orderdate, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' WHEN 'O' THEN 'OPEN' ELSE 'REJECTED' END AS status FROM orders)
SELECT c_custkey AS id, coalesce((SELECT arg_max(status, (o_orderdate, o_orderkey)) FROM e WHERE finding_id = c_custkey), 'OPEN') AS status FROM customer""")
def status_events(spark, sf_dir):
    """The last event (order) of each finding (customer) gives its status."""
    events = _read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("finding_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"),
        F.element_at(F.create_map(F.lit("F"), F.lit("ACCEPTED"), F.lit("O"), F.lit("OPEN"), F.lit("P"), F.lit("REJECTED")), F.col("o_orderstatus")).alias("status"))
    return store.with_status(_projects(spark, sf_dir).select("id", F.lit("OPEN").alias("status")), events).select("id", "status")


_SQL_RUNS = """(SELECT event_id, user_id % 5 AS model, CASE WHEN event_type IN ('purchase', 'click') THEN 'OK' WHEN event_type = 'view' THEN 'CACHE_HIT' ELSE 'LLM_ANALYSIS_FAILED' END AS status,
  CASE WHEN event_type = 'view' THEN 0 ELSE floor(abs(value) * 10)::BIGINT END AS duration_ms, event_id % 100 AS input_tokens, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 7 END AS output_tokens FROM events)"""


def _runs(spark, sf_dir) -> DataFrame:
    """events as runs of the model pass: event_type the status, value the duration, user_id the model."""
    t = F.col("event_type")
    return _read(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 5).alias("model"),
        F.when(t.isin("purchase", "click"), "OK").when(t == "view", "CACHE_HIT").otherwise("LLM_ANALYSIS_FAILED").alias("status"),
        F.when(t == "view", 0).otherwise(F.floor(F.abs("value") * 10)).alias("duration_ms"),
        (F.col("event_id") % 100).alias("input_tokens"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 7).alias("output_tokens"))


_SQL_STATS = """count(*) AS runs, count_if(status = 'OK') AS ok, count_if(status = 'LLM_ANALYSIS_FAILED') AS failed, count_if(status = 'CACHE_HIT') AS cache_hits,
  coalesce(round_even(avg(duration_ms) FILTER (WHERE status <> 'CACHE_HIT' AND duration_ms > 0), 1), 0) AS avg_ms,
  sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens"""


@query("agg_run_stats", f"SELECT {_SQL_STATS} FROM {_SQL_RUNS}")
def run_stats(spark, sf_dir):
    return store.run_stats(_runs(spark, sf_dir))


@query("agg_model_benchmark", f"""
SELECT model, {_SQL_STATS}, round_even(count_if(status = 'OK') / nullif(count_if(status IN ('OK', 'LLM_ANALYSIS_FAILED')), 0), 3) AS structured_output_rate
FROM {_SQL_RUNS} GROUP BY model""")
def model_benchmark(spark, sf_dir):
    return store.model_benchmark(_runs(spark, sf_dir))


# lineitem as findings: l_partkey the file, l_suppkey the method, l_returnflag the priority, l_linestatus the quality.
_SQL_FOUND = """(SELECT l_partkey AS path, l_suppkey AS method, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS w, l_linestatus = 'O' AS covered FROM lineitem)"""


def _found(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("method"),
        F.element_at(F.create_map(F.lit("R"), F.lit("HIGH"), F.lit("A"), F.lit("MEDIUM"), F.lit("N"), F.lit("LOW")), F.col("l_returnflag")).alias("priority"),
        F.lit(True).alias("existing_logging"), F.when(F.col("l_linestatus") == "O", "GOOD").otherwise("WEAK").alias("logging_quality"))


_SQL_READINESS = """round_even(100.0 * sum(CASE WHEN covered THEN w ELSE 0 END) / sum(w), 1) AS ai_readiness,
  CASE coalesce(max(CASE WHEN NOT covered THEN w END), 1) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
  sum(w)::BIGINT AS risk_weight, count_if(w = 3) AS high, count_if(w = 2) AS medium, count_if(w = 1) AS low"""


@query("agg_readiness_risk", f"SELECT path, {_SQL_READINESS} FROM {_SQL_FOUND} GROUP BY path")
def readiness_risk(spark, sf_dir):
    return contract.readiness(_found(spark, sf_dir), "path")


@query("top_files", f"SELECT path, {_SQL_READINESS} FROM {_SQL_FOUND} GROUP BY path ORDER BY risk_weight DESC, path LIMIT 40")
def top_files(spark, sf_dir):
    return contract.readiness(_found(spark, sf_dir), "path").orderBy(F.desc("risk_weight"), "path").limit(40)


@query("top_methods", f"SELECT path, method, {_SQL_READINESS} FROM {_SQL_FOUND} GROUP BY path, method ORDER BY risk_weight DESC, path, method LIMIT 20")
def top_methods(spark, sf_dir):
    return contract.readiness(_found(spark, sf_dir), "path", "method").orderBy(F.desc("risk_weight"), "path", "method").limit(20)


@query("top_select_candidates", f"""
SELECT o_orderkey AS id, {_SQL_PRIORITY} AS priority FROM orders WHERE {_SQL_PRIORITY} IN ('HIGH', 'MEDIUM')
ORDER BY CASE {_SQL_PRIORITY} WHEN 'HIGH' THEN 0 ELSE 1 END, o_custkey, o_orderkey LIMIT 75""")
def select_candidates(spark, sf_dir):
    from tracewell.operators.advise import select

    f = _findings(spark, sf_dir).withColumns({"path": F.col("project_id"), "line": F.col("id")})
    return select(f, "medium", 75).select("id", "priority")


@query("rpt_first_per_category", f"""
SELECT fingerprint AS category, id FROM (
  SELECT o_orderpriority AS fingerprint, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1""")
def first_per_category(spark, sf_dir):
    from tracewell.operators.report import contract_rows

    f = _findings(spark, sf_dir).select(F.col("fingerprint").alias("category"), F.col("id").alias("finding_no"))
    return contract_rows(f).select("category", F.col("finding_no").alias("id"))


@query("join_band_proximity", """
SELECT a.l_orderkey AS method_id, a.l_linenumber AS line, count(b.l_linenumber) AS logs, coalesce(bool_or(b.l_returnflag = 'R'), false) AS structured
FROM lineitem a LEFT JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber <> a.l_linenumber AND abs(b.l_linenumber - a.l_linenumber) <= 2
GROUP BY a.l_orderkey, a.l_linenumber""")
def band_proximity(spark, sf_dir):
    """Line items of an order as operations and as logs: which logs stand within two lines."""
    li = _read(spark, sf_dir, "lineitem")
    ops = li.select(F.col("l_orderkey").alias("method_id"), F.col("l_linenumber").alias("line"))
    logs = li.select(F.col("l_orderkey").alias("method_id"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "R").alias("structured"))
    return store.band_join(ops, logs, 2)


@query("join_range_resolution", """
SELECT e.event_id, min(o.o_orderkey) AS method_id FROM events e
LEFT JOIN (SELECT o_orderkey, o_custkey, o_orderkey % 1000 AS lo, o_orderkey % 1000 + 200 AS hi FROM orders) o
  ON e.user_id = o.o_custkey AND e.event_id % 1000 BETWEEN o.lo AND o.hi GROUP BY e.event_id""")
def range_resolution(spark, sf_dir):
    """Events as findings in the spans of methods (orders of the same customer): the first that holds the line."""
    found = _read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("file"), (F.col("event_id") % 1000).alias("line"))
    spans = _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("method_id"), F.col("o_custkey").alias("file"), (F.col("o_orderkey") % 1000).alias("start_line"), (F.col("o_orderkey") % 1000 + 200).alias("end_line"))
    return store.resolve_method(found, spans, "event_id", ["file"]).select("event_id", "method_id")


_EDGES = "SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, n_nationkey // 2 FROM nation WHERE n_nationkey % 4 = 0"


@query("flow_closure", f"""
WITH RECURSIVE edges AS ({_EDGES}), reach AS (
  SELECT n_nationkey AS action, n_nationkey AS line FROM nation WHERE n_nationkey % 6 = 0
  UNION SELECT r.action, e.b FROM reach r JOIN edges e ON e.a = r.line)
SELECT line, min(action) AS action_line FROM reach GROUP BY line""")
def flow_closure(spark, sf_dir):
    """Nations as statements with edges by arithmetic: the least action that each line reaches."""
    n = _read(spark, sf_dir, "nation").select("n_nationkey")
    edges = n.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b")).union(
        n.where("n_nationkey % 4 = 0").select("n_nationkey", F.floor(F.col("n_nationkey") / 2).cast("int")))
    return store.least_reached(edges, n.where("n_nationkey % 6 = 0").select(F.col("n_nationkey").alias("action")))


# --- the rendered corpus ------------------------------------------------------


def _corpus(spark: SparkSession, sf_dir: str) -> Analysis:
    """The analysis of the classes rendered from part; the small rows are dealt out before they become text."""
    return analyse(rendered_corpus(dealt(_read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")))


#: Per class: d the distance, the lines of its places, and what its attributes imply.
_SQL_CORPUS = """
p AS (SELECT p_partkey AS k, 'gen/Part' || p_partkey || '.java' AS path, 'Part' || p_partkey AS class_name, (p_partkey % 12)::INT AS d, p_size % 3 AS style,
        (p_partkey % 2 = 0 AND p_partkey % 6 <> 5) AS acts, p_partkey % 4 < 2 AS caught, (p_partkey % 6)::INT AS op FROM part),
places AS (
  SELECT k, path, class_name, style, caught, d, ['JOIN', 'FILTER', 'DEDUPLICATION', 'SORT', 'WITH_COLUMN'][op + 1] AS category,
         8 + d AS line, CASE WHEN acts THEN 10 + d END AS execution_line,
         ['HIGH', 'HIGH', 'HIGH', 'MEDIUM', 'LOW'][op + 1] AS priority, ['join', 'filter', 'deduplication', 'repartition', 'transformation'][op + 1] AS rule,
         'Dataset<Row> s = ' || ['in.join(other, "k")', 'in.filter("x > 1")', 'in.dropDuplicates("id")', 'in.orderBy("id")', 'in.withColumn("c", other)'][op + 1] || ';' AS snippet
  FROM p WHERE op < 5
  UNION ALL SELECT k, path, class_name, style, caught, d, 'SPARK_ACTION', 11 + d, 11 + d, 'MEDIUM', 'action', 's.count();' FROM p WHERE acts
  UNION ALL SELECT k, path, class_name, style, caught, d, 'EXCEPTION', 12 + d, NULL, 'HIGH', 'exception', 'catch block at line ' || (12 + d) FROM p WHERE NOT caught),
near AS (SELECT *, style > 0 AND (line - 7 <= 8 OR coalesce(execution_line - 7 <= 8, false)) AS log_near,
           caught AND (abs(13 + d - line) <= 8 OR coalesce(abs(13 + d - execution_line) <= 8, false)) AS error_near FROM places),
f AS (SELECT *, log_near OR error_near AS existing_logging,
        CASE WHEN NOT (log_near OR error_near) THEN 'MISSING'
             WHEN NOT ((log_near AND style = 2) OR error_near) THEN 'WEAK'
             WHEN category = 'JOIN' AND log_near AND style = 2 THEN 'GOOD' ELSE 'PARTIAL' END AS logging_quality FROM near)"""


@query("corpus_findings", f"""
WITH {_SQL_CORPUS}
SELECT path, class_name, 'run' AS method, category, line, execution_line, priority, existing_logging, logging_quality, rule || '@1' AS rule_id, snippet FROM f""")
def corpus_findings(spark, sf_dir):
    return _corpus(spark, sf_dir).findings.select(
        "path", "class_name", "method", "category", "line", "execution_line", "priority", "existing_logging", "logging_quality", "rule_id", "snippet")


@query("corpus_ops", f"""
WITH {_SQL_CORPUS}
SELECT path, category AS operation_type, line, priority, category = 'SPARK_ACTION' AS is_action, category <> 'SPARK_ACTION' AS lazy, execution_line AS materialized_at
FROM f WHERE category <> 'EXCEPTION'""")
def corpus_ops(spark, sf_dir):
    return T.unfold(_corpus(spark, sf_dir).methods, ["path"], "ops", "o").select(
        "path", "o.operation_type", "o.line", "o.priority", "o.is_action", "o.lazy", "o.materialized_at")


@query("corpus_logs", f"""
WITH {_SQL_CORPUS}
SELECT path, 7 AS line, 'INFO' AS level, CASE style WHEN 1 THEN '"processing"' ELSE '"run_id=' || chr(123) || chr(125) || ' left_count={{}} right_count={{}} output_count={{}} join_type={{}}"' END AS message_pattern,
       style = 2 AS structured, false AS sensitive FROM p WHERE style > 0
UNION ALL SELECT path, 13 + d, 'ERROR', '"failed run_id={{}}"', true, false FROM p WHERE caught""")
def corpus_logs(spark, sf_dir):
    return T.unfold(_corpus(spark, sf_dir).methods, ["path"], "logs", "l").select(
        "path", "l.line", "l.level", "l.message_pattern", "l.structured", "l.sensitive")


@query("corpus_exceptions", f"WITH {_SQL_CORPUS} SELECT path, 'TRY_CATCH' AS kind, 12 + d AS start_line, 14 + d AS end_line, caught AS has_error_logging FROM p")
def corpus_exceptions(spark, sf_dir):
    return T.unfold(_corpus(spark, sf_dir).methods, ["path"], "exceptions", "e").select(
        "path", "e.kind", "e.start_line", "e.end_line", "e.has_error_logging")


@query("corpus_methods", f"""
WITH {_SQL_CORPUS}
SELECT path, 'run' AS name, class_name, 6 AS start_line, 15 + d AS end_line, 'void' AS return_type, 'Dataset<Row> in,Dataset<Row> other' AS parameters FROM p""")
def corpus_methods(spark, sf_dir):
    return _corpus(spark, sf_dir).methods.select(
        "path", "name", "class_name", "start_line", "end_line", "return_type", F.array_join("parameters", ",").alias("parameters"))


@query("corpus_files", f"""
WITH {_SQL_CORPUS} SELECT path, 'gen.p' || k AS package, 17 + d AS line_count, false AS is_test, class_name AS classes, 'org.apache.spark.sql.*' AS imports FROM p""")
def corpus_files(spark, sf_dir):
    return _corpus(spark, sf_dir).files.select(
        "path", "package", "line_count", "is_test", F.array_join("classes", ",").alias("classes"), F.array_join("imports", ",").alias("imports"))


@query("corpus_fingerprints", f"""
WITH {_SQL_CORPUS}
SELECT path, category, line, substr(sha1(path || '|' || class_name || '|run|' || category || '|' || rule || '|' || lower(replace(snippet, ' ', ''))), 1, 16) AS fingerprint FROM f""")
def corpus_fingerprints(spark, sf_dir):
    return _corpus(spark, sf_dir).findings.select("path", "category", "line", "fingerprint")


@query("corpus_numbered", f"""
WITH {_SQL_CORPUS}
SELECT path, category, line, row_number() OVER (ORDER BY CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, path, line)::INT AS finding_no FROM f""")
def corpus_numbered(spark, sf_dir):
    return contract.numbered(_corpus(spark, sf_dir).findings).select("path", "category", "line", "finding_no")


_SQL_BUCKETS = ", ".join(
    f"CASE WHEN count_if(category IN ({', '.join(repr(c) for c in cats)})) = 0 THEN {P.WEIGHTS[b]}.0 ELSE "
    f"round_even({P.WEIGHTS[b]} * count_if(category IN ({', '.join(repr(c) for c in cats)}) AND logging_quality IN ('GOOD', 'PARTIAL'))"
    f" / count_if(category IN ({', '.join(repr(c) for c in cats)})), 1) END AS {b}" for b, cats in P.BUCKETS.items())


@query("corpus_scores", f"""
WITH {_SQL_CORPUS}, b AS (SELECT {_SQL_BUCKETS} FROM f),
l AS (SELECT round_even(10 * (count_if(style = 2) + count_if(caught)) / (count_if(style > 0) + count_if(caught)), 1) AS structured_logging,
             CASE WHEN count_if(style = 2) + count_if(caught) > 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS run_correlation FROM p)
SELECT b.*, l.*, round_even({' + '.join(P.WEIGHTS)}, 1) AS overall_score FROM b, l""")
def corpus_scores(spark, sf_dir):
    return _corpus(spark, sf_dir).scores().drop("not_applicable")


@query("corpus_file_rollup", f"""
WITH {_SQL_CORPUS}, g AS (SELECT path, CASE priority WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS w, logging_quality IN ('GOOD', 'PARTIAL') AS covered FROM f)
SELECT path, {_SQL_READINESS} FROM g GROUP BY path""")
def corpus_file_rollup(spark, sf_dir):
    return contract.readiness(_corpus(spark, sf_dir).findings, "path")


@query("corpus_orphans", f"WITH {_SQL_CORPUS} SELECT path, category AS operation_type, line FROM f WHERE category IN ('JOIN', 'FILTER', 'DEDUPLICATION', 'SORT') AND execution_line IS NULL")
def corpus_orphans(spark, sf_dir):
    from tracewell.operators.report import orphans

    return orphans(_corpus(spark, sf_dir).methods).select("path", "operation_type", "line")


@query("corpus_deferred", f"WITH {_SQL_CORPUS} SELECT path, category AS operation_type, line, execution_line AS materialized_at FROM f WHERE category NOT IN ('SPARK_ACTION', 'EXCEPTION') AND execution_line IS NOT NULL")
def corpus_deferred(spark, sf_dir):
    from tracewell.operators.report import deferred

    return deferred(_corpus(spark, sf_dir).methods).select("path", "operation_type", "line", "materialized_at")


@query("corpus_op_histogram", f"WITH {_SQL_CORPUS} SELECT category AS operation_type, count(*) AS n FROM f WHERE category <> 'EXCEPTION' GROUP BY category")
def corpus_op_histogram(spark, sf_dir):
    from tracewell.operators.report import op_histogram

    return op_histogram(_corpus(spark, sf_dir).methods)


@query("corpus_log_levels", f"""
WITH {_SQL_CORPUS}, l AS (SELECT 'INFO' AS level, style = 2 AS structured FROM p WHERE style > 0 UNION ALL SELECT 'ERROR', true FROM p WHERE caught)
SELECT level, count(*) AS n, count_if(structured) AS structured, 0::BIGINT AS sensitive FROM l GROUP BY level""")
def corpus_log_levels(spark, sf_dir):
    from tracewell.operators.report import log_levels

    return log_levels(_corpus(spark, sf_dir).methods)


@query("corpus_counters", f"""
WITH {_SQL_CORPUS} SELECT count(*) AS files_scanned, count(*) AS classes_scanned, count(*) AS methods_scanned,
  (SELECT count(*) FROM f WHERE category <> 'EXCEPTION') AS spark_operations, count_if(style > 0) + count_if(caught) AS existing_logs FROM p""")
def corpus_counters(spark, sf_dir):
    from tracewell.operators.report import counters

    a = _corpus(spark, sf_dir)
    return counters(a.files, a.methods)


@query("corpus_detection_matrix", f"""
WITH {_SQL_CORPUS} SELECT path, false AS input, op = 0 AS join, op = 1 AS filter, false AS aggregation, false AS output, false AS external_io,
  style = 2 OR caught AS structured_logging, caught AS exception_context, style = 2 OR caught AS run_correlation FROM p""")
def corpus_detection_matrix(spark, sf_dir):
    return contract.detection_matrix(_corpus(spark, sf_dir).methods).drop("method_ord", "name", "class_name", "start_line")
