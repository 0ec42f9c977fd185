"""Command line: scan, doctor, init, history, compare, report, eval, benchmark, findings, finding."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import __version__
from tracewell.config import Config
from tracewell.operators import advise, store
from tracewell.operators.contract import Contract, numbered
from tracewell.operators.report import Report
from tracewell.plans.scan import Analysis, analyse
from tracewell.sources import corpus

ACTIONS = {"accept": "ACCEPTED", "reject": "REJECTED", "implemented": "IMPLEMENTED", "false-positive": "FALSE_POSITIVE", "reviewed": "REVIEWED"}


def session() -> SparkSession:
    """The active session, else a new one by Spark's own configuration."""
    return SparkSession.getActiveSession() or (
        SparkSession.builder.appName("tracewell").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())


def pass_one(spark: SparkSession, root: str, cfg: Config) -> tuple[DataFrame, Analysis, DataFrame]:
    """(project, analysis, sources) of a project's folder."""
    if "://" not in root:
        root = os.path.abspath(root)
        if not os.path.isdir(root):
            raise ValueError(f"no such folder: {root}")
    s = cfg.scan
    sources = corpus.read_tree(spark, root, tuple(s["ignore_dirs"]), tuple(s["include_globs"]), tuple(s["exclude_globs"]))
    project = store.durable(corpus.project_info(sources, corpus.read_build(spark, root), os.path.basename(root.rstrip("/")), root))
    return project, analyse(sources), sources


def _provider(cfg: Config) -> advise.OllamaProvider:
    cfg.check_endpoint()
    return advise.OllamaProvider(cfg.llm["host"], cfg.llm["timeout_seconds"])


def _ready(cfg: Config, model: str) -> advise.OllamaProvider:
    provider = _provider(cfg)
    if not provider.is_available():
        raise ValueError(f"no model server at {cfg.llm['host']}; start it or use --no-llm")
    if not provider.has_model(model):
        raise ValueError(f"the server has no model {model}")
    return provider


def scan(spark: SparkSession, root: str, cfg: Config, provider: advise.Provider | None = None) -> tuple[int, list[str]]:
    """Scan a project, store it and write its reports; the scan's id and the reports' paths."""
    if cfg.llm["enabled"] and provider is None:
        provider = _ready(cfg, cfg.llm["model"])
    project, analysis, sources = pass_one(spark, root, cfg)
    advice = None
    if provider is not None and cfg.llm["enabled"]:
        info = project.first().asDict()
        advice = advise.advise(
            store.durable(numbered(analysis.findings)), analysis.methods, sources, info, provider, cfg.llm["model"], min_priority=cfg.llm["priority"], limit=cfg.llm["limit"],
            temperature=cfg.llm["temperature"], retries=cfg.llm["max_retries"], cache=cfg.cache["dir"] if cfg.llm["cache_enabled"] else None)
    s = store.Store(spark, cfg.database["path"])
    scan_id = s.save(analysis, project, advice=advice, scanner_version=__version__)
    return scan_id, report(spark, scan_id, cfg)


def report(spark: SparkSession, scan_id: int | None, cfg: Config) -> list[str]:
    s = store.Store(spark, cfg.database["path"])
    scan_id = scan_id or store.latest_scan(s.read("scans")).first()["scan_id"]
    if scan_id is None or s.read("scans").where(F.col("id") == scan_id).isEmpty():
        raise ValueError("no such scan")
    return Report(s.scan(scan_id), Contract.load(), scan_id).write(cfg.output["dir"])


# --- commands ------------------------------------------------------------------


def _scan(args, cfg, spark) -> int:
    scan_id, paths = scan(spark, args.project, cfg)
    s = store.Store(spark, cfg.database["path"])
    row = store.scan_row(s.read("scans"), scan_id).first()
    counts = {r["priority"]: r["n"] for r in store.priority_counts(s.read("findings").where(F.col("scan_id") == scan_id)).collect()}
    print(f"Files: {row['files_scanned']}\nMethods: {row['methods_scanned']}\nOperations: {row['spark_operations']}\nLogs: {row['existing_logs']}")
    print(f"Findings: {row['findings_count']} (HIGH {counts.get('HIGH', 0)}, MEDIUM {counts.get('MEDIUM', 0)}, LOW {counts.get('LOW', 0)})")
    print(f"Observability score: {row['score']}/100\nScan id: {scan_id}\n" + "\n".join(paths))
    return 0


def _doctor(args, cfg, spark) -> int:
    provider = _provider(cfg)
    up = provider.is_available()
    print(f"Model server {cfg.llm['host']}: {'available' if up else 'not available'}")
    if up:
        print(f"Model {cfg.llm['model']}: {'present' if provider.has_model(cfg.llm['model']) else 'missing'}\nModels: {', '.join(provider.list_models())}")
    print(f"Spark {spark.version}\nStore: {cfg.database['path']}")
    return 0 if up else 1


def _init(args, cfg, spark) -> int:
    s = store.Store(spark, cfg.database["path"])
    for name, schema in store.TABLES.items():
        if s.read(name).isEmpty():
            s.append(name, spark.createDataFrame([], schema))
    print(f"Store ready: {cfg.database['path']}")
    return 0


def _history(args, cfg, spark) -> int:
    s = store.Store(spark, cfg.database["path"])
    rows = store.history(s.read("scans"), s.projects().select(F.col("project_id").alias("id"), "name"), args.limit).collect()
    for r in rows:
        print(f"{r['scan_id']:<5}{r['started_at']:%Y-%m-%d %H:%M:%S}  {r['score']!s:<7}{r['findings_count']!s:<7}{r['llm_model'] or '-':<20}{r['project']}")
    if not rows:
        print("No scans yet.")
    return 0


def _compare(args, cfg, spark) -> int:
    if len(args.scan) != 2:
        raise ValueError("compare takes two scans")
    s = store.Store(spark, cfg.database["path"])
    a, b = args.scan
    scans = s.read("scans").where(F.col("id").isin(a, b))
    score = {r["id"]: r["score"] or 0.0 for r in scans.collect()}
    if set(score) != {a, b}:
        raise ValueError("one or both scans were not found")
    counts = {r["priority"]: r for r in store.compare(s.read("findings"), scans.select(F.col("id").alias("scan_id"), "score"), a, b).collect()}
    print(f"Scan {a}: {score[a]}\nScan {b}: {score[b]}\nImprovement: {round(score[b] - score[a], 1):+}")
    for p in ("HIGH", "MEDIUM", "LOW"):
        print(f"{p:<8}{counts[p]['before']} -> {counts[p]['after']}" if p in counts else f"{p:<8}0 -> 0")
    return 0


def _report(args, cfg, spark) -> int:
    print("\n".join(report(spark, args.scan, cfg)))
    return 0


def _eval(args, cfg, spark) -> int:
    model = cfg.llm["model"]
    checks, summary = advise.run_eval(spark, _ready(cfg, model), model)
    for r in checks.orderBy("id").collect():
        failed = [k for k in advise.CHECKS if r[k] is False]
        print(f"{r['id']:<14} {'failed: ' + ', '.join(failed) if failed else 'ok'}")
    print(summary.first().asDict())
    return 0


def _benchmark(args, cfg, spark) -> int:
    project, analysis, sources = pass_one(spark, args.project, cfg)
    models = [m for x in args.models for m in x.split(",")]
    rows = advise.benchmark(store.durable(numbered(analysis.findings)), analysis.methods, sources, project.first().asDict(), _provider(cfg), models,
                            min_priority=cfg.llm["priority"], limit=cfg.llm["limit"], temperature=cfg.llm["temperature"], retries=cfg.llm["max_retries"])
    for r in rows:
        print(r)
    return 0


def _findings(args, cfg, spark) -> int:
    s = store.Store(spark, cfg.database["path"])
    rows = store.list_findings(s.findings(), args.scan, args.priority).collect()
    for r in rows:
        print(f"{r['id']:<12}{r['priority']:<8}{r['status']:<15}{r['category']:<16}{r['path']}:{r['line']}")
    if not rows:
        print("No findings.")
    return 0


def _finding(args, cfg, spark) -> int:
    s = store.Store(spark, cfg.database["path"])
    if args.action != "show":
        ok = s.set_status(args.id, ACTIONS[args.action])
        print(f"Finding {args.id}: {ACTIONS[args.action]}" if ok else f"No finding {args.id}.")
        return 0 if ok else 1
    f = s.finding(args.id)
    if f is None:
        print(f"No finding {args.id}.")
        return 1
    print(f"Finding {f['id']} [{f['priority']}] {f['category']} ({f['status']})\n  {f['path']}:{f['line']} {f['class_name']}.{f['method']}")
    print(f"  rule {f['rule_id']}, logging {f['logging_quality']}, model {f['llm_status']}\n  fields: {', '.join(f['required_fields'])}\n  {f['snippet']}")
    if r := f["recommendation"]:
        print(f"  {r['model']}: {r['reason']}\n    fields: {', '.join(r['recommended_fields'])}\n    do not log: {'; '.join(r['do_not_log'])}\n    use: {r['ai_usefulness']} {', '.join(r['ai_use_cases'])}")
    if (run := f["llm_run"]) and run["duration_ms"]:
        print(f"  run: {run['status']} in {run['duration_ms']} ms, {run['input_tokens']} to {run['output_tokens']} tokens")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewell", description="Where a Java and Spark code base lacks logs.")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for option in ("config", "database", "model", "host"):
            c.add_argument(f"--{option}")
        c.set_defaults(run=run)
        return c

    def model_options(c: argparse.ArgumentParser) -> None:
        c.add_argument("--llm-priority", choices=["high", "medium", "low"])
        c.add_argument("--llm-limit", type=int)
        c.add_argument("--verbose", "-v", action="store_true")

    c = command("scan", _scan, "scan a project and write reports")
    c.add_argument("--project", required=True)
    c.add_argument("--output")
    c.add_argument("--include", action="append")
    c.add_argument("--exclude", action="append")
    c.add_argument("--no-llm", action="store_true")
    c.add_argument("--parser", choices=["auto", "treesitter", "regex"], help="accepted for compatibility; there is one parser")
    model_options(c)
    command("doctor", _doctor, "check the model server")
    command("init", _init, "create the store")
    command("history", _history, "list scans").add_argument("--limit", type=int, default=50)
    command("compare", _compare, "compare two scans").add_argument("--scan", type=int, action="append", required=True)
    c = command("report", _report, "write the reports of a stored scan")
    c.add_argument("--scan", type=int)
    c.add_argument("--output")
    command("eval", _eval, "score a model on fixed cases").add_argument("--verbose", "-v", action="store_true")
    c = command("benchmark", _benchmark, "compare models on a project")
    c.add_argument("--project", required=True)
    c.add_argument("--models", action="append", required=True)
    model_options(c)
    c = command("findings", _findings, "list findings")
    c.add_argument("--scan", type=int)
    c.add_argument("--priority", type=str.upper, choices=["HIGH", "MEDIUM", "LOW"])
    c = command("finding", _finding, "show a finding or set its status")
    c.add_argument("action", choices=["show", *ACTIONS])
    c.add_argument("id", type=int)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    cfg = Config.load(args.config)
    options = ("model", "host", "no_llm", "output", "database", "llm_priority", "llm_limit", "include", "exclude", "parser")
    cfg.override(**{k: getattr(args, k) for k in options if getattr(args, k, None) is not None})
    try:
        return args.run(args, cfg, spark or session())
    except (ValueError, advise.TransportError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
