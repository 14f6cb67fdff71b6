"""The command line: run, review, export, sessions, validate-config, check-llm, verify."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import AuditError, ReviewError
from .operators.crossverify import CrossFile
from .operators.rules import load as load_rules
from .plans import report as reports
from .plans import review as reviewer
from .plans.audit import run_audit
from .plans.config import RunConfig
from .plans.config import load as load_config
from .plans.config import parse as parse_config
from .plans.store import Store
from .plans.trail import Trail, TrailEntry, verify
from .shipping import ship

OK, BAD_INPUT, FAILED, NO_REVIEWER, BAD_STORE = range(5)
DECISIONS = {"a": "accepted", "r": "rejected", "s": "skipped"}


def session() -> SparkSession:
    spark = SparkSession.builder.appName("audit").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def clients(model: str) -> list[reviewer.HttpClient]:
    return [
        reviewer.HttpClient("ollama", "http://localhost:11434/api/generate", model, "ollama", health_url="http://localhost:11434/api/tags", timeout=5),
        reviewer.HttpClient("groq", "https://api.groq.com/openai/v1/chat/completions", model, key=os.environ.get("GROQ_API_KEY")),
        reviewer.HttpClient("mistral", "https://api.mistral.ai/v1/chat/completions", model, key=os.environ.get("MISTRAL_API_KEY")),
    ]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyspark", description="Audit a table: integrity checks, rules and reports.")
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="audit a file")
    run.add_argument("file")
    run.add_argument("--config")
    run.add_argument("--output-dir", default="output")
    run.add_argument("--sheet")
    run.add_argument("--llm", help="the provider to ask first")
    run.add_argument("--llm-model")
    run.add_argument("--no-llm", action="store_true")
    run.add_argument("--dry-run", action="store_true", help="read configuration, rules and the first rows only")
    run.add_argument("--report-format", action="append", choices=["json", "markdown", "pdf"])
    run.add_argument("--verbose", action="store_true")
    run.add_argument("--session", help="go on with a run that was cut short")
    run.add_argument("--cross-file", help="a second file to verify anomalies against")
    run.add_argument("--cross-key", action="append", metavar="COLUMN[=COLUMN]", help="a key of both files, the second name being the second file's")
    run.add_argument("--contradicts", action="append", metavar="COLUMN OP COLUMN", help="what confirms an anomaly, such as 'amount != total'")
    for name, text in (("review", "decide on findings one by one"), ("export", "write a session's reports again")):
        sub = commands.add_parser(name, help=text)
        sub.add_argument("--session", required=True)
        sub.add_argument("--output-dir", default="output")
        if name == "export":
            sub.add_argument("--format", choices=["json", "markdown", "pdf"], default="markdown")
    sessions = commands.add_parser("sessions", help="list sessions")
    sessions.add_argument("--last", type=int, default=10)
    sessions.add_argument("--output-dir", default="output")
    for name in ("validate-config", "check-llm"):
        sub = commands.add_parser(name)
        sub.add_argument("--config", required=name == "validate-config")
    commands.add_parser("verify", help="check a trail's chain").add_argument("trail")
    return top


def _config(args) -> RunConfig:
    config = load_config(args.config) if args.config else RunConfig()
    if config.rules_file:
        load_rules(config.rules_file)
    return config


def _run(args) -> int:
    config = _config(args)
    if args.sheet:
        config.input.sheet = args.sheet
    if args.report_format:
        config.report_formats = args.report_format
    if args.llm or args.llm_model:
        config.review.enabled = True
        config.review.primary, config.review.model = args.llm or config.review.primary, args.llm_model or config.review.model
    if args.no_llm:
        config.review.enabled = False
    if args.cross_file:
        keys = dict(k.split("=", 1) if "=" in k else (k, k) for k in args.cross_key or [])
        config.cross_file = CrossFile(args.cross_file, keys, [tuple(x.split()) for x in args.contradicts or []])
        parse_config({"cross_file": config.cross_file.__dict__})
    client = None
    if config.review.enabled and (client := reviewer.route(clients(config.review.model), config.review.primary)) is None:
        print("no language model can be reached; the review is left out", file=sys.stderr)
        if args.llm:
            raise ReviewError(f"{args.llm} can't be reached")
    spark = session()
    if args.dry_run:
        from .sources.readers import read_any

        print(f"{args.file}: columns {read_any(spark, args.file, config.input.sheet, config.input.separator, config.input.encoding, config.input.skip_rows).columns}")
        return OK
    if args.verbose:
        logging.basicConfig(level=logging.INFO)
    run = run_audit(spark, args.file, args.output_dir, config, args.session, client)
    print(f"session {run.session_id}: {run.report['status']}, integrity {run.report['integrity']['rating']} ({run.report['integrity']['score']}), anomalies {run.report['anomalies']['total']} {run.report['anomalies']['by_severity']}")
    for error in run.errors:
        print(error, file=sys.stderr)
    return FAILED if run.errors else OK


def _store(args) -> Store:
    return Store(session(), str(Path(args.output_dir) / "store"))


def _review(args) -> int:
    store = _store(args)
    trail = Trail(Path(args.output_dir) / f"{args.session}_trail.jsonl")
    for f in store.findings(args.session).filter(F.col("human_decision").isNull()).orderBy("severity", "row_index").toLocalIterator():
        print(f"{f['severity']} {f['rule_id']} row {f['row_index']} {f['column_name']}: {f['actual_value']} (expected {f['expected_value']}); {f['reasoning']}")
        answer = input("[a]ccept, [r]eject, [s]kip, [q]uit: ").strip().lower()[:1]
        if answer == "q":
            break
        if answer in DECISIONS:
            store.decide(args.session, f["finding_id"], DECISIONS[answer])
            trail.append(TrailEntry(args.session, "DECISION", summary=f"{f['finding_id']} {DECISIONS[answer]}"))
    trail.seal(args.session)
    return OK


def _export(args) -> int:
    store, out = _store(args), Path(args.output_dir)
    found = store.findings(args.session)
    known = store.session(args.session)
    before = json.loads(known["report"] or "{}").get("source") or {"path": known["input_path"], "rows": None}
    report = reports.build(args.session, before, found.filter("layer = 2"), found.filter("layer = 3"))
    place = out / f"{args.session}_export"
    if args.format == "json":
        print(reports.write_json(report, place.with_suffix(".json")))
    else:
        text = reports.markdown(report, f"{args.session}_trail.jsonl")
        place.with_suffix(".md").write_text(text, encoding="utf-8")
        print(reports.write_pdf(text, place.with_suffix(".pdf")) or "PDF needs markdown and weasyprint" if args.format == "pdf" else place.with_suffix(".md"))
    return OK


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "run":
            return _run(args)
        if args.command == "review":
            return _review(args)
        if args.command == "export":
            return _export(args)
        if args.command == "sessions":
            for s in _store(args).sessions(args.last).collect():
                print(s["session_id"], s["started_at"], s["status"], s["input_path"])
            return OK
        if args.command == "validate-config":
            _config(args)
            print("the configuration is valid")
            return OK
        if args.command == "check-llm":
            for c in clients(_config(args).review.model):
                print(c.name, "reachable" if c.healthy() else "not reachable")
            return OK
        good, why = verify(args.trail)
        print("the trail holds" if good else why)
        return OK if good else FAILED
    except AuditError as error:
        print(error, file=sys.stderr)
        return error.exit_code
    except FileNotFoundError as error:
        print(error, file=sys.stderr)
        return BAD_INPUT


if __name__ == "__main__":
    sys.exit(main())
