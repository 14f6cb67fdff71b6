"""A run: ingest, integrity checks, rules and grouped detections, optional review, cross-verification, report.

Each layer's output is a committed stage (see stages.py): later layers read its columns from files, and a run that was cut short
goes on, under the same session, after the last layer that it had committed."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LayerError
from ..functions.coerce import headers
from ..operators import grouped, integrity, profile
from ..operators.crossverify import cross_verify, verify_by_file
from ..operators.digest import hash_record, hash_table
from ..operators.findings import shaped
from ..operators.rules import RuleEngine, default_rules, fields_of
from ..operators.rules import load as load_rules
from ..sources.files import Files
from ..sources.readers import SourceError, open_source
from . import report as reports
from . import review
from .calls import CallLog, trail_rows
from .config import RunConfig
from .manifest import ColumnMeta, SourceManifest
from .stages import Stages
from .store import Store, now
from .trail import Trail, TrailEntry


@dataclass(frozen=True)
class AuditRun:
    """What is known after each layer; layers return the next state."""

    session_id: str
    config: RunConfig
    table: DataFrame | None = None
    types: dict[str, str] = field(default_factory=dict)
    source: dict = field(default_factory=dict)
    integrity: DataFrame | None = None
    anomalies: DataFrame | None = None
    errors: tuple[str, ...] = ()
    report: dict = field(default_factory=dict)


#: A column with more than this share of nulls is worth a warning.
MOSTLY_NULL = 0.8


def row_headers(names: list[str]) -> list[str]:
    """headers(), of which none is row_index."""
    return headers(["row_index", *names])[1:]


def ingest(spark: SparkSession, path: str, run: AuditRun) -> tuple[DataFrame, SourceManifest, DataFrame | None]:
    """(normalised table, manifest, bad lines if there are any): read, number, prune, rename, infer, normalise.

    row_index is the row's place in the source, before pruning. The source is read once for all facts of all columns, once
    (over its first rows) for inference, and once, by whoever writes the table, to normalise it."""
    c = run.config.input
    source = open_source(spark, path, c.sheet, c.separator, c.encoding, c.skip_rows, row_headers, "row_index")
    raw, names = source.table, row_headers(source.names)
    hints = {k: r.dtype for k, r in run.config.integrity.columns.items() if r.dtype and k in names}
    facts = profile.survey(raw.na.drop("all", subset=names), hints=hints, approximate=c.approximate_profile)
    counts = source.counts()
    rows = next(iter(facts.values())).row_count if facts else 0
    if not rows:
        raise SourceError(f"{path} has no rows")
    if c.max_rows is not None and counts["records"] > c.max_rows:
        raise SourceError(f"the input has more than {c.max_rows} rows")
    kept = [n for n in names if facts[n].null_count < rows]
    types, locales = {n: facts[n].dtype for n in kept}, {n: facts[n].locale for n in kept}
    table = profile.normalise(raw.na.drop("all", subset=names).select("row_index", *kept), types, locales=locales)
    warnings = list(source.warnings)
    warnings += [f"{counts['bad_lines']} lines could not be read and are left out"] if counts["bad_lines"] else []
    warnings += [f"{n} is empty and left out" for n in names if n not in kept]
    warnings += [f"{facts[n].null_ratio:.0%} of {n} is null" for n in kept if facts[n].null_ratio > MOSTLY_NULL]
    warnings += [f"{n} has amounts in several currencies: {', '.join(facts[n].codes)}" for n in kept if len(facts[n].codes) > 1]
    files = Files(spark, path).listed()
    columns = [ColumnMeta(o, n, facts[n].dtype, facts[n].null_count, facts[n].null_ratio, facts[n].unique_count, list(facts[n].samples)) for o, n in zip(source.names, names) if n in kept]
    manifest = SourceManifest(str(path), source.kind, len(files), sum(n for _, n in files), source.encoding, source.separator, counts["records"], counts["bad_lines"], rows, "", columns, warnings)
    return table, manifest, source.rejected if counts["bad_lines"] else None


def check_integrity(run: AuditRun) -> DataFrame:
    return integrity.run_checks(run.table, run.config.integrity, run.session_id)


def rules_of(config: RunConfig) -> list:
    return [r for r in (load_rules(config.rules_file) if config.rules_file else default_rules()) if r.id != "R018"]


def detect(run: AuditRun, client: review.Client | None = None, log: CallLog | None = None) -> DataFrame:
    """Rules in one scan, over the table with the flags that active rules test, R018 in any case, and the reviewer on rows that neither has flagged."""
    c = run.config
    engine = RuleEngine(rules_of(c), c.settings())
    wanted = fields_of([r for r in engine.rules if r.active])
    flagged = grouped.with_flags(run.table, c.flag_columns, c.journal_tolerance, wanted=wanted)
    found = engine.evaluate(flagged, run.session_id)
    found = found.unionByName(grouped.frequent_small(run.table, limit=c.approval_limit, least=c.frequent_count, session_id=run.session_id))
    if c.review.enabled and client is not None:
        batched = review.batches(run.table, found, c.review.hidden_columns, c.review.batch_size)
        replies = review.ask(batched, client, [x for x in run.table.columns if x != "row_index"], c.review.max_retries, log, c.review.column_notes)
        found = found.unionByName(review.validated(replies, batched, run.session_id))
    return found


def write_rules(run: AuditRun, path: Path) -> Path:
    """The rules that a run uses, lists in place of placeholders, as a file that another run can use."""
    engine = RuleEngine(rules_of(run.config), run.config.settings())
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump({"rules": [{k: v for k, v in r.__dict__.items() if v not in (None, [], "")} for r in engine.rules]}, sort_keys=False, allow_unicode=True), encoding="utf-8")
    return path


def run_audit(spark: SparkSession, path: str, out: str | Path, config: RunConfig | None = None, session_id: str | None = None, client: review.Client | None = None, other: DataFrame | None = None, contradicts=None) -> AuditRun:
    """All layers over one input, with a report, a manifest, a sealed trail and stored findings under `out`.

    Without readable input the run fails; an error of a later layer is kept, later layers still run, and the status is partial.
    Given the session_id of a run that was cut short, with the same input, configuration and code, the layers that it had
    committed are taken from their stages. A second dataset is `other`, joined by row_index, or the configuration's cross_file."""
    out = Path(out)
    out.mkdir(parents=True, exist_ok=True)
    run = AuditRun(session_id or str(uuid.uuid4()), config or RunConfig())
    c, sid = run.config, run.session_id
    trail, store, stages = Trail(out / f"{sid}_trail.jsonl"), Store(spark, str(out / "store")), Stages(spark, str(out / "stages"))
    none = shaped(spark.range(0).select(F.col("id").alias("row_index")))
    digest = hash_record(json.loads(json.dumps(c, default=lambda o: o.__dict__, sort_keys=True)))
    trail.append(TrailEntry(sid, "START", summary=str(path)[:500]))
    store.save_session(sid, input_path=str(path), config_hash=digest, status="running")

    def stage(name: str, number: str, key: str, make, summary=lambda facts: "") -> tuple[DataFrame, dict]:
        """A layer's committed output, made unless it is there; make gives (table, facts)."""
        got = stages.load(number, key)
        action = f"{name}_REUSED" if got else name
        if got is None:
            df, facts = make()
            got = stages.save(number, key, df, facts)
        trail.append(TrailEntry(sid, action, number, summary(got[1])[:500], details={"stage": key[:32]}))
        return got

    def read() -> tuple[DataFrame, dict]:
        table, manifest, rejected = ingest(spark, path, run)
        if rejected is not None:
            rejected.write.mode("overwrite").parquet(str(out / f"{sid}_rejected"))
        return table, manifest.to_dict()

    first = Stages.key(Files(spark, str(path)).identity(), c.input.__dict__, {k: r.dtype for k, r in c.integrity.columns.items()})
    table, manifest = stage("INGEST", "1", first, read, lambda f: f"{f['rows']} rows, {f['bad_lines']} bad lines")
    digest_of = Stages.key(first, "digest")
    if (known := stages.load("1-digest", digest_of)) is None:
        known = stages.save("1-digest", digest_of, spark.range(0), {"digest": hash_table(table)})
    manifest = manifest | {"digest": known[1]["digest"]}
    reports.write_json(manifest, out / f"{sid}_manifest.json")
    columns = [{"original": m["original"], "name": m["name"], "type": m["dtype"]} for m in manifest["columns"]]
    source = {k: manifest[k] for k in ("path", "rows", "records", "bad_lines", "encoding", "separator", "warnings", "digest")} | {"columns": columns}
    run = replace(run, table=table, types={m["name"]: m["dtype"] for m in manifest["columns"]}, source=source)

    def layer(name: str, number: str, key: str, make) -> DataFrame:
        nonlocal run
        try:
            return stage(name, number, key, lambda: (make().withColumn("created_at", F.lit(now())), {}))[0]
        except Exception as error:  # a layer's failure is reported and the next one runs
            run = replace(run, errors=(*run.errors, str(LayerError(name, error))))
            trail.append(TrailEntry(sid, f"{name}_FAILED", number, str(error)[:500]))
            return none

    log = CallLog(str(out / "calls"), sid) if c.review.enabled and client is not None else None
    run = replace(run, integrity=layer("INTEGRITY", "2", Stages.key(first, sid, hash_record(json.loads(json.dumps(c.integrity, default=lambda o: o.__dict__)))), lambda: check_integrity(run)))
    rules = [r.__dict__ for r in rules_of(c)] if not c.rules_file or Path(c.rules_file).exists() else str(c.rules_file)
    third = Stages.key(first, sid, digest, rules, client.name if log else None)
    run = replace(run, anomalies=layer("ANOMALY", "3", third, lambda: detect(run, client, log)))
    if log:
        calls = log.entries(spark)
        trail.extend(sid, trail_rows(calls), "3")
        store.replace_calls(sid, calls)
    if isinstance(rules, list):
        write_rules(run, out / "rules" / f"{sid}_rules.yaml")
        store.save_rules(sid, RuleEngine(rules_of(c), c.settings()).rules)

    def crossed() -> DataFrame:
        if c.cross_file.file and other is None:
            second = open_source(spark, c.cross_file.file, naming=row_headers, index="row_index").table
            return shaped(verify_by_file(run.anomalies, run.table, second.drop("row_index"), c.cross_file))
        return shaped(cross_verify(run.anomalies, other, "row_index", contradicts))

    if other is not None or c.cross_file.file:
        beside = str(uuid.uuid4()) if other is not None or not Files(spark, c.cross_file.file).exists() else Files(spark, c.cross_file.file).identity()
        before = len(run.errors)
        checked = layer("CROSS_VERIFY", "4", Stages.key(third, c.cross_file.__dict__, beside), crossed)
        run = replace(run, anomalies=checked if len(run.errors) == before else run.anomalies)
    else:
        run = replace(run, anomalies=shaped(cross_verify(run.anomalies, None)))
        trail.append(TrailEntry(sid, "CROSS_VERIFY", "4", "no second dataset"))
    store.replace_findings(sid, run.integrity.unionByName(run.anomalies))
    stored = store.table("findings").filter(F.col("session_id") == sid)
    run = replace(run, integrity=stored.filter("layer = 2"), anomalies=stored.filter("layer = 3"))
    report = reports.build(sid, run.source, run.integrity, run.anomalies, list(run.errors))
    if report["high_total"] > len(report["high"]):
        report["high_file"] = reports.write_high(run.anomalies, str(out / f"{sid}_high"))
    if said := reports.written_summary(report, client if c.review.enabled and c.review.write_summary else None):
        report["summary"] = said
    run = replace(run, report=report)
    reports.write_json(report, out / f"{sid}_report.json")
    text = reports.markdown(report, trail.path.name)
    if "markdown" in c.report_formats:
        (out / f"{sid}_report.md").write_text(text, encoding="utf-8")
    if "pdf" in c.report_formats:
        reports.write_pdf(text, out / f"{sid}_report.pdf")
    store.save_session(sid, input_path=str(path), input_hash=run.source["digest"], config_hash=digest, status=report["status"], report=json.dumps(report))
    trail.append(TrailEntry(sid, "REPORT", "5", f"{report['anomalies']['total']} anomalies, integrity {report['integrity']['rating']}"))
    trail.seal(sid)
    return run
