"""Reports: a small dictionary, Markdown and, where a renderer is installed, PDF. Only aggregates and top rows come to the driver."""

from __future__ import annotations

import hashlib
import json
import math
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ReportError
from ..operators.findings import SEVERITIES, check_scores, integrity_score, severity_counts, summary, top
from ..operators.integrity import NAMES

TABLE_ROWS, TABLE_LIMIT, DETAIL_ROWS = 50, 100, 200
#: Characters of a summary that a language model has written, at most.
SUMMARY_LIMIT = 2000
#: The checks that have a recommendation of their own.
ADVICE = {"IC-002": "Remove or explain the rows that occur more than once.", "IC-006": "Verify the negative amounts against their documents.", "IC-008": "Bring the reference data up to date, or correct the values that are not in it."}


def recommendations(findings: DataFrame) -> DataFrame:
    """(recommendation): what the findings suggest to do, in order."""
    facts = findings.agg(F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("detection_method") == "llm").alias("llm"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("rule_id") == r).alias(r) for r in ADVICE])
    rows = [F.when(F.col("high") > 3, "Escalate: there are more than three findings of high severity.")]
    rows += [F.when(F.col(f"`{r}`") > 0, text) for r, text in ADVICE.items()]
    rows += [F.when(F.col("llm") > 0, "Have a person confirm the findings of the language model.")]
    some = F.array_compact(F.array(*rows))
    generic = F.when(F.col("n") > 0, F.array(F.lit("Review the findings with the owners of the data."))).otherwise(F.array(F.lit("No action is needed.")))
    return facts.select(F.posexplode(F.when(F.size(some) > 0, some).otherwise(generic)).alias("position", "recommendation"))


def clean(value):
    """The value with what JSON can't hold as null."""
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def build(session_id: str, source: dict, integrity: DataFrame, anomalies: DataFrame, errors: list[str] | None = None) -> dict:
    """The report of a session, of bounded size whatever the number of findings."""
    score = integrity_score(integrity).first()
    per_check = {r["rule_id"]: {"findings": r["findings"], "severity_score": r["severity_score"]} for r in check_scores(integrity).collect()}
    counts = severity_counts(anomalies).first().asDict()
    by_rule: dict[str, int] = {}
    for r in summary(anomalies).collect():
        by_rule[r["rule_id"]] = by_rule.get(r["rule_id"], 0) + r["n"]
    listed = top(anomalies, TABLE_LIMIT + 1).collect()
    every = integrity.unionByName(anomalies)
    return clean({
        "session_id": session_id, "source": source, "status": "partial" if errors else "completed", "errors": errors or [],
        "integrity": {"score": score["score"], "rating": score["rating"], "checks": {ic: {"name": name, "findings": 0, "severity_score": 0} | per_check.get(ic, {}) for ic, name in NAMES.items()}},
        "anomalies": {"total": counts["total"], "by_severity": {s: counts[s] for s in SEVERITIES}, "by_rule": by_rule, "llm": counts["llm"]},
        "top_findings": [r.asDict() for r in (listed if len(listed) <= TABLE_LIMIT else listed[:TABLE_ROWS])],
        "high": [r.asDict() for r in anomalies.filter("severity = 'high'").orderBy("row_index", "rule_id").limit(DETAIL_ROWS).collect()],
        "high_total": counts["high"],
        "recommendations": [r["recommendation"] for r in recommendations(every).orderBy("position").collect()],
    })


def escaped(text) -> str:
    return "" if text is None else str(text).replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def _bad(source: dict) -> str:
    return f", {source['bad_lines']} bad lines left out" if source.get("bad_lines") else ""


def _warned(source: dict) -> list[str]:
    return ["", *[f"- Warning: {escaped(w)}" for w in source["warnings"]]] if source.get("warnings") else []


def markdown(report: dict, trail: str | None = None) -> str:
    a, i = report["anomalies"], report["integrity"]
    out = [f"# Audit report {report['session_id']}", "", f"Source: {escaped(report['source'].get('path'))}, {report['source'].get('rows')} rows{_bad(report['source'])}. Status: {report['status']}.", *_warned(report['source']), "", "## Summary", ""]
    out += [escaped(report["summary"])] if report.get("summary") else [f"Integrity is {i['rating']} (score {i['score']}). Anomalies: {a['total']}, of which {a['by_severity']['high']} high, {a['by_severity']['medium']} medium and {a['by_severity']['low']} low.", "", "## Integrity checks", "", "| Check | Name | Findings | Result |", "|-|-|-|-|"]
    out += [f"| {ic} | {c['name']} | {c['findings']} | {'FAIL' if c['findings'] else 'PASS'} |" for ic, c in i["checks"].items()]
    out += ["", "## Anomalies", "", "| Severity | Rule | Row | Column | Value | Expected |", "|-|-|-|-|-|-|"]
    out += [f"| {f['severity']} | {escaped(f['rule_id'])} {escaped(f['rule_name'])} | {f['row_index']} | {escaped(f['column_name'])} | {escaped(f['actual_value'])} | {escaped(f['expected_value'])} |" for f in report["top_findings"]]
    if a["total"] > len(report["top_findings"]):
        out += ["", f"and {a['total'] - len(report['top_findings'])} more"]
    out += ["", "## Findings of high severity", ""] + [f"- row {f['row_index']}, {escaped(f['rule_id'])}: {escaped(f['reasoning'])} (value {escaped(f['actual_value'])}, expected {escaped(f['expected_value'])})" for f in report["high"]]
    if report["high_total"] > len(report["high"]):
        out += ["", f"and {report['high_total'] - len(report['high'])} more of high severity; {report.get('high_file') or 'the table of findings'} has them all"]
    out += ["", "## Recommendations", ""] + [f"- {r}" for r in report["recommendations"]] + ["", "## Trail", "", trail or "none", ""]
    return "\n".join(out)


def write_json(report: dict, path: Path) -> Path:
    try:
        part = path.with_suffix(".part")
        part.write_text(json.dumps(report, indent=2, ensure_ascii=False, allow_nan=False), encoding="utf-8")
        os.replace(part, path)
    except OSError as error:
        raise ReportError(f"{path}: {error}") from error
    return path


def write_high(anomalies: DataFrame, path: str) -> str:
    """All findings of high severity as JSON lines, in order over the folder's files, written by Spark: there may be any number."""
    anomalies.filter("severity = 'high'").repartitionByRange("row_index", "rule_id").sortWithinPartitions("row_index", "rule_id").write.mode("overwrite").json(path)
    return path


def facts_of(report: dict) -> dict:
    """What a language model is told of a report to sum it up: counts only."""
    return {"integrity": {k: v for k, v in report["integrity"].items() if k != "checks"}, "checks": {k: c["findings"] for k, c in report["integrity"]["checks"].items() if c["findings"]}, "anomalies": report["anomalies"], "rows": report["source"].get("rows")}


def written_summary(report: dict, client) -> str | None:
    """A summary in a language model's words; None, so that the template's stands, without a client or a usable answer."""
    if client is None:
        return None
    try:
        said = client.complete(f"Sum up this audit in at most five sentences for its owner, from these counts alone: {json.dumps(facts_of(report), sort_keys=True)}")
    except (OSError, ValueError, KeyError):
        return None
    said = " ".join((said or "").split())
    return said if 0 < len(said) <= SUMMARY_LIMIT else None


def write_pdf(text: str, path: Path) -> Path | None:
    """The Markdown as PDF with its hash in the footer; None where the renderers are not installed."""
    try:
        import markdown as renderer
        from weasyprint import HTML
    except ImportError:
        return None
    digest = hashlib.sha256(text.encode()).hexdigest()
    body = renderer.markdown(text, extensions=["tables"])
    HTML(string=f"<style>@page {{ @bottom-center {{ content: 'SHA-256 {digest}'; font-size: 7pt }} }}</style>{body}").write_pdf(str(path))
    return path
