"""Reports of a run. What a reader sees is small and rendered on the driver from bounded, ordered rows; the formats that
carry all findings are written as tables by the tasks."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import scalars as S
from sievework.operators import scoring as G
from sievework.operators.catalog import RULES
from sievework.operators.findings import canonical_order

ANALYSIS, HOTSPOT, SUMMARY, SARIF = "sievework.analysis.v1", "sievework.hotspot.v1", "sievework.summary.v1", "2.1.0"
# How much a report for readers shows. Fixed values.
MARKDOWN_ROWS, HTML_ROWS, OFFENDERS, HINT = 50, 250, 10, 50
LEVELS = {"advisory": "notice", "warning": "warning", "error": "error"}
SARIF_LEVELS = {"advisory": "note", "warning": "warning", "error": "error"}


def digest(findings: DataFrame, repo_keys: tuple[str, ...] = ("file_path",)) -> dict:
    """Scores, grades and counts of a run: a few rows each, whatever the number of findings."""
    penalised = G.penalties(findings)
    pillars = [r.asDict() for r in G.pillar_rows(penalised).orderBy(F.desc("findings"), "pillar").collect()]
    total = G.composite(G.scores(penalised, "pillar")).first()
    return {
        "summary": G.severity_counts(findings).first().asDict(), "score": total["score"], "grade": total["grade"], "pillars": pillars,
        "severities": [r.asDict() for r in G.severity_grades(findings).orderBy("severity").collect()],
        "offenders": [r.asDict() for r in G.offenders(penalised, *repo_keys).limit(OFFENDERS).collect()], "top_rules": [r.asDict() for r in G.top_rules(findings, 10).collect()],
    }


def first_findings(findings: DataFrame, n: int) -> list[dict]:
    """The first n in canonical order: a report's length is the feature."""
    columns = ["rule_id", "message", "file_path", "line", "severity", "pillar", "confidence", "symbol", "fingerprint"]
    return [r.asDict() for r in findings.orderBy(*canonical_order()).limit(n).select(*columns).collect()]


def text_lines(findings: DataFrame) -> Iterator[str]:
    """The report for terminals, line by line: scores, complex places, and every finding in canonical order. Findings come
    from the tasks one part at a time, so that their number is no matter."""
    d = digest(findings)
    s = d["summary"]
    yield f"Score {d['score']:.1f} ({d['grade']})"
    yield f"Findings {s['total']}: {s['error']} errors, {s['warning']} warnings, {s['advisory']} advisories"
    yield "  ".join(f"{x['severity']} {x['grade']}" for x in d["severities"])
    for c in G.complexity_clusters(findings).orderBy("file_path", "symbol").toLocalIterator():
        yield f"Complex: {c['file_path']} {c['symbol']} ({', '.join(c['rule_ids'])})"
    for f in findings.orderBy(*canonical_order()).select("file_path", "line", "severity", "rule_id", "message").toLocalIterator():
        yield f"{f['file_path']}:{f['line'] or 0} {f['severity']} {f['rule_id']} {f['message']}"
    if s["total"] >= HINT:
        yield "Many findings: a baseline lets you begin with the new ones."


def text(findings: DataFrame) -> str:
    return "\n".join(text_lines(findings)) + "\n"


def markdown(findings: DataFrame) -> str:
    d = digest(findings)
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    out = [f"# Score {d['score']:.1f} ({d['grade']})", "", "| Pillar | Grade | Score | Findings | Errors | Warnings | Advisories |", "|---|---|---|---|---|---|---|"]
    out += [f"| {p['pillar']} | {p['grade']} | {p['score']:.1f} | {p['findings']} | {p['error']} | {p['warning']} | {p['advisory']} |" for p in d["pillars"]]
    out += ["", "| File | Line | Severity | Rule | Message |", "|---|---|---|---|---|"]
    out += [f"| {cell(f['file_path'])} | {f['line'] or ''} | {f['severity']} | {f['rule_id']} | {cell(f['message'])} |" for f in first_findings(findings, MARKDOWN_ROWS)]
    return "\n".join(out) + "\n"


def html_page(findings: DataFrame) -> str:
    d = digest(findings)
    e = lambda v: html.escape(str(v), quote=True)
    metric = findings.where(F.col("rule_id") == S.CORRELATED[1]).select(F.get_json_object("metadata_json", "$.value").try_cast("int").alias("value"))
    bars = "".join(f"<li>{e(r['label'])}: {r['n']}</li>" for r in G.histogram(metric, "value", [10, 15, 20, 30]).orderBy("bucket").collect())
    rows = "".join(f"<tr><td>{e(f['file_path'])}</td><td>{f['line'] or ''}</td><td>{e(f['severity'])}</td><td>{e(f['rule_id'])}</td><td>{e(f['message'])}</td></tr>" for f in first_findings(findings, HTML_ROWS))
    pillars = "".join(f"<tr><td>{e(p['pillar'])}</td><td>{p['grade']}</td><td>{p['score']:.1f}</td><td>{p['findings']}</td></tr>" for p in d["pillars"])
    worst = "".join(f"<li>{e(o['file_path'])}: {o['score']:.1f}</li>" for o in d["offenders"])
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Report</title></head><body><h1>Score {d['score']:.1f} ({d['grade']})</h1><table>{pillars}</table><h2>Worst files</h2><ol>{worst}</ol><h2>Branches</h2><ul>{bars}</ul><table>{rows}</table></body></html>"


def analysis_json(findings: DataFrame, most: int = 1_000_000) -> str:
    """One document with all findings; more than ``most`` raise, and belong into :func:`json_lines`."""
    rows = first_findings(findings, most + 1)
    if len(rows) > most:
        raise ValueError("too many findings for one document; write json_lines() as a table")
    d = digest(findings)
    drop = lambda x: {k: v for k, v in x.items() if v is not None}
    return json.dumps({"schemaVersion": ANALYSIS, "summary": d["summary"], "score": {"composite": d["score"], "grade": d["grade"], "pillars": d["pillars"], "topOffenders": d["offenders"]}, "findings": [drop(r) for r in rows]}, indent=2)


def hotspot_json(findings: DataFrame) -> str:
    d = digest(findings)
    return json.dumps({"schemaVersion": HOTSPOT, "composite": d["score"], "grade": d["grade"], "topOffenders": d["offenders"]}, indent=2)


def summary(findings: DataFrame, top: int = 10, as_json: bool = False) -> str:
    d = digest(findings)
    if as_json:
        return json.dumps({"schemaVersion": SUMMARY, "summary": d["summary"], "composite": d["score"], "grade": d["grade"], "pillars": d["pillars"], "topRules": d["top_rules"][:top], "topFiles": d["offenders"][:top]}, indent=2)
    out = [f"{d['score']:.1f} {d['grade']}"] + [f"{p['pillar']:<16} {p['grade']} {p['findings']:>6}" for p in d["pillars"]] + [f"{r['findings']:>6} {r['rule_id']}" for r in d["top_rules"][:top]]
    return "\n".join(out) + "\n"


def json_lines(findings: DataFrame) -> DataFrame:
    """Every finding as a line of JSON, nulls left out; to be written with ``.write.text``."""
    return findings.select(F.to_json(F.struct("rule_id", "message", "file_path", "line", "severity", "pillar", "confidence", "symbol", "fingerprint")).alias("value"))


def annotations(findings: DataFrame) -> DataFrame:
    """Every finding as a workflow command; to be written with ``.write.text``."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("notice")
    p = lambda c: S.annotation_escaped(F.coalesce(c.cast("string"), F.lit("")), True)
    return findings.select(F.concat(F.lit("::"), level, F.lit(" file="), p(F.col("file_path")), F.lit(",line="), F.coalesce("line", F.lit(1)).cast("string"), F.lit(",title="), p(F.col("rule_id")), F.lit("::"), S.annotation_escaped(F.coalesce("message", F.lit("")))).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """Results of a SARIF log as lines of JSON: rule, its place in the catalogue, level, message, place and fingerprint."""
    spark = findings.sparkSession
    order = spark.createDataFrame([(r, i) for i, r in enumerate(sorted(RULES))], "rule_id string, ruleIndex int")
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    region = F.when(F.col("line").isNotNull() & (F.col("line") > 0), F.struct(F.col("line").alias("startLine")))
    place = F.array(F.struct(F.struct(F.struct(S.uri_escaped(F.col("file_path")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    joined = findings.join(F.broadcast(order), "rule_id", "left")  # the catalogue is fixed
    return joined.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "ruleIndex", level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))).alias("value"))


def sarif(findings: DataFrame, most: int = 1_000_000) -> str:
    results = [json.loads(r[0]) for r in sarif_results(findings.orderBy(*canonical_order())).limit(most + 1).collect()]
    if len(results) > most:
        raise ValueError("too many findings for one log; write sarif_results() as a table")
    rules = [{"id": r, "shortDescription": {"text": RULES[r].description}, "help": {"text": RULES[r].remediation}, "defaultConfiguration": {"level": SARIF_LEVELS[RULES[r].severity]}, "properties": {"pillar": RULES[r].pillar, "confidence": RULES[r].confidence}} for r in sorted(RULES)]
    return json.dumps({"version": SARIF, "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "sievework", "rules": rules}}, "results": results}]}, indent=2)


FORMATS = {"text": text, "markdown": markdown, "html": html_page, "json": analysis_json, "hotspot": hotspot_json, "sarif": sarif}
