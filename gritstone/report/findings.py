"""Findings as counts, groups, SARIF, Markdown and result folders.

Counts and groups are DataFrames; only findings that go into one document come to the driver, in their total order.
"""

from __future__ import annotations

import json
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.operators.compose import SEVERITIES, glob, severity_rank
from gritstone.wql.evaluate import Engine

_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
_SCORE = {"CRITICAL": "9.5", "HIGH": "8.0", "MEDIUM": "5.5", "LOW": "3.0", "INFO": "0.0"}


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def unique_issues(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_distinct("template_id").alias("n"))


def groups(findings: DataFrame) -> DataFrame:
    """severity, template_id, n, places: one row a template, worst first."""
    place = F.concat_ws(":", "file", "line")
    return findings.groupBy("severity", "template_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(place)).alias("places")).orderBy(severity_rank("severity"), "template_id")


def chosen(findings: DataFrame, severities: list[str] | None = None, least: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """By exact severities, a least severity, and globs over template ids."""
    if severities:
        findings = findings.filter(F.col("severity").isin([s.upper() for s in severities]))
    if least:
        findings = findings.filter(severity_rank("severity") <= SEVERITIES.index(least.upper()))
    for patterns, wanted in ((include, True), (exclude, False)):
        if patterns:
            hit = F.lit(False)
            for p in patterns:
                hit = hit | glob("template_id", p)
            findings = findings.filter(hit if wanted else ~hit)
    return findings


def sarif(findings: DataFrame, version: str = "1") -> dict:
    """A SARIF 2.1.0 log; columns count code points."""
    rows = [r.asDict(recursive=True) for r in Engine.ordered(findings).collect()]
    rules = {r["template_id"]: {"id": r["template_id"], "name": r["title"] or r["template_id"], "shortDescription": {"text": r["title"] or r["template_id"]}, "properties": {"security-severity": _SCORE[r["severity"]]}} for r in rows}

    def place(r: dict) -> dict:
        region = {"startLine": max(1, r["line"]), "startColumn": max(1, r["col"])}
        if r.get("end_line"):
            region |= {"endLine": r["end_line"], "endColumn": max(1, r["end_col"]), "byteOffset": r["begin_byte"], "byteLength": max(0, r["end_byte"] - r["begin_byte"])}
        return {"physicalLocation": {"artifactLocation": {"uri": quote(r["file"].lstrip("/"))}, "region": region}}

    results = [{"ruleId": r["template_id"], "level": _LEVEL[r["severity"]], "message": {"text": r["message"] or r["title"] or r["template_id"]}, "locations": [place(r)], "relatedLocations": [place(x) for x in r["related"] or []]} for r in rows]
    return {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "gritstone", "version": version, "rules": [rules[k] for k in sorted(rules)]}}, "columnKind": "unicodeCodePoints", "results": results}]}


def _cell(x) -> str:
    return str("" if x is None else x).replace("|", "\\|").replace("\n", " ").replace("<", "&lt;")


def markdown(findings: DataFrame) -> str:
    """By severity, then template."""
    rows = Engine.ordered(findings).collect()
    out = ["# Findings", "", f"{len(rows)} in all.", ""]
    for s in SEVERITIES:
        mine = [r for r in rows if r.severity == s]
        if mine:
            out += [f"## {s.title()} ({len(mine)})", ""]
        for t in sorted({r.template_id for r in mine}):
            one = [r for r in mine if r.template_id == t]
            out += [f"### {_cell(one[0].title or t)} (`{t}`)", "", "| File | Line | Contract | Function | What |", "|---|---|---|---|---|"]
            out += [f"| {_cell(r.file)} | {r.line} | {_cell(r.contract)} | {_cell(r.function)} | {_cell(r.primary_name)} |" for r in one] + [""]
    return "\n".join(out)


def write(findings: DataFrame, folder: str) -> None:
    """findings.json, findings.sarif, README.md with counts, findings.md."""
    p = Path(folder)
    p.mkdir(parents=True, exist_ok=True)
    rows = [r.asDict(recursive=True) for r in Engine.ordered(findings).collect()]
    (p / "findings.json").write_text(json.dumps(rows, indent=1))
    (p / "findings.sarif").write_text(json.dumps(sarif(findings), indent=1))
    (p / "findings.md").write_text(markdown(findings))
    counts = {s: sum(r["severity"] == s for r in rows) for s in SEVERITIES}
    (p / "README.md").write_text("# Summary\n\n" + "\n".join(f"- {s}: {n}" for s, n in counts.items()) + f"\n- templates that fired: {len({r['template_id'] for r in rows})}\n")
