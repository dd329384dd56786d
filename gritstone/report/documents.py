"""Documents about a code database and its findings: navigation, explorer, overview, diagnostics, summary, HTML, and the folder that holds all of them.

Whatever grows with the code is put together by DataFrames; a document's own rows come to the driver, for a document is read by people.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone import __version__
from gritstone.operators.compose import SEVERITIES
from gritstone.plans import extract
from gritstone.report import findings as report
from gritstone.solidity.codedb import CodeDB
from gritstone.wql.evaluate import Engine


def safe_name(name: str) -> str:
    """A name that any file system takes: letters, digits, dot, dash and underscore, never hidden, never empty."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", name).lstrip(".") or "_"


def fence(text: str, language: str = "") -> str:
    """A Markdown code block whose fence is longer than any run of back-ticks in it."""
    longest = max((len(m) for m in re.findall(r"`+", text)), default=0)
    mark = "`" * max(3, longest + 1)
    return f"{mark}{language}\n{text}\n{mark}"


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


# --- navigation ------------------------------------------------------------------------------------------------------


def navigation(db: CodeDB) -> DataFrame:
    """function_id, callers, callees, implemented_by: only calls whose exact target is a function of the database lead anywhere."""
    known = db.functions.select("function_id").distinct()
    edges = db.calls.filter("dst is not null").join(known.withColumnRenamed("function_id", "dst"), "dst", "left_semi").select("src", "dst", "line")
    into = edges.groupBy(F.col("dst").alias("function_id")).agg(F.array_sort(F.collect_set(F.struct(F.col("src").alias("function_id"), "line"))).alias("callers"))
    out = edges.groupBy(F.col("src").alias("function_id")).agg(F.array_sort(F.collect_set(F.struct(F.col("dst").alias("function_id"), "line"))).alias("callees"))
    made = extract.implementations(db).groupBy(F.col("interface_function").alias("function_id")).agg(F.array_sort(F.collect_set("function_id")).alias("implemented_by"))
    place = db.functions.groupBy("function_id").agg(F.min(F.struct("file", "line", "name", "contract_id")).alias("at")).select("function_id", "at.*")
    return place.join(into, "function_id", "left").join(out, "function_id", "left").join(made, "function_id", "left")


def explorer(db: CodeDB) -> DataFrame:
    """A row for each contract: where it lies, its order of bases, its functions and variables."""
    functions = db.functions.groupBy("contract_id").agg(F.array_sort(F.collect_list(F.struct("line", "name", "kind", "selector", "signature", "visibility", "mutability", "is_entry", "function_id"))).alias("functions"))
    variables = db.state_vars.groupBy("contract_id").agg(F.array_sort(F.collect_list(F.struct("decl_idx", "name", "type_name", "visibility", "is_constant", "is_immutable", "line"))).alias("variables"))
    order = db.lineage.groupBy("contract_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base_id"))), lambda x: x["base_id"]).alias("linearization"))
    heads = db.contracts.select("contract_id", "name", "kind", "file", "line", "weight")
    return heads.join(order, "contract_id", "left").join(functions, "contract_id", "left").join(variables, "contract_id", "left")


def overview(db: CodeDB, findings: DataFrame) -> dict:
    """Counts of code and findings, and the contracts to start with, the most derived first."""
    counts = {r["severity"]: r["n"] for r in _rows(report.severity_counts(findings))}
    mains = db.main_contracts.join(db.contracts.select("contract_id", "name", "file"), "contract_id").orderBy(F.desc("weight"), "contract_id")
    return {"stats": {r["what"]: r["n"] for r in _rows(extract.stats(db))}, "severities": {s: counts.get(s, 0) for s in SEVERITIES}, "unique_issues": report.unique_issues(findings).first()[0], "main_contracts": _rows(mains), "complete": extract.complete(db)}


def diagnostics(db: CodeDB) -> dict:
    """What the analysis couldn't do, in a total order, with counts; complete if nothing of it hides code."""
    rows = _rows(db.diagnostics.distinct().orderBy("file", "line", "code", "severity", "message"))
    counts: dict[str, int] = {}
    for r in rows:
        counts[r["severity"]] = counts.get(r["severity"], 0) + 1
    return {"counts": counts, "complete": not rows, "diagnostics": rows}


def mermaid(db: CodeDB, contract: str | None = None) -> str:
    """The resolved calls among functions (of one contract's lineage) as a Mermaid graph."""
    edges = extract.edges(db)
    if contract is not None:
        own = db.lineage.filter(F.col("contract_id") == extract.the_contract(db, contract)).select("base_id")
        inner = db.functions.join(own, F.col("contract_id") == F.col("base_id"), "left_semi").select(F.col("function_id").alias("src"))
        edges = edges.join(inner.distinct(), "src", "left_semi")
    pairs = sorted({(r["src"], r["dst"], r["type"]) for r in _rows(edges)})
    ids = {f: f"n{i}" for i, f in enumerate(sorted({x for p in pairs for x in p[:2]}))}
    label = lambda f: f.split("#")[-1].replace('"', "'")
    return "\n".join(["graph TD", *(f'  {n}["{label(f)}"]' for f, n in ids.items()), *(f"  {ids[a]} -->|{t}| {ids[b]}" for a, b, t in pairs)])


def summary(db: CodeDB, findings: DataFrame) -> str:
    """The project in Markdown: counts, each main contract with its bases, entries and written state."""
    o = overview(db, findings)
    out = ["# Summary", "", *(f"- {k}: {v}" for k, v in sorted(o["stats"].items())), "", "| Severity | Findings |", "|---|---|", *(f"| {s} | {n} |" for s, n in o["severities"].items()), ""]
    entries: dict[str, list[str]] = {}
    for r in _rows(db.entry_functions.orderBy("contract_id", "function_id")):
        entries.setdefault(r["contract_id"], []).append(f"{r['function_id'].split('#')[-1]} ({r['signature']})")
    bases: dict[str, list[str]] = {}
    for r in _rows(db.lineage.join(db.main_contracts.select("contract_id"), "contract_id", "left_semi").orderBy("contract_id", "pos")):
        bases.setdefault(r["contract_id"], []).append(r["base_id"].split("#")[-1])
    for c in o["main_contracts"]:
        out += [f"## {c['name']}", "", f"`{c['file']}`, {' → '.join(bases.get(c['contract_id'], []))}", "", *(f"- `{e}`" for e in entries.get(c["contract_id"], [])), ""]
    return "\n".join(out)


# --- findings as HTML ------------------------------------------------------------------------------------------------


def excerpts(db: CodeDB, findings: DataFrame, context: int = 3) -> DataFrame:
    """The findings with the lines around each, numbered."""
    lines = db.files.select(F.col("path").alias("file"), F.split("content", "\n").alias("lines"))
    first = F.greatest(F.lit(1), F.col("line") - context)
    cut = F.slice("lines", first, F.col("end_line") + context - first + 1)
    numbered = F.array_join(F.transform(cut, lambda x, i: F.concat((first + i).cast("string"), F.lit("  "), x)), "\n")
    return findings.join(lines, "file", "left").withColumn("excerpt", F.coalesce(numbered, F.lit(""))).drop("lines")


_STYLE = "body{font:15px system-ui;margin:2em auto;max-width:60em;padding:0 1em}pre{background:#f4f4f4;padding:.7em;overflow:auto}.CRITICAL,.HIGH{color:#a00}.MEDIUM{color:#a60}.LOW,.INFO{color:#555}summary{cursor:pointer}"


def html_page(db: CodeDB, findings: DataFrame) -> str:
    """One page without scripts or outside resources: findings by severity and template, each with its way from the entry and its lines."""
    rows = _rows(Engine.ordered(excerpts(db, findings)))
    e = lambda x: html.escape(str("" if x is None else x), quote=True)
    out = ["<!doctype html><html lang=en><meta charset=utf-8><title>Findings</title>", f"<style>{_STYLE}</style><h1>Findings</h1><p>{len(rows)} in all.</p>"]
    for s in SEVERITIES:
        mine = [r for r in rows if r["severity"] == s]
        if mine:
            out.append(f"<h2 class={s}>{s.title()} ({len(mine)})</h2>")
        for t in sorted({r["template_id"] for r in mine}):
            one = [r for r in mine if r["template_id"] == t]
            out.append(f"<details open><summary><b>{e(one[0]['title'] or t)}</b> <code>{e(t)}</code> ({len(one)})</summary>")
            for r in one:
                way = " → ".join(p.split("#")[-1] for p in r["path"] or [])
                out.append(f"<p>{e(r['file'])}:{r['line']}:{r['col']} {e(r['contract'])}.{e(r['function'])}{'<br>' + e(way) if way else ''}</p><pre>{e(r['excerpt'])}</pre>")
            out.append("</details>")
    return "\n".join([*out, "</html>"])


# --- the folder ------------------------------------------------------------------------------------------------------


def bundle(db: CodeDB, findings: DataFrame, folder: str, project: dict | None = None) -> dict:
    """All documents in a folder, a subfolder for each main contract, and manifest.json with the checksums of what was read and written."""
    p = Path(folder)
    report.write(findings, folder)
    (p / "data").mkdir(exist_ok=True)
    text = lambda x: json.dumps(x, indent=1, ensure_ascii=False)
    wrote = {"summary.md": summary(db, findings), "overview.md": "# Calls\n\n" + fence(mermaid(db), "mermaid") + "\n", "findings.html": html_page(db, findings)}
    wrote |= {f"data/{n}.json": text(x) for n, x in (("overview", overview(db, findings)), ("diagnostics", diagnostics(db)), ("nav", _rows(navigation(db).orderBy("function_id"))), ("explorer", _rows(explorer(db).orderBy("contract_id"))), ("state", _rows(extract.state_matrix(db).orderBy("contract_id", "var"))))}
    # What each main contract's folder says comes from a few tables, read once for all of them.
    found: dict[str, list[dict]] = {}
    for r in _rows(Engine.ordered(findings)):
        found.setdefault(r["contract"], []).append(r)
    seen: dict[str, int] = {}
    for c in overview(db, findings)["main_contracts"]:
        name = safe_name(c["name"])
        seen[name] = seen.get(name, 0) + 1
        name += f"-{seen[name]}" if seen[name] > 1 else ""
        lines = [f"- {r['severity']} `{r['template_id']}` line {r['line']}: {r['title']}" for r in found.get(c["name"], [])]
        wrote[f"contracts/{name}/README.md"] = "\n".join([f"# {c['name']}", "", f"`{c['file']}`", "", *(lines or ["No findings."]), ""])
    for name, body in wrote.items():
        (p / name).parent.mkdir(parents=True, exist_ok=True)
        (p / name).write_text(body, encoding="utf-8")
    files = sorted(x for x in p.rglob("*") if x.is_file() and x.name != "manifest.json")
    manifest = {"tool": "gritstone", "version": __version__, "project": project or {}, "sources": _rows(db.files.select("path", "checksum").orderBy("path")), "files": [{"path": str(x.relative_to(p)), "sha256": hashlib.sha256(x.read_bytes()).hexdigest()} for x in files]}
    (p / "manifest.json").write_text(text(manifest), encoding="utf-8")
    return manifest
