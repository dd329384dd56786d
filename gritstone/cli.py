"""The command line: scan a project, build its code database, ask questions about it.

    python -m gritstone scan PROJECT [-o FOLDER | FILE.sarif|.json|.md|.html] [--templates PATH] [--min-severity high] ...
    python -m gritstone build PROJECT -o DATABASE
    python -m gritstone templates ARCHIVE.zip
    python -m gritstone extract main|entry|inheritance|statevar|selector|source|context|workflow|involve|bundle|diff ...
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from gritstone import home
from gritstone.detectors import pack
from gritstone.plans import extract
from gritstone.report import documents
from gritstone.report import findings as report
from gritstone.ship import ship
from gritstone.solidity.codedb import CodeDB, build
from gritstone.sources import project
from gritstone.wql import rules
from gritstone.wql.evaluate import Engine
from gritstone.wql.scan import scan


class Stop(Exception):
    """What the user should read."""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gritstone", description="Code queries on Spark.")
    p.add_argument("--master", help="Spark master, where the session isn't started by spark-submit")
    commands = p.add_subparsers(dest="command", required=True)

    def sources(c: argparse.ArgumentParser) -> None:
        c.add_argument("path", nargs="*", help="project folder, or files")
        c.add_argument("--db", help="a database that build wrote, in place of a path")
        c.add_argument("-o", "--output", help="where to write; to the terminal by default")
        c.add_argument("--strict-imports", action="store_true", help="stop where an import can't be found")

    c = commands.add_parser("scan")
    sources(c)
    c.add_argument("--templates", help="a template file or folder, in place of the detectors that come with the library")
    c.add_argument("--lenient", action="store_true", help="leave out templates that can't be meant as written")
    c.add_argument("--min-severity")
    c.add_argument("--severity", action="append")
    c.add_argument("--include", action="append", help="glob over template ids")
    c.add_argument("--exclude", action="append")
    c.add_argument("--fail-on", help="exit with 1 if there are findings of at least this severity")
    c = commands.add_parser("templates", help="install templates from a zip file, to be used where scan isn't told others")
    c.add_argument("archive")
    c = commands.add_parser("build")
    sources(c)
    c.add_argument("--json", action="store_true", help="JSON lines in place of Parquet")
    c = commands.add_parser("extract")
    asked = c.add_subparsers(dest="what", required=True)
    for what, name in (("main", None), ("entry", "contract"), ("inheritance", "contract"), ("statevar", "contract"), ("selector", None), ("source", "function"), ("context", "function"), ("workflow", "function"), ("involve", "function"), ("bundle", "function")):
        q = asked.add_parser(what)
        if name:
            q.add_argument(name)
        sources(q)
        q.add_argument("--format", choices=("md", "json"))
        if name == "function":
            q.add_argument("--contract", help="look for the function in this contract alone")
        if what == "workflow":
            q.add_argument("--depth", type=int, default=10)
    q = asked.add_parser("diff")
    q.add_argument("--db1", required=True)
    q.add_argument("--db2", required=True)
    q.add_argument("-o", "--output")
    q.add_argument("--format", choices=("md", "json"))
    return p


def opened(spark: SparkSession, path: str) -> CodeDB:
    """A database that build wrote, in either form."""
    p = Path(path)
    if not p.is_dir():
        raise Stop(f"{path}: no database")
    return CodeDB.from_json(spark, path) if (p / "files.schema").exists() else CodeDB.open(spark, path)


def database(spark: SparkSession, a: argparse.Namespace) -> CodeDB:
    if bool(a.db) == bool(a.path):
        raise Stop("give a path or --db, one of them")
    if a.db:
        return opened(spark, a.db)
    try:
        db = build(spark, a.path)
    except FileNotFoundError as e:
        raise Stop(str(e)) from e
    if a.strict_imports and (lost := db.diagnostics.filter("code = 'import-unresolved'").collect()):
        raise Stop("\n".join(f"{r.file}: can't find {r.message}" for r in lost))
    return db


def put(text: str, output: str | None) -> None:
    if output:
        Path(output).parent.mkdir(parents=True, exist_ok=True)
        Path(output).write_text(text, encoding="utf-8")
    else:
        print(text)


def run_scan(spark: SparkSession, a: argparse.Namespace) -> int:
    templates, wrong = rules.load(a.templates, not a.lenient) if a.templates else (pack(), [])
    for w in wrong:
        print(f"left out: {w}", file=sys.stderr)
    db = database(spark, a)
    found = report.chosen(scan(db, templates), a.severity, a.min_severity, a.include, a.exclude).cache()
    out = a.output or ""
    if out.endswith(".sarif"):
        put(json.dumps(report.sarif(found), indent=1), out)
    elif out.endswith(".html"):
        put(documents.html_page(db, found), out)
    elif out.endswith(".json"):
        put(json.dumps([r.asDict(recursive=True) for r in Engine.ordered(found).collect()], indent=1), out)
    elif not out or out.endswith(".md"):
        put(report.markdown(found), out)
    else:
        root = project.project_root(a.path[0]) if a.path else ""
        documents.bundle(db, found, out, {"root": root, "framework": project.framework(root)} | project.git_info(root) if root else None)
    return int(bool(a.fail_on) and not report.chosen(found, least=a.fail_on).isEmpty())


def answer(db: CodeDB, a: argparse.Namespace) -> DataFrame | dict:
    if a.what == "main":
        return extract.main(db).orderBy("contract_id", "function_id")
    if a.what == "selector":
        return extract.selectors(db).distinct().orderBy("selector", "contract_id")
    if a.what in ("entry", "inheritance", "statevar"):
        return {"entry": extract.entries, "inheritance": extract.inheritance, "statevar": extract.state_variables}[a.what](db, a.contract)
    f = extract.the_function(db, a.function, a.contract)
    if a.what == "source":
        return extract.source(db, db.functions.filter(db.functions.function_id == f).select("function_id").distinct())
    if a.what == "workflow":
        return extract.workflow(db, f, a.depth)
    return {"context": extract.context, "bundle": extract.bundle, "involve": lambda d, x: extract.involve(d, x).orderBy("src", "dst")}[a.what](db, f)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "templates":
            print(home.install(a.archive))
            return 0
        kept = home.Config.load()
    except (OSError, ValueError) as e:
        print(f"gritstone: {e}", file=sys.stderr)
        return 2
    if a.command == "scan":
        own = home.folder() / "templates"
        a.templates = a.templates or kept.templates or (str(own) if own.is_dir() else None)
        a.min_severity = a.min_severity or kept.min_severity or None
    if hasattr(a, "strict_imports"):
        a.strict_imports = a.strict_imports or kept.strict_imports
    made = spark is None
    if made:
        b = SparkSession.builder.appName("gritstone")
        spark = (b.master(a.master) if a.master else b).getOrCreate()
        ship(spark)
    try:
        if a.command == "scan":
            return run_scan(spark, a)
        if a.command == "build":
            if not a.output:
                raise Stop("build needs -o")
            db = database(spark, a)
            (db.to_json if a.json else db.save)(a.output)
            put(extract.render(extract.stats(db).orderBy("what"), "md", "Database"), None)
            return 0
        how = extract.format_of(a.format, a.output)
        what = extract.difference_of(opened(spark, a.db1), opened(spark, a.db2)).orderBy("entity", "key") if a.what == "diff" else answer(database(spark, a), a)
        put(extract.render(what, how, a.what), a.output)
        return 0
    except (Stop, extract.Ambiguous, rules.TemplateError) as e:
        print(f"gritstone: {e}", file=sys.stderr)
        return 2
    finally:
        if made:
            spark.stop()
