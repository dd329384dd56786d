"""The command line and the documents it writes, on the project of the engine's tests."""

import hashlib
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from test_engine import FILES

from gritstone.cli import main
from gritstone.plans import extract
from gritstone.report import documents
from gritstone.solidity import codedb, keccak
from gritstone.sources import project


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("project")
    for name, text in FILES.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text, encoding="utf-8")
    return folder


@pytest.fixture(scope="module")
def saved(spark, root, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    assert main(["build", str(root), "-o", str(out / "db")], spark) == 0
    assert main(["build", "--db", str(out / "db"), "-o", str(out / "json"), "--json"], spark) == 0
    return out


def test_scan_writes_each_form(spark, saved, capsys):
    for form in ("sarif", "json", "md", "html"):
        assert main(["scan", "--db", str(saved / "db"), "-o", str(saved / f"f.{form}"), "--min-severity", "high"], spark) == 0
    log = json.loads((saved / "f.sarif").read_text())
    rows = json.loads((saved / "f.json").read_text())
    assert len(log["runs"][0]["results"]) == len(rows) > 3 and {r["severity"] for r in rows} <= {"CRITICAL", "HIGH"}
    page = (saved / "f.html").read_text()
    assert page.count("<pre>") == len(rows) and "<script" not in page and "&lt;" in page
    assert main(["scan", "--db", str(saved / "json"), "--exclude", "*", "--fail-on", "low"], spark) == 0
    assert main(["scan", "--db", str(saved / "json"), "--include", "weak-*", "--include", "msg-*", "--fail-on", "low"], spark) == 1
    assert "msg-value-in-loop" in capsys.readouterr().out


def test_scan_writes_a_folder(spark, root, tmp_path):
    assert main(["scan", str(root), "-o", str(tmp_path / "out")], spark) == 0
    out = tmp_path / "out"
    manifest = json.loads((out / "manifest.json").read_text())
    assert {f["path"] for f in manifest["files"]} >= {"README.md", "summary.md", "overview.md", "findings.md", "findings.html", "findings.sarif", "data/nav.json", "data/explorer.json", "data/overview.json", "data/diagnostics.json", "data/state.json", "contracts/Vault/README.md"}
    for f in manifest["files"]:
        assert hashlib.sha256((out / f["path"]).read_bytes()).hexdigest() == f["sha256"]
    assert len(manifest["sources"]) == 3 and manifest["project"]["framework"] == "foundry"
    nav = {r["function_id"].split("#")[1]: r for r in json.loads((out / "data/nav.json").read_text())}
    assert [c["function_id"].split("#")[1] for c in nav["Maths.twice(uint256)"]["callers"]] == ["Vault.take(address,uint256)"]
    overview = json.loads((out / "data/overview.json").read_text())
    assert overview["main_contracts"][0]["name"] == "Vault" and not overview["complete"] and overview["stats"]["code_lines"] > 20
    said = json.loads((out / "data/diagnostics.json").read_text())
    assert said["counts"] == {"warning": 1} and not said["complete"]
    state = {r["var"]: [e.split("#")[1] for e in r["entries"]] for r in json.loads((out / "data/state.json").read_text())}
    assert "Vault.take(address,uint256)" in state["shares"]
    assert "graph TD" in (out / "overview.md").read_text() and "Vault → Other → Base → Root" in (out / "summary.md").read_text()


def test_extract_answers(spark, saved, capsys):
    def ask(*what):
        assert main(["extract", *what, "--db", str(saved / "db"), "--format", "json"], spark) == 0
        return json.loads(capsys.readouterr().out)

    assert [r["name"] for r in ask("inheritance", "Vault")] == ["Vault", "Other", "Base", "Root"]
    assert "take(address,uint256)" in {r["selector"] for r in ask("entry", "Vault")}
    assert [r["name"] for r in ask("statevar", "Vault")][:2] == ["held", "other"]
    assert {r["name"] for r in ask("main")} == {"Vault", "Söl"}
    assert {r["signature"] for r in ask("selector") if r["selector"] == "hook()"} == {keccak.selector("hook()")}
    assert "selfdestruct" in ask("source", "low")[0]["source"]
    bundle = ask("bundle", "take")
    assert [x["name"] for x in bundle["inheritance"]][0] == "Vault" and any("_book" in c for c in bundle["callees"]) and "to.call" in bundle["function"]["source"]
    assert [c.split("#")[1] for c in ask("context", "_c")["callers"]] == ["Vault._b(uint256)"]
    assert {r["function_id"].split("#")[1] for r in ask("workflow", "hook", "--contract", "Vault")} >= {"Maths.plus(uint256,uint256)"}
    assert {(r["src"].split(".")[-1], r["dst"].split(".")[-1]) for r in ask("involve", "_c")} == {("deep(uint256)", "_a(uint256)"), ("_a(uint256)", "_b(uint256)"), ("_b(uint256)", "_c(uint256)")}
    assert main(["extract", "diff", "--db1", str(saved / "db"), "--db2", str(saved / "json")], spark) == 0
    assert "Nothing." in capsys.readouterr().out
    assert main(["extract", "main", "--db", str(saved / "db")], spark) == 0
    assert capsys.readouterr().out.startswith("# main\n\n| name |")


def test_mistakes_are_told(spark, saved, root, tmp_path, capsys):
    assert main(["extract", "entry", "Nobody", "--db", str(saved / "db")], spark) == 2
    assert main(["scan", str(root), "--strict-imports"], spark) == 2
    assert "./missing.sol" in capsys.readouterr().err
    assert main(["scan", str(root), "--db", str(saved / "db")], spark) == 2
    (tmp_path / "bad.yaml").write_text("{id: x}")
    assert main(["scan", str(root), "--templates", str(tmp_path)], spark) == 2
    assert main(["build", str(tmp_path), "-o", str(tmp_path / "db")], spark) == 2


def test_names_fences_and_formats():
    assert documents.safe_name("../a b/ü") == "_a_b_" and documents.safe_name("..") == "_"
    assert documents.fence("a ``` b").startswith("````\n")
    assert extract.format_of(None, "x.json") == "json" and extract.format_of("md", "x.json") == "md" and extract.format_of(None, None) == "md"
    with pytest.raises(ValueError):
        extract.render([], "xml")


def test_file_urls(tmp_path):
    at = {"remote": "https://github.com/a/b", "branch": "main", "commit": "abc"}
    assert project.file_url(at, "/r", "/r/src/A b.sol") == "https://github.com/a/b/blob/abc/src/A%20b.sol"
    assert project.file_url(at | {"remote": "https://gitlab.com/a/b"}, "/r", "/r/A.sol") == "https://gitlab.com/a/b/-/blob/abc/A.sol"
    assert project.file_url(at | {"remote": ""}, "/r", "/r/A.sol") == ""


def test_places_to_look_for_imports(tmp_path):
    (tmp_path / "foundry.toml").write_text("")
    (tmp_path / "packages/inner").mkdir(parents=True)
    (tmp_path / "packages/inner/hardhat.config.ts").write_text("")
    root = str(tmp_path)
    got = project.candidates("@openzeppelin/contracts/A.sol", f"{root}/packages/inner/src/B.sol", root, [("", "@x/", "y/")])
    assert got[0] == f"{root}/lib/openzeppelin-contracts/contracts/A.sol" and f"{root}/packages/inner/node_modules/@openzeppelin/contracts/A.sol" in got
    assert project.candidates("../A.sol", f"{root}/src/B.sol", root, []) == [f"{root}/A.sol"]
    assert codedb.fields("a int, b map<string,int>, c struct<x:int,y:int>") == ["a int", " b map<string,int>", " c struct<x:int,y:int>"]


def test_it_runs_from_any_folder(root, tmp_path):
    """As a process of its own, in a folder that doesn't have the package: executors get it from the driver."""
    home = Path(__file__).resolve().parent.parent
    code = f"import sys; sys.path.insert(0, {str(home)!r}); from gritstone.cli import main; sys.exit(main(['--master', 'local[2]', 'scan', {str(root)!r}, '-o', 'f.json']))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert run.returncode == 0, run.stderr[-2000:]
    assert json.loads((tmp_path / "f.json").read_text())
