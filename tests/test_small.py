"""Literals, identifiers, versions, regular expressions, home."""

import re
import zipfile

import pytest

from gritstone import home
from gritstone.cli import main
from gritstone.functions import literals as lit
from gritstone.functions import text
from gritstone.wql import rules


@pytest.mark.parametrize(("given", "unit", "value"), [("10", "", 10), ("1_000", "", 1000), ("0x1F", "", 31), ("0xff_ff", "", 65535), ("0.5", "ether", 5 * 10**17), ("1e18", "", 10**18), ("1.5e1", "gwei", 15 * 10**9), ("2", "days", 172800), ("25e-1", "", None), ("5e-1", "ether", 5 * 10**17), ("1__0", "", None), ("_1", "", None), ("1_", "", None), ("", "", None), (".", "", None), ("abc", "", None), ("1", "years", None), ("1e5000", "", None), ("0x", "", None), (str(2**256 - 1), "", 2**256 - 1), (str(2**256), "", None), (".5", "ether", 5 * 10**17), ("0x10", "ether", None)])
def test_integer_constants(given, unit, value):
    assert lit.integer_constant(given, unit) == value


def test_canonical_literals():
    assert lit.canonical_literal("1_0") == lit.canonical_literal("0xa", "number") == "integer:10"
    assert lit.canonical_literal("10", "string", "string") == "string:string:10" and lit.canonical_literal("0.3", "number", "rational") == "number:rational:0.3"


def test_identifiers():
    f = lit.function_id("/a/b.sol", "C", "f(uint256)")
    assert lit.parse_function_id(f) == ("/a/b.sol", "C", "f(uint256)") and lit.parse_contract_id("/a/b.sol#C") == ("/a/b.sol", "C")
    assert lit.parse_function_id("C.f()") == ("C.f()", "", "") and lit.parse_contract_id("C") == ("", "C") and lit.parse_function_id("p#C") == ("p", "C", "")


@pytest.mark.parametrize(("constraint", "version", "holds"), [(">=0.8", "^0.8.4", True), ("<0.8", "0.7.6", True), ("==0.8.0", "0.8.0", True), ("0.8.1", "0.8.0", False), ("^0.8.0", "0.8.1", False), ("~0.8.1", ">=0.8.1 <0.9.0", True), (">1", "0.8.0", False), ("<=0.8.10", "0.8.9", True), (">=0.8.0", "", True), (">=0.8.0", None, True), (">=0.8.0", "^0.8", True)])
def test_versions_by_one_grammar(spark, constraint, version, holds):
    assert rules.version_text(constraint) == constraint
    assert text.version_satisfies(version, constraint) is holds
    df = spark.createDataFrame([(version,)], "v string")
    assert df.select(text.version_holds("v", constraint)).first()[0] is holds


@pytest.mark.parametrize("constraint", ["!=0.8.0", "v0.8.0", "<v0.8", "0.8.0.1", "latest", ">= 0.8.x"])
def test_versions_that_mean_nothing(constraint):
    with pytest.raises(rules.TemplateError):
        rules.version_text(constraint)


@pytest.mark.parametrize(("pattern", "whole", "yes", "no"), [("^a$", False, "a", "a\n"), ("a|b", True, "b", "ab"), (r"(?i)owner", False, "theOWNER", "own"), (r"[[:alpha:]]+\d", True, "ab1", "é1"), (r"(?P<x>a)b", False, "ab", "b"), (r"(?m)^b$", False, "a\nb", "ab"), (r"[$]", False, "$", "S"), (r"\$", False, "$", "S"), (r"(?s)a.b", False, "a\nb", "ab"), (r"a\z", False, "ba", "ab")])
def test_regex_dialect_is_one(spark, pattern, whole, yes, no):
    df = spark.createDataFrame([(yes,), (no,)], "s string")
    assert [r[0] for r in df.select(text.matches("s", pattern, whole)).collect()] == [True, False]
    assert text.found_in(yes, pattern, whole) and not text.found_in(no, pattern, whole) and not text.found_in(None, pattern, whole)


def test_spans_against_finditer(spark):
    texts = [(1, "ab\nxab ab\n\nab", "k"), (2, None, "k"), (3, "", None), (4, "é☃ab\r\nab", "k"), (5, "none", "k")]
    df = spark.createDataFrame(texts, "id int, body string, `odd.name` string")
    got = {(r.id, r.match_no, r.match, r.begin, r.end, r.line, r.col) for r in text.spans(df, "body", "ab").collect()}
    want = set()
    for i, t, _ in texts:
        for n, m in enumerate(re.finditer("ab", t or ""), 1):
            before = t[: m.start()]
            want.add((i, n, "ab", m.start(), m.end(), before.count("\n") + 1, len(before) - (before.rfind("\n") + 1) + 1))
    assert got == want and text.spans(df, "body", "ab").columns == ["id", "odd.name", "match_no", "match", "begin", "end", "line", "col"]
    assert text.spans(df, "body", "zz").count() == 0


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("GRITSTONE_HOME", str(tmp_path))
    assert home.Config.load() == home.Config()
    (tmp_path / "config.yaml").write_text("min_severity: high\nstrict_imports: true\n")
    assert home.Config.load() == home.Config("", "high", True)
    for bad in ("color: red", "strict_imports: 1", "- a", "a: [", "min_severity: 3"):
        (tmp_path / "config.yaml").write_text(bad)
        with pytest.raises(ValueError):
            home.Config.load()
    assert main(["scan", "."]) == 2


def test_installing_templates(tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("GRITSTONE_HOME", str(tmp_path / "home"))
    good = tmp_path / "good.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("pack/a.yaml", "{id: a, query: {select: call}}")
        z.writestr("pack/readme.txt", "not a template")
    assert main(["templates", str(good)]) == 0
    assert [t.id for t in rules.load(capsys.readouterr().out.strip())[0]] == ["a"]
    assert not list((tmp_path / "home").rglob("readme.txt"))
    for name in ("../out.yaml", "/out.yaml", "a/../../out.yaml", "c:out.yaml"):
        bad = tmp_path / "bad.zip"
        with zipfile.ZipFile(bad, "w") as z:
            z.writestr("ok.yaml", "{}")
            z.writestr(name, "{}")
        assert main(["templates", str(bad)]) == 2
    link = zipfile.ZipInfo("link.yaml")
    link.external_attr = 0o120777 << 16
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr(link, "/etc/passwd")
    assert main(["templates", str(bad)]) == 2 and main(["templates", str(tmp_path / "none.zip")]) == 2
    assert [p.name for p in (tmp_path / "home").iterdir()] == ["templates"] and (tmp_path / "home/templates/pack/a.yaml").exists()
