"""Scalar functions: regular-expression dialect, versions, line counts, spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "word": r"\w"}


def to_java(pattern: str) -> str:
    """A linear-time (RE2 style) pattern for Java's engine: named groups, POSIX classes, and an end that isn't before a last line break. Look-around and back references have no counterpart and are refused."""
    if re.search(r"\(\?(?:[=!]|<[=!])", pattern):
        raise ValueError(f"look-around isn't allowed: {pattern}")
    if re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise ValueError(f"back references aren't allowed: {pattern}")
    out, i, in_class = [], 0, False
    multi = bool(re.match(r"\(\?[a-z]*m", pattern))
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class and (m := re.match(r"\[:(\w+):\]", pattern[i:])):
            out.append(_POSIX[m[1]])
            i += m.end()
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif c == "$" and not in_class and not multi:
            out.append(r"\z")
            i += 1
            continue
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        out.append(c)
        i += 1
    return "".join(out)


_RANGES = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "punct": r"!-/:-@\[-`{-~", "xdigit": "0-9A-Fa-f", "word": r"\w"}


def to_python(pattern: str) -> str:
    """The same dialect for Python's engine, with ASCII classes."""
    to_java(pattern)
    out = re.sub(r"\[:(\w+):\]", lambda m: _RANGES[m[1]], pattern)
    out = re.sub(r"\\z", lambda _: r"\Z", out).replace("(?<", "(?P<").replace("(?PP<", "(?P<")
    if re.match(r"\(\?[a-z]*m", out):
        return out
    cut, in_class, i = [], False, 0
    while i < len(out):
        if out[i] == "\\":
            cut.append(out[i : i + 2])
            i += 2
            continue
        in_class = (in_class or out[i] == "[") and out[i] != "]"
        cut.append(r"\Z" if out[i] == "$" and not in_class else out[i])
        i += 1
    return "".join(cut)


@lru_cache(maxsize=4096)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(to_python(pattern), re.ASCII)


def found_in(text: str | None, pattern: str, whole: bool = False) -> bool:
    """``matches`` of one text."""
    if text is None:
        return False
    p = compiled(pattern)
    return (p.fullmatch(text) if whole else p.search(text)) is not None


def anchored(pattern: str) -> str:
    return rf"\A(?:{to_java(pattern)})\z"


def matches(c: Column | str, pattern: str, whole: bool = False) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(anchored(pattern) if whole else to_java(pattern))


def version_parts(c: Column | str) -> Column:
    """The first x.y.z of a version text as an array that compares in order; null where there is none."""
    c = F.col(c) if isinstance(c, str) else c
    found = F.regexp_extract(c, r"(\d+\.\d+\.\d+)", 1)
    return F.when(found != "", F.transform(F.split(found, r"\."), lambda x: x.cast("int")))


_CONSTRAINT = re.compile(r"\s*(>=|<=|==|>|<|=|\^|~)?\s*(\d+)(?:\.(\d+))?(?:\.(\d+))?\s*")


def version_constraint(text: str) -> tuple[str, list[int]]:
    """Operator and x.y.z of a constraint; parts that aren't given are 0, and ^ and ~ compare as equality. The one grammar for templates and their evaluation."""
    m = _CONSTRAINT.fullmatch(text)
    if not m:
        raise ValueError(f"no version constraint: {text}")
    return {"<": "<", "<=": "<=", ">": ">", ">=": ">="}.get(m[1] or "=", "="), [int(x or 0) for x in m.groups()[1:]]


def version_holds(c: Column | str, constraint: str) -> Column:
    """``<0.8.0`` and the like against a version text; an unknown version holds."""
    op, parts = version_constraint(constraint)
    want, have = F.array(*map(F.lit, parts)), version_parts(c)
    test = {"<": have < want, "<=": have <= want, ">": have > want, ">=": have >= want, "=": have == want}[op]
    return have.isNull() | test


def version_satisfies(version: str | None, constraint: str) -> bool:
    """``version_holds`` of one text."""
    op, want = version_constraint(constraint)
    m = re.search(r"(\d+)\.(\d+)\.(\d+)", version or "")
    have = [int(x) for x in m.groups()] if m else None
    return have is None or {"<": have < want, "<=": have <= want, ">": have > want, ">=": have >= want, "=": have == want}[op]


def code_lines(c: Column | str) -> Column:
    """Lines that are neither blank nor comments."""
    return F.size(F.filter(F.split(c, "\n"), lambda x: ~x.rlike(r"^\s*$") & ~x.rlike(r"^\s*(//|/\*|\*)")))


def spans(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """Each match of ``pattern`` in the column ``text``: the other columns with match_no, match, begin and end (characters from 0), line and col (from 1).

    One pass over each text where it lies, lines counted on from match to match; no row carries its text along."""
    find = to_python(pattern)
    others = [c for c in rows.columns if c != text]
    names = [f"c{i}" for i in range(len(others))]
    plain = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)], F.col(f"`{text}`").cast("string").alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = re.compile(find, re.ASCII)
        for batch in batches:
            at, out = [], []
            for row, body in enumerate(batch.column("text").to_pylist()):
                line, since = 1, 0
                for i, m in enumerate(compiled.finditer(body) if body else (), 1):
                    begin = m.start()
                    line += body.count("\n", since, begin)
                    since = begin
                    at.append(row)
                    out.append((i, m[0], begin, m.end(), line, begin - body.rfind("\n", 0, begin)))
            kept = [batch.column(n).take(pa.array(at, pa.int64())) for n in names]
            found = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(found, (pa.int32(), pa.string(), *[pa.int32()] * 4), strict=True))], [*names, "match_no", "match", "begin", "end", "line", "col"])

    fields = [*plain.schema.fields[:-1], *T.StructType.fromDDL("match_no int, match string, begin int, end int, line int, col int").fields]
    return plain.mapInArrow(search, T.StructType(fields)).toDF(*others, "match_no", "match", "begin", "end", "line", "col")
