"""Reading Solidity projects: pruned directory scans, imports with remappings, and the closure of what a project needs.

Reading and parsing are DataFrame work; the driver holds paths, and reads remapping files of a few lines each.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import tomllib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators.storage import stored

PRUNED = ("node_modules", "out", "artifacts", "cache", "forge-cache", "test", "tests", "script", "scripts", "lib", "mock", "mocks", "broadcast", "coverage", "typechain", "typechain-types", "deployments", "logs", "dependencies")
MARKERS = {"foundry.toml": "foundry", "hardhat.config.js": "hardhat", "hardhat.config.ts": "hardhat", "truffle-config.js": "truffle", "remappings.txt": "remappings"}


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path of every .sol file at or under a path; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sol").load(path)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path")).distinct()


def contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, raw of the given files."""
    files = spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths])
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("content").alias("raw")).dropDuplicates(["path"])


_SKIPPED = re.compile(r"(^|/)(\.[^/]*|" + "|".join(map(re.escape, PRUNED)) + ")/")


def kept(path: str, root: str) -> bool:
    """Whether a file under the root lies in no hidden folder nor one that holds dependencies, tests or build products."""
    return not _SKIPPED.search(path[len(root.rstrip("/")) + 1 :])


def parse_remappings(lines: str) -> list[tuple[str, str, str]]:
    """(context, prefix, target) of each ``[context:]prefix=target`` line."""
    out = []
    for line in lines.splitlines():
        line = line.strip()
        if "=" in line and not line.startswith("#"):
            left, target = line.split("=", 1)
            context, _, prefix = left.rpartition(":")
            out.append((context, prefix, target.strip()))
    return out


def remappings(root: str) -> list[tuple[str, str, str]]:
    """From remappings.txt and the active profile of foundry.toml."""
    out = []
    if os.path.isfile(p := f"{root}/remappings.txt"):
        with open(p, encoding="utf-8") as f:
            out += parse_remappings(f.read())
    if os.path.isfile(p := f"{root}/foundry.toml"):
        with open(p, "rb") as f:
            profile = tomllib.load(f).get("profile", {})
        mine = profile.get(os.environ.get("FOUNDRY_PROFILE", "default"), profile.get("default", {}))
        out += parse_remappings("\n".join(mine.get("remappings", [])))
    return out


def framework(root: str) -> str:
    return next((name for marker, name in MARKERS.items() if os.path.exists(f"{root}/{marker}")), "unknown")


def project_root(path: str) -> str:
    """The nearest folder above that holds a project's marker; the path's own folder where none does."""
    start = at = os.path.abspath(path if os.path.isdir(path) else os.path.dirname(path))
    while True:
        if any(os.path.exists(f"{at}/{m}") for m in (*MARKERS, ".git")):
            return at
        if os.path.dirname(at) == at:
            return start
        at = os.path.dirname(at)


def file_url(info: dict[str, str], root: str, path: str) -> str:
    """The web page of a file at the commit (else the branch) that was read; empty where the remote isn't known."""
    at = info["commit"] or info["branch"]
    if not info["remote"] or not at:
        return ""
    inner = posixpath.relpath(path, root)
    how = "src" if "bitbucket." in info["remote"] else "-/blob" if "gitlab" in info["remote"] else "blob"
    return f"{info['remote']}/{how}/{at}/{quote(inner)}"


def git_info(root: str) -> dict[str, str]:
    """remote, branch and commit as the folder's .git has them, without running git."""
    out = {"remote": "", "branch": "", "commit": ""}
    try:
        with open(f"{root}/.git/HEAD", encoding="utf-8") as f:
            head = f.read().strip()
        if head.startswith("ref: "):
            out["branch"] = head[5:].removeprefix("refs/heads/")
            with open(f"{root}/.git/{head[5:]}", encoding="utf-8") as f:
                out["commit"] = f.read().strip()
        else:
            out["commit"] = head
        with open(f"{root}/.git/config", encoding="utf-8") as f:
            if m := re.search(r'\[remote "origin"\][^\[]*?url\s*=\s*(\S+)', f.read()):
                out["remote"] = re.sub(r"^git@([^:]+):", r"https://\1/", m[1]).removesuffix(".git")
    except OSError:
        pass
    return out


#: What frameworks map without being told: prefix and target.
USUAL = {
    "foundry": (("@openzeppelin/contracts-upgradeable/", "lib/openzeppelin-contracts-upgradeable/contracts/"), ("@openzeppelin/contracts/", "lib/openzeppelin-contracts/contracts/"), ("openzeppelin-contracts/", "lib/openzeppelin-contracts/"), ("forge-std/", "lib/forge-std/src/"), ("ds-test/", "lib/ds-test/src/"), ("solmate/", "lib/solmate/src/"), ("solady/", "lib/solady/src/")),
    "hardhat": (("@", "node_modules/@"),),
    "truffle": (("@", "node_modules/@"),),
}


def candidates(wanted: str, file: str, root: str, maps: list[tuple[str, str, str]]) -> list[str]:
    """Where an import may lie, best first."""
    if wanted.startswith("."):
        return [posixpath.normpath(posixpath.join(posixpath.dirname(file), wanted))]
    inner = posixpath.relpath(file, root)
    fit = [m for m in maps if inner.startswith(m[0]) and wanted.startswith(m[1])]
    fit.sort(key=lambda m: (-len(m[0]), -len(m[1])))
    out = [posixpath.normpath(posixpath.join(root, m[2] + wanted[len(m[1]) :])) for m in fit]
    first, _, rest = wanted.partition("/")
    out += [posixpath.normpath(posixpath.join(root, target + wanted[len(prefix) :])) for prefix, target in USUAL.get(framework(root), ()) if wanted.startswith(prefix)]
    out += [f"{root}/node_modules/{wanted}", f"{root}/lib/{wanted}", f"{root}/lib/{first}/src/{rest}", f"{root}/lib/{first}/contracts/{rest}"]
    near = posixpath.dirname(file)
    while near.startswith(root) and near != root:  # a project within the project, nearest first
        if any(os.path.exists(f"{near}/{m}") for m in MARKERS):
            out += [f"{near}/node_modules/{wanted}", f"{near}/lib/{wanted}", f"{near}/{wanted}"]
        near = posixpath.dirname(near)
    out += [f"{root}/{wanted}", wanted]
    return [posixpath.normpath(p) for p in out]


UNIT = "path string, content string, checksum string, pragma string, unit string, imports array<struct<wanted:string,alias:string,symbols:array<array<string>>,places:array<string>>>, troubles array<struct<message:string,line:int>>"


def parsed(files: DataFrame, root: str, maps: list[tuple[str, str, str]]) -> DataFrame:
    """One row a file: its text, its declarations as JSON, its imports with the places to look in, and what couldn't be parsed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from gritstone.solidity.parser import parse

        for part in parts:
            rows = []
            for path, raw, checksum in zip(part["path"], part["raw"], part["checksum"], strict=True):
                text = bytes(raw).decode("utf-8", "replace").removeprefix("﻿")
                unit = parse(text)
                imports = [{"wanted": i["path"], "alias": i["alias"], "symbols": i["symbols"], "places": candidates(i["path"], path, root, maps)} for i in unit.pop("imports")]
                troubles = [{"message": t["message"], "line": text.count("\n", 0, t["at"]) + 1} for t in unit.pop("troubles")]
                pragma = next((p.removeprefix("solidity").strip() for p in unit["pragmas"] if p.startswith("solidity")), "")
                rows.append((path, text, checksum, pragma, json.dumps(unit), imports, troubles))
            yield pd.DataFrame(rows, columns=["path", "content", "checksum", "pragma", "unit", "imports", "troubles"])

    return files.select("path", "raw", F.sha2("raw", 256).alias("checksum")).mapInPandas(run, UNIT)


def load(spark: SparkSession, path: str | list[str], maps: list[tuple[str, str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(units, links): the parsed files of a file, some files or a project folder with all they import, and their imports as file, wanted,
    target (null where nothing was found), alias, symbols.

    Only paths are listed at first; a file is read and parsed once it is known to be needed, those that one round of imports
    names together. The driver holds paths alone."""
    given = [os.path.abspath(p) for p in ([path] if isinstance(path, str) else path)]
    root = project_root(given[0])
    maps = remappings(root) if maps is None else maps
    known = {r[0] for r in listing(spark, root if any(map(os.path.isdir, given)) else os.path.dirname(given[0])).collect()}
    known |= {p for p in given if os.path.isfile(p)}
    wave = {p for g in given for p in ([g] if os.path.isfile(g) else [p for p in known if p.startswith(g.rstrip("/") + "/") and kept(p, g)])}
    seen: set[str] = set()
    rounds = []
    while wave:
        seen |= wave
        rounds.append(stored(parsed(contents(spark, sorted(wave)), root, maps), "units"))
        places = rounds[-1].select(F.explode("imports").alias("i")).select("i.places").distinct().collect()
        wave = {next((p for p in r[0] if p in known or os.path.isfile(p)), None) for r in places} - {None} - seen
        known |= wave
    if not rounds:
        raise FileNotFoundError(f"no Solidity files in {path}")
    units = reduce(DataFrame.unionByName, rounds)
    imports = units.select(F.col("path").alias("file"), F.explode("imports").alias("i")).select("file", "i.*")
    tries = imports.select("file", "wanted", F.posexplode("places").alias("n", "place"))
    target = tries.join(units.select(F.col("path").alias("place")), "place").groupBy("file", "wanted").agg(F.min_by("place", "n").alias("target"))
    return units, imports.drop("places").join(target, ["file", "wanted"], "left")
