"""The code database: a project's files, contracts, functions, calls, effects and syntax-tree nodes as DataFrames.

A project's names resolve from the heads of its contracts alone, and fail closed where one is ambiguous. Each contract
with its ancestors and libraries is then one row, from which a single Python pass emits every entity. Entities are nested
columns of one Parquet table, so a reader takes those it needs; a scope's nodes are one row, so templates need no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gritstone.operators.storage import spread, stored
from gritstone.sources.project import load

def fields(ddl: str) -> list[str]:
    """The fields of a schema, without cutting within < >."""
    out, depth, held = [], 0, ""
    for ch in ddl:
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and not depth:
            out.append(held)
            held = ""
        else:
            held += ch
    return [*out, held]


_SPAN = "line int, col int, end_line int, end_col int, begin_byte int, end_byte int"
NODE = f"scope_id string, inst int, pre int, post int, parent int, child_idx int, arg_idx int, kind string, name string, value string, attrs map<string,string>, ref_kind string, taints array<string>, x int, y int, last_x int, last_y int, arms map<string,string>, stmt int, stmt_post int, target string, proven boolean, file string, fn string, {_SPAN}"
SCOPE = f"scope_id string, scope string, contract_id string, contract string, contract_kind string, function_id string, function string, visibility string, mutability string, modifiers array<string>, params array<string>, bases array<string>, controlled boolean, caller_checked boolean, is_main boolean, file string, {_SPAN}"
FUNCTION = f"function_id string, contract_id string, name string, kind string, selector string, signature string, visibility string, mutability string, modifiers array<string>, is_entry boolean, has_body boolean, file string, {_SPAN}"
CALL = "src string, dst string, called string, type string, line int"
WRITE = "function_id string, var string, kind string, line int"
GUARD = "function_id string, kind string, expr string, line int"
VAR = "contract_id string, decl_idx int, name string, type_name string, visibility string, is_constant boolean, is_immutable boolean, line int"
ENTRY = "contract_id string, function_id string, signature string"
FLOW = "function_id string, source string, target string, line int"
_NODE = NODE.removeprefix("scope_id string, ")
_GIVEN = ", ".join(x.strip().replace(" ", ":", 1) for x in fields(_NODE))
#: A scope with all the nodes that are looked at in it: its instances, the bodies of the modifiers it applies, the whole lines these lie on, and the way to each instance.
TREE = f"{SCOPE}, pragma string, nodes array<struct<{_GIVEN}>>, guards array<struct<{_GIVEN}>>, texts array<struct<file:string,first:int,text:string>>, paths array<array<string>>"
TABLES = {"trees": TREE, "functions": FUNCTION, "calls": CALL, "state_writes": WRITE, "guards": GUARD, "state_vars": VAR, "entry_functions": ENTRY, "flows": FLOW}


@dataclass(frozen=True)
class CodeDB:
    files: DataFrame
    contracts: DataFrame
    lineage: DataFrame
    trees: DataFrame
    functions: DataFrame
    calls: DataFrame
    state_writes: DataFrame
    guards: DataFrame
    state_vars: DataFrame
    entry_functions: DataFrame
    flows: DataFrame
    main_contracts: DataFrame
    diagnostics: DataFrame

    @property
    def scopes(self) -> DataFrame:
        return self.trees.select(*[x.split()[0] for x in fields(SCOPE)])

    @property
    def nodes(self) -> DataFrame:
        return self.trees.select("scope_id", F.explode("nodes").alias("n")).select("scope_id", "n.*")

    def save(self, path: str) -> None:
        """One Parquet table for each entity."""
        for name in self.__dataclass_fields__:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def open(spark: SparkSession, path: str) -> CodeDB:
        return CodeDB(**{name: spark.read.parquet(f"{path}/{name}") for name in CodeDB.__dataclass_fields__})

    def to_json(self, path: str) -> None:
        """A folder of JSON lines for each entity with its schema beside it: ``from_json`` gives the same database again."""
        for name in self.__dataclass_fields__:
            df = getattr(self, name)
            df.write.mode("overwrite").json(f"{path}/{name}")
            df.sparkSession.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}.schema")

    @staticmethod
    def from_json(spark: SparkSession, path: str) -> CodeDB:
        schema = lambda name: StructType.fromJson(json.loads(spark.read.text(f"{path}/{name}.schema").first()[0]))
        return CodeDB(**{name: spark.read.schema(schema(name)).json(f"{path}/{name}") for name in CodeDB.__dataclass_fields__})


def declarations(units: DataFrame) -> DataFrame:
    """contract_id, name, kind, file, bases, decl: decl is all that a program needs to know of the contract."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text, unit, pragma in zip(part["path"], part["content"], part["unit"], part["pragma"], strict=True):
                u = json.loads(unit)
                for c in u["contracts"]:
                    # Of the file's text only the whole lines that the contract lies on, with where they start.
                    a, z = text.rfind("\n", 0, c["s"]) + 1, text.find("\n", max(c["s"], c["e"] - 1))
                    own, line = text[a : len(text) if z < 0 else z], text.count("\n", 0, a) + 1
                    c |= {"id": f"{path}#{c['name']}", "file": path, "text": [own, a, line, len(text[:a].encode("utf-8", "surrogatepass"))], "pragma": pragma, "file_structs": u["structs"], "file_enums": u["enums"]}
                    mentioned = {(d["library"] or "").split(".")[-1] for d in c["using"]} | set(re.findall(r"\b([A-Za-z_$][\w$]*)\s*\.", own))
                    rows.append((c["id"], c["name"], c["kind"], path, [b["name"] for b in c["bases"]], line, sorted(mentioned - {""}), json.dumps(c)))
            yield pd.DataFrame(rows, columns=["contract_id", "name", "kind", "file", "bases", "line", "mentions", "decl"])

    return units.select("path", "content", "unit", "pragma").mapInPandas(run, "contract_id string, name string, kind string, file string, bases array<string>, line int, mentions array<string>, decl string")


RESOLVED = "contract_id string, mro array<string>, direct array<string>, unresolved array<string>, libraries array<string>, is_main boolean, kinds array<struct<name:string,kind:string>>"


def resolve(heads: list[dict], links: list[dict]) -> list[dict]:
    """What a project's names mean, of its contracts' heads and its import links: rows of ``RESOLVED``.

    A name is looked for in its own file, then among symbols that imports bind, then in all that these reach; where the nearest of these
    know several, it fails closed. Only heads take part, so a project of any real size is small."""
    from gritstone.solidity.program import linearize

    steps: dict[str, list[dict]] = {}
    for x in links:
        if x["target"] is not None:
            steps.setdefault(x["file"], []).append(x)
    declared: dict[str, dict[str, list[dict]]] = {}
    for h in heads:
        declared.setdefault(h["file"], {}).setdefault(h["name"], []).append(h)
    seen: dict[str, list[str]] = {}

    def reached_from(file: str) -> list[str]:
        if file not in seen:
            out, at = [file], 0
            have = {file}
            while at < len(out):
                for x in steps.get(out[at], []):
                    if x["target"] not in have:
                        have.add(x["target"])
                        out.append(x["target"])
                at += 1
            seen[file] = out
        return seen[file]

    def candidates(file: str, name: str) -> list[str]:
        own = [h["contract_id"] for h in declared.get(file, {}).get(name, [])]
        if own:
            return own
        bound = {h["contract_id"] for x in steps.get(file, []) for symbol, alias in (s[:2] for s in x["symbols"] if len(s) > 1) if alias == name for h in declared.get(x["target"], {}).get(symbol, [])}
        return sorted(bound) or sorted({h["contract_id"] for f in reached_from(file)[1:] for h in declared.get(f, {}).get(name, [])})

    direct, unresolved, libraries = {}, {}, {}
    of = {h["contract_id"]: h for h in heads}
    for h in heads:
        got = [(b, candidates(h["file"], b.split(".")[-1])) for b in h["bases"]]
        direct[h["contract_id"]] = [c[0] for _, c in got if len(c) == 1]
        unresolved[h["contract_id"]] = [b for b, c in got if len(c) != 1]
        mentioned = [candidates(h["file"], m) for m in h["mentions"]]
        libraries[h["contract_id"]] = [c[0] for c in mentioned if len(c) == 1 and of[c[0]]["kind"] == "library" and c[0] != h["contract_id"]]
    inherited = {b for bases in direct.values() for b in bases}
    kinds: dict[str, list[tuple[str, str]]] = {}
    out = []
    for h in heads:
        c, file = h["contract_id"], h["file"]
        if file not in kinds:
            known = {(k, x["kind"]) for f in reached_from(file) for k, xs in declared.get(f, {}).items() for x in xs}
            known |= {(alias, x["kind"]) for link in steps.get(file, []) for symbol, alias in (s[:2] for s in link["symbols"] if len(s) > 1) for x in declared.get(link["target"], {}).get(symbol, [])}
            kinds[file] = sorted(known)
        mro = linearize(c, direct)
        need, at = [x for b in mro for x in libraries.get(b, [])], 0
        need = list(dict.fromkeys(need))
        while at < len(need):  # libraries call libraries
            need.extend(x for x in libraries.get(need[at], []) if x not in need)
            at += 1
        out.append({"contract_id": c, "mro": mro, "direct": direct[c], "unresolved": unresolved[c], "libraries": need, "is_main": h["kind"] == "contract" and c not in inherited, "kinds": kinds[file]})
    return out


def resolved(heads: DataFrame, links: DataFrame) -> DataFrame:
    """``resolve`` for each project of the heads (project, contract_id, name, kind, file, bases, mentions) and links (project, file, target, symbols)."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = lambda x: [] if x.empty else x.to_dict("records")
        out = pd.DataFrame(resolve(rows(left), [r | {"symbols": [list(s) for s in r["symbols"]] if r["symbols"] is not None else []} for r in rows(right)]), columns=["contract_id", "mro", "direct", "unresolved", "libraries", "is_main", "kinds"])
        out["kinds"] = [[{"name": n, "kind": k} for n, k in ks] for ks in out["kinds"]]
        return out

    return heads.groupBy("project").cogroup(links.groupBy("project")).applyInPandas(run, RESOLVED)


def _span(p, s: int, e: int) -> dict:
    return {"line": p.line(s), "col": p.col(s), "end_line": p.line(max(s, e)), "end_col": p.col(max(s, e)), "begin_byte": p.byte(s), "end_byte": p.byte(e)}


def _texts(attrs: dict) -> list[tuple[str, str]]:
    return [(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in attrs.items() if v is not None]


def _lvalue(n):
    while n is not None and n.kind in ("expr.index_access", "expr.member_access") and n.kids:
        n = n.kids[0]
    return n


def write_target(n) -> str | None:
    """The state variable that a node writes, if it writes one."""
    if n.kind == "asm.sstore":
        return "<slot>"
    if n.kind in ("stmt.assign", "stmt.state_mutation") and n.attrs.get("is_state_var") and n.kids:
        base = _lvalue(n.kids[0])
        return base.name if base is not None else ""
    if n.kind == "expr.unary_op" and n.attrs.get("operator") in ("delete", "++", "--") and n.kids:
        base = _lvalue(n.kids[0])
        return base.name if base is not None and base.ref_kind == "state_var" else None
    return None


def node_rows(program, instances: list[dict]) -> list[dict]:
    labels = program.order(instances)
    out = []
    for inst in instances:
        f = inst["fn"]
        place, tree = program.place(f.owner), f.tree
        taints = program.taints(f, tree, inst["env"])
        for n in (tree, *tree.walk()):
            out.append(_row(inst["inst"], n, place, f.owner["file"], f.id, taints.get(id(n), ()), labels.get((inst["inst"], n.pre), (0, 0, {}, 0, 0)), program.bound_proven(n)))
    return out


def guard_rows(program, f) -> list[dict]:
    """The bodies of the modifiers that a function applies, an instance each."""
    out = []
    for i, m in enumerate(f.modifiers):
        g = program.modifier(m["name"])
        if g is not None and g.d["body"] is not None:
            place = program.place(g.owner)
            out += [_row(i, n, place, g.owner["file"], g.id, n.taint, (n.pre, n.pre, {}, n.pre, n.pre), False) for n in (g.tree, *g.tree.walk())]
    return out


def texts_of(owners: list[dict], rows: list[dict], program) -> list[dict]:
    """The whole lines that rows lie on, by file; owners are the contracts that these belong to."""
    spans: dict[str, list[int]] = {}
    for r in rows:
        at = spans.setdefault(r["file"], [r["line"], r["end_line"]])
        at[0], at[1] = min(at[0], r["line"]), max(at[1], r["end_line"])
    out = []
    for c in owners:
        place = program.place(c)
        if c["file"] in spans:
            a, z = max(spans[c["file"]][0], place.first), min(spans[c["file"]][1], place.first + len(place.starts) - 1)
            if a <= z:
                out.append({"file": c["file"], "first": a, "text": place.lines(a, z)})
    return out


def _row(inst, n, place, file, fn, taints, label, proven) -> dict:
    up = n.parent
    held = next((a for a in n.above() if a.kind.startswith(("stmt.", "check.")) or a.kind == "decl.variable"), None)
    args = up.args() if up is not None else []
    return {"inst": inst, "pre": n.pre, "post": n.post, "parent": up.pre if up is not None else -1, "child_idx": up.kids.index(n) if up is not None else -1, "arg_idx": next((i for i, a in enumerate(args) if a is n), -1), "kind": n.kind, "name": n.name, "value": n.value, "attrs": _texts(n.attrs), "ref_kind": n.ref_kind, "taints": sorted(taints), "x": label[0], "y": label[1], "last_x": label[3], "last_y": label[4], "arms": list(label[2].items()), "stmt": held.pre if held is not None else -1, "stmt_post": held.post if held is not None else -1, "target": write_target(n), "proven": bool(proven), "file": file, "fn": fn} | _span(place, n.s, n.e)


def contract_tree(program):
    """The synthetic tree of a contract: state variables and modifiers of all its lineage, and its active functions with their parameters; and each node's owner."""
    from gritstone.solidity.tree import Node, function_tree, number

    c = program.contract
    root, owner = Node("decl.contract", c["s"], c["e"], c["name"]), {}
    for d in program.lineage:
        for v in d["vars"]:
            root.add(Node("decl.variable", v["s"], v["e"], v["name"], type=v["type"], visibility=v["visibility"], is_state_var=True))
            owner[id(root.kids[-1])] = d
        for m in d["modifiers"]:
            root.add(function_tree(program.view, m))
            owner[id(root.kids[-1])] = d
    for f in program.active:
        t = function_tree(program.view, f.d)
        params = [Node("decl.parameter", p["s"], p["e"], p["name"], type=p["type"]) for p in f.d["params"]]
        for p in params:
            p.parent = t
        t.kids = params + t.kids
        root.add(t)
        owner[id(t)] = f.owner
    number(root)
    return root, owner


def call_type(program, c: dict, node, g) -> str:
    receiver = node.attrs.get("receiver_name")
    if receiver == "super":
        return "super"
    if receiver == "this":
        return "self"
    if g is not None and g.owner["kind"] == "library" and g.owner is not c or receiver and program.view.kinds.get(receiver) == "library":
        return "library"
    kind = node.kind.removeprefix("call.").split(".")[0]
    return kind if g is None or node.kind != "call.internal" else "internal" if g.owner is c else "inherited"


def lineage_calls(program) -> list[dict]:
    """Edges that only this contract's order tells: where super leads from each of its bases' functions, and the base constructors its constructor runs."""
    out, c = [], program.contract
    for base in program.lineage[1:]:
        for f in program.functions[base["id"]]:
            if f.d["body"] is None:
                continue
            for n in f.tree.walk():
                if n.kind.startswith("call.") and n.attrs.get("receiver_name") == "super" and (g := program.callee(f, n)) is not None:
                    out.append({"src": f.id, "dst": g.id, "called": n.name, "type": "super", "line": program.place(base).line(n.s)})
    for f in program.functions[c["id"]]:
        if f.d.get("kind") == "constructor":
            for m in f.d.get("modifiers", []):
                base = next((b for b in program.lineage[1:] if b["name"] == m["name"].split(".")[-1]), None)
                made = next((g for g in program.functions[base["id"]] if g.d.get("kind") == "constructor"), None) if base is not None else None
                if made is not None:
                    out.append({"src": f.id, "dst": made.id, "called": base["name"], "type": "constructor", "line": program.place(c).line(m["s"])})
    return out


def flow_rows(f, place) -> list[dict]:
    """source, target of each assignment: what is read on its right flows into what stands on its left."""
    from gritstone.solidity.program import targets

    out = []
    for n in f.tree.walk():
        if n.kind == "stmt.assign" and len(n.kids) > 1:
            read = sorted({x.name for x in (n.kids[-1], *n.kids[-1].walk()) if x.kind == "expr.identifier" and x.name and x.ref_kind})
            written = sorted({t for k in n.kids[:-1] for t in targets(k)} | ({b.name} if n.attrs.get("is_state_var") and (b := _lvalue(n.kids[0])) is not None and b.name else set()))
            out += [{"function_id": f.id, "source": a, "target": b, "line": place.line(n.s)} for a in read for b in written]
    return out


def facts(program, is_main: bool) -> dict[str, list]:
    """Every entity row that one contract gives."""
    from gritstone.solidity.keccak import selector

    c, out = program.contract, {t: [] for t in TABLES}
    place = program.place(c)
    names = [b["name"] for b in program.lineage]
    owners = [*program.lineage, *program.libraries]

    def scope(kind: str, sid: str, nodes: list[dict], f=None, guards: list[dict] = (), paths: list[tuple] = ()) -> None:
        at, p = (f.d, program.place(f.owner)) if f else (c, place)
        row = {"scope_id": sid, "scope": kind, "contract_id": c["id"], "contract": c["name"], "contract_kind": c["kind"], "function_id": f.id if f else None, "function": f.name if f else None, "visibility": f.visibility if f else None, "mutability": f.mutability if f else None, "modifiers": [m["name"] for m in f.modifiers] if f else [], "params": f.params if f else [], "bases": names, "controlled": program.controlled(f) if f else False, "caller_checked": bool(f) and (program.controlled(f) or program.caller_compared(f)), "is_main": is_main, "file": f.owner["file"] if f else c["file"]} | _span(p, at["s"], at["e"])
        out["trees"].append(row | {"pragma": (f.owner if f else c).get("pragma", ""), "nodes": nodes, "guards": list(guards), "texts": texts_of(owners, [row, *nodes, *guards], program), "paths": [list(x) for x in paths]})

    for i, v in enumerate(c["vars"]):
        out["state_vars"].append({"contract_id": c["id"], "decl_idx": i, "name": v["name"], "type_name": v["type"], "visibility": v["visibility"], "is_constant": v["constant"], "is_immutable": v["immutable"], "line": place.line(v["s"])})
    for f in [*program.functions[c["id"]], *program.modifiers[c["id"]]]:
        kind = "modifier" if f.is_modifier else f.d["kind"]
        out["functions"].append({"function_id": f.id, "contract_id": c["id"], "name": f.name, "kind": kind, "selector": f.selector, "signature": selector(f.selector) if kind == "function" else "", "visibility": f.visibility if not f.is_modifier else "internal", "mutability": f.mutability, "modifiers": [m["name"] for m in f.modifiers] if not f.is_modifier else [], "is_entry": f.is_entry, "has_body": f.d["body"] is not None, "file": c["file"]} | _span(place, f.d["s"], f.d["e"]))
        if f.d["body"] is None:
            continue
        for m in f.modifiers if not f.is_modifier else ():
            g = program.modifier(m["name"])
            out["calls"].append({"src": f.id, "dst": g.id if g else None, "called": m["name"], "type": "modifier", "line": place.line(m["s"])})
        for n in f.tree.walk():
            line = place.line(n.s)
            if n.kind.startswith("call.") and not n.attrs.get("type_cast"):
                g = program.callee(f, n)
                out["calls"].append({"src": f.id, "dst": g.id if g else None, "called": n.name, "type": call_type(program, c, n, g), "line": line})
            target = write_target(n)
            if target is not None:
                how = n.attrs.get("operator") or n.kind.rpartition(".")[2]
                out["state_writes"].append({"function_id": f.id, "var": target, "kind": {"=": "assign", "++": "increment", "--": "decrement"}.get(how, how), "line": line})
            if n.kind.startswith("check.") or n.kind == "stmt.if":
                test = n.kids[0] if n.kids else None
                out["guards"].append({"function_id": f.id, "kind": n.kind.rpartition(".")[2], "expr": place.cut(test.s, test.e) if test is not None else n.name, "line": line})
        out["flows"] += flow_rows(f, place)
        if not f.is_modifier:
            instances = program.expand(f)
            scope("function", f"function|{c['id']}|{f.id}", node_rows(program, instances), f, guard_rows(program, f), [i["path"] for i in instances])
    out["calls"] += lineage_calls(program)
    out["state_writes"] = [dict(t) for t in dict.fromkeys(tuple(w.items()) for w in out["state_writes"])]
    if is_main:
        seen = set()
        for f in program.entries:
            sign = selector(f.selector)
            if sign in seen:
                continue
            seen.add(sign)
            out["entry_functions"].append({"contract_id": c["id"], "function_id": f.id, "signature": sign})
            instances = program.expand(f)
            scope("entry_function", f"entry|{c['id']}|{f.id}", node_rows(program, instances), f, guard_rows(program, f), [i["path"] for i in instances])
    root, owner = contract_tree(program)
    held, nodes = c, []
    for n in (root, *root.walk()):
        held = owner.get(id(n), held)
        nodes.append(_row(0, n, program.place(held), held["file"], "", n.taint, (n.pre, n.pre, {}, n.pre, n.pre), False))
    scope("contract", f"contract|{c['id']}", nodes)
    return out


def build(spark: SparkSession, path: str | list[str]) -> CodeDB:
    """The code database of a file, some files or a project folder."""
    return from_units(*load(spark, path))


def from_units(units: DataFrame, links: DataFrame) -> CodeDB:
    """The code database of parsed files and their import links; of several projects where both name them in a column project."""
    of_project = lambda df: df if "project" in df.columns else df.withColumn("project", F.lit(""))
    units, links = of_project(units), of_project(links)
    contracts = stored(declarations(units), "declarations")
    heads = contracts.drop("decl")
    meant = stored(resolved(heads.join(units.select(F.col("path").alias("file"), "project"), "file"), links.select("project", "file", "target", "symbols")), "resolved")
    decls = contracts.select(F.col("contract_id").alias("base_id"), "decl")
    parts = meant.select("contract_id", F.posexplode(F.concat(F.col("mro"), F.col("libraries"))).alias("pos", "base_id")).join(decls, "base_id")
    lineage = spread(parts, "contract_id").groupBy("contract_id").agg(F.array_sort(F.collect_list(F.struct("pos", "decl"))).alias("l"))
    programs = lineage.join(meant.select("contract_id", F.size("mro").alias("bases"), "kinds", "is_main"), "contract_id").select("contract_id", F.col("l.decl").alias("decls"), "bases", "kinds", "is_main")
    schema = StructType.fromDDL(", ".join(f"{t} array<struct<{','.join(x.strip().replace(' ', ':', 1) for x in fields(d))}>>" for t, d in TABLES.items()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gritstone.solidity.program import Program

        for batch in batches:
            for row in batch.to_pylist():
                decls = [json.loads(d) for d in row["decls"]]
                got = facts(Program(decls[: row["bases"]], {k["name"]: k["kind"] for k in row["kinds"] or []}, decls[row["bases"] :]), row["is_main"])
                yield pa.RecordBatch.from_arrays([pa.array([got[t]], arrow.field(t).type) for t in TABLES], schema=arrow)

    emitted = stored(programs.mapInArrow(run, schema), "entities")
    tables = {t: emitted.select(F.explode(t).alias("r")).select("r.*") for t in TABLES}
    tables["calls"] = tables["calls"].distinct()  # where super leads, several contracts may say alike
    troubles = units.select(F.col("path").alias("file"), F.explode("troubles").alias("t")).select(F.lit("parse").alias("code"), F.lit("warning").alias("severity"), F.col("t.message").alias("message"), "file", F.col("t.line").alias("line"))
    missing = links.filter("target is null").select(F.lit("import-unresolved").alias("code"), F.lit("warning").alias("severity"), F.col("wanted").alias("message"), "file", F.lit(0).alias("line"))
    lost = meant.select("contract_id", F.explode("unresolved").alias("message")).join(heads.select("contract_id", "file"), "contract_id").select(F.lit("base-unresolved").alias("code"), F.lit("error").alias("severity"), "message", "file", F.lit(0).alias("line"))
    mro = meant.select("contract_id", F.posexplode("mro").alias("pos", "base_id"))
    weights = meant.select("contract_id", F.size("mro").alias("weight"))
    return CodeDB(files=units.drop("unit"), contracts=heads.drop("mentions").join(weights, "contract_id"), lineage=mro, main_contracts=meant.filter("is_main").select("contract_id", F.size("mro").alias("weight")), diagnostics=troubles.unionByName(missing).unionByName(lost).distinct(), **tables)
