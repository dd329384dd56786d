"""Rule trees to DataFrames: every rule becomes the set of nodes that satisfy it.

Predicates of one node are Columns; ``has`` and ``in`` are interval semi joins within a tree, ``not`` anti joins,
``left``, ``right`` and ``arg`` joins on the parent and position, ``sequence`` an ordered self join. All joins have the
tree as equality key, so none is a nested loop. A template's scopes are filtered by context before any node is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.text import matches, spans, version_holds
from gritstone.operators.compose import first_branch, severity_rank
from gritstone.solidity.codedb import CodeDB
from gritstone.wql.rules import Query, Template

TREE = ["scope_id", "inst"]
KEY = [*TREE, "pre"]
_CONTRACTS = {"main_contract": None, "any_contract": None, "contract": "contract", "library": "library", "abstract": "abstract"}
_GROUPS = {
    "outgoing_call": ["call.external", "call.lowlevel.call", "call.lowlevel.delegatecall", "call.lowlevel.staticcall", "call.builtin.transfer", "call.builtin.send", "call.create", "asm.call", "asm.delegatecall", "asm.staticcall"],
    "eth_transfer": ["call.builtin.transfer", "call.builtin.send", "call.lowlevel.call", "asm.call"],
    "delegatecall": ["call.lowlevel.delegatecall", "asm.delegatecall"],
    "selfdestruct": ["call.builtin.selfdestruct", "asm.selfdestruct"],
    "check": ["check.require", "check.assert", "check.revert"],
    "token_call": ["call.external"],  # for rules made in Python: which methods is a matter of name
}
#: What a finding says of its place, and all of its columns.
FINDING = ("file", "contract", "function", "fn", "line", "col", "end_line", "end_col", "begin_byte", "end_byte", "primary_kind", "primary_name", "related", "path")
finding_rows = ("template_id", "severity", "confidence", "title", "message", *FINDING)
_EXISTS = ("has", "in", "arg_any", "statement_has", "left", "right", "args", "seq")
_CALLS = ("call.", "check.", "stmt.emit", "stmt.state_mutation", "asm.")


def kind_is(kind: str) -> Column:
    c = F.col("kind")
    if kind in _GROUPS:
        return c.isin(_GROUPS[kind])
    if kind == "any_call":
        return c.startswith("call.")
    if kind == "state_write":
        return F.col("target").isNotNull()
    if kind == "state_read":
        return (c == "asm.sload") | (c == "expr.identifier") & (F.col("ref_kind") == "state_var")
    return c == kind


def _attribute(key: str, want) -> Column:
    c = F.col("attrs")[key]
    if isinstance(want, bool):
        return F.coalesce(F.lower(c) == str(want).lower(), F.lit(False))
    if isinstance(want, list):
        return F.coalesce(c.isin(want), F.lit(False))
    return F.coalesce(matches(c, want, whole=True), F.lit(False))


def local(r: dict) -> Column | None:
    """The rule as a predicate of one node; None where it needs other nodes. Never null."""
    if any(k in r for k in _EXISTS):
        return None
    parts = [F.lit(True)]
    if "kind" in r:
        parts.append(kind_is(r["kind"]))
    if "name" in r:
        text = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("value"))
        dotted = F.concat_ws(".", F.col("attrs")["parent"], "name")
        parts.append(matches(text, r["name"]) | (F.col("kind") == "expr.member_access") & matches(dotted, r["name"]))
    parts += [_attribute(k, v) for k, v in r.get("attrs", {}).items()]
    if "regex" in r:
        parts.append(F.coalesce(matches("source", r["regex"]), F.lit(False)))
    for k in ("visibility", "mutability"):
        if k in r:
            parts.append(F.coalesce(F.lower(F.col("attrs")[k]).isin(r[k]), F.lit(False)))
    if "tainted" in r:
        wanted = ["parameter", "sender"] if r["tainted"] == "user_controlled" else [r["tainted"]]
        parts.append(F.arrays_overlap("taints", F.array(*map(F.lit, wanted))))
    if r.get("unchecked"):
        parts.append(~F.col("proven"))
    for branches in r.get("any", []):
        got = [local(b) for b in branches]
        if any(g is None for g in got):
            return None
        parts.append(reduce(Column.__or__, got))
    for sub in r.get("all", []):
        if (got := local(sub)) is None:
            return None
        parts.append(got)
    for sub in r.get("not", []):
        if (got := local(sub)) is None:
            return None
        parts.append(~got)
    return F.coalesce(reduce(Column.__and__, parts), F.lit(False))


def _exclusive(a: Column, b: Column) -> Column:
    """Whether two nodes lie in different branches of one conditional."""
    return F.exists(F.map_keys(a), lambda k: F.coalesce(b[k] != a[k], F.lit(False)))


def _sensitive(r: dict) -> bool:
    """Whether a rule reads taints or arguments, which belong to one calling context."""
    if "tainted" in r or "args" in r or "arg_any" in r:
        return True
    below = [x for k in ("has", "in", "not", "statement_has", "all") for x in r.get(k, [])] + [x for k in ("any", "seq") for xs in r.get(k, []) for x in xs] + [r[k] for k in ("left", "right") if k in r]
    return any(map(_sensitive, below))


class Nodes:
    """Match sets over the nodes of some scopes."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    def match(self, r: dict, base: DataFrame | None = None) -> DataFrame:
        """The rows of ``base`` (all nodes by default) that satisfy the rule."""
        df = self.nodes if base is None else base
        plain = {k: v for k, v in r.items() if k not in _EXISTS and k not in ("any", "not", "all")}
        df = df.filter(local(plain))
        later = []
        for branches in r.get("any", []):
            got = [local(b) for b in branches]
            if all(g is not None for g in got):
                df = df.filter(reduce(Column.__or__, got))
            else:
                later.append(branches)
        for sub in r.get("not", []):
            if (got := local(sub)) is not None:
                df = df.filter(~got)
        for sub in r.get("has", []):
            df = df.join(self._ids(sub), self._below(df), "left_semi")
        for sub in r.get("in", []):
            s = self.match(sub).select(*[F.col(c).alias("__" + c) for c in (*KEY, "post")])
            df = df.join(s, (F.col("scope_id") == F.col("__scope_id")) & (F.col("inst") == F.col("__inst")) & (F.col("__pre") < F.col("pre")) & (F.col("__post") >= F.col("pre")), "left_semi")
        for sub in r.get("statement_has", []):
            on = (F.col("scope_id") == F.col("__scope_id")) & (F.col("inst") == F.col("__inst")) & (F.col("stmt") >= 0) & (F.col("__pre") > F.col("stmt")) & (F.col("__pre") <= F.col("stmt_post"))
            df = df.join(self._ids(sub), on, "left_semi")
        for i, side in enumerate(("left", "right")):
            if side in r:
                df = self._side(df, r[side], i)
        for i, sub in r.get("args", {}).items():
            df = self._child(df.filter(self._takes_arguments()), sub, F.col("__arg_idx") == i)
        for sub in r.get("arg_any", []):
            df = self._child(df.filter(self._takes_arguments()), sub, F.col("__arg_idx") >= 0)
        for sub in r.get("all", []):
            df = self.match(sub, df)
        for steps in r.get("seq", []):
            df = df.join(self.sequence(steps).select(*[F.col(c).alias("__" + c) for c in TREE]).distinct(), (F.col("scope_id") == F.col("__scope_id")) & (F.col("inst") == F.col("__inst")), "left_semi")
        for branches in later:
            keys = reduce(DataFrame.unionByName, [self.match(b, df).select(*KEY) for b in branches]).distinct()
            df = df.join(keys, KEY, "left_semi")
        for sub in r.get("not", []):
            if local(sub) is None:
                df = df.join(self.match(sub, df).select(*KEY), KEY, "left_anti")
        return df

    @staticmethod
    def _takes_arguments() -> Column:
        return reduce(Column.__or__, [F.col("kind").startswith(k) for k in _CALLS])

    @staticmethod
    def _below(df: DataFrame) -> Column:
        return (F.col("scope_id") == F.col("__scope_id")) & (F.col("inst") == F.col("__inst")) & (F.col("__pre") > F.col("pre")) & (F.col("__pre") <= F.col("post"))

    def _ids(self, sub: dict) -> DataFrame:
        return self.match(sub).select(*[F.col(c).alias("__" + c) for c in KEY])

    def _child(self, df: DataFrame, sub: dict, place: Column) -> DataFrame:
        kids = self.match(sub).select(*[F.col(c).alias("__" + c) for c in (*TREE, "parent", "child_idx", "arg_idx")]).filter(place)
        return df.join(kids, (F.col("scope_id") == F.col("__scope_id")) & (F.col("inst") == F.col("__inst")) & (F.col("pre") == F.col("__parent")), "left_semi")

    def _side(self, df: DataFrame, sub: dict, i: int) -> DataFrame:
        """left and right: the first and second child of assignments and binary operations; of a member access its base, and its own name."""
        pair = self._child(df.filter(F.col("kind").isin("stmt.assign", "expr.binary_op")), sub, F.col("__child_idx") == i)
        member = df.filter(F.col("kind") == "expr.member_access")
        if i == 0:
            member = self._child(member, sub, F.col("__child_idx") == 0)
        else:
            member = member.filter(matches("name", sub["name"])) if set(sub) == {"name"} else member.filter(F.lit(False))
        return pair.unionByName(member)

    def sequence(self, steps: list[dict]) -> DataFrame:
        """scope_id, inst, pre (first witness), at (inst of the witness): step i + 1 may run after step i, isn't part of it, and all can run in one go."""
        inlined = not any(map(_sensitive, steps))
        columns = ("inst", "pre", "post", "x", "y", "last_x", "last_y", "arms")
        found = None
        for i, step in enumerate(steps):
            s = self.match(step).select("scope_id", F.struct(*columns).alias(f"s{i}"))
            if found is None:
                found = s
                continue
            a, b = F.col(f"s{i - 1}"), F.col(f"s{i}")
            before = (b["last_x"] < a["x"]) & (b["last_y"] < a["y"])
            inside = (a["inst"] == b["inst"]) & (b["pre"] >= a["pre"]) & (b["pre"] <= a["post"])
            ok = ~before & ~inside
            if not inlined:
                ok = ok & (a["inst"] == b["inst"])
            for j in range(i):
                ok = ok & ~_exclusive(F.col(f"s{j}")["arms"], b["arms"])
            found = found.join(s, "scope_id").filter(ok)
        root = F.lit(0) if inlined else F.col("s0.inst")
        return found.select("scope_id", root.alias("inst"), F.col("s0.pre").alias("pre"), F.col("s0.inst").alias("at")).distinct()

    def anchors(self, r: dict, ok: DataFrame) -> DataFrame:
        """scope_id, inst, at, pre of the nodes that a root rule's positive parts found, for the roots in ``ok``."""
        out = []
        for sub in r.get("has", []):
            out.append(self.match(sub).select("scope_id", "inst", F.col("inst").alias("at"), "pre"))
        for steps in r.get("seq", []):
            out.append(self.sequence(steps).select("scope_id", "inst", "at", "pre"))
        for sub in [*r.get("all", []), *[b for bs in r.get("any", []) for b in bs]]:
            out.append(self.anchors(sub, self.match(sub, ok)))
        found = reduce(DataFrame.unionByName, out) if out else ok.select("scope_id", "inst", F.col("inst").alias("at"), "pre")
        return found.join(ok.select(*TREE).distinct(), TREE, "left_semi")


def reads_source(r: dict) -> bool:
    from gritstone.wql.rules import walk

    return any("regex" in x for x in walk(r))


class Engine:
    def __init__(self, db: CodeDB):
        self.db = db

    # context
    def context(self, r: dict) -> Column:
        parts = [F.lit(True)]
        for p in r.get("preset", []):
            parts.append({"access_controlled": F.col("controlled"), "caller_checked": F.col("caller_checked"), "reentrancy_guarded": F.exists("modifiers", lambda m: m.rlike("(?i)(nonreentrant|noreentrancy|reentrancyguard|mutex|lock|guard)"))}[p])
        if "modifier" in r:
            parts.append(F.exists("modifiers", lambda m: matches(m, r["modifier"])))
        if "func_name" in r:
            parts.append(matches("function", r["func_name"]))
        if "base" in r:
            parts.append(F.exists("bases", lambda b: matches(b, r["base"])))
        if "has_param" in r:
            parts.append(F.array_contains("params", r["has_param"]))
        if "version" in r:
            parts.append(F.coalesce(version_holds("pragma", r["version"]), F.lit(True)))
        for k in ("visibility", "mutability"):
            if f"context_{k}" in r:
                parts.append(F.lower(k).isin(r[f"context_{k}"]))
        if "context_regex" in r:
            parts.append(matches("source", r["context_regex"]))
        for sub in r.get("context_not", []):
            parts.append(~self.context(sub))
        for branches in r.get("context_any", []):
            parts.append(reduce(Column.__or__, map(self.context, branches)))
        return F.coalesce(reduce(Column.__and__, parts), F.lit(False))

    def _lines(self, rows: DataFrame) -> DataFrame:
        """With source: the whole lines of each row's span."""
        text = self.db.files.select(F.col("path").alias("file"), F.split("content", "\n").alias("__lines"))
        cut = F.array_join(F.slice("__lines", F.col("line"), F.greatest(F.lit(1), F.col("end_line") - F.col("line") + 1)), "\n")
        return rows.join(text, "file", "left").withColumn("source", F.coalesce(cut, F.lit(""))).drop("__lines")

    def scopes(self, q: Query) -> DataFrame:
        if q.scope in _CONTRACTS:
            rows = self.db.scopes.filter("scope = 'contract'")
            rows = rows.filter("is_main") if q.scope == "main_contract" else rows.filter(F.col("contract_kind") == _CONTRACTS[q.scope]) if _CONTRACTS[q.scope] else rows
        else:
            rows = self.db.scopes.filter(F.col("scope") == q.scope)
        text = str(q.context)
        if "'version'" in text:
            rows = rows.join(self.db.files.select(F.col("path").alias("file"), "pragma"), "file", "left")
        if "'context_regex'" in text:
            rows = self._lines(rows)
        rows = rows.filter(self.context({k: v for k, v in q.context.items() if k != "guarded_by"}))
        for sub in q.context.get("guarded_by", []):
            rows = rows.join(self._guarded(sub), "scope_id", "left_semi")
        return rows

    def _guarded(self, sub: dict) -> DataFrame:
        """Scopes with a check in their body, or in an applied modifier's, that satisfies the rule."""
        checks = self.db.nodes.filter(F.col("kind").startswith("check."))
        own = Nodes(self.db.nodes).match(sub, checks).filter("inst = 0").select("scope_id")
        trees = self.db.nodes.filter(F.col("scope_id").startswith("contract|"))
        declared = trees.filter("kind = 'decl.modifier'").select("scope_id", F.col("name").alias("m"), F.col("pre").alias("a"), F.col("post").alias("z"))
        inner = Nodes(trees).match(sub).select("scope_id", "pre").join(declared, "scope_id").filter("pre >= a and pre <= z").select(F.substring_index("scope_id", "|", -1).alias("contract_id"), "m").distinct()
        applied = self.db.scopes.select("scope_id", "contract_id", F.explode("modifiers").alias("m")).join(inner, ["contract_id", "m"]).select("scope_id")
        return own.union(applied).distinct()

    # queries
    def sites(self, q: Query, every: bool = False) -> DataFrame:
        """scope_id, inst, pre: the first matching node of each scope (all of them if ``every``)."""
        kept = self.scopes(q).select("scope_id")
        nodes = self.db.nodes.join(kept, "scope_id", "left_semi")
        if q.scope != "entry_function" and "seq" not in str(q.match):
            nodes = nodes.filter("inst = 0")
        if reads_source(q.match):
            nodes = self._lines(nodes)
        n = Nodes(nodes)
        if q.select is not None:
            hit = n.match(q.match).filter("pre > 0").select("scope_id", "inst", "pre")
            if q.scope != "entry_function":
                hit = hit.filter("inst = 0")
        else:
            roots = nodes.filter("pre = 0")
            if q.scope != "entry_function":
                roots = roots.filter("inst = 0")
            ok = n.match(q.match, roots)
            hit = n.anchors(q.match, ok).select("scope_id", F.col("at").alias("inst"), "pre")
        if every:
            return hit.distinct()
        return hit.groupBy("scope_id").agg(F.min(F.struct("inst", "pre")).alias("x")).select("scope_id", "x.inst", "x.pre")

    def _located(self, sites: DataFrame) -> DataFrame:
        n = self.db.nodes.select(*KEY, "kind", "name", "value", "file", "fn", "line", "col", "end_line", "end_col", "begin_byte", "end_byte")
        s = self.db.trees.select("scope_id", "contract", "function", "paths")
        return sites.join(n, KEY).join(s, "scope_id").withColumn("path", F.coalesce(F.try_element_at("paths", F.col("inst") + 1), F.array().cast("array<string>"))).drop("paths")

    def run(self, t: Template) -> DataFrame:
        """Findings of one template."""
        q = t.query
        if q.scope == "source" and not q.branches:
            rows = self._source(q)
        elif q.join == "and":
            per = [self._located(self.sites(b, True)).withColumn("branch", F.lit(i)) for i, b in enumerate(q.branches)]
            both = reduce(DataFrame.unionByName, per)
            kept = both.groupBy("scope_id").agg(F.count_distinct("branch").alias("n"), F.array_sort(F.collect_list(F.struct("branch", "file", "line", "col", "kind", "name"))).alias("related")).filter(F.col("n") == len(per)).drop("n")
            first = per[0].withColumn("__n", F.row_number().over(Window.partitionBy("scope_id").orderBy("inst", "pre"))).filter("__n = 1").drop("__n", "branch")
            rows = first.join(kept, "scope_id")
        elif q.join == "or":
            per = [(self._source(b) if b.scope == "source" else self._located(self.sites(b)).withColumn("related", self._none())).withColumn("branch", F.lit(i)) for i, b in enumerate(q.branches)]
            rows = first_branch(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), per), ["file", "begin_byte", "end_byte", "kind"], "branch")
        else:
            rows = self._located(self.sites(q)).withColumn("related", self._none())
        return self._told(rows, t)

    @staticmethod
    def _told(rows: DataFrame, t: Template) -> DataFrame:
        fixed = {"template_id": t.id, "severity": t.severity, "confidence": t.confidence, "title": t.title, "message": t.message}
        named = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("value"))
        return rows.select(*[F.lit(v).alias(k) for k, v in fixed.items()], *[c for c in FINDING if c not in ("primary_kind", "primary_name")], F.col("kind").alias("primary_kind"), named.alias("primary_name")).select(*finding_rows)

    def source_findings(self, t: Template, q: Query) -> DataFrame:
        """Findings of a query of source texts."""
        return self._told(self._source(q), t)

    @staticmethod
    def _none() -> Column:
        return F.array().cast("array<struct<branch:int,file:string,line:int,col:int,kind:string,name:string>>")

    def _source(self, q: Query) -> DataFrame:
        """A row for each match; of the functions around it the one with the smallest span."""
        rows = spans(self.db.files.select(F.col("path").alias("file"), "content"), "content", q.match["regex"]).withColumn("key", F.struct("file", "begin", "end"))
        inner = self.db.functions.select("file", F.col("name").alias("function"), "contract_id", "function_id", F.col("line").alias("a"), F.col("end_line").alias("z")).distinct()
        held = rows.join(inner, "file").filter("line >= a and line <= z").groupBy("key").agg(F.min(F.struct(F.col("z") - F.col("a"), F.col("function_id"), F.col("contract_id"), F.col("function"))).alias("x"))
        hit = rows.join(held, "key", "left")
        lines = F.size(F.split("match", "\n"))
        whole = {"line": F.col("line"), "col": F.col("col"), "end_line": F.col("line") + lines - 1, "end_col": F.col("col") + F.length("match"), "begin_byte": F.col("begin"), "end_byte": F.col("end")}
        texts = {"scope_id": F.lit(None), "contract": F.element_at(F.split("x.contract_id", "#"), -1), "contract_id": F.col("x.contract_id"), "function": F.col("x.function"), "function_id": F.col("x.function_id"), "fn": F.coalesce("x.function_id", F.lit("")), "kind": F.lit("source"), "name": F.col("match"), "value": F.lit("")}
        return hit.select("file", *[v.cast("int").alias(k) for k, v in whole.items()], *[v.cast("string").alias(k) for k, v in texts.items()], F.array().cast("array<string>").alias("path")).withColumn("related", self._none())

    def findings(self, templates: list[Template]) -> DataFrame:
        """All templates' findings, a job of joins for each; ``scan`` finds the same in one pass."""
        if not templates:
            raise ValueError("no templates")
        rows = reduce(DataFrame.unionByName, [self.run(t) for t in templates])
        return rows

    @staticmethod
    def ordered(findings: DataFrame) -> DataFrame:
        return findings.orderBy("file", "line", "col", "begin_byte", "template_id", "contract", "function", "primary_kind", "primary_name", "message")

    @staticmethod
    def at_least(findings: DataFrame, severity: str) -> DataFrame:
        return findings.filter(severity_rank("severity") <= severity_rank(F.lit(severity)))
