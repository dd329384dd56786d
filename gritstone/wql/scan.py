"""All templates over a code database in one pass: a scope's nodes are one row, so every rule is decided where that row lies, with no shuffle.

What the relational engine says with joins is said here by walks over one small tree: both must find the same. A scope
is looked at by those templates alone whose scope and context fit; a rule's matches are found once a scope, however many
rules name it. Only the fields of nodes and scopes that the templates and the wanted columns read leave their table.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.functions.text import found_in, version_satisfies
from gritstone.operators.compose import first_branch
from gritstone.operators.storage import stored
from gritstone.solidity.codedb import CodeDB
from gritstone.wql.evaluate import _CALLS, _CONTRACTS, _GROUPS, FINDING, Engine, _sensitive, finding_rows, reads_source
from gritstone.wql.rules import Query, Template, walk

_GUARD = re.compile(r"(nonreentrant|noreentrancy|reentrancyguard|mutex|lock|guard)", re.IGNORECASE)
_INTS = ("inst", "pre", "post", "parent", "child_idx", "arg_idx", "stmt", "stmt_post", "x", "y", "last_x", "last_y", "line", "col", "end_line", "end_col", "begin_byte", "end_byte")
_TEXTS = ("kind", "name", "value", "ref_kind", "file", "fn", "target")
_FIELDS = (*_INTS, *_TEXTS, "taints", "proven", "attrs", "arms")
_SCOPE = ("scope_id", "scope", "contract", "contract_kind", "function", "visibility", "mutability", "modifiers", "params", "bases", "controlled", "caller_checked", "is_main", "file", "line", "end_line", "pragma")
#: Texts of which a batch has few.
_FEW = frozenset({"kind", "ref_kind", "file", "fn"})
#: Columns that tell rows of one place apart, for the branches of an or.
_SITE = ("file", "begin_byte", "end_byte", "primary_kind")
#: What the parts of a rule read of nodes, beside inst, pre and kind.
_READ = {
    "name": ("name", "value", "attrs"), "attrs": ("attrs",), "tainted": ("taints",), "unchecked": ("proven",), "visibility": ("attrs",), "mutability": ("attrs",), "regex": ("file", "line", "end_line"),
    "has": ("post",), "statement_has": ("stmt", "stmt_post"), "in": ("parent",), "left": ("parent", "child_idx", "name"), "right": ("parent", "child_idx", "name"), "args": ("parent", "arg_idx"), "arg_any": ("parent", "arg_idx"),
    "seq": ("post", "x", "y", "last_x", "last_y", "arms"),
}
_OF_KIND = {"state_write": "target", "state_read": "ref_kind"}
#: What the parts of a context read of scopes.
_HELD = {"modifier": ("modifiers",), "func_name": ("function",), "base": ("bases",), "has_param": ("params",), "version": ("pragma",), "context_visibility": ("visibility",), "context_mutability": ("mutability",), "context_regex": ("file", "line", "end_line")}
_PRESET = {"access_controlled": "controlled", "caller_checked": "caller_checked", "reentrancy_guarded": "modifiers"}


@dataclass(frozen=True)
class Needs:
    """What a scan reads: fields of nodes, keys of their attributes, fields of scopes, source texts, bodies of modifiers, and the columns of findings it gives."""

    nodes: frozenset[str]
    attrs: frozenset[str]
    scope: frozenset[str]
    texts: bool
    guards: bool
    columns: tuple[str, ...]


def needs(templates: Sequence[Template], columns: Sequence[str] = FINDING) -> Needs:
    """For the findings of templates with these of FINDING's columns."""
    queries = [b for t in templates for b in (t.query.branches or (t.query,))]
    rules, contexts = [x for q in queries for x in walk(q.match)], [x for q in queries for x in walk(q.context)]
    # A guarded_by has rules of nodes in it.
    read = [x for rs in (rules, contexts) for x in rs]
    kept = tuple(c for c in FINDING if c in columns or any(t.query.join == "or" for t in templates) and c in _SITE)
    nodes = {"inst", "pre", "kind"} | {f for x in read for k in x for f in _READ.get(k, ())} | {_OF_KIND[x["kind"]] for x in read if x.get("kind") in _OF_KIND}
    nodes |= {f for c in kept for f in {"primary_kind": ("kind",), "primary_name": ("name", "value"), "related": ("file", "line", "col", "name")}.get(c, (c,) if c in _FIELDS else ())}
    attrs = {k for x in read for k in x.get("attrs", ())} | {k for x in read for k in ("visibility", "mutability") if k in x} | {"parent" for x in read if "name" in x}
    scope = {"scope", "contract_kind", "is_main"} | {f for x in contexts for k in x for f in _HELD.get(k, ())} | {_PRESET[p] for x in contexts for p in x.get("preset", ())} | {c for c in ("contract", "function") if c in kept}
    texts = any(reads_source(q.match) for q in queries) or any("context_regex" in x or "regex" in x for x in contexts)
    return Needs(frozenset(nodes), frozenset(attrs), frozenset(scope), texts, any("guarded_by" in x for x in contexts), kept)


def _list(of: pa.Array, few: bool = False) -> list:
    if few and not of.null_count:
        words = of.dictionary_encode()
        return words.dictionary.to_numpy(zero_copy_only=False)[words.indices.to_numpy()].tolist()
    return of.to_numpy(zero_copy_only=False).tolist()


class Columns:
    """The nodes of a batch's scopes, a list for each column that is read, and the bounds of each scope's."""

    def __init__(self, batch: pa.RecordBatch, prefix: str, fields: Iterable[str] = _FIELDS):
        one = batch.column(f"{prefix}_pre")
        self.bounds = (one.offsets.to_numpy() - one.offsets[0].as_py()).tolist()
        self._maps = {}
        for c in fields:
            held = batch.column(f"{prefix}_{c}").flatten()
            if c in ("attrs", "arms"):
                self._maps[c] = held
            elif c == "taints":
                self.taints = self._lists(held)
            else:
                setattr(self, c, _list(held, c in _FEW))

    @staticmethod
    def _lists(of: pa.ListArray) -> list[list | None]:
        if of.null_count:
            return of.to_pylist()
        at, words = (of.offsets.to_numpy() - of.offsets[0].as_py()).tolist(), _list(of.flatten())
        return [words[a:z] for a, z in zip(at, at[1:], strict=False)]

    @cached_property
    def maps(self) -> dict:
        return {c: (m.offsets.to_pylist(), m.keys.to_pylist(), m.items.to_pylist()) for c, m in self._maps.items()}

    def map_of(self, c: str, i: int) -> dict:
        off, keys, items = self.maps[c]
        return dict(zip(keys[off[i] : off[i + 1]], items[off[i] : off[i + 1]], strict=True))


class Tree:
    """The nodes of one scope; a node is its place in the columns."""

    def __init__(self, columns: Columns, k: int, texts: list[dict]):
        self.c, self.span = columns, range(columns.bounds[k], columns.bounds[k + 1])
        self.texts = texts
        self._holds: dict[tuple[int, int], bool] = {}
        self._found: dict[int, list[int]] = {}
        self._below: dict[int, dict[int, list[int]]] = {}
        self._attrs: dict[int, dict] = {}
        self._arms: dict[int, dict] = {}
        self._sequences: dict[int, set] = {}

    @cached_property
    def at(self) -> dict[tuple[int, int], int]:
        return {(self.c.inst[i], self.c.pre[i]): i for i in self.span}

    @cached_property
    def by_kind(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for i in self.span:
            out.setdefault(self.c.kind[i], []).append(i)
        return out

    @cached_property
    def children(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for i in self.span:
            up = self.at.get((self.c.inst[i], self.c.parent[i]))
            if up is not None:
                out.setdefault(up, []).append(i)
        return out

    def attrs(self, i: int) -> dict:
        if i not in self._attrs:
            self._attrs[i] = self.c.map_of("attrs", i)
        return self._attrs[i]

    def arms(self, i: int) -> dict:
        if i not in self._arms:
            self._arms[i] = self.c.map_of("arms", i)
        return self._arms[i]

    def lines(self, file: str, first: int, last: int) -> str:
        for t in self.texts:
            rows = t.setdefault("rows", t["text"].split("\n"))
            if t["file"] == file and t["first"] <= first < t["first"] + len(rows):
                return "\n".join(rows[first - t["first"] : max(first, last) - t["first"] + 1])
        return ""

    # predicates
    def is_kind(self, i: int, kind: str) -> bool:
        k = self.c.kind[i]
        if kind in _GROUPS:
            return k in _GROUPS[kind]
        if kind == "any_call":
            return k.startswith("call.")
        if kind == "state_write":
            return self.c.target[i] is not None
        if kind == "state_read":
            return k == "asm.sload" or k == "expr.identifier" and self.c.ref_kind[i] == "state_var"
        return k == kind

    def candidates(self, r: dict) -> list[int] | range:
        kind = r.get("kind")
        if kind is None:
            return self._of_branches(r)
        if kind == "state_write":
            return [i for i in self.span if self.c.target[i] is not None]
        if kind == "state_read":
            return self.span
        if kind == "any_call":
            return [i for k, xs in self.by_kind.items() if k.startswith("call.") for i in xs]
        return [i for k in _GROUPS.get(kind, (kind,)) for i in self.by_kind.get(k, ())]

    def _of_branches(self, r: dict) -> list[int] | range:
        """For a rule that names no kind: where each of some branches does, theirs."""
        for branches in r.get("any", ()):
            got = [self.candidates(b) for b in branches]
            if self.span not in got:
                return sorted({i for x in got for i in x})
        return self.span

    def named(self, i: int, pattern: str) -> bool:
        name = self.c.name[i]
        if found_in(name if name else self.c.value[i], pattern):
            return True
        return self.c.kind[i] == "expr.member_access" and found_in(".".join(x for x in (self.attrs(i).get("parent"), name) if x is not None), pattern)

    def attribute(self, i: int, key: str, want) -> bool:
        have = self.attrs(i).get(key)
        if have is None:
            return False
        if isinstance(want, bool):
            return have.lower() == str(want).lower()
        return have in want if isinstance(want, list) else found_in(have, want, whole=True)

    def holds(self, r: dict, i: int) -> bool:
        key = (id(r), i)
        got = self._holds.get(key)
        if got is None:
            got = self._holds[key] = self._decide(r, i)
        return got

    def _decide(self, r: dict, i: int) -> bool:
        for key, value in r.items():
            if not _TESTS[key](self, value, i):
                return False
        return True

    def _any(self, choices: list[list[dict]], i: int) -> bool:
        for branches in choices:
            for b in branches:
                if self.holds(b, i):
                    break
            else:
                return False
        return True

    def _in_attrs(self, key: str, wanted: list[str], i: int) -> bool:
        return (self.attrs(i).get(key) or "").lower() in wanted

    def _an_argument(self, tests: list[tuple[int | None, dict]], i: int) -> bool:
        if not self.c.kind[i].startswith(_CALLS):
            return False
        kids, place = self.children.get(i, ()), self.c.arg_idx
        return all(any((place[k] == n if n is not None else place[k] >= 0) and self.holds(sub, k) for k in kids) for n, sub in tests)

    def matches(self, r: dict) -> list[int]:
        got = self._found.get(id(r))
        if got is None:
            got = self._found[id(r)] = [i for i in self.candidates(r) if self.holds(r, i)]
        return got

    def within(self, r: dict, inst: int, after: int, last: int) -> bool:
        """Whether a match lies beyond one place of a tree, up to another."""
        places = self._below.get(id(r))
        if places is None:
            places = self._below[id(r)] = {}
            for i in self.matches(r):
                places.setdefault(self.c.inst[i], []).append(self.c.pre[i])
            for x in places.values():
                x.sort()
        mine = places.get(inst)
        if not mine:
            return False
        at = bisect_right(mine, after)
        return at < len(mine) and mine[at] <= last

    def above(self, i: int) -> Iterator[int]:
        up = self.at.get((self.c.inst[i], self.c.parent[i]))
        while up is not None:
            yield up
            up = self.at.get((self.c.inst[up], self.c.parent[up]))

    def side(self, i: int, sub: dict, side: int) -> bool:
        kind = self.c.kind[i]
        if kind == "expr.member_access" and side == 1:
            return set(sub) == {"name"} and found_in(self.c.name[i], sub["name"])
        if kind not in ("stmt.assign", "expr.binary_op", "expr.member_access"):
            return False
        return any(self.c.child_idx[k] == side and self.holds(sub, k) for k in self.children.get(i, ()))

    def sequence(self, steps: list[dict]) -> set[tuple[int, int, int]]:
        """(root's inst, inst and pre of the first witness) of every run of the steps."""
        got = self._sequences.get(id(steps))
        if got is None:
            got = self._sequences[id(steps)] = self._search(steps)
        return got

    def _search(self, steps: list[dict]) -> set[tuple[int, int, int]]:
        c, lists = self.c, []
        for s in steps:
            lists.append(self.matches(s))
            if not lists[-1]:
                return set()
        inlined = not any(map(_sensitive, steps))

        def follows(chosen: list[int], b: int) -> bool:
            a = chosen[-1]
            if c.last_x[b] < c.x[a] and c.last_y[b] < c.y[a] or c.inst[a] == c.inst[b] and c.pre[a] <= c.pre[b] <= c.post[a]:
                return False
            if not inlined and c.inst[a] != c.inst[b]:
                return False
            mine = self.arms(b)
            return not any(mine.get(k, arm) != arm for x in chosen for k, arm in self.arms(x).items())

        def completes(chosen: list[int]) -> bool:
            if len(chosen) == len(steps):
                return True
            return any(completes([*chosen, b]) for b in lists[len(chosen)] if follows(chosen, b))

        return {(0 if inlined else c.inst[a], c.inst[a], c.pre[a]) for a in lists[0] if completes([a])}

    def anchors(self, r: dict, roots: list[int]) -> set[tuple[int, int]]:
        """(inst, pre) of the nodes that a root rule's positive parts found, for the roots given."""
        ok, out, parts = {self.c.inst[i] for i in roots}, set(), 0
        for sub in r.get("has", []):
            parts += 1
            out |= {(self.c.inst[i], self.c.pre[i]) for i in self.matches(sub) if self.c.inst[i] in ok}
        for steps in r.get("seq", []):
            parts += 1
            out |= {(inst, pre) for root, inst, pre in self.sequence(steps) if root in ok}
        for sub in [*r.get("all", []), *[b for bs in r.get("any", []) for b in bs]]:
            parts += 1
            out |= self.anchors(sub, [i for i in roots if self.holds(sub, i)])
        return out if parts else {(self.c.inst[i], self.c.pre[i]) for i in roots}

    def sites(self, q: Query) -> list[tuple[int, int]]:
        """(inst, pre) of what the query finds, in order."""
        own = q.scope != "entry_function"
        if q.select is not None:
            return sorted((self.c.inst[i], self.c.pre[i]) for i in self.matches(q.match) if self.c.pre[i] > 0 and not (own and self.c.inst[i]))
        roots = [i for i in self.span if self.c.pre[i] == 0 and not (own and self.c.inst[i]) and self.holds(q.match, i)]
        hidden = own and "seq" not in str(q.match)  # other instances take part in sequences alone
        return sorted(x for x in (self.anchors(q.match, roots) if roots else ()) if not (hidden and x[0]))


#: What each part of a rule asks of a node.
_TESTS = {
    "kind": lambda t, v, i: t.is_kind(i, v),
    "name": lambda t, v, i: t.named(i, v),
    "attrs": lambda t, v, i: all(t.attribute(i, k, want) for k, want in v.items()),
    "tainted": lambda t, v, i: not {"parameter", "sender"}.isdisjoint(t.c.taints[i] or ()) if v == "user_controlled" else v in (t.c.taints[i] or ()),
    "unchecked": lambda t, v, i: not t.c.proven[i],
    "visibility": lambda t, v, i: t._in_attrs("visibility", v, i),
    "mutability": lambda t, v, i: t._in_attrs("mutability", v, i),
    "regex": lambda t, v, i: found_in(t.lines(t.c.file[i], t.c.line[i], t.c.end_line[i]), v),
    "any": lambda t, v, i: t._any(v, i),
    "not": lambda t, v, i: not any(t.holds(sub, i) for sub in v),
    "all": lambda t, v, i: all(t.holds(sub, i) for sub in v),
    "has": lambda t, v, i: all(t.within(sub, t.c.inst[i], t.c.pre[i], t.c.post[i]) for sub in v),
    "statement_has": lambda t, v, i: t.c.stmt[i] >= 0 and all(t.within(sub, t.c.inst[i], t.c.stmt[i], t.c.stmt_post[i]) for sub in v),
    "in": lambda t, v, i: all(any(t.holds(sub, a) for a in t.above(i)) for sub in v),
    "left": lambda t, v, i: t.side(i, v, 0),
    "right": lambda t, v, i: t.side(i, v, 1),
    "args": lambda t, v, i: t._an_argument(list(v.items()), i),
    "arg_any": lambda t, v, i: t._an_argument([(None, sub) for sub in v], i),
    "seq": lambda t, v, i: all(any(root == t.c.inst[i] for root, _, _ in t.sequence(steps)) for steps in v),
}


def context(r: dict, scope: dict, tree: Tree, guards: Tree | None) -> bool:
    again = lambda x: context(x, scope, tree, guards)
    modifiers = scope.get("modifiers") or []  # read where a rule asks for them
    for p in r.get("preset", []):
        if not {"access_controlled": lambda: scope["controlled"], "caller_checked": lambda: scope["caller_checked"], "reentrancy_guarded": lambda: any(_GUARD.search(m) for m in modifiers)}[p]():
            return False
    if "modifier" in r and not any(found_in(m, r["modifier"]) for m in modifiers):
        return False
    if "func_name" in r and not found_in(scope["function"], r["func_name"]):
        return False
    if "base" in r and not any(found_in(b, r["base"]) for b in scope["bases"] or []):
        return False
    if "has_param" in r and r["has_param"] not in (scope["params"] or []):
        return False
    if "version" in r and not version_satisfies(scope["pragma"], r["version"]):
        return False
    for k in ("visibility", "mutability"):
        if f"context_{k}" in r and (scope[k] or "").lower() not in r[f"context_{k}"]:
            return False
    if "context_regex" in r and not found_in(tree.lines(scope["file"], scope["line"], scope["end_line"]), r["context_regex"]):
        return False
    for sub in r.get("guarded_by", []):
        own = any(tree.c.inst[i] == 0 and tree.c.kind[i].startswith("check.") for i in tree.matches(sub))
        if not own and not guards.matches(sub):
            return False
    return not any(map(again, r.get("context_not", []))) and all(any(map(again, branches)) for branches in r.get("context_any", []))


def in_scope(q: Query, scope: dict) -> bool:
    if q.scope in _CONTRACTS:
        kind = _CONTRACTS[q.scope]
        return scope["scope"] == "contract" and (scope["is_main"] if q.scope == "main_contract" else kind is None or scope["contract_kind"] == kind)
    return scope["scope"] == q.scope


#: What a finding says of its place: of the nodes, the scope, the node that was found and the way to its instance.
_PLACED = {
    "contract": lambda c, scope, i, way: scope["contract"], "function": lambda c, scope, i, way: scope["function"], "primary_kind": lambda c, scope, i, way: c.kind[i],
    "primary_name": lambda c, scope, i, way: c.name[i] or c.value[i], "path": lambda c, scope, i, way: list(way), "related": lambda c, scope, i, way: None,
}


def _of_node(name: str):
    return lambda c, scope, i, way: getattr(c, name)[i]


def findings_of(tree: Tree, guards: Tree | None, scope: dict, paths: list[list[str]], templates: list[Template], columns: Sequence[str] = FINDING) -> Iterator[tuple]:
    """(template, branch, the columns' values) for every finding in one scope."""
    c = tree.c
    told = [_PLACED.get(x) or _of_node(x) for x in columns]
    at = columns.index("related") if "related" in columns else None

    def placed(site: tuple[int, int], related: list[tuple] = ()) -> list:
        i = tree.at[site]
        way = paths[site[0]] if site[0] < len(paths) else []
        row = [f(c, scope, i, way) for f in told]
        if at is not None:
            row[at] = [dict(zip(("branch", "file", "line", "col", "kind", "name"), x, strict=True)) for x in related]
        return row

    def sites(q: Query) -> list[tuple[int, int]]:
        if not in_scope(q, scope) or q.select is not None and not tree.candidates(q.match):
            return []
        return tree.sites(q) if context(q.context, scope, tree, guards) else []

    for k, t in enumerate(templates):
        q = t.query
        if q.join == "and":
            per = [sites(b) for b in q.branches]
            if all(per):
                related = [] if at is None else [(b, c.file[i], c.line[i], c.col[i], c.kind[i], c.name[i]) for b, found in enumerate(per) for i in (tree.at[s] for s in found)]
                yield k, 0, *placed(per[0][0], sorted(related))
        else:
            for b, one in enumerate(q.branches if q.join == "or" else [q]):
                if one.scope != "source" and (found := sites(one)):
                    yield k, b, *placed(found[0])


_OUT = {
    "t": ("int", pa.int32()), "branch": ("int", pa.int32()), **{x: ("string", pa.string()) for x in ("file", "contract", "function", "fn", "primary_kind", "primary_name")},
    **{x: ("int", pa.int32()) for x in ("line", "col", "end_line", "end_col", "begin_byte", "end_byte")}, "path": ("array<string>", pa.list_(pa.string())),
    "related": ("array<struct<branch:int,file:string,line:int,col:int,kind:string,name:string>>", pa.list_(pa.struct([("branch", pa.int32()), ("file", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("kind", pa.string()), ("name", pa.string())]))),
}


def scan(db: CodeDB, templates: list[Template], columns: Sequence[str] = FINDING) -> DataFrame:
    """The findings of all templates, as the relational engine gives them, with these of FINDING's columns."""
    if not templates:
        raise ValueError("no templates")
    queries = [b for t in templates for b in (t.query.branches or (t.query,))]
    wanted = sorted({"contract" if q.scope in _CONTRACTS else q.scope for q in queries} - {"source"})
    need = needs(templates, columns)
    fields, of_scope, kept = sorted(need.nodes), sorted(need.scope), need.columns
    rows = db.trees.filter(F.col("scope").isin(wanted)) if wanted else db.trees.filter("false")
    rows = rows.select(
        *of_scope,
        *(["paths"] if "path" in kept else []),
        *(["texts"] if need.texts else []),
        *[F.col(f"nodes.{x}").alias(f"nodes_{x}") for x in fields],
        *([F.col(f"guards.{x}").alias(f"guards_{x}") for x in fields] if need.guards else []),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("t", "branch", *kept)
        schema = pa.schema([(n, _OUT[n][1]) for n in names])
        for batch in batches:
            nodes, held = Columns(batch, "nodes", fields), Columns(batch, "guards", fields) if need.guards else None
            scopes = zip(*[batch.column(c).to_pylist() for c in of_scope], strict=True)
            none = [[]] * len(batch)
            texts = batch.column("texts").to_pylist() if need.texts else none
            paths = batch.column("paths").to_pylist() if "path" in kept else none
            out = []
            for k, scope in enumerate(scopes):
                guards = Tree(held, k, texts[k]) if need.guards else None
                out.extend(findings_of(Tree(nodes, k, texts[k]), guards, dict(zip(of_scope, scope, strict=True)), paths[k], templates, kept))
            values = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, schema.field(i).type) for i, x in enumerate(values)], schema=schema)

    found = rows.mapInArrow(run, ", ".join(f"{n} {_OUT[n][0]}" for n in ("t", "branch", *kept)))
    either = [k for k, t in enumerate(templates) if t.query.join == "or"]
    if either:  # What all branches found says which of them a place keeps: the trees aren't walked again for that.
        found = stored(found, "found")
    # Templates are few and known: what they say of themselves is written in, not joined.
    said = lambda name: F.element_at(F.array(*[F.lit(getattr(t, name)) for t in templates]), F.col("t") + 1).alias({"id": "template_id"}.get(name, name))
    named = found.select("t", "branch", *[said(n) for n in ("id", "severity", "confidence", "title", "message")], *kept)
    shown = [*finding_rows[:5], *[c for c in FINDING if c in columns]]
    parts = []
    if len(either) < len(templates):
        parts.append((named.filter(~F.col("t").isin(either)) if either else named).select(*shown))
    for k in either:
        t = templates[k]
        per = [named.filter(F.col("t") == k)] if any(b.scope != "source" for b in t.query.branches) else []
        per += [Engine(db).source_findings(t, b).select(*finding_rows[:5], *kept).withColumn("branch", F.lit(i)) for i, b in enumerate(t.query.branches) if b.scope == "source"]
        one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), per)
        parts.append(first_branch(one, _SITE, "branch").select(*shown))
    parts += [Engine(db).source_findings(t, t.query).select(*shown) for t in templates if t.query.scope == "source" and not t.query.branches]
    return reduce(DataFrame.unionByName, parts)
