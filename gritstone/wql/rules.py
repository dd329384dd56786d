"""Templates of the query language: YAML text to checked rule trees, before any Spark job runs.

A rule is a plain dict. Node part: kind, name, regex, visibility, mutability, tainted, attrs, unchecked, and the structural
has, in, not, left, right, args, arg_any, statement_has, any, all, seq. Context part: preset, modifier, func_name, base,
has_param, version, guarded_by, context_not, context_any, and what an ``and`` lifts to the filter layer.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from gritstone.functions.text import to_java, version_constraint

GROUPS = ("any_call", "outgoing_call", "delegatecall", "eth_transfer", "selfdestruct", "check", "state_write", "state_read")
_PLAIN = {
    "call": "any_call", "guard": "check", "external_call": "call.external", "internal_call": "call.internal", "staticcall": "call.lowlevel.staticcall", "lowlevel_call": "call.lowlevel.call", "create": "call.create",
    **{g: g for g in ("outgoing_call", "delegatecall", "eth_transfer", "selfdestruct", "state_write", "state_read")},
    **{f"builtin_{x}": f"call.builtin.{x}" for x in ("transfer", "send", "selfdestruct")},
    **{x: f"check.{x}" for x in ("require", "assert", "revert")},
    **{x: f"stmt.{x}" for x in ("assign", "if", "loop", "return", "emit", "try_catch", "unchecked", "block")},
    **{x: f"expr.{x}" for x in ("identifier", "literal", "tuple")}, "binary": "expr.binary_op", "unary": "expr.unary_op", "member": "expr.member_access", "index": "expr.index_access", "ternary": "expr.conditional",
    **{x: f"decl.{x}" for x in ("function", "contract", "variable", "parameter", "modifier")},
    "asm": "asm.block", **{f"asm_{x}": f"asm.{x}" for x in ("sstore", "sload", "delegatecall", "call", "staticcall", "create", "selfdestruct", "revert", "return")},
}
KINDS = dict(_PLAIN)
ATTRIBUTES = {x: x for x in ("receiver_name", "has_value", "has_gas", "call_option", "operator", "type", "type_kind", "is_state_var", "has_salt", "parent", "cond_role", "conditional_part", "try_part", "loop_type", "receiver_type", "receiver_type_kind", "receiver_type_is_address")} | {"receiver": "call_receiver", "signature": "called_signature", "literal_kind": "subtype"}
SCOPES = ("source", "entry_function", "function", "main_contract", "any_contract", "contract", "library", "abstract")
PRESETS = ("access_controlled", "caller_checked", "reentrancy_guarded")
CONTEXT = ("preset", "modifier", "func_name", "base", "has_param", "version", "guarded_by")
TAINTS = ("parameter", "sender", "state_var", "local_var", "user_controlled")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
_VISIBILITY, _MUTABILITY = {"public", "external", "internal", "private"}, {"payable", "nonpayable", "view", "pure"}
MAX_DEPTH = 64


class TemplateError(ValueError):
    """A template that can't be meant as written."""


@dataclass(frozen=True)
class Query:
    scope: str
    context: dict
    match: dict
    select: str | None = None
    branches: tuple[Query, ...] = ()
    join: str = ""


@dataclass(frozen=True)
class Template:
    id: str
    severity: str
    query: Query
    title: str = ""
    message: str = ""
    confidence: str = ""
    meta: dict = field(default_factory=dict)


class _Strict(yaml.SafeLoader):
    """No merge keys, no repeated keys."""

    def construct_mapping(self, node, deep=False):
        keys = []
        for k, _ in node.value:
            if k.tag == "tag:yaml.org,2002:merge":
                raise TemplateError("merge keys aren't allowed")
            keys.append(self.construct_object(k, deep=True))
        if len(keys) != len(set(map(str, keys))):
            raise TemplateError(f"a key occurs twice among {keys}")
        return super().construct_mapping(node, deep)


def _text(key: str, value) -> str:
    if isinstance(value, bool) or not isinstance(value, (str, int)) or str(value) == "":
        raise TemplateError(f"{key} needs a text that isn't empty")
    return str(value)


def _regex(key: str, value) -> str:
    value = _text(key, value)
    try:
        re.compile(re.sub(r"\[:\w+:\]", "a", value))
        to_java(value)
    except (re.error, ValueError) as e:
        raise TemplateError(f"{key}: {e}") from e
    return value


def _list(key: str, value) -> list:
    if not isinstance(value, list) or not value:
        raise TemplateError(f"{key} needs a list that isn't empty")
    return value


def _csv(key: str, value, known: set[str]) -> list[str]:
    out = [x.strip().lower() for x in (value if isinstance(value, list) else _text(key, value).split(","))]
    if not set(out) <= known:
        raise TemplateError(f"{key}: unknown among {out}")
    return out


def kind_of(name) -> str:
    if not isinstance(name, str) or name not in KINDS:
        raise TemplateError(f"unknown block {name!r}")
    return KINDS[name]


def version_text(value) -> str:
    value = _text("version", value)
    try:
        version_constraint(value)
    except ValueError as e:
        raise TemplateError(f"version: {e}") from e
    return value


def is_context(r: dict) -> bool:
    return bool(r) and all(k in CONTEXT or k in ("context_not", "context_any") for k in r)


def merge(into: dict, more: dict) -> dict:
    """Conjunction of two rules; witnesses of repeated existential matchers stay independent, scalars that differ are an error."""
    out = dict(into)
    for k, v in more.items():
        if k in ("has", "in", "not", "arg_any", "statement_has", "any", "all", "seq", "context_not", "context_any", "guarded_by", "preset"):
            out[k] = [*out.get(k, []), *v]
        elif k in ("attrs", "args"):
            both = dict(out.get(k, {}))
            for a, b in v.items():
                if a in both and both[a] != b:
                    raise TemplateError(f"{a} is given twice with different values")
                both[a] = b
            out[k] = both
        elif k in out and out[k] != v:
            raise TemplateError(f"{k} is given twice with different values")
        else:
            out[k] = v
    return out


def rule(body, depth: int = 0) -> dict:
    """One mapping, or a list of mappings that all must hold."""
    if depth > MAX_DEPTH:
        raise TemplateError("rules are nested too deeply")
    if isinstance(body, list):
        out: dict = {}
        for item in _list("where", body):
            out = merge(out, rule(item, depth))
        return out
    if not isinstance(body, dict) or not body:
        raise TemplateError(f"expected matchers, found {body!r}")
    out = {}
    for key, value in body.items():
        out = merge(out, matcher(str(key), value, depth))
    return out


def matcher(key: str, value, depth: int) -> dict:
    inner = lambda v: rule(v, depth + 1)
    if value is None:
        raise TemplateError(f"{key} has no value")
    if key in ("block", "select"):
        return {"kind": kind_of(value)}
    if key in ("name", "regex", "modifier", "func_name", "base"):
        return {key: _regex(key, value)}
    if key == "visibility":
        return {key: _csv(key, value, _VISIBILITY)}
    if key == "mutability":
        return {key: _csv(key, value, _MUTABILITY)}
    if key == "tainted":
        if value not in TAINTS:
            raise TemplateError(f"unknown taint {value!r}")
        return {key: value}
    if key == "preset":
        if value not in PRESETS:
            raise TemplateError(f"unknown preset {value!r}")
        return {key: [value]}
    if key == "has_param":
        return {key: _text(key, value)}
    if key == "version":
        return {key: version_text(value)}
    if key == "unchecked_var":
        if value is not True:
            raise TemplateError("unchecked_var can only be true")
        return {"unchecked": True}
    if key in ("has", "in", "statement_has", "guarded_by"):
        got = inner(value)
        if is_context(got):
            raise TemplateError(f"{key} looks at nodes, not at their function")
        return {key: [got]}
    if key == "contains":
        return {"has": [inner(value)]}
    if key in ("left", "right"):
        return {key: inner(value)}
    if key == "arg.any":
        return {"arg_any": [inner(value)]}
    if m := re.fullmatch(r"arg\.(\d+)", key):
        return {"args": {int(m[1]): inner(value)}}
    if key == "not":
        got = inner(value)
        return {"context_not": [got]} if is_context(got) else {"not": [got]}
    if key == "any":
        got = [inner(v) for v in _list(key, value)]
        context = [is_context(g) for g in got]
        if all(context):
            return {"context_any": [got]}
        if any(context):
            raise TemplateError("any can't mix matchers of nodes with those of their function")
        return {"any": [got]}
    if key == "and":
        out: dict = {}
        for v in _list(key, value):
            got = inner(v)
            lifted = {f"context_{k}": got.pop(k) for k in ("visibility", "mutability", "regex") if k in got and depth == 0}
            out = merge(out, merge(got, lifted) if got else lifted)
        return out
    if key == "sequence":
        steps = [inner(v) for v in _list(key, value)]
        if len(steps) < 2:
            raise TemplateError("a sequence needs two steps")
        if not set(steps[0]) - {"not"}:
            raise TemplateError("a sequence's first step must say what it is")
        return {"seq": [steps]}
    if key == "attr":
        if not isinstance(value, dict) or not value:
            raise TemplateError("attr needs a mapping")
        out = {}
        for k, v in value.items():
            out = merge(out, {"attrs": {ATTRIBUTES.get(k, k): attribute(k, v)}})
        return out
    if key in ATTRIBUTES:
        return {"attrs": {ATTRIBUTES[key]: attribute(key, value)}}
    raise TemplateError(f"unknown matcher {key!r}")


def attribute(key: str, value):
    if isinstance(value, bool):
        return value
    if isinstance(value, list):
        return [_text(key, v) for v in _list(key, value)]
    return _regex(key, value)


def split(r: dict) -> tuple[dict, dict]:
    """(context, node part)."""
    context = {k: v for k, v in r.items() if k in CONTEXT or k.startswith("context_")}
    return context, {k: v for k, v in r.items() if k not in context}


def walk(r: dict) -> Iterable[dict]:
    yield r
    for k in ("has", "in", "not", "arg_any", "statement_has", "all", "guarded_by", "context_not"):
        for x in r.get(k, []):
            yield from walk(x)
    for k in ("any", "seq", "context_any"):
        for xs in r.get(k, []):
            for x in xs:
                yield from walk(x)
    for k in ("left", "right"):
        if k in r:
            yield from walk(r[k])
    for x in r.get("args", {}).values():
        yield from walk(x)


def simple(body: dict, scope: str | None = None, branch: bool = False) -> Query:
    known = {"from", "select", "where"}
    if not isinstance(body, dict) or set(body) - known:
        raise TemplateError(f"a query has {sorted(known)}, found {body!r}")
    scope = body.get("from", scope or "entry_function")
    if scope not in SCOPES:
        raise TemplateError(f"unknown scope {scope!r}")
    if "where" not in body and "select" not in body:
        raise TemplateError("a query needs select or where")
    context, match = split(rule(body["where"]) if "where" in body else {})
    select = body.get("select")
    for x in walk(match):
        if x is not match and any(k in CONTEXT for k in x):
            raise TemplateError("matchers of the function can't be nested under a node")
    if scope == "source":
        if set(match) != {"regex"} or context or select:
            raise TemplateError("a query of source has one regex and nothing else")
    elif scope in ("main_contract", "any_contract", "contract", "library", "abstract"):
        if bad := set(context) - {"base", "context_not", "context_any"}:
            raise TemplateError(f"{sorted(bad)} say nothing about a contract")
    if select is not None:
        match = merge({"kind": kind_of(select)}, match)
    if branch and select is None and not any(k in match for k in ("has", "seq", "any")):
        raise TemplateError("a branch of and needs a node to report")
    return Query(scope, context, match, select)


def query(body) -> Query:
    if not isinstance(body, dict) or not body:
        raise TemplateError("query is missing")
    for join in ("and", "or"):
        if join in body:
            if set(body) - {join, "from"}:
                raise TemplateError(f"{join} stands alone in a query")
            branches = tuple(simple(b, body.get("from"), join == "and") for b in _list(join, body[join]))
            if join == "and" and len({b.scope for b in branches}) > 1:
                raise TemplateError("branches of and share one scope")
            return Query(branches[0].scope, {}, {}, None, branches, join)
    return simple(body)


def parse(text: str) -> Template:
    """One template document."""
    try:
        doc = yaml.load(text, _Strict)  # noqa: S506
    except yaml.YAMLError as e:
        raise TemplateError(f"not YAML: {e}") from e
    if not isinstance(doc, dict) or not doc.get("id"):
        raise TemplateError("a template needs an id")
    severity = str(doc.get("severity", "INFO")).upper()
    if severity not in SEVERITIES:
        raise TemplateError(f"unknown severity {severity!r}")
    meta = {k: v for k, v in doc.items() if k not in ("id", "severity", "query", "title", "message", "confidence")}
    return Template(str(doc["id"]), severity, query(doc.get("query")), str(doc.get("title", "")), str(doc.get("message", "")), str(doc.get("confidence", "")), meta)


def load(path: str, strict: bool = True) -> tuple[list[Template], list[str]]:
    """Templates of a file or folder in order of severity and id, and what was wrong with those left out (nothing is left out if strict)."""
    p = Path(path)
    out, wrong = [], []
    for f in [p] if p.is_file() else sorted([*p.rglob("*.yaml"), *p.rglob("*.yml")]):
        for text in re.split(r"(?m)^---\s*$", f.read_text(encoding="utf-8")):
            if not text.strip():
                continue
            try:
                out.append(parse(text))
            except TemplateError as e:
                if strict:
                    raise TemplateError(f"{f}: {e}") from e
                wrong.append(f"{f}: {e}")
    if len({t.id for t in out}) != len(out):
        raise TemplateError("two templates share an id")
    return sorted(out, key=lambda t: (SEVERITIES.index(t.severity), t.id)), wrong
