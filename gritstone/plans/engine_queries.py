"""Templates of the query language, run by the engine itself over trees made of orders, each with the DuckDB SQL that must give the same rows.

An order is a function of a customer, each of its lines a statement with two operands: returned lines call or check,
accepted ones write state, the others compute. A customer is a contract, and its orders are its variables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.solidity.codedb import NODE, SCOPE, TREE, CodeDB, fields
from gritstone.wql.rules import Template, parse
from gritstone.wql.scan import Needs, needs, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TEMPLATES: dict[str, Template] = {}

_KIND = "CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_discount > 0.07 THEN 'check.require' ELSE 'call.external' END WHEN l_returnflag = 'A' THEN 'stmt.assign' ELSE 'expr.binary_op' END"
_NAME = "CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_suppkey % 2 = 0 THEN 'transfer' ELSE 'approve' END ELSE '' END"
_OPERATOR = "CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_tax > 0.04 THEN '+' ELSE '-' END WHEN l_returnflag = 'A' THEN '=' END"
_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_discount", "l_tax", "l_linestatus")


_NODE = dict(x.strip().split(" ", 1) for x in fields(NODE.removeprefix("scope_id string, ")))
_NO_TEXTS, _NO_ENTRIES = "cast(array() as array<string>)", "cast(map() as map<string,string>)"


def _node(need: Needs | None, pre: str, post: str, parent: str, place: str, kind: str, **more: str) -> str:
    """A node as SQL, with the fields that are needed, null where they aren't given; all of them if nothing is said."""
    given = {"inst": "0", "pre": pre, "post": post, "parent": parent, "child_idx": place, "arg_idx": place, "kind": kind, "name": "''", "value": "''", "attrs": _NO_ENTRIES, "ref_kind": "''", "taints": _NO_TEXTS, "arms": _NO_ENTRIES, "stmt": "-1", "stmt_post": "-1", "proven": "false", "file": "'f'", "fn": "''"}
    given |= dict.fromkeys(("x", "y", "last_x", "last_y", "line", "end_line", "begin_byte"), pre) | {"col": "1", "end_col": "1", "end_byte": f"{pre} + 1"} | more
    return "named_struct(" + ", ".join(f"'{n}', cast({given.get(n, 'null')} as {t})" for n, t in _NODE.items() if need is None or n in need.nodes) + ")"


def _attrs(need: Needs | None, **entries: str) -> str:
    pairs = [f"named_struct('key', '{k}', 'value', cast({v} as string))" for k, v in entries.items() if need is None or k in need.attrs]
    return f"map_from_entries(filter(array({', '.join(pairs)}), e -> e.value is not null))" if pairs else _NO_ENTRIES


def _tree(need: Needs | None, scope: dict[str, Column], nodes: Column) -> list[Column]:
    none = F.array().cast("array<string>")
    given = {"scope_id": F.lit(""), "modifiers": none, "params": none, "bases": none, "controlled": F.lit(False), "caller_checked": F.lit(False), "is_main": F.lit(False), "file": F.lit("f"), "line": F.lit(0), "end_line": F.lit(0), "pragma": F.lit("")} | scope
    types = dict(x.strip().split(" ", 1) for x in fields(TREE))
    held = "array<struct<" + ",".join(f"{n}:{t}" for n, t in _NODE.items() if need is None or n in need.nodes) + ">>"
    types |= {"nodes": held, "guards": held}
    given |= {"nodes": nodes, "guards": F.array(), "texts": F.array(), "paths": F.array()}
    return [given.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()]


def _of_line(sql: str) -> str:
    """An expression of lineitem's columns as one of ``x``, a struct that holds them."""
    return re.sub(r"\bl_(?=[a-z]+\b)", "x.l_", sql)


def trees(spark: SparkSession, sf_dir: str, need: Needs | None = None) -> DataFrame:
    """Trees with all fields of their nodes, or with those that are needed.

    Lines travel as they lie in their table; nodes, many times as large, are made of an order's lines where these are looked at."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    taints = "array(case when l_tax >= 0.04 then 'parameter' else 'state_var' end)"
    pre, holds = "(3 * i + 1)", "(l_returnflag = 'A' or l_returnflag = 'R' and l_discount > 0.07)"
    statement = {"stmt": f"case when {holds} then {pre} else -1 end", "stmt_post": f"case when {holds} then {pre} + 2 else -1 end"}
    attrs = _attrs(need, operator=_OPERATOR, is_state_var="case when l_returnflag = 'A' then 'true' end", receiver_name="case when l_returnflag = 'R' then concat('t', l_suppkey % 10) end", has_value="case when l_returnflag = 'R' and l_tax > 0.05 then 'true' end")
    line = [
        _node(need, pre, f"{pre} + 2", "0", "i", _KIND, name=_NAME, attrs=attrs, taints=taints, target="case when l_returnflag = 'A' then 'bal' end", proven="l_returnflag = 'N' and l_discount < 0.03"),
        _node(need, f"{pre} + 1", f"{pre} + 1", pre, "0", "'expr.identifier'", name="l_linestatus", ref_kind="case when l_linestatus = 'F' then 'state_var' else 'parameter' end", taints=taints, **statement),
        _node(need, f"{pre} + 2", f"{pre} + 2", pre, "1", "'expr.literal'", value="cast(cast(l_quantity as int) as string)", **statement),
    ]
    lines = read("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*_ORDER))).alias("s"))
    orders = read("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    root = _node(need, "0", "3 * size(s)", "-1", "-1", "'decl.function'")
    rank = F.substring("o_orderpriority", 1, 1)
    functions = orders.select(
        *_tree(
            need,
            {
                "scope_id": F.concat(F.lit("function|"), F.col("o_orderkey").cast("string")), "scope": F.lit("function"), "contract": F.col("o_custkey").cast("string"), "contract_kind": F.lit("contract"), "function": F.col("o_orderkey").cast("string"),
                "visibility": F.expr("case o_orderstatus when 'F' then 'external' when 'O' then 'public' else 'internal' end"), "mutability": F.when(rank == "1", "payable").when(rank == "2", "nonpayable").when(rank == "3", "view").otherwise("pure"),
                "modifiers": F.when(rank == "1", F.array(F.lit("onlyOwner"))).when(rank == "2", F.array(F.lit("nonReentrant"))).otherwise(F.array().cast("array<string>")), "params": F.when(F.col("o_totalprice") > 200000, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>")),
                "controlled": F.col("o_orderstatus") == "P", "caller_checked": F.col("o_orderstatus") != "F", "pragma": F.concat(F.lit("^0.8."), (F.col("o_custkey") % 20).cast("string")),
            },
            F.expr(f"concat(array({root}), flatten(transform(s, (x, i) -> array({', '.join(map(_of_line, line))}))))"),
        )
    )
    variable = _node(need, "(i + 1)", "(i + 1)", "0", "i", "'decl.variable'", name="x.o_orderstatus", attrs=_attrs(need, is_state_var="'true'", type="'uint256'"))
    held = read("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("s"))
    customers = read("customer").join(held, F.col("c_custkey") == F.col("o_custkey"))
    kinds = F.expr("case c_nationkey % 3 when 0 then 'contract' when 1 then 'library' else 'abstract' end")
    contracts = customers.select(
        *_tree(
            need,
            {"scope_id": F.concat(F.lit("contract|"), F.col("c_custkey").cast("string")), "scope": F.lit("contract"), "contract": F.col("c_custkey").cast("string"), "contract_kind": kinds, "bases": F.array("c_mktsegment"), "is_main": (kinds == "contract") & (F.col("c_acctbal") > 0)},
            F.expr(f"concat(array({_node(need, '0', 'size(s)', '-1', '-1', "'decl.contract'")}), transform(s, (x, i) -> {variable}))"),
        )
    )
    return functions.unionByName(contracts)


def database(of: DataFrame) -> CodeDB:
    return CodeDB(**dict.fromkeys(CodeDB.__dataclass_fields__) | {"trees": of})


#: What a query shows of a finding, as SQL expressions.
SHOWN = ("cast(coalesce(function, contract) as bigint) as scope", "line as place", "primary_kind as kind")
#: The columns of findings that are read for it.
_COLUMNS = ("contract", "function", "line", "primary_kind")


def shown(findings: DataFrame) -> DataFrame:
    return findings.selectExpr(*SHOWN)


def _add(name: str, body: str, sql: str) -> None:
    """A template whose findings give scope (function or contract), place and kind; sql gives o or c, pre and kind of every match, of which the first of each scope is found."""
    TEMPLATES[name] = template = parse(f"{{id: {name}, query: {body}}}")
    QUERIES[name] = lambda spark, sf_dir: shown(scan(database(trees(spark, sf_dir, needs([template], _COLUMNS))), [template], _COLUMNS))
    ORACLES[name] = f"{_SQL}, m AS ({sql}) SELECT s AS scope, min(pre)::INTEGER AS place, arg_min(kind, pre) AS kind FROM m GROUP BY s"


_SQL = f"""WITH l AS (SELECT l_orderkey AS s, 3 * row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ORDER)}) - 2 AS pre, {_KIND} AS kind, {_NAME} AS name, {_OPERATOR} AS op, l_linestatus AS st, l_tax >= 0.04 AS par, l_quantity::INTEGER::VARCHAR AS q,
  l_returnflag = 'N' AND l_discount < 0.03 AS proven, l_suppkey % 10 AS supp, l_tax > 0.05 AS pays FROM lineitem),
f AS (SELECT o_orderkey AS s, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'external' WHEN 'O' THEN 'public' ELSE 'internal' END AS vis, o_orderpriority[1] AS rank, o_totalprice > 200000 AS has_n FROM orders),
v AS (SELECT o_custkey AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pre, 'decl.variable' AS kind, o_orderstatus AS name, c_mktsegment AS base, c_nationkey % 3 AS k, c_acctbal > 0 AS rich FROM orders JOIN customer ON c_custkey = o_custkey)"""
_EXTERNAL, _WRITE, _CHECK, _BINARY = (f"kind = '{k}'" for k in ("call.external", "stmt.assign", "check.require", "expr.binary_op"))
_ID, _LIT = "s, pre + 1 AS pre, 'expr.identifier' AS kind", "s, pre + 2 AS pre, 'expr.literal' AS kind"

_add("wql_select_kind_name", "{from: function, select: external_call, where: [{name: '^transfer$'}]}", f"SELECT s, pre, kind FROM l WHERE {_EXTERNAL} AND name = 'transfer'")
_add("wql_attribute", "{from: function, select: external_call, where: [{receiver_name: '^t[0-4]$'}, {has_value: true}]}", f"SELECT s, pre, kind FROM l WHERE {_EXTERNAL} AND supp < 5 AND pays")
_add("wql_operator", "{from: function, select: binary, where: [{operator: '[+]'}]}", f"SELECT s, pre, kind FROM l WHERE {_BINARY} AND op = '+'")
_add("wql_groups_of_kinds", "{from: function, where: [{has: {any: [{block: outgoing_call}, {block: guard}]}}]}", f"SELECT s, pre, kind FROM l WHERE {_EXTERNAL} OR {_CHECK}")
_add("wql_state_read", "{from: function, select: state_read, where: [{tainted: parameter}]}", f"SELECT {_ID} FROM l WHERE st = 'F' AND par")
_add("wql_state_write", "{from: function, select: state_write, where: [{right: {name: '^1'}}]}", f"SELECT s, pre, kind FROM l WHERE {_WRITE} AND q LIKE '1%'")
_add("wql_tainted", "{from: function, select: identifier, where: [{tainted: user_controlled}]}", f"SELECT {_ID} FROM l WHERE par")
_add("wql_has", "{from: function, where: [{has: {block: literal, name: '^4[0-9]$'}}]}", f"SELECT {_LIT} FROM l WHERE regexp_full_match(q, '4[0-9]')")
_add("wql_nested_has", "{from: function, select: call, where: [{has: {block: literal, name: '^[12]'}}, {has: {block: identifier, name: F}}]}", f"SELECT s, pre, kind FROM l WHERE {_EXTERNAL} AND q[1] IN ('1', '2') AND st = 'F'")
_add("wql_in", "{from: function, select: literal, where: [{in: {block: assign}}, {name: '^1'}]}", f"SELECT {_LIT} FROM l WHERE {_WRITE} AND q LIKE '1%'")
_add("wql_not", "{from: function, where: [{has: {block: state_write}}, {not: {has: {block: external_call}}}]}", f"SELECT s, pre, kind FROM l WHERE {_WRITE} AND s NOT IN (SELECT s FROM l WHERE {_EXTERNAL})")
_add("wql_left_right", "{from: function, select: binary, where: [{left: {name: '^O$'}}, {right: {name: '^[12]'}}]}", f"SELECT s, pre, kind FROM l WHERE {_BINARY} AND st = 'O' AND q[1] IN ('1', '2')")
_add("wql_arguments", "{from: function, select: external_call, where: [{arg.0: {tainted: parameter}}, {arg.any: {block: literal, name: '5$'}}]}", f"SELECT s, pre, kind FROM l WHERE {_EXTERNAL} AND par AND q LIKE '%5'")
_add("wql_statement_has", "{from: function, select: identifier, where: [{statement_has: {block: literal, name: '^3'}}]}", f"SELECT {_ID} FROM l WHERE ({_WRITE} OR {_CHECK}) AND q LIKE '3%'")
_add("wql_any", "{from: function, where: [{has: {any: [{block: assign, left: {name: '^F$'}}, {block: binary, operator: '-', not: {right: {name: '^[1-4]'}}}]}}]}", f"SELECT s, pre, kind FROM l WHERE {_WRITE} AND st = 'F' OR {_BINARY} AND op = '-' AND q[1] NOT IN ('1', '2', '3', '4')")
_add("wql_and_of_matchers", "{from: function, select: state_write, where: [{and: [{left: {name: O}}, {right: {name: '0$'}}]}]}", f"SELECT s, pre, kind FROM l WHERE {_WRITE} AND st = 'O' AND q LIKE '%0'")
_add("wql_unchecked_var", "{from: function, select: binary, where: [{unchecked_var: true}]}", f"SELECT s, pre, kind FROM l WHERE {_BINARY} AND NOT proven")
_add("wql_sequence_2", "{from: function, where: [{sequence: [{block: external_call}, {block: state_write}]}]}", f"SELECT s, pre, kind FROM l a WHERE {_EXTERNAL} AND EXISTS (SELECT 1 FROM l b WHERE b.s = a.s AND b.pre > a.pre AND b.{_WRITE})")
_add("wql_sequence_3", "{from: function, where: [{sequence: [{block: guard}, {block: external_call, arg.0: {tainted: parameter}}, {block: state_write}]}]}", f"SELECT s, pre, kind FROM l a WHERE {_CHECK} AND EXISTS (SELECT 1 FROM l b JOIN l c ON c.s = b.s AND c.pre > b.pre WHERE b.s = a.s AND b.pre > a.pre AND b.{_EXTERNAL} AND b.par AND c.{_WRITE})")
_add("wql_sequence_not_reentrancy_guarded", "{from: function, where: [{sequence: [{block: outgoing_call}, {block: state_write}]}, {not: {preset: reentrancy_guarded}}]}", f"SELECT s, pre, kind FROM l a WHERE {_EXTERNAL} AND EXISTS (SELECT 1 FROM l b WHERE b.s = a.s AND b.pre > a.pre AND b.{_WRITE}) AND s NOT IN (SELECT s FROM f WHERE rank = '2')")
_add("wql_access_controlled", "{from: function, select: state_write, where: [{not: {preset: access_controlled}}]}", f"SELECT s, pre, kind FROM l WHERE {_WRITE} AND s NOT IN (SELECT s FROM f WHERE vis = 'internal')")
_add("wql_caller_checked", "{from: function, select: state_write, where: [{not: {preset: caller_checked}}]}", f"SELECT s, pre, kind FROM l WHERE {_WRITE} AND s IN (SELECT s FROM f WHERE vis = 'external')")
_add("wql_modifier_and_parameter", "{from: function, select: guard, where: [{modifier: '(?i)^only'}, {has_param: n}]}", f"SELECT s, pre, kind FROM l WHERE {_CHECK} AND s IN (SELECT s FROM f WHERE rank = '1' AND has_n)")
_add("wql_function_name", "{from: function, select: guard, where: [{func_name: '^1'}]}", f"SELECT s, pre, kind FROM l WHERE {_CHECK} AND s::VARCHAR LIKE '1%'")
_add("wql_visibility_mutability", "{from: function, select: guard, where: [{and: [{visibility: 'external,public'}]}, {and: [{mutability: 'payable,view'}]}]}", f"SELECT s, pre, kind FROM l WHERE {_CHECK} AND s IN (SELECT s FROM f WHERE vis <> 'internal' AND rank IN ('1', '3'))")
_add("wql_version", "{from: function, select: guard, where: [{version: '>=0.8.7'}, {version: '>=0.8.7'}]}", f"SELECT s, pre, kind FROM l WHERE {_CHECK} AND s IN (SELECT s FROM f WHERE o_custkey % 20 >= 7)")
_add("wql_guarded_by", "{from: function, select: state_write, where: [{guarded_by: {has: {name: '^O$'}}}]}", f"SELECT s, pre, kind FROM l WHERE {_WRITE} AND s IN (SELECT s FROM l WHERE {_CHECK} AND st = 'O')")
_add("wql_query_and", "{from: function, and: [{select: guard}, {select: external_call}]}", f"SELECT s, pre, kind FROM l WHERE {_CHECK} AND s IN (SELECT s FROM l WHERE {_EXTERNAL})")
_add("wql_main_contract", "{from: main_contract, where: [{has: {block: variable, is_state_var: true, name: '^P$'}}]}", "SELECT s, pre, kind FROM v WHERE name = 'P' AND k = 0 AND rich")
_add("wql_any_contract_base", "{from: any_contract, where: [{base: '^(BUILDING|MACHINERY)$'}, {has: {block: variable, name: '^F$'}}]}", "SELECT s, pre, kind FROM v WHERE name = 'F' AND base IN ('BUILDING', 'MACHINERY')")
_add("wql_library", "{from: library, select: variable, where: [{name: '^O$'}]}", "SELECT s, pre, kind FROM v WHERE name = 'O' AND k = 1")
_add("wql_abstract", "{from: abstract, select: variable, where: [{type: 'uint.*'}]}", "SELECT s, pre, kind FROM v WHERE k = 2")
_add("wql_contract", "{from: contract, where: [{not: {has: {block: variable, name: '^P$'}}}]}", "SELECT s, 0 AS pre, 'decl.contract' AS kind FROM v WHERE k = 0 AND s NOT IN (SELECT s FROM v WHERE name = 'P')")

# Branches of or: each may find a place of its own in a scope.
_add("wql_query_or", "{from: function, or: [{select: guard}, {select: state_write}]}", "SELECT 0 AS s, 0 AS pre, '' AS kind")
ORACLES["wql_query_or"] = f"{_SQL} SELECT s AS scope, min(pre)::INTEGER AS place, kind FROM l WHERE {_CHECK} OR {_WRITE} GROUP BY s, kind"
