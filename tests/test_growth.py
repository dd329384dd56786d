"""What keeps queries in proportion to their input: small rows in shuffles, no task for a whole hot key, nothing done twice."""

import pyarrow as pa
import pytest
from compare import assert_same

from gritstone.operators import compose, graph
from gritstone.plans import engine_queries as eq
from gritstone.wql import scan
from gritstone.wql.scan import needs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_branch_of_a_site_that_most_rows_share(spark):
    """Were rows brought together by site, one task would hold all of them."""
    rows = spark.range(3000).selectExpr("if(id % 100 = 0, id, null) as file", "1 as line", "cast(id % 3 as int) as branch", "id")
    got = compose.first_branch(rows, ["file", "line"], "branch")
    assert "Window" not in plan_of(got)
    want = sorted(r.id for r in rows.collect() if r.file is not None or r.branch == 0)
    assert sorted(r.id for r in got.collect()) == want


def test_branches_of_or_walk_the_trees_once(spark, sf_dir):
    assert "MapInArrow" not in plan_of(eq.QUERIES["wql_query_or"](spark, sf_dir))


@pytest.mark.parametrize("name", list(eq.QUERIES))
def test_each_template_reads_what_it_needs(name, spark, sf_dir, duck):
    got = eq.QUERIES[name](spark, sf_dir)
    assert "Window" not in plan_of(got) and "collect_list(nodes" not in plan_of(got)
    assert_same(got.toPandas(), duck.execute(eq.ORACLES[name]).df())


def test_nodes_have_the_fields_that_a_template_reads(spark, sf_dir):
    held = lambda name: set(eq.trees(spark, sf_dir, needs([eq.TEMPLATES[name]], ("line", "primary_kind"))).schema["nodes"].dataType.elementType.names)
    assert held("wql_attribute") == {"inst", "pre", "kind", "attrs", "line"}
    assert held("wql_state_write") == {"inst", "pre", "kind", "line", "target", "parent", "child_idx", "name", "value", "attrs"}
    assert held("wql_query_or") == {"inst", "pre", "kind", "line", "target", "file", "begin_byte", "end_byte"}
    assert {"taints", "arms", "arg_idx"} < held("wql_sequence_3")


def test_reach_carries_many_origins_in_a_row(spark, monkeypatch):
    """300 origins that share a chain: more than a block, and an edge carries a block at a time. Null is a node that leads nowhere."""
    tables, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: tables.append((name, stored(df, name))) or tables[-1][1])
    edges = spark.createDataFrame([(i, 1000) for i in range(300)] + [(1000 + i, 1001 + i) for i in range(11)] + [(1003, None), (None, 5), (1002, 1000)], "src long, dst long")
    seeds = spark.createDataFrame([(i, i) for i in range(300)] + [(None, None), (7, 8)], "origin long, node long")
    got = sorted(((r.origin, r.node, r.depth) for r in graph.reach(edges, seeds).collect()), key=str)
    want = {(o, 1000 + i): 1 + i for o in range(300) for i in range(12)} | {(o, o): 0 for o in range(300)} | {(o, None): 5 for o in range(300)} | {(7, 8): 0, (None, None): 0}
    assert got == sorted(((*k, d) for k, d in want.items()), key=str)
    assert max(df.count() for name, df in tables if name == "reached") < 700
    assert sorted({r.depth for r in graph.reach(edges, seeds, 3).collect()}) == [0, 1, 2, 3]
    assert graph.reach(edges, seeds.limit(0)).count() == 0


def test_rules_without_a_kind_look_at_what_their_branches_name():
    """Of all nodes of a scope, each of which was asked for every branch before."""
    kinds = ["decl.function", "stmt.assign", "expr.identifier", "expr.literal", "expr.binary_op"]
    batch = pa.RecordBatch.from_pydict({"nodes_pre": [[0, 1, 2, 3, 4]], "nodes_inst": [[0] * 5], "nodes_kind": [kinds], "nodes_target": [[None, "bal", None, None, None]]})
    tree = scan.Tree(scan.Columns(batch, "nodes", ["inst", "kind", "pre", "target"]), 0, [])
    rule = {"any": [[{"kind": "stmt.assign"}, {"kind": "expr.binary_op"}]]}
    assert list(tree.candidates(rule)) == tree.matches(rule) == [1, 4]
    assert tree.matches({"any": [[{"kind": "state_write"}, {"not": [{"kind": "expr.literal"}]}]]}) == [0, 1, 2, 4]
    assert list(tree.candidates({"any": [[{"kind": "stmt.assign"}, {"name": "a"}], [{"kind": "expr.literal"}]]})) == [3]
