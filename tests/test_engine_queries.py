import pytest
from compare import assert_same

from gritstone.plans import engine_queries as eq
from gritstone.wql.evaluate import Engine
from gritstone.wql.scan import scan


@pytest.fixture(scope="module")
def trees(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("trees") / "trees")
    eq.trees(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def found(trees):
    """All templates in one pass."""
    findings = scan(eq.database(trees), list(eq.TEMPLATES.values()))
    rows = findings.selectExpr(*eq.SHOWN, "template_id").toPandas().rename(columns={"template_id": "id"})
    return dict(tuple(rows.groupby("id")))


@pytest.mark.parametrize("name", list(eq.QUERIES))
def test_templates_match_sql(name, found, duck):
    assert_same(found[name].drop(columns="id"), duck.execute(eq.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["wql_arguments", "wql_contract"])
def test_queries_run_one(name, spark, sf_dir, found):
    assert_same(eq.QUERIES[name](spark, sf_dir).toPandas(), found[name].drop(columns="id"))


def test_the_relational_engine_agrees(trees, found):
    engine = Engine(eq.database(trees))
    for name in ("wql_left_right", "wql_sequence_3", "wql_not", "wql_statement_has", "wql_library"):
        assert_same(eq.shown(engine.run(eq.TEMPLATES[name])).toPandas(), found[name].drop(columns="id"))
