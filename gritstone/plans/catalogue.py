"""The code-query operators restated over relational tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.functions import text as fn
from gritstone.operators import compose, graph, sequence, structural
from gritstone.operators.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str):
    def add(f: Callable[[Tables], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return add


# --- scans and node predicates ---------------------------------------------------------------------------------

_MAIL = "[A-Za-z0-9._]+@[A-Za-z0-9]+[.][A-Za-z.]+"


@query(f"""WITH g AS (SELECT doc_id, text, regexp_extract_all(text, '{_MAIL}') AS m, regexp_split_to_array(text, '{_MAIL}') AS p FROM documents WHERE regexp_matches(text, '{_MAIL}')),
e AS (SELECT doc_id, text, i AS match_no, m[i] AS match, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS b FROM g, unnest(range(1, len(m) + 1)) AS u(i))
SELECT doc_id, match_no::BIGINT AS match_no, match, (length(text[1:b]) - length(replace(text[1:b], chr(10), '')) + 1)::BIGINT AS line, (length(list_last(string_split(text[1:b], chr(10)))) + 1)::BIGINT AS col, b::BIGINT AS begin_char, (b + length(match))::BIGINT AS end_char FROM e""")
def scope_source_regex(t: Tables) -> DataFrame:
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return fn.spans(t.documents.select("doc_id", "text"), "text", _MAIL).select("doc_id", big("match_no"), "match", big("line"), big("col"), F.col("begin").cast("bigint").alias("begin_char"), F.col("end").cast("bigint").alias("end_char"))


@query("""SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
WHERE event_type IN ('click', 'purchase', 'error') AND regexp_full_match(event_type, 'click|err.*') AND regexp_matches(event_type, 'c|rr') AND regexp_full_match(json_extract_string(props, '$.k'), '[1-9]')""")
def atomic_kind_name_attr(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    rows = t.events.filter(F.col("event_type").isin("click", "purchase", "error") & fn.matches("event_type", "click|err.*", whole=True) & fn.matches("event_type", "c|rr") & fn.matches(k, "[1-9]", whole=True))
    return rows.select("event_id", "user_id", "event_type", k.cast("int").alias("k"))


@query("""SELECT 'events' AS tab, CASE WHEN event_type IN ('purchase', 'signup') THEN 'state_write' WHEN event_type = 'error' THEN 'check' ELSE 'read' END AS grp, count(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT 'part', CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'size' ELSE 'grade' END, count(*) FROM part GROUP BY ALL""")
def semantic_group(t: Tables) -> DataFrame:
    e = F.when(F.col("event_type").isin("purchase", "signup"), "state_write").when(F.col("event_type") == "error", "check").otherwise("read")
    p = F.when(F.col("p_type").isin("SMALL", "MEDIUM", "LARGE"), "size").otherwise("grade")
    one = t.events.groupBy(e.alias("grp")).agg(F.count("*").alias("n")).select(F.lit("events").alias("tab"), "grp", "n")
    return one.unionByName(t.part.groupBy(p.alias("grp")).agg(F.count("*").alias("n")).select(F.lit("part").alias("tab"), "grp", "n"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE lower(trim(o_orderpriority)) IN ('1-urgent', '2-high')")
def visibility_csv(t: Tables) -> DataFrame:
    wanted = [x.strip().lower() for x in "1-URGENT, 2-High".split(",")]
    return t.orders.filter(F.lower(F.trim("o_orderpriority")).isin(wanted)).select("o_orderkey", "o_orderpriority")


# --- structure: a customer's orders and their lines as interval-labelled trees -------------------------------------

_TREE = """items AS (SELECT c_custkey AS root, -1::BIGINT AS o, -1::BIGINT AS l, 'customer' AS kind, c_mktsegment AS name, c_custkey AS key, 0.0 AS q FROM customer
 UNION ALL SELECT o_custkey, o_orderkey, -1, 'order', o_orderstatus, o_orderkey, 0.0 FROM orders
 UNION ALL SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice), 'line', l_returnflag, l_orderkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
numbered AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY o, l) - 1 AS pre FROM items),
tree AS (SELECT *, CASE kind WHEN 'customer' THEN max(pre) OVER (PARTITION BY root) WHEN 'order' THEN max(pre) OVER (PARTITION BY root, o) ELSE pre END AS post FROM numbered)"""


def _tree(t: Tables) -> DataFrame:
    zero, none = F.lit(0.0).alias("q"), F.lit(-1).cast("bigint")
    c = t.customer.select(F.col("c_custkey").alias("root"), none.alias("o"), none.alias("l"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("key"), zero)
    o = t.orders.select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("o"), none.alias("l"), F.lit("order").alias("kind"), F.col("o_orderstatus").alias("name"), F.col("o_orderkey").alias("key"), zero)
    place = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).cast("bigint")
    lines = t.orders.select("o_orderkey", "o_custkey").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    i = lines.select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("o"), place.alias("l"), F.lit("line").alias("kind"), F.col("l_returnflag").alias("name"), F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("q"))
    n = structural.interval_tree(c.unionByName(o).unionByName(i), "root", ["o", "l"])
    # Rows of one tree lie together already: both windows reuse that.
    post = F.when(F.col("kind") == "customer", F.max("pre").over(Window.partitionBy("root"))).when(F.col("kind") == "order", F.max("pre").over(Window.partitionBy("root", "o"))).otherwise(F.col("pre"))
    return n.withColumn("post", post)


@query(f"WITH {_TREE} SELECT a.root, a.key, a.pre::BIGINT AS pre FROM tree a WHERE a.kind = 'order' AND EXISTS (SELECT 1 FROM tree d WHERE d.root = a.root AND d.pre > a.pre AND d.pre <= a.post AND d.kind = 'line' AND d.name = 'R' AND d.q > 45)")
def has_descendant(t: Tables) -> DataFrame:
    n = _tree(t)
    found = structural.has(F.expr("kind = 'line' and name = 'R' and q > 45"))
    return n.withColumn("found", found).filter("kind = 'order' and found").select("root", "key", F.col("pre").cast("bigint").alias("pre"))


@query(f"WITH {_TREE} SELECT d.root, d.key, d.pre::BIGINT AS pre FROM tree d WHERE d.kind = 'line' AND d.q > 40 AND EXISTS (SELECT 1 FROM tree a WHERE d.root = a.root AND d.pre > a.pre AND d.pre <= a.post AND a.kind = 'order' AND a.name = 'F') AND EXISTS (SELECT 1 FROM tree a WHERE d.root = a.root AND d.pre > a.pre AND d.pre <= a.post AND a.kind = 'customer' AND a.name = 'BUILDING')")
def in_ancestor(t: Tables) -> DataFrame:
    n = _tree(t)
    held = n.withColumn("of_f", structural.inside(F.expr("kind = 'order' and name = 'F'"))).withColumn("of_b", structural.inside(F.expr("kind = 'customer' and name = 'BUILDING'")))
    return held.filter("kind = 'line' and q > 40 and of_f and of_b").select("root", "key", F.col("pre").cast("bigint").alias("pre"))


@query(f"WITH {_TREE} SELECT a.root, min(d.pre)::BIGINT AS first_pre, arg_min(d.key, d.pre) AS first_order FROM tree a JOIN tree d ON d.root = a.root AND d.pre > a.pre AND d.pre <= a.post WHERE a.kind = 'customer' AND d.kind = 'line' AND d.q >= 50 GROUP BY a.root")
def first_match_anchor(t: Tables) -> DataFrame:
    n = _tree(t)
    got = structural.first_descendant(n.filter("kind = 'customer'").select("root", "pre", "post"), n.filter("kind = 'line' and q >= 50").select("root", "pre", "key"), ["root"], ["pre", "key"])
    return got.select("root", F.col("hit_pre").cast("bigint").alias("first_pre"), F.col("hit_key").alias("first_order"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def not_has(t: Tables) -> DataFrame:
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'")
    return t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1 AND l_quantity > 25) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 2 AND l_returnflag = 'N')")
def child_left_right(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("o_orderkey", F.col("l_orderkey"))
    left = structural.child_at(t.orders.select("o_orderkey"), lines.filter("l_quantity > 25"), "o_orderkey", F.col("l_linenumber") == 1)
    return structural.child_at(left, lines.filter("l_returnflag = 'N'"), "o_orderkey", F.col("l_linenumber") == 2)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3 AND l_discount >= 0.05)")
def arg_n(t: Tables) -> DataFrame:
    return structural.child_at(t.orders.select("o_orderkey", "o_custkey"), t.lineitem.withColumn("o_orderkey", F.col("l_orderkey")).filter("l_discount >= 0.05"), "o_orderkey", F.col("l_linenumber") == 3)


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)")
def arg_any(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("o_orderkey", F.col("l_orderkey"))
    return structural.any_child(t.orders.select("o_orderkey"), lines.filter("l_returnflag = 'R'"), lines.filter("l_quantity > 48"), key="o_orderkey")


@query("""SELECT DISTINCT a.l_orderkey, a.l_linenumber, a.l_partkey FROM lineitem a WHERE a.l_quantity >= 49 AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber <> a.l_linenumber AND b.l_returnflag = 'R' AND b.l_tax > 0.06)""")
def statement_has(t: Tables) -> DataFrame:
    other = t.lineitem.filter("l_returnflag = 'R' and l_tax > 0.06").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("n"))
    return t.lineitem.filter("l_quantity >= 49").join(other, (F.col("l_orderkey") == F.col("g")) & (F.col("l_linenumber") != F.col("n")), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey").distinct()


# --- composition ------------------------------------------------------------------------------------------------

@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 200 UNION SELECT user_id FROM events WHERE event_type = 'error' AND value > 300")
def any_union(t: Tables) -> DataFrame:
    return compose.any_of(t.events.filter("event_type = 'purchase' and value > 200").select("user_id"), t.events.filter("event_type = 'error' and value > 300").select("user_id"))


@query("""WITH a AS (SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS b1 FROM conversations WHERE role = 'user' AND length(text) > 200 GROUP BY 1), b AS (SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS b2 FROM conversations WHERE role = 'assistant' AND length(text) > 1000 GROUP BY 1)
SELECT conv_id, b1, b2 FROM a JOIN b USING (conv_id)""")
def and_same_scope(t: Tables) -> DataFrame:
    return compose.all_in_scope("conv_id", t.conversations.filter("role = 'user' and length(text) > 200"), t.conversations.filter("role = 'assistant' and length(text) > 1000"), item="turn")


@query("""WITH b AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id, 1 AS branch FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER), event_id, 2 FROM events WHERE event_type IN ('view', 'error'))
SELECT user_id, k, event_id, branch FROM b QUALIFY branch = min(branch) OVER (PARTITION BY user_id, k)""")
def or_branch_dedupe(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_id", "event_type")
    rows = e.filter("event_type in ('click', 'view')").withColumn("branch", F.lit(1)).unionByName(e.filter("event_type in ('view', 'error')").withColumn("branch", F.lit(2)))
    return compose.first_branch(rows, ["user_id", "k"], "branch").select("user_id", "k", "event_id", "branch")


# --- sequences --------------------------------------------------------------------------------------------------

@query("""WITH a AS (SELECT user_id, min((ts, event_id)) AS x FROM events WHERE event_type = 'error' GROUP BY 1), b AS (SELECT e.user_id, any_value(a.x) AS x, min((e.ts, e.event_id)) AS y FROM events e JOIN a ON e.user_id = a.user_id WHERE event_type = 'purchase' AND (e.ts, e.event_id) > a.x GROUP BY 1)
SELECT user_id, x[2] AS s1_event_id, y[2] AS s2_event_id FROM b""")
def sequence_2(t: Tables) -> DataFrame:
    return sequence.sequence(t.events, "user_id", ["ts", "event_id"], [F.col("event_type") == "error", F.col("event_type") == "purchase"]).select("user_id", "s1_event_id", "s2_event_id")


@query("""WITH a AS (SELECT user_id, min((ts, event_id)) AS x FROM events WHERE event_type = 'signup' AND value > 20 GROUP BY 1), b AS (SELECT e.user_id, any_value(a.x) AS x, min((e.ts, e.event_id)) AS y FROM events e JOIN a ON e.user_id = a.user_id WHERE event_type = 'error' AND (e.ts, e.event_id) > a.x GROUP BY 1),
c AS (SELECT e.user_id, any_value(b.x) AS x, any_value(b.y) AS y, min((e.ts, e.event_id)) AS z FROM events e JOIN b ON e.user_id = b.user_id WHERE event_type = 'purchase' AND value > 100 AND (e.ts, e.event_id) > b.y GROUP BY 1) SELECT user_id, x[2] AS s1_event_id, y[2] AS s2_event_id, z[2] AS s3_event_id FROM c""")
def sequence_3(t: Tables) -> DataFrame:
    steps = [(F.col("event_type") == "signup") & (F.col("value") > 20), F.col("event_type") == "error", (F.col("event_type") == "purchase") & (F.col("value") > 100)]
    return sequence.sequence(t.events.select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"], steps).select("user_id", "s1_event_id", "s2_event_id", "s3_event_id")


_ARM = "CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 90 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 END"


@query(f"""WITH e AS (SELECT user_id, ts, event_id, event_type, value, {_ARM} AS arm FROM events), p AS (SELECT a.user_id, min(((a.ts, a.event_id), (b.ts, b.event_id))) AS x FROM e a JOIN e b ON a.user_id = b.user_id AND (b.ts, b.event_id) > (a.ts, a.event_id) AND (a.arm IS NULL OR b.arm IS NULL OR a.arm = b.arm)
WHERE a.event_type = 'click' AND b.event_type = 'error' AND b.value > 100 GROUP BY 1) SELECT user_id, x[1][2] AS s1_event_id, x[2][2] AS s2_event_id FROM p""")
def sequence_exclusive_arm(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t.events.withColumn("arm", F.when(k < 90, k % 2))
    return sequence.sequence_on_one_path(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "click", (F.col("event_type") == "error") & (F.col("value") > 100), F.col("arm")).select("user_id", "s1_event_id", "s2_event_id")


@query("""WITH a AS (SELECT conv_id, min(turn) AS x FROM conversations WHERE role = 'user' GROUP BY 1) SELECT c.conv_id, any_value(a.x) AS s1_turn, min(c.turn) AS s2_turn FROM conversations c JOIN a USING (conv_id) WHERE c.role = 'assistant' AND c.turn > a.x GROUP BY 1""")
def sequence_turns(t: Tables) -> DataFrame:
    return sequence.sequence(t.conversations.select("conv_id", "turn", "role"), "conv_id", ["turn"], [F.col("role") == "user", F.col("role") == "assistant"])


@query("SELECT event_id, user_id FROM events p WHERE event_type = 'purchase' AND value > 150 AND EXISTS (SELECT 1 FROM events g WHERE g.user_id = p.user_id AND g.event_type = 'signup' AND (g.ts, g.event_id) < (p.ts, p.event_id))")
def guarded_by(t: Tables) -> DataFrame:
    guard = t.events.filter("event_type = 'signup'").groupBy(F.col("user_id").alias("u")).agg(F.min(F.struct("ts", "event_id")).alias("g"))
    rows = t.events.filter("event_type = 'purchase' and value > 150")
    return rows.join(guard, (F.col("user_id") == F.col("u")) & (F.col("g") < F.struct("ts", "event_id")), "left_semi").select("event_id", "user_id")


@query("SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER w AS before, lag(value) OVER w AS bound FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'purchase' AND NOT (coalesce(before, '') = 'view' AND bound >= value)")
def unchecked_guard(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.withColumn("before", F.lag("event_type").over(w)).withColumn("bound", F.lag("value").over(w))
    return rows.filter((F.col("event_type") == "purchase") & ~((F.coalesce("before", F.lit("")) == "view") & (F.col("bound") >= F.col("value")))).select("event_id", "user_id")


# --- graphs: parts that follow each other in an order call each other, parts of size 1 are entries ------------------------------------------------

_EDGES = "edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"


def _edges(t: Tables) -> DataFrame:
    a = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("src"))
    b = t.lineitem.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["k", "n"]).select("src", "dst").distinct()


@query(f"""WITH RECURSIVE {_EDGES}, walk(origin, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_size = 1 UNION SELECT w.origin, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 10)
SELECT origin, node, min(depth)::INTEGER AS depth FROM walk GROUP BY 1, 2""")
def closure_bfs(t: Tables) -> DataFrame:
    seeds = t.part.filter("p_size = 1").select(F.col("p_partkey").alias("origin"), F.col("p_partkey").alias("node"))
    return graph.reach(_edges(t), seeds, 10)


@query(f"""WITH RECURSIVE {_EDGES}, walk(node, depth) AS (SELECT min(p_partkey), 0 FROM part UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 10) SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY 1""")
def call_chain_depth(t: Tables) -> DataFrame:
    return graph.reached(graph.cut(_edges(t)), t.part.agg(F.min("p_partkey").alias("node")), 10)


_NEXT = "step AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events), edges AS (SELECT DISTINCT src, dst FROM step WHERE dst IS NOT NULL AND after > value)"


@query(f"WITH RECURSIVE {_NEXT}, walk(origin, node) AS (SELECT src, dst FROM edges UNION SELECT w.origin, e.dst FROM walk w JOIN edges e ON e.src = w.node) SELECT DISTINCT node FROM walk WHERE origin = node")
def has_cycle(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = t.events.select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), "value", F.lead("value").over(w).alias("after"))
    return graph.in_cycle(step.filter("dst is not null and after > value").select("src", "dst").distinct())


@query(f"""WITH RECURSIVE {_EDGES}, f(node) AS (SELECT p_partkey FROM part WHERE p_size = 1 UNION SELECT e.dst FROM f JOIN edges e ON e.src = f.node), b(node) AS (SELECT p_partkey FROM part WHERE p_size = 50 UNION SELECT e.src FROM b JOIN edges e ON e.dst = b.node)
SELECT src, dst FROM edges WHERE src IN (SELECT node FROM f) AND dst IN (SELECT node FROM b)""")
def entry_to_target_paths(t: Tables) -> DataFrame:
    node = F.col("p_partkey").alias("node")
    return graph.on_paths(graph.cut(_edges(t)), t.part.filter("p_size = 1").select(node), t.part.filter("p_size = 50").select(node))


@query(f"WITH {_EDGES} SELECT p_partkey, coalesce(o.n, 0)::BIGINT AS callees, coalesce(i.n, 0)::BIGINT AS callers FROM part LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) o ON o.src = p_partkey LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) i ON i.dst = p_partkey")
def callers_callees(t: Tables) -> DataFrame:
    e = _edges(t)
    out, into = e.groupBy(F.col("src").alias("p_partkey")).agg(F.count("*").alias("o")), e.groupBy(F.col("dst").alias("p_partkey")).agg(F.count("*").alias("i"))
    return t.part.select("p_partkey").join(out, "p_partkey", "left").join(into, "p_partkey", "left").select("p_partkey", F.coalesce("o", F.lit(0)).cast("bigint").alias("callees"), F.coalesce("i", F.lit(0)).cast("bigint").alias("callers"))


@query(f"WITH {_EDGES} SELECT src, dst FROM edges WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = dst AND p_brand = 'Brand#13')")
def resolved_target_semi(t: Tables) -> DataFrame:
    return _edges(t).join(t.part.filter("p_brand = 'Brand#13'"), F.col("dst") == F.col("p_partkey"), "left_semi")


@query("SELECT l_orderkey, l_linenumber, p_brand AS taint, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 5 GROUP BY ALL")
def taint_binding(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part.filter("p_size <= 5"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "l_linenumber", F.col("p_brand").alias("taint")).agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_EDGES}, mark(node, label) AS (SELECT p_partkey, p_type FROM part WHERE p_size = 1 UNION SELECT e.dst, m.label FROM mark m JOIN edges e ON e.src = m.node) SELECT node, label FROM mark""")
def taint_fixpoint(t: Tables) -> DataFrame:
    return graph.propagate(graph.cut(_edges(t)), t.part.filter("p_size = 1").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("label")))


# --- inheritance and declarations -----------------------------------------------------------------------------------

@query("""SELECT p_name, p_type, p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_type ORDER BY p_size DESC, p_partkey) = 1""")
def mro_first_wins(t: Tables) -> DataFrame:
    return compose.first_wins(t.part, ["p_name", "p_type"], F.desc("p_size"), "p_partkey").select("p_name", "p_type", "p_partkey", "p_brand")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def main_not_inherited(t: Tables) -> DataFrame:
    inherited = t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey")
    mains = t.orders.join(inherited, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey", "o_totalprice")
    return ordered(mains, F.desc("o_totalprice"), F.asc("o_orderkey"), name="place")


@query("SELECT s_nationkey, p_type, arg_min(s_suppkey, (-s_acctbal, s_suppkey)) AS implementation FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def interface_implementation(t: Tables) -> DataFrame:
    pairs = t.lineitem.select("l_suppkey", "l_partkey").join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_type").distinct()
    rows = pairs.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("s_nationkey", "p_type").agg(F.min_by("s_suppkey", F.struct(-F.col("s_acctbal"), "s_suppkey")).alias("implementation"))


@query("""WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), b AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def set_diff_added_removed(t: Tables) -> DataFrame:
    cut = F.lit("1998-01-01").cast("timestamp")
    return compose.difference(t.orders.filter(F.col("o_orderdate") < cut), t.orders.filter(F.col("o_orderdate") >= cut), ["o_custkey", "o_orderpriority"])


@query(f"""WITH RECURSIVE {_EDGES}, entries AS (SELECT p_partkey FROM part WHERE p_size = 1), walk(origin, node) AS (SELECT p_partkey, p_partkey FROM entries UNION SELECT w.origin, e.dst FROM walk w JOIN edges e ON e.src = w.node),
writes AS (SELECT p_partkey AS writer, p_brand AS var FROM part WHERE p_size = 50) SELECT var, count(DISTINCT writer) AS writers, count(DISTINCT origin) AS entries, string_agg(DISTINCT origin::VARCHAR, ',' ORDER BY origin::VARCHAR) AS entry_list FROM writes JOIN walk ON node = writer GROUP BY 1""")
def state_matrix(t: Tables) -> DataFrame:
    seeds = t.part.filter("p_size = 1").select(F.col("p_partkey").alias("origin"), F.col("p_partkey").alias("node"))
    writes = t.part.filter("p_size = 50").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("var"))
    # An entry writes a variable if it reaches any of its writers: their sets are joined before any entry is spelled out.
    sets = graph.reach_sets(_edges(t), seeds)
    got = stored(sets.whole.join(writes, "node"), "writers")
    entries = sets.spelled(got.groupBy("var", "block").agg(*[F.bit_or(f"s{j}").alias(f"n{j}") for j in range(sets.words)]), "var")
    listed = entries.groupBy("var").agg(F.count("origin").alias("entries"), F.array_join(F.array_sort(F.collect_list(F.col("origin").cast("string"))), ",").alias("entry_list"))
    writers = got.groupBy(F.col("var").alias("__var")).agg(F.count_distinct("node").alias("writers"))
    return listed.join(writers, F.col("var").eqNullSafe(F.col("__var"))).select("var", "writers", "entries", "entry_list")


# --- reports: events as findings, their type as the query that found them ---------------------------------------------

_SEVERITY = "CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'MEDIUM' WHEN 'click' THEN 'LOW' ELSE 'INFO' END"


def _findings(t: Tables) -> DataFrame:
    return t.events.withColumn("severity", F.expr(_SEVERITY))


def ordered(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """A total order as a column of ranks, without one task that sorts all: rows are sorted by ranges, and each range's rows shifted by those of the ranges before."""
    laid = graph.cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i")))
    at = Window.partitionBy("__p").orderBy("__i")
    sizes = laid.groupBy("__p").agg(F.count("*").alias("__c"))
    before = sizes.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__b"))  # one row a partition
    return laid.withColumn("__r", F.row_number().over(at)).join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + F.col("__r")).drop("__p", "__i", "__c", "__b", "__r")


@query("SELECT (SELECT count(*) FROM customer) AS contracts, (SELECT count(*) FROM orders) AS functions, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS entries, (SELECT count(*) FROM lineitem) AS nodes, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS kinds")
def db_stats(t: Tables) -> DataFrame:
    one = t.orders.agg(F.count("*").alias("functions"), F.count_if(F.col("o_orderstatus") == "O").alias("entries"))
    return t.customer.agg(F.count("*").alias("contracts")).crossJoin(one).crossJoin(t.lineitem.agg(F.count("*").alias("nodes"), F.count_distinct("l_partkey").alias("kinds")))


@query(f"SELECT {_SEVERITY} AS severity, count(*) AS n FROM events GROUP BY 1")
def severity_counts(t: Tables) -> DataFrame:
    return _findings(t).groupBy("severity").agg(F.count("*").alias("n"))


@query(f"SELECT {_SEVERITY} AS severity, event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, count(DISTINCT user_id) AS scopes FROM events GROUP BY 1, 2")
def group_findings(t: Tables) -> DataFrame:
    return _findings(t).groupBy("severity", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count_distinct("user_id").alias("scopes"))


@query("SELECT user_id, count(DISTINCT event_type) AS issues FROM events GROUP BY 1")
def unique_issues(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count_distinct("event_type").alias("issues"))


@query("SELECT event_id, user_id, row_number() OVER (ORDER BY user_id, ts, event_type, event_id) AS place FROM events")
def findings_total_order(t: Tables) -> DataFrame:
    return ordered(t.events.select("event_id", "user_id", "ts", "event_type"), "user_id", "ts", "event_type", "event_id").select("event_id", "user_id", "place")


@query(f"SELECT event_id, {_SEVERITY} AS severity FROM events WHERE {_SEVERITY} IN ('CRITICAL', 'HIGH', 'MEDIUM')")
def severity_filter_rank(t: Tables) -> DataFrame:
    return _findings(t).filter(compose.severity_rank("severity") <= compose.SEVERITIES.index("MEDIUM")).select("event_id", "severity")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand GLOB 'Brand#1*' AND NOT p_brand GLOB 'Brand#1?'")
def template_glob_filter(t: Tables) -> DataFrame:
    return t.part.filter(compose.glob("p_brand", "Brand#1*") & ~compose.glob("p_brand", "Brand#1?")).select("p_partkey", "p_brand")


_VERSION = "concat('pragma ^', p_size % 3, '.', p_size % 9, '.', p_partkey % 30)"


@query("SELECT p_partkey FROM part WHERE (p_size % 3, p_size % 9, p_partkey % 30) < (0, 8, 0)")
def version_compare(t: Tables) -> DataFrame:
    return t.part.filter(fn.version_holds(F.expr(_VERSION), "<0.8.0")).select("p_partkey")


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*$') AND NOT regexp_matches(x, '^\\s*(//|/\\*|\\*)')))::BIGINT AS nsloc, len(string_split(text, chr(10)))::BIGINT AS lines FROM documents")
def nsloc(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.code_lines("text").cast("bigint").alias("nsloc"), F.size(F.split("text", "\n")).cast("bigint").alias("lines"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS excerpt FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def code_excerpt(t: Tables) -> DataFrame:
    lines = F.split("text", "\n")
    return t.documents.filter(F.size(lines) >= 2).select("doc_id", F.array_join(F.slice(lines, 2, 3), "\n").alias("excerpt"))


@query("SELECT lang, source, count(*) AS files, count(DISTINCT sha256(text)) AS checksums, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL")
def source_files_summary(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("files"), F.count_distinct(F.sha2("text", 256)).alias("checksums"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.length("text")).alias("chars"))


@query("SELECT user_id, event_type, count(*) > 0 AS present, bool_or(value > 400) AS incomplete, count(*) AS n FROM events GROUP BY ALL")
def diagnostics_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg((F.count("*") > 0).alias("present"), F.bool_or(F.col("value") > 400).alias("incomplete"), F.count("*").alias("n"))


@query("SELECT DISTINCT user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def diagnostics_dedupe(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).distinct()
