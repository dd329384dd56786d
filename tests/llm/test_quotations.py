import random

from compare import assert_same

from gritstone.llm import quotations as q

SCHEMA = "conv_id long, turn long, role string, text string, level int, source int, run int"
ROWS = [
    (1, 0, "user", "Hello there.\nHow are you?\n\nSecond  paragraph here."),
    (1, 1, "assistant", "> How are you?\nFine, thanks."),
    (1, 2, "user", "> Second paragraph\n> here.\nThat one."),
    (1, 3, "assistant", ">> How are you?\n> Fine, thanks.\n\nGlad.\n\n\n\nBye"),
    (1, 4, "user", "> unknown text\n  \nwhat"),
    (1, 5, "user", None),
    (1, 6, "user", "> > How are you?\nStill"),
    (2, 3, None, ">x"),
    (2, 4, "u", "Que\r\n> x\r\nZ"),
    (2, 4, "u", "Que\r\n> x\r\nZ"),
    (None, 1, "u", "t"),
    (3, None, "u", "t"),
    (4, 1, "u", ""),
    (5, 1, "u", "a b c\n" * 20_000),
    (5, 2, "u", "> A B  c\nyes"),
    (5, 3, "u", "Same"),
    (5, 4, "u", "Same"),
    (5, 5, "u", "> same\nlatest"),
    (6, 0, "u", "First line here.\nSecond line here.\nThird line here.\n\nNext paragraph\nof two lines."),
    (6, 1, "a", "Something else.\nYes."),
    (6, 2, "u", "Ann wrote:\n> Second line here.\n> Third line here.\nTrimmed quote."),
    (6, 3, "a", "> Third line here.\n> Next paragraph\n> of two lines.\nAcross paragraphs."),
    (6, 4, "u", "> something else.\n> never said\nPartly known."),
    (6, 5, "a", "He wrote:\n\n> Yes.\nKept, not right before the quote."),
]


def frame(spark):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in ROWS], SCHEMA)


def test_links_and_order(spark):
    got = {(r.conv_id, r.turn): r for r in q.conversations(frame(spark)).collect()}
    parents = {k: r.parent_turn for k, r in got.items()}
    assert parents[1, 1] == 0 and parents[1, 2] == 0 and parents[1, 3] == 1 and parents[1, 4] == 3 and parents[1, 6] == 0
    assert parents[5, 2] == 1 and parents[5, 5] == 4 and parents[1, 0] is None
    assert got[1, 3].text == "Glad.\n\nBye" and got[1, 3].quoted_links == 2
    assert got[1, 4].text == "what" and got[1, 4].quoted_links == 0
    assert got[2, 3].text == "" and got[2, 3].role is None and got[1, 5].text == ""
    order = sorted((r.position, r.turn, r.depth) for k, r in got.items() if k[0] == 1)
    assert [(t, d) for _, t, d in order] == [(0, 0), (1, 1), (3, 2), (4, 3), (5, 4), (2, 1), (6, 1)]
    assert parents[6, 2] == 0 and parents[6, 3] == 0 and parents[6, 4] == 1 and parents[6, 5] == 1
    assert got[6, 2].text == "Trimmed quote." and got[6, 2].quoted_links == 2 and got[6, 3].quoted_links == 3 and got[6, 4].quoted_links == 1
    assert got[6, 5].text.startswith("He wrote:")
    assert len(got) == 21


def test_matches_sql(spark, duck, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "c"))
    assert_same(q.conversations(frame(spark)).toPandas(), duck.execute(q.ORACLE.replace("FROM conversations", f"FROM '{tmp_path}/c/*.parquet'")).df())


def test_table_matches_sql(spark, sf_dir, duck):
    assert_same(q.query(spark, sf_dir).toPandas(), duck.execute(q.ORACLE).df())


def test_empty(spark):
    assert q.conversations(frame(spark).filter("false")).count() == 0


def test_long_conversations_are_ranked_alike(spark):
    want, got = (sorted(map(tuple, q.conversations(frame(spark), listed=n).collect()), key=repr) for n in (q.LISTED, 2))
    assert got == want


def test_order_by_doubling_equals_the_walk(spark):
    r = random.Random(6)
    rows = [(c, t, None if t == 0 else r.randrange(max(0, t - 5), t)) for c in range(4) for t in range(60)]
    trees = spark.createDataFrame(rows, "conv_id long, turn long, parent_turn long")
    got = {(x.conv_id, x.turn): (x.position, x.depth) for x in q.order_ranked(trees).collect()}
    want = {(c, t): (p, d) for c in range(4) for t, p, d in q.reply_order([x[1] for x in rows if x[0] == c], [x[2] for x in rows if x[0] == c])}
    assert got == want


def test_deep_reply_chain(spark):
    rows = [(1, i, "u", f"line {i}" if i == 0 else f"> line {i - 1}\nline {i}") for i in range(1500)]
    got = q.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got.filter("depth = turn and position = turn").count() == 1500
