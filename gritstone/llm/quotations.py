"""Chat formatting by quotation linking: quoted passages lead to the messages they come from, and conversations are
put into reply order without their quotes.

A line's quote level is the number of ``>`` before its text. Lines of one level that follow each other without a
blank line between are a passage; its text, with white space joined and capitals folded, is hashed. A quoted
passage belongs to the last earlier message of its conversation whose own (unquoted) words contain that passage as
a whole body, a paragraph or a line. Of a passage of several lines that no message has as a whole each line is
looked for alone, so trimmed quotes link too. A message replies to the message that its outermost linked quotes come
from: the lowest level counts first, then the most characters, then the later message. A message that
quotes nothing known replies to the one before it. Conversations are then listed depth first, replies in order
of turn. A line that ends in "wrote:" right before a quote introduces it and goes with it.

Lines are parsed and hashed where their message lies; only numbers are shuffled. The link is an as-of match: own and
quoted hashes of a conversation lie in one window by turn, so each quote finds its source without pairing it with
every message that has the passage. Messages of a conversation of at most ``LISTED`` are put in order together;
a longer one is ranked by pointer doubling over its tour, so no task holds a conversation of any size.

Defined cases. Rows without a conv_id or turn are left out; rows that repeat (conv_id, turn) are one message, the
first by role and text. A null text is an empty message, and a message of nothing but quotes an empty one in the
result. A null role stays null. The first message of a conversation has no parent. Quotes that match nothing are
removed all the same. Other columns than the four aren't read. No rows in, no rows out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.llm.common import BROADCAST_BYTES, arrow_batches, small_side, stored, stored_bytes, table

#: Messages of a conversation up to which it is put in order as one row.
LISTED = 100_000
_MARKS = re.compile(r"[ \t]*(?:>[ \t]?)*")
_WROTE = re.compile(r"wrote:[ \t]*$", re.IGNORECASE)
_SPACE, _GAPS = re.compile("[ \t\n]+"), re.compile("\n[ \t]*(?:\n[ \t]*)+")


def _normal(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ").lower()


def _hash(words: str) -> int:
    n = xxhash.xxh3_64_intdigest(words.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


def lines_of(text: str) -> list[tuple[int, str]]:
    """(level, body) of each line that introduces no quote."""
    out = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        marks = _MARKS.match(line)[0]
        level = marks.count(">")
        if level and out and out[-1][0] == 0 and _WROTE.search(out[-1][1]):
            out[-1] = (-1, "")
        out.append((level, line[len(marks) :] if level else line))
    return [x for x in out if x[0] >= 0]


def passages(lines: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """(level, lines) of each run of lines of one level without a blank one."""
    out, open_ = [], False
    for level, body in lines:
        if not body.strip(" \t"):
            open_ = False
        elif open_ and out[-1][0] == level:
            out[-1][1].append(body)
        else:
            out.append((level, [body]))
            open_ = True
    return out


def parse(text: str, own: bool = True) -> tuple[str, list[int], list[tuple[int, int, int, int, int]]]:
    """The text without quotes, the hashes of what it says itself, and its quoted units (passage, whole, level, hash, chars)."""
    quoting = re.search(r"(?:^|[\r\n])[ \t]*>", text) is not None
    if not (quoting or own):
        return text, [], []
    lines = lines_of(text)
    parts = passages(lines)
    body = "\n".join(b for level, b in lines if level == 0)
    said = {_normal(body), *(_normal("\n".join(p)) for level, p in parts if level == 0), *(_normal(b) for level, b in lines if level == 0)} - {""}
    units = []
    for i, (level, p) in enumerate(x for x in parts if x[0] > 0):
        whole = [(1, _normal("\n".join(p)))] + ([(0, _normal(b)) for b in p] if len(p) > 1 else [])
        units.extend((i, w, level, _hash(words), len(words)) for w, words in whole if words)
    clean = _GAPS.sub("\n\n", body).strip(" ").strip("\n") if quoting else text
    return clean, sorted(map(_hash, said)) if own else [], units


_UNIT = "struct<passage:int,whole:int,level:int,hash:bigint,chars:int>"
_UNIT_TYPE = pa.struct([("passage", pa.int32()), ("whole", pa.int32()), ("level", pa.int32()), ("hash", pa.int64()), ("chars", pa.int32())])


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, own, quotes of each message, stored; own only where a message of the conversation quotes."""
    rows = messages.filter("conv_id is not null and turn is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = ["conv_id", "turn"]
    again = stored(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys), "repeated")
    if not again.isEmpty():
        again = small_side(again)
        one = rows.join(again, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct("role", "text")).alias("x")).select(*keys, "x.role", "x.text")
        rows = rows.join(again, keys, "left_anti").unionByName(one)
    quoting = stored(rows.filter(F.col("text").rlike(r"(^|[\r\n])[ \t]*>")).select("conv_id").distinct(), "quoting")
    if stored_bytes(quoting) * 4 <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(quoting.withColumn("own", F.lit(True))), "conv_id", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    else:  # too many conversations to tell apart without a shuffle of texts: all are hashed
        rows = rows.withColumn("own", F.lit(True))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [parse(t, o) for t, o in zip(batch.column("text").to_pylist(), batch.column("own").to_pylist(), strict=True)]
            units = pa.array([[dict(zip(("passage", "whole", "level", "hash", "chars"), u, strict=True)) for u in x[2]] for x in out], pa.list_(_UNIT_TYPE))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role")), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.int64())), units], ["conv_id", "turn", "role", "text", "own", "quotes"])

    return stored(arrow_batches(rows.select("conv_id", "turn", "role", "text", "own"), read, f"conv_id bigint, turn bigint, role string, text string, own array<bigint>, quotes array<{_UNIT}>"), "parsed")


def replies(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn (null for the first message), quoted_links of ``parsed`` messages."""
    keys = ["conv_id", "turn"]
    # A conversation without a quote has nothing to link: no hash of it is shuffled.
    quoting = stored(messages.filter(F.size("quotes") > 0).select("conv_id").distinct(), "linking")
    scope = messages.select(*keys, "own", "quotes").join(small_side(quoting), "conv_id", "left_semi")
    none = F.lit(None).cast("int")
    sources = scope.select(*keys, F.explode("own").alias("hash"), none.alias("passage"), none.alias("whole"), none.alias("level"), none.alias("chars"))
    quotes = scope.select(*keys, F.explode("quotes").alias("q")).select(*keys, "q.hash", "q.passage", "q.whole", "q.level", "q.chars")
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = sources.union(quotes).withColumn("source", F.max(F.when(F.col("level").isNull(), F.col("turn"))).over(before)).filter("level is not null and source is not null")
    # From here on all is by message: one shuffle serves the window and both groupings.
    best = F.max("whole").over(Window.partitionBy(*keys, "passage"))
    kept = found.repartition(*keys).withColumn("best", best).filter("whole = best")
    votes = kept.groupBy(*keys, "source", "level").agg(F.sum("chars").alias("chars"), F.count("*").alias("links"))
    parent = votes.groupBy(*keys).agg(F.max(F.struct((-F.col("level")).alias("level"), "chars", "source")).alias("x"), F.sum("links").alias("quoted_links")).select(*keys, "x.source", "quoted_links")
    previous = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return messages.select(*keys).withColumn("previous", previous).join(parent, keys, "left").select(*keys, F.coalesce("source", "previous").alias("parent_turn"), F.coalesce("quoted_links", F.lit(0).cast("bigint")).alias("quoted_links"))


def reply_order(turns: list[int], parents: list[int | None]) -> Iterator[tuple[int, int, int]]:
    """(turn, depth-first place, depth) of one conversation's messages, without recursion."""
    children: dict[int | None, list[int]] = {}
    for turn, parent in zip(turns, parents, strict=True):
        children.setdefault(parent, []).append(turn)
    stack, place = [(t, 0) for t in sorted(children.get(None, []), reverse=True)], 0
    while stack:
        turn, depth = stack.pop()
        yield turn, place, depth
        place += 1
        stack.extend((t, depth + 1) for t in sorted(children.get(turn, []), reverse=True))


def order_listed(trees: DataFrame) -> DataFrame:
    """conv_id, turn, position, depth of (conv_id, turn, parent_turn), each conversation as one row, many in a batch."""

    def order_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, members in zip(batch.column("conv_id").to_pylist(), batch.column("m").to_pylist(), strict=True):
                out.extend((conv, *x) for x in reply_order([m["turn"] for m in members], [m["parent_turn"] for m in members]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["conv_id", "turn", "position", "depth"])

    lists = trees.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "parent_turn")).alias("m"))
    return arrow_batches(lists, order_of, "conv_id bigint, turn bigint, position bigint, depth int")


def order_ranked(trees: DataFrame) -> DataFrame:
    """The same for conversations of any size: every message is entered and left once on the tour of its tree; pointer doubling sums, from
    each step to the tour's end, the messages still to come and the levels still to leave."""
    siblings = Window.partitionBy("conv_id", "parent_turn").orderBy("turn")
    nodes = stored(trees.withColumn("after", F.lead("turn").over(siblings)), "tour")
    first = nodes.filter("parent_turn is not null").groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("child"))
    down = nodes.join(first, ["conv_id", "turn"], "left").select("conv_id", "turn", F.lit(0).alias("up"), F.coalesce("child", "turn").alias("to"), F.col("child").isNull().cast("int").alias("to_up"), F.lit(1).cast("bigint").alias("left"), F.lit(1).alias("levels"))
    up = nodes.select("conv_id", "turn", F.lit(1).alias("up"), F.coalesce("after", "parent_turn").alias("to"), F.col("after").isNull().cast("int").alias("to_up"), F.lit(0).cast("bigint").alias("left"), F.lit(-1).alias("levels"))
    steps = stored(down.union(up), "steps")
    while not steps.filter("to is not null").isEmpty():
        ahead = steps.select("conv_id", F.col("turn").alias("to"), F.col("up").alias("to_up"), F.col("to").alias("far"), F.col("to_up").alias("far_up"), F.col("left").alias("more"), F.col("levels").alias("more_levels"))
        jumped = steps.join(ahead, ["conv_id", "to", "to_up"], "left")
        steps = stored(jumped.select("conv_id", "turn", "up", F.col("far").alias("to"), F.coalesce("far_up", "to_up").alias("to_up"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"), (F.col("levels") + F.coalesce("more_levels", F.lit(0))).alias("levels")), "steps")
    sizes = trees.groupBy("conv_id").agg(F.count("*").alias("messages"))
    return steps.filter("up = 0").join(sizes, "conv_id").select("conv_id", "turn", (F.col("messages") - F.col("left")).alias("position"), (-F.col("levels")).cast("int").alias("depth"))


def conversations(messages: DataFrame, listed: int = LISTED) -> DataFrame:
    """conv_id, position, depth, turn, parent_turn, role, text, quoted_links: every message, in reply order by position."""
    whole = parsed(messages)
    tree = stored(replies(whole), "replies")
    edges = tree.select("conv_id", "turn", "parent_turn")
    long = stored(edges.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > listed).select("conv_id"), "long")
    if long.isEmpty():
        order = order_listed(edges)
    else:
        long = small_side(long)
        order = order_listed(edges.join(long, "conv_id", "left_anti")).unionByName(order_ranked(edges.join(long, "conv_id", "left_semi")))
    keys = ["conv_id", "turn"]
    return whole.select(*keys, "role", "text").join(tree.join(order, keys), keys).select("conv_id", F.col("position").cast("int").alias("position"), "depth", "turn", "parent_turn", "role", "text", "quoted_links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


def _normal_sql(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '[ \\t\\n]+', ' ', 'g')))"


ORACLE = f"""WITH RECURSIVE msg AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, coalesce(text, '')) = 1),
quoting AS (SELECT conv_id, turn FROM msg WHERE regexp_matches(text, '(^|[\\r\\n])[ \\t]*>')),
split AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS line_no
  FROM msg WHERE conv_id IN (SELECT conv_id FROM quoting)),
marked AS (SELECT *, regexp_extract(line, '^[ \\t]*(>[ \\t]?)*') AS marks FROM split),
every AS (SELECT conv_id, turn, line_no, length(marks) - length(replace(marks, '>', '')) AS level, CASE WHEN contains(marks, '>') THEN substr(line, length(marks) + 1) ELSE line END AS body FROM marked),
lines AS (SELECT * FROM every QUALIFY NOT (level = 0 AND regexp_matches(body, '(?i)wrote:[ \\t]*$') AND coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY line_no), 0) > 0)),
cut AS (SELECT *, trim(regexp_replace(body, '[ \\t]+', ' ', 'g')) = '' AS blank FROM lines),
run0 AS (SELECT *, blank OR lag(level) OVER w IS NULL OR lag(level) OVER w <> level OR lag(blank) OVER w AS starts FROM cut WINDOW w AS (PARTITION BY conv_id, turn ORDER BY line_no)),
run1 AS (SELECT *, sum(starts::INT) OVER (PARTITION BY conv_id, turn ORDER BY line_no) AS run FROM run0),
parts AS (SELECT conv_id, turn, run, first(level) AS level, count(*) AS many, {_normal_sql("string_agg(body, chr(10) ORDER BY line_no)")} AS words FROM run1 WHERE NOT blank GROUP BY conv_id, turn, run),
own AS (SELECT conv_id, turn, string_agg(body, chr(10) ORDER BY line_no) AS words FROM lines WHERE level = 0 GROUP BY conv_id, turn),
sources AS (SELECT DISTINCT conv_id, turn, words FROM (SELECT conv_id, turn, {_normal_sql("words")} AS words FROM own UNION ALL SELECT conv_id, turn, words FROM parts WHERE level = 0 UNION ALL SELECT conv_id, turn, {_normal_sql("body")} FROM lines WHERE level = 0) WHERE words <> ''),
units AS (SELECT row_number() OVER () AS q, * FROM (SELECT conv_id, turn, run, 1 AS whole, level, words FROM parts WHERE level > 0 AND words <> ''
  UNION ALL SELECT r.conv_id, r.turn, r.run, 0, r.level, {_normal_sql("r.body")} FROM run1 r JOIN parts p ON r.conv_id = p.conv_id AND r.turn = p.turn AND r.run = p.run WHERE NOT r.blank AND r.level > 0 AND p.many > 1)),
found AS (SELECT u.q, u.conv_id, u.turn, u.run, u.whole, u.level, length(u.words) AS chars, max(s.turn) AS source FROM units u JOIN sources s ON u.conv_id = s.conv_id AND u.words = s.words AND s.turn < u.turn GROUP BY ALL),
kept AS (SELECT * FROM found QUALIFY whole = max(whole) OVER (PARTITION BY conv_id, turn, run)),
votes AS (SELECT conv_id, turn, source, level, sum(chars) AS chars, count(*) AS links FROM kept GROUP BY ALL),
parent AS (SELECT conv_id, turn, arg_max(source, (-level, chars, source)) AS source, sum(links) AS quoted_links FROM votes GROUP BY ALL),
linked AS (SELECT m.conv_id, m.turn, coalesce(p.source, lag(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn)) AS parent_turn, m.role,
  CASE WHEN q.conv_id IS NULL THEN m.text ELSE coalesce(regexp_replace(trim(regexp_replace(o.words, '\\n[ \\t]*(\\n[ \\t]*)+', chr(10) || chr(10), 'g')), '^\\n+|\\n+$', '', 'g'), '') END AS text, coalesce(p.quoted_links, 0)::BIGINT AS quoted_links
  FROM msg m LEFT JOIN parent p USING (conv_id, turn) LEFT JOIN own o USING (conv_id, turn) LEFT JOIN quoting q ON q.conv_id = m.conv_id AND q.turn = m.turn),
walk AS (SELECT conv_id, turn, 0 AS depth, [turn] AS path FROM linked WHERE parent_turn IS NULL
  UNION ALL SELECT l.conv_id, l.turn, w.depth + 1, list_append(w.path, l.turn) FROM walk w JOIN linked l ON l.conv_id = w.conv_id AND l.parent_turn = w.turn)
SELECT l.conv_id, (row_number() OVER (PARTITION BY l.conv_id ORDER BY w.path) - 1)::INTEGER AS position, w.depth::INTEGER AS depth, l.turn, l.parent_turn, l.role, l.text, l.quoted_links FROM linked l JOIN walk w ON w.conv_id = l.conv_id AND w.turn = l.turn"""
