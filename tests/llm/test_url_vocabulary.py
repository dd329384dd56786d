import re
from urllib.parse import unquote_to_bytes

import pytest
from compare import assert_same

from gritstone.llm import url_vocabulary as uv

TERMS = (*uv.STRICT, *uv.SOFT)


def by_hand(url):
    """Another way round: bytes unquoted by the standard library until they stay, and lookarounds for each term alone."""
    text = (url or "").encode("utf-8", "surrogatepass")
    while (less := unquote_to_bytes(text)) != text:
        text = less
    text = "".join(chr(b).lower() if 0 < b < 128 else " " for b in text)
    out = {}
    for i, t in enumerate(TERMS):
        n = len(re.findall(rf"(?<![a-z0-9])(?={re.escape(t)}(?![a-z0-9]))", text))
        if n:
            out[i] = n
    return out


URLS = ["https://www.cheap-pills.example.com/x", "http://cheap.example/pills", "https://farmhouse.example/cheapest", "http://a.example/bet-bet-BET?bet=1", "http://xxx.example", "xxxx", "http://spam-farm.example/spam/farm", "é-casino-poker", "", None, "%20casino%20", "casino" * 5000, "poker-" * 20000]
ENCODED = ["http://a.example/?q=free%20porn", "http://a.example/a%2Fporn%2Fb", "http://a.example/%70orn", "http://a.example/?u=%252Fporn%252F", "http://a.example/%50%4F%52%4e", "http://a.example/%C3%A9porn%ff", "100%porn", "%%70orn", "x%00porn", "a%2fcasino%26poker", "%zzporn", "poker%", "%2", "casino\npoker", "bet%0abet"]


def test_hits_and_boundaries():
    urls = URLS + ENCODED
    got = {}
    for u, t, n in zip(*uv.hits(urls, TERMS)):
        got.setdefault(int(u), {})[int(t)] = int(n)
    assert [got.get(i, {}) for i in range(len(urls))] == [by_hand(u) for u in urls]
    for u in urls:
        assert len(uv.hits([u], TERMS)[0]) == len(by_hand(u))
    assert all(TERMS.index("porn") in by_hand(u) for u in ENCODED[:9])


def test_verdicts_match_sql(spark, duck, tmp_path):
    pages = spark.createDataFrame([(i, u, "h", 1, True) for i, u in enumerate(URLS + ENCODED)] + [(None, "http://porn.example", None, None, None)] * 2, "page_id long, url string, html string, weight int, rejected boolean")
    pages.write.parquet(str(tmp_path / "p"))
    got = uv.verdicts(pages)
    assert_same(got.toPandas(), duck.execute(uv.ORACLE.replace("FROM pages", f"FROM '{tmp_path}/p/*.parquet'")).df())
    rejected = {r.url for r in got.filter("rejected").collect()}
    assert rejected == {URLS[0], URLS[1], URLS[4], URLS[6], URLS[7], "http://porn.example", *ENCODED[:10], ENCODED[13]} | {u for u in ("%zzporn",) if by_hand(u)}


def test_table_and_empty(spark, sf_dir, duck):
    assert_same(uv.query(spark, sf_dir).toPandas(), duck.execute(uv.ORACLE).df())
    assert uv.verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_parameters(spark):
    pages = spark.createDataFrame([(1, "http://a.example/one/two"), (2, "http://a.example/three")], "page_id long, url string")
    got = {r.page_id: (r.soft_terms, r.rejected, r.weight) for r in uv.verdicts(pages, strict=(), soft=("one", "two", "three"), soft_terms=2).collect()}
    assert got == {1: (2, True, 1.0), 2: (1, False, 0.5)}
    with pytest.raises(ValueError):
        uv.verdicts(pages, (), ())


def test_vocabulary_from_a_table(spark):
    rows = [("One", True, 4.0), ("two", False, None), ("two", False, 0.25), ("three", None, 3.0), (None, True, 1.0), ("", False, 1.0), ("one", False, 9.0)]
    words = spark.createDataFrame(rows, "term string, strict boolean, weight double")
    strict, soft = uv.terms_of(words)
    assert strict == {"one": 4.0} and soft == {"two": 0.5, "three": 3.0}
    pages = spark.createDataFrame([(1, "http://a.example/one/two"), (2, "http://a.example/three")], "page_id long, url string")
    assert {r.page_id: (r.rejected, r.weight) for r in uv.verdicts(pages, strict, soft).collect()} == {1: (True, 4.5), 2: (False, 3.0)}
    with pytest.raises(ValueError):
        uv.terms_of(words, most=3)
