"""URL filter by a weighted vocabulary: one Aho-Corasick pass counts strict and soft terms with boundary checks.

Percent signs are decoded until nothing changes, so a term is found however it is written; what isn't ASCII, and NUL,
counts as a mark. A hit counts where no letter or digit stands directly before or after the term. A URL is rejected by
one strict hit or by ``SOFT_TERMS`` distinct soft terms; its weight is the sum of the weights of the distinct terms it
has. Every term has a weight of its own; ``terms_of`` reads strict and soft terms from a table.

The URLs of a batch are one text to the automaton, so Python works once a hit, not once a URL.

Defined cases. A null url has no hits and is kept, an empty one too. Matching folds ASCII capitals. Repeated rows each
get their verdict; a null page_id stays null. Overlapping hits of different terms all count. Only page_id and url are
read. No rows in, no rows out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gritstone.llm.common import arrow_batches, table

STRICT_WEIGHT, SOFT_WEIGHT, SOFT_TERMS, MOST_TERMS = 1.0, 0.5, 2, 1_000_000
STRICT = {"spam-farm": 1.0, "cheap-pills": 1.0, "xxx": 1.0, "porn": 2.0, "porno": 2.0, "hentai": 2.0, "escorts": 1.5, "viagra": 1.5, "cialis": 1.5, "warez": 1.0, "camgirls": 2.0, "online-casino": 1.0, "payday-loans": 1.0, "replica-watches": 1.0, "malware": 1.5, "phishing": 1.5}
SOFT = {"spam": 0.75, "cheap": 0.25, "pills": 0.5, "farm": 0.25, "casino": 0.75, "poker": 0.5, "bet": 0.25, "betting": 0.5, "slots": 0.5, "loan": 0.25, "loans": 0.25, "adult": 0.5, "sex": 0.5, "sexy": 0.75, "nude": 0.75, "torrent": 0.5, "crack": 0.25, "keygen": 0.75, "serial": 0.25, "hack": 0.25, "diet": 0.25, "weight-loss": 0.5, "replica": 0.5, "discount": 0.25, "free-download": 0.5, "bonus": 0.25, "jackpot": 0.5, "dating": 0.5, "webcam": 0.5, "gambling": 0.75}

_COLUMNS = ("strict_hits", "soft_hits", "strict_terms", "soft_terms")


def weights(terms: Mapping[str, float] | Iterable[str], usual: float) -> tuple[tuple[str, float], ...]:
    """(term, weight) of a mapping, or of terms that all weigh as ``usual``."""
    return tuple(terms.items()) if isinstance(terms, Mapping) else tuple((t, usual) for t in terms)


def terms_of(vocabulary: DataFrame, most: int = MOST_TERMS) -> tuple[dict[str, float], dict[str, float]]:
    """Strict and soft terms of a table (term, strict, weight); rows with a null or empty term are no terms, a null weight is the kind's
    usual one, of repeated terms the heaviest counts, strict before soft. More than ``most`` rows are an error: an automaton is held by every worker."""
    rows = vocabulary.select("term", "strict", "weight").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has more than {most} rows")
    strict, soft = {}, {}
    for r in rows:
        if r["term"]:
            kind, usual = (strict, STRICT_WEIGHT) if r["strict"] else (soft, SOFT_WEIGHT)
            term = r["term"].translate(_FOLD)
            kind[term] = max(kind.get(term, float("-inf")), usual if r["weight"] is None else float(r["weight"]))
    return strict, {t: w for t, w in soft.items() if t not in strict}


@lru_cache(maxsize=2)
def automaton(terms: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        found.add_word(term, (i, len(term)))
    found.make_automaton()
    return found


_FOLD = {c: c + 32 for c in range(65, 91)}
_ESCAPE = re.compile("%([0-9A-Fa-f]{2})")


def _character(m: re.Match) -> str:
    n = int(m[1], 16)
    return chr(n) if 0 < n < 128 else " "


def decoded(url: str) -> str:
    """The URL as terms are looked for in it."""
    while "%" in url and (less := _ESCAPE.sub(_character, url)) != url:
        url = less
    return url.translate(_FOLD)


def hits(urls: list[str | None], terms: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(url, term, times) for each term that a URL has, by their places."""
    texts = [decoded(u) if u else "" for u in urls]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    whole = "\n".join(texts) + "\n"
    found = [(end, term, size) for end, (term, size) in automaton(terms).iter(whole)]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    end, term, size = np.array(found, np.int64).T
    inside = np.frombuffer(whole.encode("ascii", "replace"), np.uint8)
    inside = (inside >= 48) & (inside <= 57) | (inside >= 97) & (inside <= 122)
    ok = ~inside[np.minimum(end + 1, len(inside) - 1)] & ~((end >= size) & inside[end - size])
    owner = np.searchsorted(starts, end[ok] - size[ok] + 1, "right") - 1
    key, times = np.unique(owner * len(terms) + term[ok], return_counts=True)
    return key // len(terms), key % len(terms), times


def verdicts(pages: DataFrame, strict: Mapping[str, float] | Iterable[str] = STRICT, soft: Mapping[str, float] | Iterable[str] = SOFT, soft_terms: int = SOFT_TERMS) -> DataFrame:
    """page_id, url, strict_hits, soft_hits, strict_terms, soft_terms, weight, rejected for every row."""
    strict, soft = weights(strict, STRICT_WEIGHT), weights(soft, SOFT_WEIGHT)
    terms, weight = tuple(t for t, _ in strict + soft), np.array([w for _, w in strict + soft])
    if not terms:
        raise ValueError("the vocabulary has no terms")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            url, term, times = hits(batch.column("url").to_pylist(), terms)
            kind = (term >= len(strict)).astype(np.int64)
            count = lambda of, by, n=len(batch): np.bincount(url[of], weights=by[of], minlength=n)
            n = [count(kind == k, by).astype(np.int32) for by in (times, np.ones(len(url))) for k in (0, 1)]
            sums = np.bincount(url, weights=weight[term], minlength=len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, n), pa.array(sums), pa.array((n[2] > 0) | (n[3] >= soft_terms))], ["page_id", "url", *_COLUMNS, "weight", "rejected"])

    rows = pages.selectExpr("cast(page_id as bigint) as page_id", "cast(url as string) as url")
    return arrow_batches(rows, judge, "page_id bigint, url string, strict_hits int, soft_hits int, strict_terms int, soft_terms int, weight double, rejected boolean", 10_000)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "pages"))


def _count(term: str) -> str:
    # Every mark is doubled, so that neighbouring hits have a boundary each.
    return f"len(regexp_extract_all(u, '(^|[^a-z0-9]){term.replace('-', '--')}($|[^a-z0-9])'))"


def _sum(terms: Mapping[str, float], what: str) -> str:
    return " + ".join(what.format(n=_count(t), w=w) for t, w in terms.items())


_PART = "CASE WHEN regexp_matches(x, '^[0-9A-Fa-f]{2}') THEN CASE WHEN ('0x' || x[1:2])::INTEGER BETWEEN 1 AND 127 THEN chr(('0x' || x[1:2])::INTEGER) ELSE ' ' END || x[3:] ELSE '%' || x END"
_DECODE = f"string_split(url, '%')[1] || array_to_string(list_transform(string_split(url, '%')[2:], lambda x: {_PART}), '')"

ORACLE = f"""WITH RECURSIVE r AS (SELECT row_number() OVER () AS row, page_id, url FROM pages),
d AS (SELECT row, 0 AS pass, coalesce(url, '') AS url FROM r UNION ALL SELECT row, pass + 1, next FROM (SELECT *, {_DECODE} AS next FROM d WHERE contains(url, '%')) WHERE next <> url),
last AS (SELECT row, arg_max(url, pass) AS url FROM d GROUP BY row),
u AS (SELECT row, regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([^a-z0-9])', '\\1\\1', 'g') AS u FROM last),
c AS (SELECT row, ({_sum(STRICT, "{n}")})::INTEGER AS strict_hits, ({_sum(SOFT, "{n}")})::INTEGER AS soft_hits, ({_sum(STRICT, "({n} > 0)::INT")})::INTEGER AS strict_terms, ({_sum(SOFT, "({n} > 0)::INT")})::INTEGER AS soft_terms, {_sum(STRICT | SOFT, "({n} > 0)::INT * {w}::DOUBLE")} AS weight FROM u)
SELECT page_id, url, strict_hits, soft_hits, strict_terms, soft_terms, weight, strict_terms > 0 OR soft_terms >= {SOFT_TERMS} AS rejected FROM r JOIN c USING (row)"""
