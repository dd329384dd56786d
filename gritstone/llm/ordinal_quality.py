"""Quality classifier: an ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector over hashed text features is shared by all grades,
and ordered thresholds cut its score. Features are words, runs of punctuation, words in capitals, and words and lines that
repeat the one before, hashed to 2**18 places, with sublinear counts and unit length. The expected grade orders
documents; the tail probability P(grade >= top) selects them.

One more feature doesn't fade as a text grows: the strength of its strongest marker. A marker is a word that significantly
more rated documents of the grade below the top hold than of the top; its strength is the logarithm of how many times
as likely they hold it. Markers are told apart by their whole 64-bit hashes.

The model is fitted on at most ``FIT_ROWS`` rated documents (those with the lowest hash of their doc_id), on the
driver; every document is scored where it lies, with no shuffle.

Defined cases. Rows without a doc_id are left out. Null texts and texts of white space alone have no features:
expected grade 0, tail 0, rejected. Ratings with a null part are not used; of several for one doc_id the lowest
grade counts. With no usable rating at all nothing can be judged: every text that isn't blank gets the top
grade. Repeated rows get equal scores and are all selected or all rejected. Only doc_id and text are read;
``select`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.llm import kernels
from gritstone.llm.common import TEXT_ROWS, arrow_batches, keyed, table

BUCKETS, FIT_ROWS, TOP, LEAST_TAIL = 1 << 18, 10_000, 2, 0.4
#: LEAST_TAIL is the highest tenth that keeps 99 % of clean documents held out of sf0.1 (three folds together, by doc_id % 3).
#: A feature counts only if so many rated documents have it: what fewer have would be learnt by heart.
LEAST_DOCUMENTS = 3
#: The likelihood ratio statistic from which a word is a marker, and what its strength is multiplied by as a feature, at the place after the hashed ones.
LEAST_G2, MARKER_SCALE, MARKER = 15.0, 0.2, BUCKETS
_CAPS, _ECHO, _LINE = (np.uint64(x) for x in (0x5A1D3C0B7F2E4961, 0x2C6B8A90E5D4F173, 0x71B5E09D3A86C42F))


def _punctuation() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for b in range(33, 127):
        if not chr(b).isalnum():
            t[b] = b
    return t


PUNCT = _punctuation()


LINES = np.arange(256, dtype=np.uint8)
LINES[[0, 10, 13]] = 0


def _repeats(run: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the runs start that equal the one before them in the same text."""
    text = np.searchsorted(offsets, at, "right")
    return at[1:][(run[1:] == run[:-1]) & (text[1:] == text[:-1])]


def features(raw: np.ndarray, offsets: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (bounds, place, value): unit length, 1 + log count; a text without any token is an empty row. words: its runs of words, if they are known."""
    texts = len(offsets) - 1
    word, at, size = kernels.runs(raw, offsets, kernels.FOLD) if words is None else words
    mark, mark_at, _ = kernels.runs(raw, offsets, PUNCT)
    upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90), dtype=np.int32)])
    loud = (size > 1) & ((upper[at + size] - upper[at]) * 5 >= size * 4)
    line, line_at, _ = kernels.runs(raw, offsets, LINES)
    echo, again = _repeats(word, at, offsets), _repeats(line, line_at, offsets)
    h = np.concatenate([word, mark ^ _CAPS, np.full(int(loud.sum()), _CAPS), np.full(len(echo), _ECHO), np.full(len(again), _LINE)])
    owner = np.searchsorted(offsets, np.concatenate([at, mark_at, at[loud], echo, again]), "right") - 1
    key, count = np.unique((owner.astype(np.int64) << 18) | (kernels.mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    row = key >> 18
    value = 1.0 + np.log(count)
    bounds = np.zeros(texts + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=texts), out=bounds[1:])
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=texts))
    return bounds, (key & (BUCKETS - 1)).astype(np.int32), (value / norm[row]).astype(np.float32)


def text_words(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``features`` of texts a megabyte at a time, as (first text, end, bounds, place, value, words' hashes, their texts from the first)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + kernels.WINDOW, "right")) - 1)
        part, cuts = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        words = kernels.runs(part, cuts, kernels.FOLD)
        yield (a, b, *features(part, cuts, words), words[0], np.searchsorted(cuts, words[1], "right") - 1)
        a = b


def text_features(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``features`` of texts a megabyte at a time, as (first text, end, bounds, place, value)."""
    for x in text_words(raw, offsets):
        yield x[:5]


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Markers:
    """Hashes of words in order, and their strengths."""

    word: np.ndarray
    strength: np.ndarray

    def strongest(self, word: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """Of each text the strength of its strongest marker times ``MARKER_SCALE``, 0 where it has none."""
        out = np.zeros(texts)
        if len(self.word):
            place = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
            hit = np.flatnonzero(self.word[place] == word)
            np.maximum.at(out, text[hit], self.strength[place[hit]] * MARKER_SCALE)
        return out


NO_MARKERS = Markers(np.zeros(0, np.uint64), np.zeros(0))


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def markers(word: np.ndarray, grade: np.ndarray, documents: np.ndarray, least_documents: int = LEAST_DOCUMENTS) -> Markers:
    """word, grade: a row for each distinct word of each document; documents: how many each grade has. The last two grades are compared."""
    n = documents[-2:].astype(float)
    if n.min() == 0:
        return NO_MARKERS
    top = len(documents) - 1
    of_two = grade >= top - 1
    words, column = np.unique(word[of_two], return_inverse=True)
    below = np.bincount(column, weights=grade[of_two] < top, minlength=len(words))
    above = np.bincount(column, minlength=len(words)) - below
    parts = _x_log_x(below) + _x_log_x(above) + _x_log_x(n[0] - below) + _x_log_x(n[1] - above)
    g2 = 2 * (parts - _x_log_x(below + above) - _x_log_x(n.sum() - below - above) - _x_log_x(n).sum() + _x_log_x(n.sum()))
    strength = np.log((below + 0.5) / (n[0] + 1)) - np.log((above + 0.5) / (n[1] + 1))
    marks = (g2 >= LEAST_G2) & (strength > 0) & (below >= least_documents)
    return Markers(words[marks], strength[marks])


def with_markers(bounds: np.ndarray, place: np.ndarray, value: np.ndarray, strongest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows with the strongest marker as a last feature of those that have one."""
    some = np.flatnonzero(strongest)
    ends = bounds[some + 1]
    return bounds + np.concatenate([[0], np.cumsum(strongest > 0)]), np.insert(place, ends, MARKER), np.insert(value.astype(float), ends, strongest[some])


@dataclass(frozen=True)
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray
    markers: Markers = NO_MARKERS

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. in columns."""
        return logistic(score[:, None] - self.thresholds[None, :])


def fit(bounds: np.ndarray, place: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, steps: int = 250, rate: float = 0.4, shrink: float = 1e-5, least_documents: int = LEAST_DOCUMENTS) -> Ordinal:
    """Full-batch Adam on the mean negative log likelihood. Thresholds start at the grades' smoothed shares and stay ordered through logarithms of their gaps."""
    n = len(grade)
    share = (np.bincount(grade, minlength=grades) + 0.5) / (n + 0.5 * grades)
    cut = np.log(np.cumsum(share)[:-1] / (1 - np.cumsum(share)[:-1]))
    free = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
    common = np.bincount(place)[place] >= least_documents
    row = np.repeat(np.arange(n), np.diff(bounds))[common]
    value = value[common]
    used, column = np.unique(place[common], return_inverse=True)
    w = np.zeros(len(used))
    state = [np.zeros(len(used) + len(free)) for _ in range(2)]
    for step in range(1, steps + 1):
        cut = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        score = np.bincount(row, weights=value * w[column], minlength=n)
        edge = np.concatenate([np.ones((n, 1)), logistic(score[:, None] - cut), np.zeros((n, 1))], axis=1)  # P(grade >= k)
        top, low = edge[np.arange(n), grade], edge[np.arange(n), grade + 1]
        p = np.maximum(top - low, 1e-12)
        slope = edge * (1 - edge)
        d_top, d_low = slope[np.arange(n), grade] / p, slope[np.arange(n), grade + 1] / p
        g_score = -(d_top - d_low) / n
        g_cut = np.zeros(grades + 1)
        np.add.at(g_cut, grade, d_top / n)
        np.add.at(g_cut, grade + 1, -d_low / n)
        g_cut = g_cut[1:-1]
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(column, weights=value * g_score[row], minlength=len(used)) + shrink * w, tail[:1], tail[1:] * np.exp(free[1:])])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = rate * (1 - step / (steps + 1)) * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-9)
        w -= move[: len(used)]
        free -= move[len(used) :]
    weights = np.zeros(BUCKETS + 1)
    weights[used] = w
    return Ordinal(weights, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 poor, 1 good but toxic, 2 good and clean."""
    rated = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    grade = F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).otherwise(TOP)
    return rated.groupBy("doc_id").agg(F.min(grade).cast("int").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, fit_rows: int = FIT_ROWS, grades: int = TOP + 1, least_documents: int = LEAST_DOCUMENTS) -> Ordinal | None:
    """Fit on the ``fit_rows`` rated documents of lowest hash; None where there are none. Features of fewer than ``least_documents`` of them are left out."""
    sample = ratings.select(F.col("doc_id").alias("rated"), "grade").orderBy(F.xxhash64("rated"), "rated").limit(fit_rows)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = kernels.buffers(batch.column("text"))
            for a, b, bounds, place, value, word, text in text_words(raw, off):
                cut = bounds.astype(np.int32)
                order = np.lexsort((word, text))
                word, text = word[order].astype(np.int64), text[order]
                new = np.ones(len(word), bool)
                new[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
                of = np.searchsorted(text[new], np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("grade").slice(a, b - a), pa.ListArray.from_arrays(cut, place), pa.ListArray.from_arrays(cut, value), pa.ListArray.from_arrays(of, word[new])], ["doc_id", "grade", "place", "value", "words"])

    # The sample is bounded by fit_rows, so it may be broadcast.
    texts = keyed(docs, F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("rated")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "grade", "text")
    got = arrow_batches(texts, rows, "doc_id bigint, grade int, place array<int>, value array<float>, words array<bigint>").toArrow()
    if got.num_rows == 0:
        return None
    got = got.take(np.argsort(got.column("doc_id").to_numpy(), kind="stable"))
    grade = got.column("grade").to_numpy()
    words = got.column("words").combine_chunks()
    got = got.drop_columns(["words"])  # what is large is let go as soon as it was used: the driver is small
    of = np.diff(words.offsets.to_numpy())
    word, text = words.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(grade), dtype=np.int32), of)
    marks = markers(word, grade[text], np.bincount(grade, minlength=grades), least_documents)
    strongest = marks.strongest(word, text, len(grade))
    del words, word, text
    place, value = (got.column(c).combine_chunks() for c in ("place", "value"))
    order = (place.offsets.to_numpy() - place.offsets[0].as_py()).astype(np.int64)
    rows_of = with_markers(order, place.flatten().to_numpy(), value.flatten().to_numpy(), strongest)
    del got, place, value
    return replace(fit(*rows_of, grade, grades, least_documents=least_documents), markers=marks)


def judged(column: pa.Array, model: Ordinal | None, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and P(grade is the top one) of each text."""
    expected, tail = np.zeros(len(column)), np.zeros(len(column))
    for start in range(0, len(column), TEXT_ROWS):
        raw, off = kernels.buffers(column.slice(start, TEXT_ROWS))
        for a, _, bounds, place, value, word, owner in text_words(raw, off):
            some = np.flatnonzero(np.diff(bounds))
            at = start + a + some
            if model is None:
                expected[at], tail[at] = grades - 1, 1.0
            elif len(some):
                marked = model.weights[MARKER] * model.markers.strongest(word, owner, len(bounds) - 1)
                p = model.tails(np.add.reduceat(model.weights[place] * value, bounds[:-1][some]) + marked[some])
                expected[at], tail[at] = p.sum(1), p[:, -1]
    return expected, tail


def scored(text: Column, model: Ordinal | None, grades: int = TOP + 1) -> Column:
    """grade (expected) and tail, P(grade is the top one), of a text. Only the text goes to Python and only two numbers come back; rows wait for them in the executor's memory."""

    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in texts:
            yield pa.StructArray.from_arrays([pa.array(x) for x in judged(whole, model, grades)], ["grade", "tail"])

    # Of several readers of the result none may make Spark judge a text twice.
    return F.arrow_udf(judge, "grade double, tail double").asNondeterministic()(text.cast("string"))


def graded(docs: DataFrame, model: Ordinal | None, grades: int = TOP + 1) -> DataFrame:
    """doc_id, expected_grade, tail_probability of every document. The doc_id goes through Python with the text, so that no text waits in the executor's memory until it is judged."""
    texts = keyed(docs, F.col("text").cast("string").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in judged(batch.column("text"), model, grades))], ["doc_id", "expected_grade", "tail_probability"])

    numbers = [T.StructField(name, T.DoubleType()) for name in ("expected_grade", "tail_probability")]
    return arrow_batches(texts, judge, T.StructType([texts.schema["doc_id"], *numbers]))


def select(docs: DataFrame, model: Ordinal | None, least_tail: float = LEAST_TAIL) -> DataFrame:
    """The documents whose tail probability reaches ``least_tail``, with all their columns, whatever their names."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.struct("*").alias("row"), scored(F.col("text"), model).alias("p"))
    return rows.filter(F.col("p.tail") >= least_tail).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return graded(docs, train(docs, grades_of(table(spark, sf_dir, "labels")))).filter(F.col("tail_probability") >= LEAST_TAIL)
