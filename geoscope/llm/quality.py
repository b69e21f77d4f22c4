"""Quality of texts: a generalised additive model with pairwise interactions over measures of the text.

Each measure of ``MEASURES`` (shares of characters, words, lines and repeats; none knows a language) is cut into
bins at quantiles of the training rows. The model is a lookup table for every measure, and one for
each of a few pairs of measures. Tables are learned by cyclic boosting: measure after measure, a shallow tree
over its bins takes a small step down the loss, again and again; then the pairs whose best two cuts
explain most of what is left are boosted in the same way. A text's score is the logistic function of
the sum of its bins' entries, so a prediction is a handful of additions and each one can be read off.

Texts are measured in the tasks, whole. The driver gets the measures of a bounded sample of labelled
rows, not their texts, and sends back tables of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoscope.llm import files
from geoscope.llm.bpe import in_parts
from geoscope.llm.toxicity import is_held_out

#: Bound of the training sample: rows of each label.
SAMPLE_ROWS = 10_000
PART_BYTES = 4 << 20
#: Words of a window in which words are told apart.
WINDOW = 32
BINS, PAIR_BINS, PAIRS = 32, 8, 6
CYCLES, PAIR_CYCLES, RATE, RIDGE = 150, 60, 0.1, 2.0
LEAST_ROWS = 5

MEASURES = (
    "log_chars", "upper", "digit", "space", "point", "symbol", "high",
    "log_words", "word_mean", "word_spread", "no_letter", "symbol_end", "upper_start", "all_upper",
    "same_as_before", "distinct", "log_line", "distinct_lines",
)

_UPPER, _LOWER, _DIGIT, _SPACE, _POINT, _SYMBOL, _HIGH, _FOLLOWS = range(8)
_CLASS = np.full(256, _SYMBOL, dtype=np.uint8)
_CLASS[0x80:0xC0], _CLASS[0xC0:] = _FOLLOWS, _HIGH
for _kind, _chars in ((_SPACE, b" \t\n\r\x0b\x0c"), (_POINT, b".,;:'\"()-?"), (_DIGIT, b"0123456789")):
    _CLASS[list(_chars)] = _kind
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B] = _UPPER, _LOWER


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes' classes and the texts' borders in them."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, raw = texts.buffers()
    borders = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, dtype=np.uint8)[borders[0] : borders[-1]] if raw is not None else np.zeros(0, np.uint8)
    return _CLASS[data], borders - borders[0]


def _sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of what lies between borders, empty ones included."""
    out = np.zeros(len(borders) - 1)
    some = np.flatnonzero(np.diff(borders))
    if len(some):
        out[some] = np.add.reduceat(values, borders[some], dtype=np.float64)
    return out


def _distinct(groups: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """How many different ids each of n groups has."""
    width = int(ids.max()) + 1 if len(ids) else 1
    return np.bincount(np.unique(groups * width + ids) // width, minlength=n).astype(np.float64)


def measures(texts: pa.Array) -> np.ndarray:
    """A row of ``MEASURES`` for each text; null texts count as empty, and an empty text's shares are zero."""
    texts = pc.fill_null(texts, "")
    kinds, borders = _bytes_of(texts)
    of = {k: _sums(kinds == k, borders) for k in range(8)}
    chars = np.diff(borders) - of[_FOLLOWS]
    some = np.maximum(chars, 1)

    lists = pc.ascii_split_whitespace(texts)
    spelled = lists.flatten().dictionary_encode()
    known, word = spelled.dictionary, spelled.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    kinds, ends = _bytes_of(known)
    size = np.diff(ends)
    real = size[word] > 0  # a text that begins or ends with white space has an empty word there
    word, owner = word[real], owner[real]
    letters = _sums((kinds == _UPPER) | (kinds == _LOWER) | (kinds == _HIGH), ends)
    filled = size > 0
    first, last = np.zeros(len(size), np.uint8), np.zeros(len(size), np.uint8)
    first[filled], last[filled] = kinds[ends[:-1][filled]], kinds[ends[1:][filled] - 1]
    uppers = _sums(kinds == _UPPER, ends)
    length = size - _sums(kinds == _FOLLOWS, ends)

    counts = np.bincount(owner, minlength=len(texts))
    words = np.maximum(counts, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=mask, minlength=len(texts)) / words

    mean = share(length[word])
    again = np.zeros(len(word))
    if len(word):
        again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    starts = np.cumsum(counts) - counts
    windows = -(-counts // WINDOW)
    window = (np.cumsum(windows) - windows)[owner] + (np.arange(len(word)) - starts[owner]) // WINDOW
    different = _distinct(window, word, int(windows.sum()))
    by_text = np.bincount(np.repeat(np.arange(len(texts)), windows), weights=different, minlength=len(texts))

    lines = pc.split_pattern(texts, "\n")
    line = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    per_text = np.diff(lines.offsets.to_numpy())
    line_owner = np.repeat(np.arange(len(texts)), per_text)
    columns = (
        np.log1p(chars), of[_UPPER] / some, of[_DIGIT] / some, of[_SPACE] / some, of[_POINT] / some, of[_SYMBOL] / some, of[_HIGH] / some,
        np.log1p(counts), mean, np.sqrt(np.maximum(share(length[word] ** 2) - mean**2, 0)), share(letters[word] == 0),
        share(last[word] == _SYMBOL), share(first[word] == _UPPER), share((uppers[word] > 0) & (uppers[word] == letters[word])),
        share(again), by_text / words, np.log1p(chars / per_text), _distinct(line_owner, line, len(texts)) / per_text,
    )
    return np.stack(columns, axis=1)


@dataclass(frozen=True)
class Model:
    """Cuts and table of every measure; of pairs: the two measures, their coarser cuts and a square table."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.bias)
        for column, cuts, entries in zip(rows.T, self.cuts, self.tables):
            total += entries[np.searchsorted(cuts, column, side="right")]
        for (a, b), entries in zip(self.pairs, self.pair_tables):
            total += entries[
                np.searchsorted(self.pair_cuts[a], rows[:, a], side="right"), np.searchsorted(self.pair_cuts[b], rows[:, b], side="right")
            ]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Inner borders of bins with about as many rows each, halfway between neighbouring values."""
    values = np.unique(column)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    at = np.unique(np.searchsorted(values, np.quantile(column, np.arange(1, bins) / bins)))
    at = at[at > 0]
    return (values[at - 1] + values[at]) / 2


def _tree(slope: np.ndarray, curve: np.ndarray, rows: np.ndarray, depth: int = 2) -> np.ndarray:
    """A step for each bin from a tree over the bins: each node is cut where the loss falls most, Newton's
    step in the leaves."""
    out = np.full(len(slope), -slope.sum() / (curve.sum() + RIDGE))
    if depth and len(slope) > 1:
        left_g, left_h, left_n = np.cumsum(slope)[:-1], np.cumsum(curve)[:-1], np.cumsum(rows)[:-1]
        g, h, n = slope.sum(), curve.sum(), rows.sum()
        gain = left_g**2 / (left_h + RIDGE) + (g - left_g) ** 2 / (h - left_h + RIDGE) - g**2 / (h + RIDGE)
        gain[(left_n < LEAST_ROWS) | (n - left_n < LEAST_ROWS)] = 0
        at = int(np.argmax(gain)) + 1
        if gain[at - 1] > 1e-9:
            out[:at] = _tree(slope[:at], curve[:at], rows[:at], depth - 1)
            out[at:] = _tree(slope[at:], curve[at:], rows[at:], depth - 1)
    return out


def _quadrants(slope: np.ndarray, curve: np.ndarray, rows: np.ndarray) -> tuple[float, np.ndarray]:
    """Of square tables: the best cut of both measures into four, its gain and the steps."""
    def corners(x: np.ndarray) -> np.ndarray:
        c = x.cumsum(0).cumsum(1)
        a, top, side = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return np.stack([a, top - a, side - a, c[-1, -1] - top - side + a])

    if min(slope.shape) < 2:
        return 0.0, np.zeros_like(slope)
    g, h, n = corners(slope), corners(curve), corners(rows)
    gain = np.where(n >= LEAST_ROWS, g**2 / (h + RIDGE), 0).sum(0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    steps = np.where(n[:, i, j] >= LEAST_ROWS, -g[:, i, j] / (h[:, i, j] + RIDGE), 0)
    out = np.empty_like(slope)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = steps
    return float(gain[i, j]), out


def train(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> Model:
    """Fits the tables to measures and labels. ``weights`` say how many rows each one stands for. Without rows of
    both labels, all texts get one score: 0.98 if only label 1 is known (or none), else 0.02."""
    rows, labels = np.asarray(rows, dtype=np.float64).reshape(len(labels), len(MEASURES)), np.asarray(labels, dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        return Model(4.0 if not len(labels) or labels[0] else -4.0, [], [], [], [], [])
    weights = np.ones(len(labels)) if weights is None else np.asarray(weights, dtype=np.float64)
    weights = weights * (len(weights) / weights.sum())
    cuts = [_cuts(c, BINS) for c in rows.T]
    bins = [np.searchsorted(k, c, side="right") for k, c in zip(cuts, rows.T)]
    tables = [np.zeros(len(k) + 1) for k in cuts]
    held = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, tables)]
    mean = (weights * labels).sum() / weights.sum()
    bias = float(np.log(mean / (1 - mean)))
    total = np.full(len(labels), bias)

    def loss() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return weights * (p - labels), weights * np.maximum(p * (1 - p), 1e-6)

    for _ in range(CYCLES):
        for b, entries, n in zip(bins, tables, held):
            slope, curve = loss()
            step = RATE * _tree(np.bincount(b, slope, len(entries)), np.bincount(b, curve, len(entries)), n)
            entries += step
            total += step[b]

    pair_cuts = [_cuts(c, PAIR_BINS) for c in rows.T]
    coarse = [np.searchsorted(k, c, side="right") for k, c in zip(pair_cuts, rows.T)]

    def square(a: int, b: int, values: np.ndarray | None) -> np.ndarray:
        shape = (len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], values, shape[0] * shape[1]).reshape(shape).astype(np.float64)

    slope, curve = loss()
    gains = {(a, b): _quadrants(square(a, b, slope), square(a, b, curve), square(a, b, None))[0] for a, b in combinations(range(len(MEASURES)), 2)}
    pairs = [p for p in sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS] if gains[p] > 1e-9]
    pair_tables = [np.zeros((len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)) for a, b in pairs]
    for _ in range(PAIR_CYCLES):
        for (a, b), entries in zip(pairs, pair_tables):
            slope, curve = loss()
            step = RATE * _quadrants(square(a, b, slope), square(a, b, curve), square(a, b, None))[1]
            entries += step
            total += step[coarse[a], coarse[b]]
    return Model(bias, cuts, tables, pairs, pair_cuts, pair_tables)


def _measured(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for part in in_parts(batch, column, PART_BYTES):
        yield part, measures(part.column(column))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> pa.Table:
    """``label, weight, found`` (the measures) of labelled rows that are not held out. Of each label the ``rows``
    ids with the smallest hashes are taken, and of their different rows at most ``rows``, so that the
    sample is the same at every run and a repeated row counts once. ``weight`` makes up for the bound. Null
    texts, null labels and ids with labels of both kinds teach nothing."""
    agreed = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
        .filter("label = most")
        .select("doc_id", "label")
    )
    parts = [agreed.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for value in (0, 1)]
    found = docs.select("doc_id", "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id").filter("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, got in _measured(batch, "text"):
                lists = pa.FixedSizeListArray.from_arrays(pa.array(got.reshape(-1)), len(MEASURES)).cast(pa.list_(pa.float64()))
                columns = [part.column("doc_id"), part.column("label"), part.column("same"), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "same", "found"])

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label {labels.schema['quality'].dataType.simpleString()}, same bigint, found array<double>"
    told = found.select("doc_id", "text", "label", F.xxhash64("text").alias("same")).mapInArrow(run, kinds)
    distinct, place = files.written(told.groupBy("doc_id", "label", "same").agg(F.min("found").alias("found")), "measured")
    totals = {r["label"]: r["n"] for r in agreed.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    got = []
    for value in (0, 1):
        one = distinct.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id", "same"), "doc_id", "same").limit(rows).select("label", "found").toArrow()
        stands = max(1.0, totals.get(value, 0) / rows)
        got.append(one.append_column("weight", pa.array(np.full(one.num_rows, stands))))
    files.drop(docs.sparkSession, place)
    return pa.concat_tables(got)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learns ``quality`` from a :func:`sample` of labelled rows that are not held out."""
    got = sample(docs, labels, rows)
    found = got.column("found").combine_chunks()
    return train(found.flatten().to_numpy() if len(found) else np.zeros(0), got.column("label").to_numpy(), got.column("weight").to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` for the whole text of every row; no other column plays a part. Null texts count as empty;
    repeated rows score alike; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in _measured(batch, text_col):
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(sent.value.score(found))], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose texts score at least ``least``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in _measured(batch, text_col):
                yield part.filter(pa.array(sent.value.score(found) >= least))

    return docs.mapInArrow(run, docs.schema)
