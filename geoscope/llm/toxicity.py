"""Toxicity of texts: subword-bag embeddings averaged into a linear softmax, trained jointly.

A word's features are itself and its character n-grams, hashed to rows of one embedding matrix. A
passage of ``PASSAGE`` words is the mean of its words' mean vectors, and a linear softmax over it gives
the probability of label 1; a text scores as its most toxic passage, so a few words count in a long
text as in a short one. Embeddings and softmax are trained together, by Adam in numpy, on a bounded
sample of labelled rows. Unseen spellings share n-gram vectors with seen ones.

Scoring is linear in the words until the maximum, so workers keep one number per word met and sum
numbers; the model's size is fixed (``BUCKETS`` x ``WIDTH``), and so is what is sent to the workers.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoscope.llm import files
from geoscope.llm.bpe import in_parts
from geoscope.llm.kept import Kept

BUCKETS, WIDTH = 1 << 18, 8
GRAMS = range(3, 7)
#: Words of more characters are cut into pieces of so many, the most toxic of which counts.
WORD_CHARS = 32
PASSAGE = 8
#: Bound of the training sample: rows of each label. Their texts are learned whole.
SAMPLE_ROWS = 2500
#: Features that stand in fewer training texts have no vector.
RARE = 2
#: Training goes from whole texts to passages: up to these shares of the updates, passages are so
#: wide; after that, PASSAGE words.
WIDTHS = ((0.3, 1 << 30), (0.5, 64), (0.7, 24))
UPDATES, BATCH_DOCS, RATE, DECAY = 300, 500, 0.05, 2e-4
CACHED_WORDS = 300_000
SEED = 7


def _clean(word: str) -> str:
    """Lower case without punctuation at the ends; a word of punctuation alone has no features."""
    word = word.lower()
    if word.isalnum():
        return word
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def features(piece: str) -> list[int]:
    """Rows of the embedding matrix: the piece and its n-grams, with marks at its ends."""
    marked = f"<{piece}>"
    grams = {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)} | {marked}
    return [zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in sorted(grams)]


def _pieces(word: str) -> list[str]:
    core = _clean(word)
    return [core[i : i + WORD_CHARS] for i in range(0, len(core), WORD_CHARS)]


class _Words:
    """Features of distinct words, as one flat array with borders."""

    def __init__(self, words: Iterable[str]):
        owner, sizes, flat = array("i"), array("i"), array("i")
        self.words = 0
        for word in words:
            for piece in _pieces(word):
                found = features(piece)
                owner.append(self.words)
                sizes.append(len(found))
                flat.extend(found)
            self.words += 1
        self.owner, self.sizes, self.flat = (np.array(x, dtype=np.int32) for x in (owner, sizes, flat))
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes

    def scores(self, by_feature: np.ndarray) -> np.ndarray:
        """Each word's number from a number per feature: the mean, the largest of its pieces; else zero."""
        out = np.zeros(self.words)
        if len(self.flat):
            means = np.add.reduceat(by_feature[self.flat], self.starts) / self.sizes
            out[:] = -np.inf
            np.maximum.at(out, self.owner, means)
            out[np.isinf(out)] = 0
        return out


@dataclass(frozen=True)
class Model:
    """``by_feature``: the embeddings times the difference of the softmax's two weight vectors."""

    by_feature: np.ndarray
    bias: float


def _passages(counts: np.ndarray, width: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Of texts with so many words, laid one after the other: each passage's first word and its text. A
    text's passages are near-equal, of at most ``width`` words."""
    passages = -(-counts // width)
    text = np.repeat(np.arange(len(counts)), passages)
    within = np.arange(len(text)) - np.repeat(np.cumsum(passages) - passages, passages)
    return (np.cumsum(counts) - counts)[text] + within * counts[text] // passages[text], text


def train(texts: list[str], labels: np.ndarray) -> Model:
    """Fits the embeddings and the softmax. Without any text of either label the model says "not toxic"
    by a fixed small probability."""
    labels = np.asarray(labels, dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), -4.0)
    vocabulary: dict[str, int] = {}
    spelled, counts = array("i"), np.zeros(len(texts), dtype=np.int64)
    for n, text in enumerate(texts):
        split = text.split()
        spelled.extend([vocabulary.setdefault(w, len(vocabulary)) for w in split])
        counts[n] = len(split)
    words, known = np.array(spelled, dtype=np.int32), _Words(vocabulary)
    del spelled, vocabulary
    # in how many texts each feature stands; rare ones would only tell the training texts apart
    pairs = np.unique(np.repeat(np.arange(len(counts)), counts) * known.words + words) % known.words
    times = np.bincount(pairs, minlength=known.words)[known.owner]
    learned = np.bincount(known.flat, weights=np.repeat(times, known.sizes), minlength=BUCKETS) >= RARE
    firsts = np.cumsum(counts) - counts
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32) * learned[:, None]
    weights, bias = rng.normal(0, 1, WIDTH).astype(np.float32), -2.0
    state = [np.zeros_like(table), np.zeros_like(table), np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0]
    turn = 0
    while turn < UPDATES and counts.any():
        order = rng.permutation(len(counts))
        for at in range(0, len(order), BATCH_DOCS):
            docs = order[at : at + BATCH_DOCS]
            docs = docs[counts[docs] > 0]
            if not len(docs):
                continue
            turn += 1
            size = counts[docs]
            place = np.repeat(firsts[docs] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            own = words[place]
            score = known.scores(table @ weights)[own]
            start, text = _passages(size, next((w for until, w in WIDTHS if turn <= until * UPDATES), PASSAGE))
            length = np.diff(np.append(start, len(own)))
            logit = np.add.reduceat(score, start) / length + bias
            top = np.zeros(len(docs), dtype=np.int64)  # the passage that counts
            best = np.full(len(docs), -np.inf)
            np.maximum.at(best, text, logit)
            hit = np.flatnonzero(logit == best[text])[::-1]
            top[text[hit]] = hit
            slope = (1 / (1 + np.exp(-best)) - labels[docs]) / len(docs)
            # back to words, their features, and the two factors
            spread = np.concatenate([np.arange(start[p], start[p] + length[p]) for p in top])
            each = np.repeat(slope / length[top], length[top])
            by_word = np.bincount(own[spread], weights=each, minlength=known.words)
            by_piece = by_word[known.owner] / known.sizes
            grad = np.bincount(known.flat, weights=np.repeat(by_piece, known.sizes), minlength=BUCKETS).astype(np.float32) * learned
            steps = (
                (table, np.outer(grad, weights) + DECAY * table, 0),
                (weights, grad @ table, 2),
            )
            for value, slope_of, k in steps:
                state[k] = 0.9 * state[k] + 0.1 * slope_of
                state[k + 1] = 0.999 * state[k + 1] + 0.001 * slope_of**2
                value -= RATE * (state[k] / (1 - 0.9**turn)) / (np.sqrt(state[k + 1] / (1 - 0.999**turn)) + 1e-8)
            state[4] = 0.9 * state[4] + 0.1 * slope.sum()
            state[5] = 0.999 * state[5] + 0.001 * slope.sum() ** 2
            bias -= RATE * (state[4] / (1 - 0.9**turn)) / (np.sqrt(state[5] / (1 - 0.999**turn)) + 1e-8)
    return Model((table @ weights).astype(np.float64), float(bias))


class Scorer:
    """Scores texts by a model; keeps a number per word."""

    def __init__(self, model: Model):
        self.model = model
        self._kept = Kept(CACHED_WORDS)

    def score(self, texts: pa.Array) -> np.ndarray:
        """The probability of label 1 for each text; null and empty texts get the bias alone."""
        lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten().dictionary_encode()
        spelled = words.dictionary.to_pylist()
        missing = self._kept.missing(spelled)
        kept = self._kept.now
        kept.update(zip(missing, _Words(missing).scores(self.model.by_feature).tolist()))
        number = np.array([kept[w] for w in spelled])
        counts = np.diff(lists.offsets.to_numpy())
        logit = np.full(len(counts), self.model.bias)
        if counts.sum():
            each = number[words.indices.to_numpy(zero_copy_only=False)]
            start, text = _passages(counts)
            means = np.add.reduceat(each, start) / np.diff(np.append(start, len(each)))
            best = np.full(len(counts), -np.inf)
            np.maximum.at(best, text, means + self.model.bias)
            logit = np.where(counts > 0, best, logit)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def is_held_out(id_col: str = "doc_id"):
    """True for ids whose labels are not learned: crc32 of the id as text is divisible by 5. False for
    null ids, whose labels are not learned either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learns from labelled rows that are not held out. Of each label the ``rows`` ids with the smallest hashes
    are taken, and of their different rows at most ``rows``, those with the smallest hashes of (id, text), so
    that the sample is the same at every run and neither label takes the other's place. Repeated rows count
    once. Ids with labels of both kinds, and null labels, teach nothing."""
    agreed = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .filter("toxic = most")
        .select("doc_id", "toxic")
    )
    parts = []
    for value in (0, 1):
        ids = agreed.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        parts.append(ids)
    chosen = parts[0].union(parts[1])
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null")
    # equal rows are one; a row repeated very often combines before the shuffle
    distinct, place = files.written(found.select("toxic", "doc_id", "text").distinct(), "labelled_texts")
    each = [
        distinct.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(rows).toArrow()
        for value in (0, 1)
    ]
    files.drop(docs.sparkSession, place)
    got = pa.concat_tables(each)
    return train(got.column("text").to_pylist(), got.column("toxic").to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` for the whole text of every row. Labels, language, source and id play no part.
    Null texts count as empty; repeated rows score alike; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in in_parts(batch, text_col, 16 << 20):
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(scorer.score(part.column(text_col)))], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep(docs: DataFrame, model: Model, below: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts score below ``below``, with all their columns; null and empty texts
    score by the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in in_parts(batch, text_col, 16 << 20):
                yield part.filter(pa.array(scorer.score(part.column(text_col)) < below))

    return docs.mapInArrow(run, docs.schema)
