"""The quality classifier: measures and scores recomputed plainly, accuracy on rows held out, odd rows."""

import os
import re
import sys
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd import TEXTS, odd_docs

from geoscope.llm import quality, queries

POINT = ".,;:'\"()-?"
SPACE = " \t\n\r\x0b\x0c"


def kind(c):
    if ord(c) > 127:
        return "high"
    if c.isupper() or c.islower():
        return "upper" if c.isupper() else "lower"
    return "digit" if c.isdigit() else "space" if c in SPACE else "point" if c in POINT else "symbol"


def plain_measures(text):
    """The measures of one text, character by character and word by word."""
    text = text or ""
    kinds = [kind(c) for c in text]
    words = [w for w in re.split(f"[{SPACE}]+", text) if w]
    n, k = max(len(text), 1), max(len(words), 1)
    lines = text.split("\n")
    sizes = [len(w) for w in words]
    out = [np.log1p(len(text)), *[kinds.count(x) / n for x in ("upper", "digit", "space", "point", "symbol", "high")]]
    out += [np.log1p(len(words)), sum(sizes) / k, np.std(sizes) if words else 0.0]
    own = [[kind(c) for c in w] for w in words]
    letters = [sum(x in ("upper", "lower", "high") for x in w) for w in own]
    out.append(sum(x == 0 for x in letters) / k)
    out.append(sum(w[-1] == "symbol" for w in own) / k)
    out.append(sum(w[0] == "upper" for w in own) / k)
    out.append(sum(0 < w.count("upper") == x for w, x in zip(own, letters)) / k)
    out.append(sum(a == b for a, b in zip(words, words[1:])) / k)
    out.append(sum(len(set(words[i : i + quality.WINDOW])) for i in range(0, len(words), quality.WINDOW)) / k)
    return [*out, np.log1p(len(text) / len(lines)), len(set(lines)) / len(lines)]


def test_measures_equal_plain_ones():
    rng = np.random.default_rng(4)
    texts = [t for _, t in TEXTS]
    texts += ["".join(rng.choice(list("aB é日😀1.,!$ \n\tx|"), int(n))) for n in rng.integers(0, 300, 200)]
    texts += [" ".join(rng.choice(["ab", "AB", "cd!!", "ef$$$"], 200)), "same line\nsame line\n\n", "   ", "é", "\n"]
    found = quality.measures(pa.array(texts, pa.string()))
    assert np.allclose(found, [plain_measures(t) for t in texts], atol=1e-6)
    sliced = quality.measures(pa.array(texts, pa.string()).slice(3, 7))
    assert np.allclose(sliced, found[3:10])
    assert quality.measures(pa.array([], pa.string())).shape == (0, len(quality.MEASURES))


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(500, len(quality.MEASURES)))
    labels = (rows[:, 0] + rows[:, 1] * rows[:, 2] > 0).astype(int)
    model = quality.train(rows, labels)
    assert model.pairs and (1, 2) in model.pairs
    for row, got in zip(rows[:50], model.score(rows[:50])):
        bins = [sum(v >= c for c in cuts) for v, cuts in zip(row, model.cuts)]
        coarse = [sum(v >= c for c in cuts) for v, cuts in zip(row, model.pair_cuts)]
        total = model.bias + sum(t[b] for t, b in zip(model.tables, bins))
        total += sum(t[coarse[a], coarse[b]] for (a, b), t in zip(model.pairs, model.pair_tables))
        assert np.isclose(got, 1 / (1 + np.exp(-np.clip(total, -30, 30))))
    assert ((model.score(rows) >= 0.5) == labels).mean() > 0.9


def test_tree_takes_the_best_cut():
    rng = np.random.default_rng(6)
    slope, curve, rows = rng.normal(size=9), rng.random(9) + 0.1, np.full(9, 50)
    step = quality._tree(slope, curve, rows, depth=1)
    cuts = [
        (slope[:i].sum() ** 2 / (curve[:i].sum() + quality.RIDGE) + slope[i:].sum() ** 2 / (curve[i:].sum() + quality.RIDGE), i)
        for i in range(1, 9)
    ]
    at = max(cuts)[1]
    want = np.repeat([-slope[p].sum() / (curve[p].sum() + quality.RIDGE) for p in (slice(0, at), slice(at, 9))], [at, 9 - at])
    assert np.allclose(step, want)


@pytest.mark.parametrize("size, kept, dropped", [("sf0.01", 0.98, 0.8), ("sf0.1", 0.99, 0.95)])
def test_held_out_accuracy(spark, size, kept, dropped):
    folder = f"/root/testdata/{size}"
    found = {r["doc_id"]: r for r in queries.op13_quality(spark, folder).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall()
    held = [(q, found[i]) for i, q in labels if i in found and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] for _, r in held) and all(0 <= r["score"] <= 1 for r in found.values())
    assert np.mean([r["predicted"] for q, r in held if q == 1]) >= kept
    assert np.mean([1 - r["predicted"] for q, r in held if q == 0]) >= dropped
    # the model alone gives every score
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    some = docs.limit(50).collect()
    assert np.allclose(model.score(quality.measures(pa.array([r["text"] for r in some]))), [found[r["doc_id"]]["score"] for r in some])


def test_sample_is_bounded_and_weighted(spark):
    """A label-0 row repeated very often takes nobody's place; held-out ids, nulls and contradictions teach nothing."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    held = [i for i in range(400) if not zlib.crc32(str(i).encode()) % 5]
    docs = [(i, f"text {i}") for i in ids] + [(ids[0], "hot")] * 3000 + [(i, "held") for i in held] + [(None, "x"), (5000, None)]
    labels = [(i, int(n > 50)) for n, i in enumerate(ids)] + [(ids[60], 0), (ids[61], None), (5000, 1), (None, 1)] + [(i, 0) for i in held]
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.sample(frame, marks, rows=20)
    for value, total in ((0, 51), (1, len(ids) - 52 + (5000 not in held))):
        one = [r for r in got.to_pylist() if r["label"] == value]
        assert len(one) == 20 and all(np.isclose(r["weight"], total / 20, rtol=0.05) for r in one)
    assert quality.sample(frame, marks, rows=20).equals(got)
    everything = quality.sample(frame, marks)
    assert everything.num_rows == len(ids) - 1 + 1  # without the contradicted id, with both texts of the hot one


def test_odd_rows_and_empty_tables(spark):
    odd = odd_docs(spark)
    marks = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (8, 1), (9, 1), (None, 0)], "doc_id long, quality int")
    model = quality.fit(odd, marks)
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.keep(odd, model, 0.0).columns == odd.columns and quality.keep(odd, model, 0.0).count() == len(TEXTS)
    none = quality.fit(odd.limit(0), marks.limit(0))
    assert {round(r["score"], 3) for r in quality.score(odd, none).collect()} == {0.982}
    assert quality.score(odd.limit(0), model).collect() == []
