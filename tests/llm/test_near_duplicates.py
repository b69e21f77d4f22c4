"""SimHash, suffix-array, vector near-duplicates, components and top-k search against brute force."""

import collections
import hashlib
import os
import sys

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd import TEXTS, odd_docs

from geoscope.llm import components, queries, simhash, suffix, topk, vector_dedup

SMALL = "/root/testdata/sf0.001"


class Forest:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# -- components


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 150, (120, 2))]
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)] + [(7, 7), (3, None)]
    forest = Forest({x for link in links for x in link if x is not None})
    for a, b in links:
        if b is not None:
            forest.link(a, b)
    found, _ = components.components(spark.createDataFrame(links, "a long, b long"))
    rows = {r.node: r.root for r in found.collect()}
    assert rows == {n: forest.find(n) for n in forest.up if forest.find(n) != n}


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long"))[0].count() == 0


# -- SimHash


def brute_fingerprint(text, words=3):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, distance=3):
    """Smallest node by fingerprint."""
    forest = Forest(fps)
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= distance:
                forest.link(a, b)
    return forest


def check_groups(rows, docs):
    fps = {brute_fingerprint(t) for _, t in docs}
    forest = brute_groups(fps)
    least = {}
    for i, t in docs:
        root = forest.find(brute_fingerprint(t))
        if i is not None:
            least[root] = min(least.get(root, i), i)
    found = collections.Counter(rows)
    assert found == collections.Counter(
        (i, format(f, "016x"), least.get(forest.find(f))) for i, t in docs for f in [brute_fingerprint(t)]
    )


def _rows(frame):
    return [(r.doc_id, format(r.fp & (1 << 64) - 1, "016x"), r.component_id) for r in frame.collect()]


def test_simhash_odd_rows(spark):
    docs = odd_docs(spark)
    check_groups(_rows(simhash.groups(docs, 3)), TEXTS)
    assert simhash.groups(docs.limit(0), 3).count() == 0
    kept = simhash.keep_one(docs, 3)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    ids = [r.doc_id for r in kept.collect()]
    roots = {r[2] for r in _rows(simhash.groups(docs, 3))}
    assert len(ids) == len(set(ids)) == len(roots) and set(ids) == roots


def test_op2_on_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_groups([tuple(r) for r in queries.op2_simhash(spark, SMALL).collect()], docs)


def test_crowded_buckets_are_split_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    fps = {base}
    while len(fps) < 250:
        fps.add(base ^ sum(1 << int(b) for b in set(rng.integers(0, 18, int(rng.integers(1, 6))))))
    fps |= {int(x) for x in rng.integers(0, 2**62, 60)}
    links, _ = simhash.close_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    forest, expected = Forest(fps), brute_groups(fps)
    for r in links.collect():
        assert (r.a ^ r.b).bit_count() >= 1
        forest.link(r.a, r.b)
    assert {f: forest.find(f) for f in fps} == {f: expected.find(f) for f in fps}


@given(st.sets(st.integers(0, 63), max_size=3), st.integers(0, 2**64 - 1))
@settings(max_examples=100, deadline=None)
def test_close_fingerprints_share_a_block(flips, fp):
    other = fp ^ sum(1 << b for b in flips)
    masks = simhash.first_masks(5, 3)
    full = (1 << 64) - 1
    assert any((fp ^ other) & m & full == 0 for m in masks)
    for mask in masks:
        if (fp ^ other) & mask & full == 0:
            assert any((fp ^ other) & m & full == 0 for m in simhash.finer_masks(mask, 3))


# -- suffixes


@given(st.data())
@settings(max_examples=150, deadline=None)
def test_shared_windows(data):
    length = data.draw(st.integers(9, 24))
    parts = data.draw(st.lists(st.text("ab", max_size=40) | st.just("abcabcabcabcabcabcabcabcabcabc"), max_size=12))
    raw = b"".join(p.encode() + b"\xff" for p in parts)
    text = np.frombuffer(raw, dtype=np.uint8)
    times = collections.Counter(raw[i : i + length] for i in range(len(raw) - length + 1))
    expected = [
        len(w) == length and b"\xff" not in w and times[w] > 1 for i in range(len(raw)) for w in [raw[i : i + length]]
    ]
    assert suffix.shared_windows(text, length).tolist() == expected


def brute_removals(texts, length):
    times = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone])
        yield len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def check_removals(rows, docs, length=200):
    texts = [(t or "").encode() for _, t in docs]
    expected = collections.Counter((i, *b) for (i, _), b in zip(docs, brute_removals(texts, length)))
    assert collections.Counter(map(tuple, rows)) == expected


def repeating_docs():
    rng = np.random.default_rng(1)
    letters = lambda n, k: "".join(chr(97 + int(x)) for x in rng.integers(0, k, n))
    passage = letters(400, 26)
    docs = [
        (i, letters(int(rng.integers(0, 300)), 3) + passage[int(rng.integers(0, 200)) : int(rng.integers(250, 400))] + letters(int(rng.integers(0, 300)), 3))
        for i in range(150)
    ]
    return docs + [(1000, "ab" * 1500), (1001, "x" * 2000), (1004, "é" * 150), (1005, "é" * 150 + "a"), (1006, "z" * 199), (1007, "z" * 199)]


def test_suffix_odd_rows(spark):
    docs = odd_docs(spark)
    check_removals(suffix.removals(docs).collect(), TEXTS)
    assert suffix.removals(docs.limit(0)).count() == 0
    cleaned = suffix.cleaned(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(TEXTS)


@pytest.mark.parametrize("group", [10, 10_000])
def test_suffix_hot_anchors(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    docs = repeating_docs()
    check_removals(suffix.removals(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_op6_on_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_removals(queries.op6_suffix(spark, SMALL).collect(), docs)


def test_cleaned_keeps_whole_characters():
    text = "aé©b".encode()
    assert suffix.whole_characters(text, [(2, 4)]) == []
    assert suffix.whole_characters(text, [(1, 4)]) == [(1, 3)]
    assert suffix.whole_characters(text, [(0, 6)]) == [(0, 6)]


# -- vectors


def brute_links(rows, cosine):
    usable = {}
    for n, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[n] = np.array(v, dtype=float) / np.linalg.norm(v)
    forest, links = Forest(range(len(rows))), collections.Counter()
    for a in usable:
        for b in usable:
            if a < b and usable[a] @ usable[b] >= cosine:
                forest.link(a, b)
                links.update([a, b])
    least = {}
    for n, (i, _) in enumerate(rows):
        if n in usable:
            least[forest.find(n)] = min(least.get(forest.find(n), i), i)
    for n, (i, _) in enumerate(rows):
        component = least[forest.find(n)] if n in usable else i
        yield i, links[n], component, i is not None and i == component


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    near = [base[int(rng.integers(0, 4))] + 0.05 * rng.normal(size=16) for _ in range(80)]
    rows = [(n, [float(x) for x in np.float32(v)]) for n, v in enumerate([*base, *near])]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, [0.0] * 16), (504, [1.0, None] + [0.0] * 14)]
    rows += [(505, [float("nan")] + [1.0] * 15), (506, [float("inf")] * 16), (507, []), (507, [2 * x for x in rows[3][1]])]
    return rows


def test_vector_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CHUNK", 16)
    rows = vectors()
    frame = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, label int, list string, entry string")
    found = vector_dedup.near_duplicates(frame, 0.9).collect()
    assert collections.Counter(map(tuple, found)) == collections.Counter(brute_links(rows, 0.9))
    empty = vector_dedup.near_duplicates(frame.limit(0), 0.9)
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_recall_on_a_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    found = {r.vec_id: r.n_links for r in queries.op4_vector_dedup(spark, "/root/testdata/sf0.1").collect()}
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    expected = dict(zip([i for i, _ in rows], ((unit @ unit.T) >= 0.9).sum(axis=1) - 1))
    assert all(found[i] <= n for i, n in expected.items())
    assert sum(found.values()) >= 0.99 * sum(expected.values())


def test_dense_group_of_different_vectors(spark, monkeypatch):
    """A third of the table is one group whose vectors are nearly all linked, cut into more lists than are probed."""
    monkeypatch.setattr(vector_dedup, "LIST_SAMPLE", 32)
    rng = np.random.default_rng(9)
    unit = rng.normal(size=(3000, 32))
    unit[:1000] = unit[0] + 0.28 * rng.normal(size=(1000, 32))
    unit[1000:1200] = unit[1200:1400] + 0.3 * rng.normal(size=(200, 32))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    frame = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(unit)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(frame, 0.9).collect()}
    expected = ((unit @ unit.T) >= 0.9).sum(axis=1) - 1
    assert expected[:1000].mean() > 900
    assert [found[n] for n in range(len(unit))] == expected.tolist()


def test_index_loses_nothing_in_a_list():
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(400, 24))
    unit[200:] = unit[:200] + 0.1 * rng.normal(size=(200, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    index = vector_dedup.fit(unit)
    codes, errors = index.code(unit - index.centres[0])
    a, b = vector_dedup._close(unit, codes, errors, unit, unit - index.centres[0], index, 0.9)
    assert len(a) == (unit @ unit.T >= 0.9).sum()


def test_lookup_as_a_product_of_matrices():
    """The product in single precision passes every pair that the tables pass, and few more; pairs that pass in numbers are ranked alike."""
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(600, 20))  # 20 components are not a multiple of the subspaces
    unit[300:] = unit[:300] + 0.2 * rng.normal(size=(300, 20))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    index = vector_dedup.fit(unit)
    residuals = unit - index.centres[1]
    codes, errors = index.code(residuals)
    within = vector_dedup._reach(0.9) + errors
    found, looked_up = index.passes(residuals, codes, within), index.lookup(residuals, codes)
    assert found[looked_up <= within**2].all() and not found[looked_up > within**2 + 2 * vector_dedup.LOOKUP_SLACK].any()
    for cosine in (-0.5, 0.9):
        a, b = vector_dedup._close(unit, codes, errors, unit, residuals, index, cosine)
        assert set(zip(a.tolist(), b.tolist())) == set(zip(*(n.tolist() for n in np.nonzero(unit @ unit.T >= cosine))))


def test_sides_grow_with_the_table():
    """Rows go to as many tasks as the table has sides, so these grow with it; wide vectors keep a side's bytes bounded."""
    for width, most in ((4, 25), (512, 98)):
        index = vector_dedup.Index(np.zeros((1, width)), np.zeros((8, 1, -(-width // 8))))
        assert vector_dedup.Plan.of(index, {0: 400_000}, {0: 1.0}).chunks[0] in range(24, most + 1)
    assert vector_dedup.Plan.of(index, {0: 5000}, {0: 1.0}).chunks == [2]


# -- top k


def brute_top(rows, asked, k):
    for n, (i, v) in enumerate(rows):
        if not asked(i) or v is None:
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), j is None, j) for m, (j, w) in enumerate(rows) if m != n and w is not None]
        for rank, (score, _, j) in enumerate(sorted(others, key=lambda o: (o[0], o[1], o[2] or 0))[:k], 1):
            yield i, rank, j, -score


@pytest.mark.parametrize("blocks", [(8, 2), (2048, 256)])
def test_top_k(spark, monkeypatch, blocks):
    from pyspark.sql import functions as F

    monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    rng = np.random.default_rng(4)
    rows = [(n, [int(x) for x in rng.integers(-40, 40, 6)]) for n in range(60)]
    rows += [(60, rows[0][1]), (60, rows[0][1]), (61, None), (None, rows[1][1]), (62, [0] * 6), (63, [5, 5])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, vector array<long>, row string")
    found = topk.top_k(frame, F.col("vec_id") % 5 == 0, 4).collect()
    expected = brute_top(rows, lambda i: i is not None and i % 5 == 0, 4)
    assert collections.Counter(map(tuple, found)) == collections.Counter(expected)
    assert topk.top_k(frame.limit(0), F.lit(True), 4).count() == 0


@given(st.integers(0, 2**32), st.integers(1, 90))
@settings(max_examples=100, deadline=None)
def test_search_is_exact(seed, n):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-9, 9, (n, 5)) * rng.integers(0, 2, (n, 1))
    query, tie = rng.integers(-9, 9, 5), rng.permutation(n)
    found, scores = topk.Index(rows).search(query, 3, 0, tie)
    best = sorted(range(1, n), key=lambda i: (-(rows[i] @ query), tie[i]))[:3]
    assert found.tolist() == best and scores.tolist() == [int(rows[i] @ query) for i in best]


def test_kept_row_is_the_same_at_every_run(spark):
    """Of rows with one id and text but other values elsewhere."""
    rows = [(1, "one two three four five", f"v{n}") for n in range(40)] + [(2, "one two three four five", "w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __keep_id string")
    kept = [simhash.keep_one(frame.repartition(n), 3).collect() for n in (1, 3, 7)]
    assert len(kept[0]) == 1 and kept[0] == kept[1] == kept[2] and kept[0][0].doc_id == 1


def test_no_table_is_left_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert suffix.cleaned(odd_docs(spark), 200).columns == odd_docs(spark).columns
    assert {t.name for t in spark.catalog.listTables()} == before
