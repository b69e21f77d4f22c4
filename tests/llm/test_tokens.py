"""Encoding, token files and packing against the tokenizers library."""

import collections
import hashlib
import os
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd import TEXTS, odd_docs

from geoscope.llm import bpe, files, packing, queries, token_files, word_tokens
from geoscope.llm.bpe import ByteBPE

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def byte_library():
    return tokenizers.Tokenizer.from_file(queries.BYTE_BPE)


@pytest.fixture(scope="module")
def word_library():
    return tokenizers.Tokenizer.from_file(queries.WORD_BPE)


@pytest.fixture(scope="module")
def coder():
    return ByteBPE(queries.BYTE_BPE)


ALPHABET = st.text(st.sampled_from(list("aAbe thing,.!'sdlmtv0123 \n\t\r éÉßñ²日本́​ 😀<|>")), max_size=60)


@given(ALPHABET)
@settings(max_examples=300, deadline=None)
def test_byte_bpe_is_the_library(coder, byte_library, text):
    expected = byte_library.encode(text, add_special_tokens=False).ids
    (found,) = coder.encode_batch([text])
    assert found.tolist() == expected
    assert coder.decode(found.tolist()) == byte_library.decode(expected, skip_special_tokens=False) == text


def test_special_and_long_words(coder, byte_library):
    texts = ["<|endoftext|>a <|endoftext|>", "a" * 5000, "é" * 700, "ab" * 40, "", "x<|endoftext|", "in" * 33 + "the"]
    for text, found in zip(texts, coder.encode_batch(texts)):
        assert found.tolist() == byte_library.encode(text, add_special_tokens=False).ids


def test_one_tree_and_many_trees_agree(coder):
    words = [b"international", b"ababababab", b" thethethe", b"zzzzzzzzzzzzzzzz", bytes(range(1, 60))]
    assert coder.merge(words) == [coder._merge_one(w) for w in words]


@given(st.lists(ALPHABET, max_size=4))
@settings(max_examples=200, deadline=None)
def test_word_tokens_are_the_library(word_library, texts):
    ids, borders = word_tokens.load(queries.WORD_BPE).encode(pa.array([*texts, None], pa.string()))
    expected = [word_library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:])] == [*expected, []]


def test_store_keeps_frequent_words():
    from geoscope.llm.kept import Kept

    kept = Kept(3)
    for turn in range(5):
        for word in kept.missing(["often", f"once{turn}", f"twice{turn}"]):
            assert word != "often" or turn == 0
            kept.now[word] = 1


def test_ids_do_not_depend_on_the_store(word_library):
    """A store of three words, and parts of which it knows half: every word of a part is found."""
    coder = word_tokens.WordCoder(queries.WORD_BPE, cached_words=3)
    words = ["alpha", "Beta.", "gamma", "delta!", "eps;", "zeta", "eta?", "theta", "iota:", "kappa", "<s>", "É.", "a.b."]
    for part in (words[:5], words, words[::-1], ["", "new, words; here.", *words], words):
        ids, borders = coder.encode(pa.array(part), 2)
        expected = [[*word_library.encode(t, add_special_tokens=False).ids, 2] for t in part]
        assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:])] == expected
    ids, borders = coder.encode(pa.array([], pa.string()), 2)
    assert ids.tolist() == [] and borders.tolist() == [0]


def test_op3(spark, byte_library):
    docs = odd_docs(spark)
    found = sorted(bpe.round_trip(docs, queries.BYTE_BPE).collect(), key=str)
    expected = []
    for i, text in TEXTS:
        ids = byte_library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(text or "")))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    encoded = bpe.encode(docs, queries.BYTE_BPE)
    decoded = bpe.decode(encoded, queries.BYTE_BPE)
    assert sorted((r.doc_id or 0, r.text) for r in decoded.collect()) == sorted((i or 0, t or "") for i, t in TEXTS)
    assert bpe.round_trip(docs.limit(0), queries.BYTE_BPE).count() == 0


def _expected_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, queries.END_ID]


def _crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_files(spark, word_library):
    docs, out = odd_docs(spark), files.new_path(spark, "tokens")
    token_files.write(docs, out, queries.WORD_BPE, queries.END_ID)
    rows = token_files.read(spark, out)
    found = token_files.digests(rows).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i))
    start = 0
    for r in found:
        assert r.start == start
        start += r.n_tokens
    expected = collections.Counter((i, len(ids), _crc(ids)) for i, t in TEXTS for ids in [_expected_ids(word_library, t)])
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected
    plan = rows.filter("doc_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan
    empty = files.new_path(spark, "tokens")
    token_files.write(docs.limit(0), empty, queries.WORD_BPE, queries.END_ID)
    assert token_files.digests(token_files.read(spark, empty)).count() == 0


def test_op10_on_a_table(spark, word_library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    start = 0
    for d, r in zip(docs, queries.op10_token_files(spark, SMALL).orderBy("doc_id").collect(), strict=True):
        ids = _expected_ids(word_library, d.text)
        assert tuple(r) == (d.doc_id, start, len(ids), _crc(ids))
        start += len(ids)


def _check_pieces(rows, docs, library, capacity):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, text in docs:
        ids, at = _expected_ids(library, text), 0
        if sum(j == i for j, _ in docs) > 1:
            continue
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), _crc(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    total, lost = 0, 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
        total += at
        lost += capacity - at if at & (at - 1) else 0
    assert total == sum(len(_expected_ids(library, t)) for _, t in docs)
    return lost / max(1, total)


def test_packing(spark, word_library):
    docs = odd_docs(spark)
    pack = lambda df, capacity: packing.pack(df, queries.WORD_BPE, queries.END_ID, capacity)
    for capacity in (16, 256, 4096):
        _check_pieces(pack(docs, capacity).collect(), TEXTS, word_library, capacity)
    assert pack(docs.limit(0), 4096).count() == 0
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert _check_pieces(queries.op5_packing(spark, SMALL).collect(), table, word_library, 4096) < 0.01


@given(st.lists(st.integers(1, 100), max_size=40), st.integers(1, 8))
@settings(max_examples=200, deadline=None)
def test_differencing_deals_every_item_once(sizes, windows):
    found = packing.differencing(sizes, windows)
    assert sorted(i for items in found for i in items) == list(range(len(sizes)))
    assert len(found) == windows


def test_differencing_balances():
    sizes = [8, 7, 6, 5, 4]
    assert sorted(sum(sizes[i] for i in w) for w in packing.differencing(sizes, 2)) == [14, 16]
    many = list(range(1, 200))
    sums = [sum(many[i] for i in w) for w in packing.differencing(many, 7)]
    assert max(sums) - min(sums) <= 4


@given(st.lists(st.integers(1, 64), min_size=1, max_size=40), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_windows_rise_until_all_fit(sizes, windows):
    pieces = [(n, 0, np.arange(size), size) for n, size in enumerate(sizes)]
    found = packing.near_equal(list(pieces), 64, windows)
    assert all(sum(len(p[2]) for p in w) <= 64 for w in found)
    assert sum(len(p[2]) for w in found for p in w) == sum(sizes)
    assert len(found) <= max(windows, -(-sum(sizes) // 64))


def test_windows_rise_while_one_exceeds_the_capacity(monkeypatch):
    sizes = [3000] * 8 + [500]
    found = packing.within_capacity(sizes, 4096, 6)
    assert len(found) == 8 and sorted(i for w in found for i in w) == list(range(9))
    assert max(sum(sizes[i] for i in w) for w in found) <= 4096
    tried = []
    differencing = packing.differencing
    monkeypatch.setattr(packing, "differencing", lambda sizes, windows: tried.append(windows) or differencing(sizes, windows))
    task = packing._Task(4096, 0)
    rng = np.random.default_rng(2)
    for doc in range(3000):
        task.add(doc, rng.integers(0, 49_000, int(rng.choice((40, 900, 2500, 3900, 9000))), dtype=np.uint32))
    task.end()
    assert any(b > a for a, b in zip(tried, tried[1:]))  # a rise within a batch
    lengths = collections.Counter()
    for _, _, length, _, _, sequence, _ in task.taken():
        lengths[sequence] += length
    padded = sum(4096 - n for n in lengths.values() if n & (n - 1))
    assert max(lengths.values()) <= 4096 and padded < 0.01 * sum(lengths.values())
