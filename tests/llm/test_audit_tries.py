"""Source divergence and conversation tries, against plain recomputation."""

import collections
import hashlib
import os
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd import CLASHING, odd_docs
from pyspark.sql import functions as F

import compare
from geoscope.llm import divergence, queries, tries

SMALL = "/root/testdata/sf0.001"

WORD = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def words(text):
    return [w.translate(LOWER) for w in WORD.findall((text or "").encode())]


# -- source divergence


def plain_audit(docs, min_docs, top):
    """The same by dictionaries of all counts."""
    groups, seen = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in docs:
        found = words(text)
        groups[lang or "", source or ""].update(found)
        seen[lang or ""].update(set(found))
    out = set()
    for (lang, source), own in groups.items():
        kept = [w for w, n in seen[lang].items() if n >= min_docs]

        def shares(counts):
            total = sum(counts[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 10**9 * (counts[w] + 5) // total for w in kept}

        p = shares(own)
        everyone = collections.Counter()
        others = {}
        for (other_lang, other), counts in groups.items():
            if other_lang == lang:
                everyone.update(counts)
                if other != source:
                    others[other.encode()] = sum(abs(a - b) for a, b in zip(p.values(), shares(counts).values()))
        q = shares(everyone)
        terms = {w: p[w] - q[w] for w in kept if own[w] and p[w] > q[w]}
        for part, values, most in (("pair", others, len(others)), ("term", terms, top)):
            for rank, item in enumerate(sorted(values, key=lambda x: (-values[x], x))[:most], 1):
                out.add((lang, source, part, item.decode(), values[item], rank))
    return out


@pytest.mark.parametrize("shard_terms, block", [(2048, 256), (3, 2)])
def test_audit_equals_plain_counting(spark, shard_terms, block):
    """Also with shards of a few terms and blocks of two sources."""
    rng = np.random.default_rng(1)
    spelled = ["Ab", "aB", "cd", "é", "日本", "x1y", "İ", "zz", "word" * 5, "word" * 5 + "s", "abcdefgh", "abcdefghi"]
    docs = [(" ,7".join(rng.choice(spelled, 9)), rng.choice(["a", "b", ""]), f"s{rng.integers(0, 5)}") for _ in range(300)]
    docs = [tuple(map(str, row)) for row in docs]
    docs += [(None, "a", "s1"), ("", "a", "empty"), ("ab cd", None, None), ("?", "lonely", "s1"), ("zz", "a", "Ω"), *[("hot zz", "b", "s1")] * 200]
    frame = spark.createDataFrame(docs, "text string, lang string, source string")
    found = [tuple(r) for r in divergence.audit(frame, 5, 3, shard_terms=shard_terms, block_sources=block).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_audit(docs, 5, 3)


def test_audit_on_odd_and_empty_tables(spark):
    odd = odd_docs(spark)
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert {tuple(r) for r in divergence.audit(odd, 1, 50).collect()} == plain_audit(rows, 1, 50)
    two = odd.limit(0).selectExpr("text", "lang", "source")
    assert divergence.audit(two).collect() == []


def test_pointers_sort_like_words():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abAB é日.0"), int(n))) for n in rng.integers(0, 60, 400)] + ["", "aaaaaaaaaaaaaaaaaaaab" * 3, "a" * 63]
    low, starts, sizes, text = divergence.word_pointers(pa.array(texts))
    assert [low[s : s + n].tobytes() for s, n in zip(starts, sizes)] == [w for t in texts for w in words(t)]
    assert text.tolist() == [i for i, t in enumerate(texts) for _ in words(t)]
    order, fresh = divergence.sort_pointers(low, starts, sizes)
    got = [low[starts[i] : starts[i] + sizes[i]].tobytes() for i in order]
    assert got == sorted(got) and [a != b for a, b in zip(got, [None, *got])] == fresh.tolist()


def test_document_counts(spark):
    frame = spark.createDataFrame([("a a b", "x", "s"), ("A", "x", "s"), ("b", "x", None)], "text string, lang string, source string")
    found = {(r["source"], r["term"]): (r["n"], r["df"]) for r in divergence.term_counts(frame).collect()}
    assert found == {("s", "a"): (3, 2), ("s", "b"): (1, 1), ("", "b"): (1, 1), ("s", None): (0, 2), ("", None): (0, 1)}


# -- conversation tries


def plain_trie(rows, group=100, below=6):
    """The same by listing every prefix of every rebuilt conversation. Turns of one number must be equal."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % below
        base = c - (c % group if c >= 0 else -(-c % group))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    children = collections.Counter(path[:-1] for path in members if path)
    leaves, saved = collections.Counter(), collections.Counter()
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1]) if path else 0
    return sorted(
        (
            min(convs), len(path), min(members[path[:-1]]) if path else -1, len(convs), children[path], leaves[path], saved[path],
            hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
        )
        for path, convs in members.items()
    )


TURNS = "conv_id long, turn long, role string, text string"


def found_trie(frame, **sizes):
    ordered, convs = tries.turns(frame)
    borrow = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    rows = tries.build(*tries.opened_alike(ordered, convs, 100, borrow, 6), **sizes).fillna(-1, ["parent_conv_id"])
    return sorted(tuple(r) for r in rows.collect())


def conversations():
    """Copies, shared openings, one long conversation and a copy of it that goes on, turnless ones, repeated rows,
    nulls, ids below zero."""
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(60, 240), *range(1000, 1040), -7, -100, -350, 5003]:
        opening = [("system", "Be kind."), ("user", "hi"), ("assistant", "héllo 😀")][: int(rng.integers(0, 4))]
        if c % 3 == 0:
            path = [("system", "copy"), ("user", "copied"), (None, "copied"), ("user", None), ("", "x")] * 2
        else:
            path = opening + [(str(rng.choice(["user", "assistant"])), str(rng.choice(["a", "b", "cc"]))) for _ in range(int(rng.integers(0, 9)))]
        rows += [(c, n if n else None, *turn) for n, turn in enumerate(path or [("user", "only")])]
    long = [(n, "user", f"turn {n % 7}") for n in range(60)]
    rows += [(100, *t) for t in long] + [(9000, *t) for t in long] + [(9001, *t) for t in [*long, (60, "user", "more")]]
    rows += [(7777, 1, "user", "again")] * 12 + [(None, 0, "user", "nobody")] * 3
    return rows


@pytest.mark.parametrize("container, shard, chunk, piece", [(4096, 1 << 14, 1024, 4096), (40, 100, 8, 16), (0, 10, 3, 2)])
def test_trie_equals_plain_listing(spark, monkeypatch, container, shard, chunk, piece):
    """Also with containers that are burst once, often and always, and with small windows and pieces."""
    monkeypatch.setattr(tries, "CHUNK", chunk)
    monkeypatch.setattr(tries, "PIECE_IDS", piece)
    rows = [r for r in conversations() if r[0] != 100] + [(100, n, "user", f"turn {n % 7}") for n in range(60)]
    frame = spark.createDataFrame(rows, TURNS).repartition(5)
    clashing = frame.selectExpr("*", *[f"'x' AS {name}" for name in [*CLASHING.split(), "depth", "length", "seq", "chunk", "at"]])
    assert found_trie(clashing, container_turns=container, shard_turns=shard) == plain_trie(rows)


def test_trie_of_no_and_of_turnless_conversations(spark):
    assert found_trie(spark.createDataFrame([], TURNS)) == []
    rows = [(c, 1, "user", "t") for c in range(101, 160)]  # most borrow from a conversation that is not there
    assert found_trie(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)


def test_ties_do_not_depend_on_the_scan(spark):
    rows = [(1, None, "user", t) for t in "abcdef"] + [(1, 2, r, "x") for r in "uvw"]
    frame = spark.createDataFrame(rows, TURNS)
    assert found_trie(frame.repartition(4)) == found_trie(frame.orderBy(F.desc("text")).coalesce(1))


@pytest.mark.parametrize("name", ["op11_divergence", "op12_tries"])
def test_query_matches_sql(name, spark):
    problem, rows = compare.difference(name, spark, compare.duck(SMALL), SMALL)
    assert problem is None and rows, problem
