"""Toxicity, license scans, URL filters and the pipeline."""

import collections
import itertools
import os
import re
import sys
import textwrap
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd import TEXTS, odd_docs
from pyspark.sql import functions as F

import compare
import corpus_pipeline
from geoscope.llm import files, licenses, queries, toxicity, url_filters

SMALL = "/root/testdata/sf0.001"


# -- toxicity


@pytest.fixture(scope="module")
def labelled():
    """Texts with and without insults; a quarter of the insults is misspelled."""
    rng = np.random.default_rng(0)
    words = ["".join(chr(97 + int(x)) for x in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(400)]
    bad = ["worthless", "disgusting", "pathetic", "stupid"]
    texts, labels = [], []
    for n in range(1200):
        text = [words[int(i)] for i in rng.integers(0, 400, int(rng.integers(5, 120)))]
        if n % 3 == 0:
            word = bad[int(rng.integers(0, 4))]
            if rng.random() < 0.25:
                at = int(rng.integers(1, len(word)))
                word = word[:at] + word[at - 1] + word[at:]
            for _ in range(2):
                text.insert(int(rng.integers(0, len(text))), word)
        texts.append(" ".join(text))
        labels.append(int(n % 3 == 0))
    return texts, np.array(labels)


def test_held_out_accuracy_and_unseen_spellings(labelled):
    texts, labels = labelled
    scorer = toxicity.Scorer(toxicity.train(texts[:900], labels[:900]))
    found = scorer.score(pa.array(texts[900:])) >= 0.5
    assert (found == labels[900:]).mean() > 0.9
    scores = scorer.score(pa.array(["so worthlesss and dissgusting", "so very fine", "", None, "?!"]))
    assert scores[0] > 0.5 > scores[1] and scores[2] == scores[3] < 0.5 and ((scores >= 0) & (scores <= 1)).all()


def test_one_passage_counts_in_a_long_text(labelled):
    texts, labels = labelled
    scorer = toxicity.Scorer(toxicity.train(texts, labels))
    clean = " ".join(t for t, y in zip(texts[:60], labels) if not y)
    assert scorer.score(pa.array([clean]))[0] < 0.5 < scorer.score(pa.array([clean + " pathetic stupid " + clean]))[0]


def test_training_without_both_labels():
    for labels in ([], [0, 0], [1, 1]):
        model = toxicity.train(["a b"] * len(labels), np.array(labels))
        assert toxicity.Scorer(model).score(pa.array(["a b"]))[0] < 0.5


def test_held_out_labels_and_odd_rows_teach_nothing(spark, labelled):
    texts, labels = labelled
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = spark.createDataFrame(list(enumerate(map(int, labels))), "doc_id long, toxic int")
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    turned = given.withColumn("toxic", F.when(F.col("doc_id").isin(held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    odd = spark.createDataFrame([(None, 1), (10**9, None), (10**9 + 1, 1), (10**9 + 1, 0)], "doc_id long, toxic int")
    one, two = toxicity.fit(docs, given), toxicity.fit(docs, turned.union(odd))
    assert one.bias == two.bias and (one.by_feature == two.by_feature).all()
    scored = toxicity.score(odd_docs(spark), one)
    assert scored.columns == ["doc_id", "score"] and scored.count() == len(TEXTS)
    kept = toxicity.keep(odd_docs(spark), one)
    assert kept.schema == odd_docs(spark).schema
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in scored.collect() if r.score < 0.5)
    nothing = toxicity.fit(docs, given.limit(0))
    assert toxicity.score(docs.limit(0), nothing).count() == 0


def test_a_repeated_row_does_not_displace_the_others(spark, labelled):
    texts, labels = labelled
    learned = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = spark.createDataFrame(list(enumerate(map(int, labels))), "doc_id long, toxic int")
    once = toxicity.fit(docs, given)
    assert once.by_feature.any()
    for label in (0, 1):
        hot = next(i for i in learned if labels[i] == label)
        more = toxicity.fit(docs.union(spark.range(20_000).select(F.lit(hot).cast("long"), F.lit(texts[hot]))), given)
        assert more.bias == once.bias and (more.by_feature == once.by_feature).all()


def test_late_passages_are_learned(spark, labelled):
    """A word that stands only beyond the first 20,000 characters of some toxic texts has a vector."""
    texts, labels = labelled
    learned = [i for i in range(len(texts)) if labels[i] and zlib.crc32(str(i).encode()) % 5][:40]
    clean = " ".join(t for t, y in zip(texts, labels) if not y)[:21_000]
    long = [clean + " loathsome" if i in learned else t for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    given = spark.createDataFrame(list(enumerate(map(int, labels))), "doc_id long, toxic int")
    model = toxicity.fit(docs, given)
    own = [f for f in toxicity.features("loathsome") if f not in {f for t in texts for w in t.split() for f in toxicity.features(w)}]
    assert own and model.by_feature[own].all()
    assert toxicity.Scorer(model).score(pa.array(["so loathsome"]))[0] > toxicity.Scorer(model).score(pa.array(["so"]))[0]


def test_op7_columns(spark):
    rows = queries.op7_toxicity(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


# -- licenses

LICENSED = [
    "MIT License mit license", "the GNU General Public License.", "cc by", "cc-by 4.0; CC BY", "ccby", "apache  LICENSE",
    "Licensed under the Apache License, Version 2.0.", "licensed under apache license version 2.0 the",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of software.",
    "Redistribution and use in source and binary forms, with modification, are permitted provided the following conditions are met",
    "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "mit\nlicense", "É mit license é", "gnu general public", None, "", "...",
    "word " * 3000 + "mit license " + "word " * 3000,
]


def test_licenses_match_sql(spark, tmp_path):
    rows = [(n, t, "x", "y") for n, t in enumerate(LICENSED)] + [(3, LICENSED[3], "x", "y"), (None, LICENSED[0], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, row string")
    found = licenses.scan(docs, queries.PHRASES, queries.TEMPLATES, queries.CONTAINMENT)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    cursor = con.execute(queries.ORACLES["op8_licenses"])
    assert [c[0] for c in cursor.description] == found.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(cursor.fetchall(), key=str)
    empty = licenses.scan(docs.limit(0), queries.PHRASES, queries.TEMPLATES, queries.CONTAINMENT)
    assert empty.count() == 0


def test_wrapped_notices(spark):
    """A notice wrapped in any way gets the label of its template; its words far apart do not."""
    bsd, gpl, mit = (next(t.text for t in queries.TEMPLATES if t.label == n) for n in ("bsd", "gpl", "mit"))
    wrap = lambda text, width, mark="", end="\n": end.join(mark + x for x in textwrap.wrap(text, width))
    texts = {
        "bsd": [wrap(bsd, 70), wrap(bsd, 40, "# "), "x y z. " + wrap(bsd, 76, " * ", "\r\n") + " more", wrap(bsd, 60, "dnl "), wrap(bsd, 50, "", "\n\n")],
        "gpl": [wrap(gpl, 72, "// "), wrap(gpl.replace("you can ", ""), 30), "word " * 3000 + "\n" + wrap(gpl, 80)],
        "mit": [wrap(mit, 45), wrap(mit.replace("free of charge, ", ""), 20)],
        "": ["\n".join(x + " word" * 60 for x in textwrap.wrap(bsd, 70)), wrap(bsd, 70)[:70], "\n".join(bsd.split()[:8] * 5)],
    }
    rows = [(label, n, text) for label, some in texts.items() for n, text in enumerate(some)]
    docs = spark.createDataFrame([(n, text) for n, (_, _, text) in enumerate(rows)], "doc_id long, text string")
    found = licenses.scan(docs, {"no such phrase": "none"}, queries.TEMPLATES, queries.CONTAINMENT).collect()
    assert {r.doc_id: r.labels for r in found} == {n: label for n, (label, _, _) in enumerate(rows)}
    assert all((r.score >= queries.CONTAINMENT) == bool(r.labels) for r in found)


def test_places_by_plain_counting(spark):
    docs = odd_docs(spark).union(odd_docs(spark).limit(0))
    found = licenses.scan(docs, queries.PHRASES, queries.TEMPLATES, queries.CONTAINMENT).collect()
    by_id = {r.doc_id: r for r in found}
    for i, text in TEXTS:
        if i is None:
            continue
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
        places = [n for p in queries.PHRASES for n in range(len(words)) if words[n : n + len(p.split())] == p.split()]
        r = by_id[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))


@pytest.mark.parametrize("size, least", [(1, 1), (5, 5), (7, 6), (8, 7), (20, 17)])
def test_needed(size, least):
    assert licenses.needed(size, 0.85) == least


# -- URLs


def url_tokens(url):
    if url is None or "://" not in url:
        return frozenset()
    scheme, rest = url.split("://", 1)
    main, _, fragment = rest.partition("#")
    main, _, query = main.partition("?")
    host, slash, path = main.partition("/")
    lower = lambda s: s.translate(str.maketrans(url_filters.UPPER, url_filters.LOWER))
    found = ["scheme=" + lower(scheme)] + ["host=" + x for x in lower(host).split(".") if x]
    found += ["path=" + x for x in re.sub("[0-9]+", "0", slash + path).split("/") if x]
    found += ["query=" + x.split("=")[0] for x in query.split("&") if x.split("=")[0]]
    return frozenset(found + (["fragment=" + fragment] if fragment else []))


def labelled_urls():
    rng = np.random.default_rng(8)
    rows = []
    for n in range(400):
        host = ["news.example.org", "blog.example.net", "win.example.com", "a.example.com"][int(rng.integers(0, 4))]
        url = f"http{'s' * int(rng.integers(0, 2))}://{host}/{'en' if rng.random() < 0.5 else 'de'}/{n}{'?ref=x&p=1' if rng.random() < 0.3 else ''}"
        rows.append((n, url, bool(rng.random() < (0.8 if "win" in host and "ref" in url else 0.1))))
    return rows


def test_mining_against_all_combinations(spark):
    rows = labelled_urls()
    urls = spark.createDataFrame([(n, u) for n, u, _ in rows] + [(900, None), (901, "no url")], "page_id long, url string")
    labels = spark.createDataFrame([(n, bad) for n, _, bad in rows] + [(900, True), (5000, True), (3, None)], "page_id long, bad boolean")
    support, confidence = 0.02, 0.6
    found = url_filters.mine(spark, urls, labels, support, 5, confidence).collect()
    counts, bads = collections.Counter(), collections.Counter()
    for _, url, bad in rows:
        tokens = sorted(url_tokens(url))
        for size in range(1, len(tokens) + 1):
            for combination in itertools.combinations(tokens, size):
                counts[combination] += 1
                bads[combination] += bad
    least = max(5, support * len(rows))
    same = {}
    for combination in counts:  # the URLs that have it, and all tokens that these share
        having = [url_tokens(url) for _, url, _ in rows if url_tokens(url) >= set(combination)]
        same[combination] = frozenset.intersection(*having)
    whole = [c for c in counts if set(c) == same[c]]
    expected = {c: (bads[c], bads[c] / counts[c]) for c in whole if bads[c] >= least and bads[c] / counts[c] >= confidence}
    assert expected and {tuple(r.tokens): (r.support, r.confidence) for r in found} == expected
    rules = spark.createDataFrame(found, url_filters.RULES)
    judged = url_filters.judge(urls, rules, {}).collect()
    for r in judged:
        url = dict((n, u) for n, u, _ in rows).get(r.page_id)
        matching = [c for c in expected if set(c) <= url_tokens(url)]
        assert r.verdict == ("block" if matching else "allow") and r.rule is None
        assert r.confidence == (max(expected[c][1] for c in matching) if matching else None)


def test_a_long_url_that_repeats_gives_one_rule(spark):
    """40 segments are 2^42 combinations, all of which the same URLs have."""
    long = "http://a.example.com/" + "/".join(f"s{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(40))
    rows = [(n, long, True) for n in range(1000)] + [(1000 + n, f"http://b.example.com/x/{chr(97 + n % 7)}", False) for n in range(500)]
    rows += [(2000 + n, "http://a.example.com/saa", n < 30) for n in range(60)]
    urls = spark.createDataFrame([(n, u) for n, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(n, bad) for n, _, bad in rows], "page_id long, bad boolean")
    found = url_filters.mine(spark, urls, labels, 0.002, 20, 0.5).collect()
    short = {"scheme=http", "host=a", "host=example", "host=com", "path=saa"}
    everywhere = {"scheme=http", "host=example", "host=com"}
    assert {frozenset(r.tokens): (r.support, r.confidence) for r in found} == {
        url_tokens(long): (1000, 1.0),
        frozenset(short): (1030, 1030 / 1060),
        frozenset(everywhere): (1030, 1030 / 1560),
    }


def test_tokens_of_the_same_sets_are_one_item(spark):
    sets = spark.createDataFrame([(["a", "b", "c"], 2), (["a", "c", "d"], 1), (["e", "f"], 0)], "tokens array<string>, bad long")
    found = {r.item: (r.members, r.bad) for r in url_filters.together(sets).collect()}
    assert found == {"a": (["a", "c"], 3), "b": (["b"], 2), "d": (["d"], 1)}


def test_a_hot_token_set_is_dealt_to_all_tasks(spark):
    sets = spark.createDataFrame([(["a", "b"], 100_500), (["a"], 3), (["c"], 0)], "tokens array<string>, bad long").coalesce(1)
    found = url_filters.transactions(sets)
    assert {tuple(r["items"]): r["count"] for r in found.groupBy("items").count().collect()} == {("a", "b"): 100_500, ("a",): 3}
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 4 and max(tasks) < 30_000


def test_without_labels_there_are_no_rules(spark):
    urls = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    rules = url_filters.mine(spark, urls, none, 0.01, 1, 0.5)
    assert rules.count() == 0
    assert url_filters.judge(urls.limit(0), rules, queries.URL_RULES).count() == 0


GIVEN = {
    "HTTP://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
    None: ("", "", None, "allow"),
    "foo": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "http://net": ("net", "", None, "allow"),
    "http://net/": ("net", "/", "net/", "block"),
    "x://example.com/de/1": ("example.com", "/de/1", "example.com/de/", "block"),
    "x://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"),
    "a://b://c": ("b:", "//c", None, "allow"),
    "http://sub.org?x=/fr/": ("sub.org", "", None, "allow"),
    "http://xnet/": ("xnet", "/", None, "allow"),
    "http://ÄA.org/fr/#": ("Äa.org", "/fr/", "org/fr/", "allow"),
    "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
    "http://" + "a" * 20000 + ".net/" + "b" * 20000: ("a" * 20000 + ".net", "/" + "b" * 20000, "net/", "block"),
}


def test_given_rules(spark):
    urls = [*GIVEN, "http://net/"]
    rows = spark.createDataFrame([(n, u, "x", "y") for n, u in enumerate(urls)], "page_id long, url string, host string, tokens string")
    found = url_filters.judge(rows, spark.createDataFrame([], url_filters.RULES), queries.URL_RULES).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found} == {n: GIVEN[u] for n, u in enumerate(urls)}


def test_op1_judges_every_page(spark):
    rows = queries.op1_url_filters(spark, SMALL).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.verdict == (queries.URL_RULES[r.rule] if r.rule else "block" if r.mined_rule else "allow")


# -- queries and pipeline

NATIVE = ("op1_url_filters", "op8_licenses")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(name, spark):
    problem, _ = compare.difference(name, spark, compare.duck(SMALL), SMALL)
    assert problem is None, problem


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_hold_no_python(name, spark):
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_all_are_registered():
    import __spark_entry__ as entry

    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())


@pytest.fixture(scope="module")
def corpus(spark):
    """A folder with planted rows: toxic texts, copies, near copies, a shared passage; clean ones."""
    rng = np.random.default_rng(6)
    words = ["".join(chr(97 + int(x)) for x in rng.integers(0, 26, int(rng.integers(3, 9)))) for _ in range(3000)]
    text = lambda n: " ".join(words[int(i)] for i in rng.integers(0, 3000, n))
    docs = {i: text(int(rng.integers(80, 300))) for i in range(400)}
    for i in range(0, 400, 4):
        docs[i] = f"you worthless {docs[i]} stupid disgusting clown {text(20)}"
    passage = text(80)
    docs |= {1001: docs[1], 1002: docs[1], 1003: docs[2] + " more", 1101: text(100) + passage + text(100), 1102: passage + text(100)}
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    path = files.new_path(spark, "corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, dict((r[0], r[1]) for r in rows), passage


def test_stages_take_effect(spark, corpus):
    path, texts, passage = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "suffix_dedup", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out, _ = files.written(stage(spark, docs, path), name)
        if name != "packing":
            assert out.schema == docs.schema
            kept[name] = {r.doc_id: r.text for r in out.collect()}
        docs = out
    toxic = {i for i in range(400) if i % 4 == 0}
    gone = set(texts) - set(kept["toxicity"])
    assert len(gone & toxic) > 90 and len(gone - toxic) < 5
    near = kept["simhash_dedup"]
    assert set(near) <= set(kept["toxicity"]) and not {1001, 1002} & set(near)
    assert len(set(kept["toxicity"]) - set(near)) <= 5  # copies, near copies and the two empty texts
    final = kept["suffix_dedup"]
    assert set(final) == set(near)
    assert not any(passage[50:-50] in (t or "") for t in final.values())
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in pieces} == set(final) and all(r.n == r["all"] for r in pieces)


def test_run_is_the_stages(spark, corpus):
    path, _, _ = corpus
    found = corpus_pipeline.run(spark, path)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert found.count() > 0
