"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoscope.llm import bpe, divergence, files, licenses, packing, quality, simhash, suffix, token_files, topk, toxicity, tries, url_filters, vector_dedup

Build = Callable[[SparkSession, str], DataFrame]

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

END_ID, CAPACITY = 2, 4096
SHINGLE_WORDS, SIMHASH_DISTANCE = 3, 3
REPEATED_BYTES = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    files.bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, END_ID, CAPACITY)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = files.new_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), out, WORD_BPE, END_ID)
    return token_files.digests(token_files.read(spark, out))


#: The given rules.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
URL_SUPPORT, URL_COUNT, URL_CONFIDENCE = 0.002, 20, 0.5


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    rules, _ = files.written(url_filters.mine(spark, pages, labels, URL_SUPPORT, URL_COUNT, URL_CONFIDENCE), "rules")
    return url_filters.judge(pages, rules, URL_RULES)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), SHINGLE_WORDS, SIMHASH_DISTANCE)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removals(table(spark, sf_dir, "documents"), REPEATED_BYTES)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.is_held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


#: Phrases and labels of the base part.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = [
    licenses.Template("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    licenses.Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    ),
    licenses.Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    licenses.Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    licenses.Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation.",
    ),
    licenses.Template(
        "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."
    ),
    licenses.Template("mit", "Released under the MIT License."),
    licenses.Template(
        "mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ),
]
CONTAINMENT = 0.85


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), PHRASES, TEMPLATES, CONTAINMENT)


def _op8_sql() -> str:
    """The same by plain counting: every line against every template."""
    breaks = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = f"translate(coalesce({{}}, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
    spelled = f"trim(regexp_replace({lower}, '{breaks}', ' ', 'g'))"
    values = ", ".join(
        f"({n}, '{t.label}', {words}, {licenses.needed(len(words), CONTAINMENT)})"
        for n, t in enumerate(TEMPLATES)
        for words in [licenses.template_words(t)]
    )
    places = " UNION ALL ".join(
        f"""SELECT rid, '{label}' AS label, i - 1 AS pos FROM split, unnest(range(1, len(words) + 1)) AS u(i)
        WHERE words[i : i + {len(phrase.split()) - 1}] = {phrase.split()}"""
        for phrase, label in PHRASES.items()
    )
    return f"""
    WITH numbered AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
    spelled AS (SELECT rid, doc_id, {spelled.format("text")} AS s FROM numbered),
    split AS (SELECT rid, doc_id, CASE WHEN s = '' THEN [] ELSE string_split(s, ' ') END AS words FROM spelled),
    places AS ({places}),
    base AS (SELECT rid, count(*) AS n, min(pos) AS first, max(pos) AS last, list(DISTINCT label) AS labels FROM places GROUP BY rid),
    templates(template, label, words, needed) AS (VALUES {values}),
    lines AS (SELECT rid, list_distinct(string_split({spelled.format("line")}, ' ')) AS words
        FROM (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM numbered)),
    shared AS (SELECT l.rid, t.label, len(list_intersect(l.words, t.words)) AS n, t.needed, len(t.words) AS size
        FROM lines AS l, templates AS t WHERE len(l.words) >= t.needed),
    more AS (SELECT rid, list(DISTINCT label) AS labels, max(n::double / size::double) AS score FROM shared WHERE n >= needed GROUP BY rid)
    SELECT doc_id, len(words)::bigint AS n_words, coalesce(n, 0)::bigint AS n_base, first::bigint AS first_word,
        last::bigint AS last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
        CASE WHEN n > 0 THEN 1.0::double ELSE coalesce(more.score, 0.0)::double END AS score
    FROM split LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)"""


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "embeddings").filter(topk.is_valid(F.col("embedding")))
    scaled = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return topk.top_k(found.select("vec_id", scaled.alias("vector")), F.col("vec_id") % 50 == 0, 5)


OP9_SQL = """
    WITH vectors AS (SELECT row_number() OVER () AS rid, vec_id,
        list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id,
        list_inner_product(q.v::double[], c.v::double[])::bigint AS score
        FROM vectors AS q, vectors AS c WHERE q.vec_id % 50 = 0 AND q.rid <> c.rid),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::int AS rank FROM scores)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


TERM_DOCS, TOP_TERMS = 30, 50


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), TERM_DOCS, TOP_TERMS)


OP11_SQL = f"""
    WITH read AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}') AS s FROM documents),
    words AS (SELECT rid, lang, source, unnest(regexp_extract_all(s, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM read),
    groups AS (SELECT DISTINCT lang, source FROM read),
    kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= {TERM_DOCS}),
    counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    every AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n
        FROM groups AS g JOIN kept AS k USING (lang) LEFT JOIN counts AS c USING (lang, source, term)),
    shares AS (SELECT lang, source, term, n,
        1 + ({divergence.SCALE}::hugeint * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p,
        1 + ({divergence.SCALE}::hugeint * (total + 5)) // (sum(total) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS q
        FROM every),
    apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    found AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0)::bigint AS value
        FROM groups AS g JOIN groups AS o ON g.lang = o.lang AND g.source <> o.source
        LEFT JOIN apart AS a ON a.lang = g.lang AND a.source = g.source AND a.item = o.source
        UNION ALL SELECT lang, source, 'term', term, (p - q)::bigint FROM shares WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM found)
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}"""


CONVERSATION_GROUP, BORROWED_BELOW = 100, 6


def op12_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered, convs = tries.turns(table(spark, sf_dir, "conversations"))
    borrow = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED_BELOW
    return tries.build(*tries.opened_alike(ordered, convs, CONVERSATION_GROUP, borrow, BORROWED_BELOW))


#: Paths are lists of (role, text); the checksum goes bit by bit over the digits of an id.
OP12_SQL = f"""
    WITH ordered AS (SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS own
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    checked AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(conv_id::varchar) + 1),
        lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint)), lambda crc, digit: list_reduce(list_prepend(xor(crc, digit), range(8)),
        lambda a, _: xor(a >> 1, (a & 1) * 3988292384))), 4294967295) % {BORROWED_BELOW} AS h FROM ordered),
    rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.own[1 : c.h], []), c.own[c.h + 1 :]) AS path
        FROM checked AS c LEFT JOIN ordered AS b ON b.conv_id = c.conv_id - c.conv_id % {CONVERSATION_GROUP}),
    prefixes AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM rebuilt),
    nodes AS (SELECT path[1 : depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CASE WHEN len(path) = depth THEN conv_id::varchar END, ',' ORDER BY conv_id), '')) AS ends_sha256
        FROM prefixes GROUP BY 1, 2),
    linked AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes AS n LEFT JOIN nodes AS p
        ON p.depth = n.depth - 1 AND p.path = n.path[1 : n.depth - 1]),
    children AS (SELECT path[1 : depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
    shares AS (SELECT l.*, coalesce(c.n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(l.path[-1][2]) END AS saved
        FROM linked AS l LEFT JOIN children AS c ON c.path = l.path),
    climbed AS (SELECT path[1 : up] AS path, sum((n_children = 0)::int) AS n_leaves, sum(saved) AS saved_tokens
        FROM (SELECT path, n_children, saved, unnest(range(depth + 1)) AS up FROM shares) GROUP BY 1)
    SELECT conv_id::bigint AS conv_id, depth::bigint AS depth, parent_conv_id::bigint AS parent_conv_id, n_convs::bigint AS n_convs,
        n_children::bigint AS n_children, n_leaves::bigint AS n_leaves, saved_tokens::bigint AS saved_tokens, ends_sha256
    FROM shares JOIN climbed USING (path)"""


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        toxicity.is_held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


QUERIES: dict[str, Build] = {f.__name__: f for f in (op1_url_filters, op2_simhash, op3_bpe, op4_vector_dedup, op5_packing, op6_suffix, op7_toxicity, op8_licenses, op9_topk, op10_token_files, op11_divergence, op12_tries, op13_quality)}
ORACLES: dict[str, str] = {"op8_licenses": _op8_sql(), "op9_topk": OP9_SQL, "op11_divergence": OP11_SQL, "op12_tries": OP12_SQL}
