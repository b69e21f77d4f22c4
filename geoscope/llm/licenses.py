"""License scans: phrases that stand in a text, and text blocks that contain a license template.

The second part is an exact set-similarity join. A block is a line of a text, or a stretch of consecutive
words over any number of lines, as the set of its words; it matches a template when it holds at least
``threshold`` of the template's words. A stretch has as many words as a template (``threshold`` of which
suffice, so it is as much longer), and counts no words of lines that match the template by themselves.
So a notice is found however it is wrapped. For lines, words are ordered by how many lines they stand
in, rarest first, over the whole table. Then

* length: a block with fewer words of all templates than a match needs is dropped in the scan;
* prefix: a match must share one of the template's rarest ``size - needed + 1`` words, so blocks meet
  templates through these words only, the rarest ones;
* position: the words after the shared one must suffice on both sides for the rest of the match;

and what remains is counted exactly. Stretches are looked for only in texts that hold enough words of a
template anywhere, by a window over the places of its words. Only functions of DataFrames are used. The templates are a
parameter; tables of their words are bounded by it, and nothing else is sent around. Lines are
collapsed to sets of template words before they meet the templates, so a line that stands in a third
of all texts is one row there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoscope.llm import files

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is not part of a word: ASCII without a-z and 0-9, after lower-casing.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str


def spelled(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, one space between them."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS, " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_columns(words: Column, phrases: dict[str, str]) -> dict[str, Column]:
    """``n_words, n_base, first_word, last_word, found`` (labels of the phrases) of a text's words as
    :func:`spelled` gives them."""
    either = "(?:" + "|".join(sorted(phrases, key=len, reverse=True)) + ")"
    text = F.concat(F.lit(" "), words, F.lit(" "))
    n_base = F.regexp_count(text, F.lit(f"(?<= ){either}(?= )"))
    place = lambda pattern: F.when(n_base > 0, (_spaces(F.regexp_extract(text, pattern, 1)) - 1).cast("bigint"))
    return {
        "n_words": F.when(words == "", 0).otherwise(_spaces(words) + 1).cast("bigint"),
        "n_base": n_base.cast("bigint"),
        "first_word": place(f"(?s)^(.*? ){either} "),
        "last_word": place(f"(?s)^(.* ){either} "),
        "found": F.filter(
            F.array(*[F.when(F.contains(text, F.lit(f" {p} ")), F.lit(label)) for p, label in phrases.items()]),
            lambda x: x.isNotNull(),
        ),
    }


def _template_text(template: Template) -> list[str]:
    import re

    return re.sub(BREAKS, " ", template.text.translate(str.maketrans(UPPER, LOWER))).split()


def template_words(template: Template) -> list[str]:
    return sorted(set(_template_text(template)))


def needed(size: int, threshold: float) -> int:
    """The fewest shared words of a match."""
    return max(1, next(n for n in range(size + 1) if n >= threshold * size - 1e-9))


def _vocabulary(templates: list[Template]) -> Column:
    return F.array(*map(F.lit, sorted({w for t in templates for w in template_words(t)})))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def held_words(text: Column, templates: list[Template]) -> Column:
    """Of each line of a text the template words it holds, sorted."""
    vocabulary = _vocabulary(templates)
    return F.transform(_lines(text), lambda line: F.array_sort(F.array_intersect(F.split(spelled(line), " "), vocabulary)))


def template_sets(held: Column, templates: list[Template], threshold: float) -> Column:
    """Of the lines' template words those that could suffice for any template."""
    least = min(needed(len(template_words(t)), threshold) for t in templates)
    return F.filter(held, lambda words: F.size(words) >= least)


def open_templates(held: Column, templates: list[Template], threshold: float) -> Column:
    """The numbers of the templates of which the whole text holds enough words, in any lines."""
    words = F.array_distinct(F.flatten(held))
    enough = lambda own: F.size(F.array_intersect(words, F.array(*map(F.lit, own)))) >= needed(len(own), threshold)
    return F.filter(F.array(*[F.when(enough(template_words(t)), F.lit(n)) for n, t in enumerate(templates)]), lambda n: n.isNotNull())


def placed_words(text: Column, templates: list[Template]) -> Column:
    """The template words of a text, each with the numbers of its line and of its place among all words."""
    spread = F.flatten(
        F.transform(
            _lines(text),
            lambda line, n: F.transform(
                F.filter(F.split(spelled(line), " "), lambda word: word != ""),
                lambda word: F.struct(word.alias("word"), n.alias("line")),
            ),
        )
    )
    placed = F.transform(spread, lambda x, at: F.struct(x["word"].alias("word"), x["line"].alias("line"), at.alias("at")))
    vocabulary = _vocabulary(templates)
    return F.filter(placed, lambda x: F.array_contains(vocabulary, x["word"]))


def similar_stretches(texts: DataFrame, templates: list[Template], threshold: float, row: str) -> DataFrame:
    """``row, label, score`` as :func:`similar_blocks`, for stretches of words over any lines. ``texts`` has the
    columns ``open`` and ``placed`` of :func:`open_templates` and :func:`placed_words`."""
    given = texts.sparkSession.createDataFrame(
        [
            (n, t.label, word, len(words), needed(len(words), threshold), math.ceil(len(_template_text(t)) / threshold))
            for n, t in enumerate(templates)
            for words in [template_words(t)]
            for word in words
        ],
        "template int, label string, word string, size int, needed int, reach int",
    )
    places = texts.filter(F.size("open") > 0).select(row, "open", F.explode("placed").alias("x")).select(row, "x.*", F.explode("open").alias("template"))
    hits = places.join(F.broadcast(given), ["template", "word"])  # a row for each word of a template
    line = Window.partitionBy(row, "template", "line")
    rest = hits.withColumn("own", F.size(F.collect_set("word").over(line))).filter("own < needed")
    # at / reach differs by less than one inside a stretch
    stretch = f"collect_set(word) OVER (PARTITION BY `{row}`, template ORDER BY at / reach RANGE BETWEEN CURRENT ROW AND 0.999999D FOLLOWING)"
    held = rest.select(row, "label", "size", "needed", F.size(F.expr(stretch)).alias("shared"))
    return held.filter("shared >= needed").groupBy(row, "label").agg(F.max(F.col("shared") / F.col("size")).alias("score"))


def similar_blocks(blocks: DataFrame, templates: list[Template], threshold: float, row: str) -> DataFrame:
    """``row, label, score``: for every row and label whose template one of the row's blocks contains to at
    least ``threshold``, the largest containment (shared words over the template's). ``blocks`` has a row
    for each set of ``words`` that :func:`template_sets` gives."""
    spark = blocks.sparkSession
    sets = blocks.groupBy("words").agg(F.count("*").alias("times"))
    sizes = [
        (n, t.label, words, needed(len(words), threshold)) for n, t in enumerate(templates) for words in [template_words(t)]
    ]
    given = spark.createDataFrame(sizes, "template int, label string, template_words array<string>, needed int")
    # rarest first: the template words in the order of the number of blocks they stand in
    counted = sets.select(F.explode("words").alias("word"), "times").groupBy("word").agg(F.sum("times").alias("blocks"))
    used = given.select(F.explode("template_words").alias("word")).distinct().join(counted, "word", "left")
    ranked = used.select(F.struct(F.coalesce("blocks", F.lit(0)).alias("blocks"), "word").alias("rank"), "word")

    def in_order(sets: DataFrame, column: str) -> DataFrame:
        words = sets.select(*sets.columns, F.explode(column).alias("word")).join(F.broadcast(ranked), "word")  # template words
        ordered = words.groupBy(*sets.columns).agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
        return ordered.select(*sets.columns, F.transform("ranks", lambda r: r["word"]).alias("ordered"))

    index = in_order(given, "template_words").select(
        "template",
        "label",
        "needed",
        F.col("ordered").alias("template_words"),
        F.posexplode(F.expr("slice(ordered, 1, size(ordered) - needed + 1)")).alias("at", "word"),
    )
    probes = in_order(sets.select("words"), "words").select("words", F.posexplode("ordered").alias("place", "word"))
    met = probes.join(F.broadcast(index), "word")  # a few rows for each template
    after = F.least(F.size("words") - F.col("place"), F.size("template_words") - F.col("at"))
    shared = F.size(F.array_intersect("words", "template_words"))
    # a pair can meet by several prefix words; its first one decides, by position, whether it can match
    candidates = met.groupBy("words", "template", "label", "needed", "template_words").agg(
        F.min(F.struct("at", "place", after.alias("after"))).alias("first")
    )
    matched = (
        candidates.filter(F.col("first.after") >= F.col("needed"))
        .select("words", "label", "needed", F.size("template_words").alias("size"), shared.alias("shared"))
        .filter("shared >= needed")
        .groupBy("words", "label")
        .agg(F.max(F.col("shared") / F.col("size")).alias("score"))
    )
    return blocks.join(matched, "words").groupBy(row, "label").agg(F.max("score").alias("score"))


def scan(
    docs: DataFrame,
    phrases: dict[str, str],
    templates: list[Template],
    threshold: float,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """For every row: ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places where a phrase's words stand consecutively, ``first_word`` and
    ``last_word`` are the smallest and largest word they start at (null without any), ``base_labels``
    their labels. ``labels`` adds those of the templates a line or a stretch of the text contains; ``score`` is 1 with
    a phrase, else the largest containment found, else 0. Null texts count as empty; repeated rows are
    reported each."""
    words = docs.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.col(text_col).alias("text"),
        spelled(F.col(text_col)).alias("words"),
        held_words(F.col(text_col), templates).alias("held"),
    ).withColumn("open", open_templates(F.col("held"), templates, threshold))
    sets = template_sets(F.col("held"), templates, threshold).alias("sets")
    placed = F.when(F.size("open") > 0, placed_words(F.col("text"), templates)).alias("placed")
    # the one pass over the texts; row numbers are stable once written
    base, _ = files.written(words.select("id", "row", sets, "open", placed, *[c.alias(n) for n, c in phrase_columns(F.col("words"), phrases).items()]), "lines")
    blocks = base.select("row", F.explode("sets").alias("words"))
    stretches = similar_stretches(base, templates, threshold, "row")
    similar = similar_blocks(blocks, templates, threshold, "row").unionByName(stretches).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("score").alias("most")
    )  # at most a label for each template
    none = F.array().cast("array<string>")
    joined = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    return base.join(similar, "row", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("found")).alias("base_labels"),
        joined(F.concat("found", F.coalesce("more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )
