"""How far the sources of a language differ in the words they use, and by which words.

Word counts come from sorted pointers: over the Arrow buffer of a slice of texts every word start is a
pointer to the bytes that follow, and a multikey quicksort orders the pointers eight bytes at a time,
going deeper only into pointers that still agree. Runs of equal words then yield, per language and
source, the occurrences and the documents, without a Python object for any word. Slices of all tasks
are combined by Spark's aggregation, first within the task.

Group probabilities are whole numbers (billionths, with five added to every count), so results do not
depend on the order of any sum. Distances between sources are summed per shard of terms: a shard holds
some thousand terms of a language and two blocks of its sources as dense matrices, whatever the number of terms
or sources; counts of zero are filled in there and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoscope.llm import files
from geoscope.llm.bpe import in_parts

SLICE_BYTES = 16 << 20
#: Terms in a shard, on average, and sources in a block.
SHARD_TERMS, BLOCK_SOURCES = 2048, 256
SCALE, ADDED = 1_000_000_000, 5

#: What a byte of a text counts as: 0 outside words, A-Z in lower case, all else as it is.
BYTES = np.zeros(256, dtype=np.uint8)
BYTES[0x80:] = np.arange(0x80, 0x100)
BYTES[0x61:0x7B] = BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
#: The first k bytes of an eight-byte key.
FIRST = np.array([0, *(((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(1, 9))], dtype=np.uint64)


def word_pointers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of string or binary texts without nulls: their lower-cased bytes (eight zeros behind), where each word
    starts, how long it is and which text it stands in. Words never cross texts."""
    if len(texts) == 0:
        return np.zeros(8, np.uint8), *(np.zeros(0, np.int64) for _ in range(3))
    _, offsets, raw = texts.buffers()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    borders = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    borders = borders.astype(np.int64)
    low = np.zeros(borders[-1] - borders[0] + 8, dtype=np.uint8)
    if len(low) > 8:
        low[:-8] = BYTES[np.frombuffer(raw, dtype=np.uint8)[borders[0] : borders[-1]]]
    borders -= borders[0]
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = borders[:-1][borders[:-1] < borders[-1]]
    begins[firsts] = inside[firsts]
    stops = inside[:-1] & (~inside[1:] | begins[1:])
    starts = np.flatnonzero(begins)
    sizes = np.flatnonzero(stops) + 1 - starts
    return low, starts, sizes, np.searchsorted(borders, starts, side="right") - 1


def sort_pointers(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pointers' order by their words, equal words in order of place, and which of them begin a run of
    equal words. A multikey quicksort on keys of eight bytes; words hold no zero byte, so a key that
    ends early tells its word's length."""
    at = np.ndarray((len(low) - 7,), dtype=">u8", buffer=low, strides=(1,))

    def keys(pointers: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(sizes[pointers] - depth, 0, 8)
        place = np.where(left > 0, starts[pointers] + depth, 0)
        return at[place].astype(np.uint64) & FIRST[left]

    def fresh_of(values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1]])

    def still_open(places: np.ndarray, new: np.ndarray, depth: int) -> np.ndarray:
        """Of places that hold whole runs: those in runs of several words that go on."""
        alone = new & np.append(new[1:], True)
        return places[~alone & (sizes[order[places]] >= depth)]

    everything = np.arange(len(starts))
    key = keys(everything, 0)
    order = np.argsort(key, kind="stable")
    fresh = fresh_of(key[order])
    depth = 8
    places = still_open(everything, fresh, depth)
    while len(places):
        run = np.cumsum(fresh[places])
        key = keys(order[places], depth)
        by = np.lexsort((key, run))
        order[places] = order[places][by]
        fresh[places] |= fresh_of(key[by])
        depth += 8
        places = still_open(places, fresh[places], depth)
    return order, fresh


def slice_counts(texts: pa.Array, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of the texts, each text being of the group with the given number: (term, group, occurrences,
    texts), one entry for each term and group that has it."""
    low, starts, sizes, text = word_pointers(texts)
    order, fresh = sort_pointers(low, starts, sizes)
    if not len(order):
        return pa.array([], pa.string()), *(np.zeros(0, np.int64) for _ in range(3))
    run, text = np.cumsum(fresh) - 1, text[order]
    first = np.flatnonzero(fresh | np.append(True, text[1:] != text[:-1]))  # of each term in each text
    times = np.diff(np.append(first, len(order)))
    code = run[first] * (int(groups.max()) + 1) + groups[text[first]]
    by = np.argsort(code, kind="stable")
    code, times = code[by], times[by]
    heads = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    term, group = np.divmod(code[heads], int(groups.max()) + 1)
    leader = order[np.flatnonzero(fresh)]
    length = sizes[leader]
    ends = np.cumsum(length)
    spelled = low[np.repeat(starts[leader] - (ends - length), length) + np.arange(ends[-1])]
    borders = np.concatenate([[0], ends]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(leader), [None, pa.py_buffer(borders), pa.py_buffer(spelled)])
    return terms.take(pa.array(term)), group, np.add.reduceat(times, heads), np.diff(np.append(heads, len(code)))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, df``: occurrences of a term in a group and the rows of the group that have it;
    a null ``term`` stands for the group itself (``n`` 0, ``df`` its rows). Nulls count as empty strings;
    repeated rows count each; other columns are not read; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, "text", SLICE_BYTES):
                named = pa.table([part.column("lang"), part.column("source")], ["lang", "source"])
                each = named.append_column("row", pa.array(np.arange(part.num_rows))).group_by(["lang", "source"], use_threads=False)
                groups = each.aggregate([("row", "list"), ("row", "count")])
                owner = np.zeros(part.num_rows, dtype=np.int64)
                rows = groups.column("row_list").combine_chunks()
                owner[rows.flatten().to_numpy()] = np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy()))
                terms, group, times, texts = slice_counts(part.column("text"), owner)
                whole = np.arange(groups.num_rows)
                of = pa.array(np.concatenate([group, whole]))
                yield pa.RecordBatch.from_arrays(
                    [
                        groups.column("lang").combine_chunks().take(of),
                        groups.column("source").combine_chunks().take(of),
                        pa.concat_arrays([terms, pa.nulls(len(whole), pa.string())]),
                        pa.array(np.concatenate([times, np.zeros_like(whole)])),
                        pa.array(np.concatenate([texts, groups.column("row_count").to_numpy()])),
                    ],
                    ["lang", "source", "term", "n", "df"],
                )

    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = read.mapInArrow(run, "lang string, source string, term string, n bigint, df bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _billionths(count: str, total: str, terms: str) -> Column:
    """The share of a count, each term's count raised by ADDED; in whole numbers throughout."""
    return F.expr(f"1 + (cast({SCALE} as decimal(12, 0)) * ({count} + {ADDED})) div ({total} + {ADDED} * {terms})")


def _shard_sums(table: pa.Table, block_sources: int) -> pa.Table:
    """Sums of |p - p'| over the terms of one shard, for sources of one block against those of another. Rows
    without a term give a source's p where it lacks the term, and the number of terms in the shard."""
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    known = table.column("term").is_valid().to_numpy()
    number, p = table.column("number").to_numpy(), table.column("p").to_numpy()
    names, terms = table.column("source").to_numpy(), table.column("terms").to_numpy()[~known]
    by = np.argsort(number[~known])
    numbers, without, names = number[~known][by], p[~known][by], names[~known][by]
    code = table.column("term").filter(pa.array(known)).combine_chunks().dictionary_encode()
    width = len(code.dictionary)
    dense = np.repeat(without[:, None], width, axis=1)
    dense[np.searchsorted(numbers, number[known]), code.indices.to_numpy()] = p[known]
    block = numbers // block_sources
    a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
    rest = int(terms[0]) - width
    out = [(i, b, np.abs(dense[i] - dense[b]).sum(axis=1) + rest * np.abs(without[i] - without[b])) for i in a]
    one = np.concatenate([np.full(len(b), i) for i, _, _ in out]) if out else np.zeros(0, int)
    other = np.tile(b, len(out))
    value = np.concatenate([v for *_, v in out]) if out else np.zeros(0, np.int64)
    if low != high:
        one, other, value = np.append(one, other), np.append(other, one), np.append(value, value)
    use = one != other
    lang = pa.array([table.column("lang")[0].as_py()] * int(use.sum()), pa.string())
    pick = lambda index: pa.array(names[index[use]], pa.string())
    return pa.table([lang, pick(one), pick(other), pa.array(value[use])], ["lang", "source", "item", "value"])


def audit(
    docs: DataFrame,
    min_docs: int = 30,
    top_terms: int = 50,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    shard_terms: int = SHARD_TERMS,
    block_sources: int = BLOCK_SOURCES,
) -> DataFrame:
    """``lang, source, part, item, value, rank``. Part ``pair``: every other source of the language, by the
    summed difference of the two sources' shares of all terms that at least ``min_docs`` rows of the
    language have. Part ``term``: the terms a source has that stand out most against its whole language.

    Nulls count as empty strings; repeated rows count each; a source without terms is compared like any
    other; an empty table gives no rows. Ties in ``value`` go to the smaller ``item``. ``shard_terms`` and
    ``block_sources`` bound a task's matrices and change no result."""
    counts, _ = files.written(term_counts(docs, text_col, lang_col, source_col), "term_counts")
    spoken = counts.filter("term IS NOT NULL")
    kept, _ = files.written(
        spoken.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df")).filter(F.col("df") >= min_docs).drop("df"),
        "kept_terms",
    )
    used, _ = files.written(spoken.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "used_terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    sizes = used.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    in_lang = Window.partitionBy("lang")
    groups, _ = files.written(
        counts.filter("term IS NULL")
        .select("lang", "source")
        .join(sizes, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .fillna(0, ["group_n", "terms", "lang_n"])
        .withColumns(
            {
                "number": F.row_number().over(in_lang.orderBy("source")) - 1,
                "blocks": F.ceil(F.count("*").over(in_lang) / block_sources).cast("int"),
                "shards": F.greatest(F.ceil(F.col("terms") / shard_terms), F.lit(1)).cast("bigint"),
            }
        ),
        "sources",
    )
    shared = used.join(groups, ["lang", "source"]).withColumns(
        {"p": _billionths("n", "group_n", "terms"), "q": _billionths("total", "lang_n", "terms")}
    )
    over = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term_part = (
        shared.filter("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(over))
        .filter(F.col("rank") <= top_terms)
    )

    shard = F.pmod(F.xxhash64("term"), F.col("shards"))
    shard_sizes = (
        kept.join(groups.select("lang", "shards").distinct(), "lang").groupBy("lang", shard.alias("shard")).agg(F.count("*").alias("in_shard"))
    )
    bare = (
        groups.withColumn("p", F.when(F.col("terms") > 0, _billionths("0", "group_n", "terms")).otherwise(0))
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)))
        .join(shard_sizes, ["lang", "shard"], "left")
        .select("lang", "source", "number", "blocks", "shard", F.lit(None).cast("string").alias("term"), "p", F.coalesce("in_shard", F.lit(0)).alias("terms"))
    )
    told = shared.select("lang", "source", "number", "blocks", shard.alias("shard"), "term", "p", F.lit(0).cast("bigint").alias("terms"))
    own, other = F.expr(f"number div {block_sources}"), F.col("other")
    dealt = (
        told.unionByName(bare)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)))
        .select("lang", "shard", F.least(own, other).alias("low"), F.greatest(own, other).alias("high"), "source", "number", "term", "p", "terms")
    )
    sums = dealt.groupBy("lang", "shard", "low", "high").applyInArrow(lambda table: _shard_sums(table, block_sources), "lang string, source string, item string, value bigint")
    pair_part = (
        sums.groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        .withColumn("rank", F.row_number().over(over))
    )
    return pair_part.unionByName(term_part)
