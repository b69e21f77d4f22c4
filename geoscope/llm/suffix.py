"""Removal of byte strings that stand elsewhere too: suffix-array deduplication.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Texts are bytes,
matches never cross texts.

*Who can match.* Of the ``GRAM``-byte strings inside a window of ``length`` bytes the one with the least
hash is the window's anchor; equal windows have equal anchors at equal places. So windows are grouped
by anchor, and only anchors that occur twice go on, with the stretch of text whose windows they own.
Equal stretches are collapsed and counted, equal texts likewise, before anything is shuffled by anchor.

*Who does match.* The stretches of some anchor groups, a few megabytes, form one string. Its suffixes
are sorted to the depth of a window, which gives the Burrows-Wheeler transform. Common prefixes are
then derived by increasing value: starting with the intervals of short strings, every interval is
extended backward by each byte that precedes its members; where the extended interval ends, the
common prefix of the neighbouring suffixes is known if it was not. This goes on breadth-first and
stops at ``length``: borders still open then separate suffixes that share a whole window.

*Hot anchors.* A group with more than ``GROUP`` different stretches is split: windows are keyed anew by
the part that ``RANGE`` neighbouring window starts have in common, and, where that is not enough, by
themselves; equal ones collapse again. So a passage that a third of all texts share is counted, not
gathered, and no window is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoscope.llm import files
from geoscope.llm.bpe import in_parts

GRAM = 64
RANGE = 8
GROUP = 2000
#: Bytes whose suffixes are sorted together, bar the last group's.
BATCH = 2 << 20
#: A byte that UTF-8 never uses stands between stretches.
BORDER = 0xFF


# -- anchors


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on, by doubling. The last GRAM - 1 are missing."""
    with np.errstate(over="ignore"):
        found = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        size = 1
        while size < GRAM:
            found = found[:-size] * np.uint64(0xD6E8FEB86659FD93) + found[size:]
            found ^= found >> np.uint64(32)
            size *= 2
        found *= np.uint64(0xBF58476D1CE4E5B9)
        found ^= found >> np.uint64(29)
    return found


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    least, size = values, 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int):
    """Of texts laid one after the other: hash, text, first window, number of windows and place after the
    first window of each anchor."""
    whole = sizes >= length
    if not whole.any():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    hashes = gram_hashes(data)
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least(ranked, length - GRAM + 1)
    windows = sizes[whole] - length + 1
    ends = np.cumsum(windows)
    at = np.repeat(starts[whole] - (ends - windows), windows) + np.arange(ends[-1])
    place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(first, len(place)))
    text = np.flatnonzero(whole)[np.searchsorted(ends, first, side="right")]
    return hashes[place[first]].view(np.int64), text, at[first] - starts[text], count, place[first] - at[first]


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """``gram, k1, place`` of every anchor: place packs 16 bits of k2, the first window (32 bits), the number
    of windows and the anchor's place after the first (8 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, "text"):
                raw = part.column("text").cast(pa.binary())
                borders = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
                data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[borders[0] : borders[-1]]
                starts = borders[:-1] - borders[0]
                gram, text, first, count, off = anchors(data, starts, np.diff(borders), length)
                k1, k2 = (part.column(c).to_numpy()[text] for c in ("k1", "k2"))
                place = (k2 & 0xFFFF) << 48 | first << 16 | count << 8 | off
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(k1), pa.array(place)], ["gram", "k1", "place"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "gram bigint, k1 bigint, place bigint")


def _stretches(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """``k1, k2, first, grp, off, stretch``: the text whose windows each of these anchors owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, "text"):
                rows: list[list] = [[], [], [], [], [], []]
                raw = part.column("text").cast(pa.binary()).to_pylist()
                for k1, k2, text, grams, places in zip(*(part.column(c).to_pylist() for c in ("k1", "k2")), raw, *(part.column(c).to_pylist() for c in ("grams", "places"))):
                    for gram, place in zip(grams, places):
                        if place >> 48 & 0xFFFF == k2 & 0xFFFF:
                            first, count = place >> 16 & 0xFFFFFFFF, place >> 8 & 0xFF
                            for column, value in zip(rows, (k1, k2, first, gram, place & 0xFF, text[first : first + count - 1 + length])):
                                column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["k1", "k2", "first", "grp", "off", "stretch"])

    lists = found.groupBy("k1").agg(F.collect_list(F.struct("gram", "place")).alias("own"))  # as long as the text
    joined = texts.join(lists, "k1").select("k1", "k2", "text", F.col("own.gram").alias("grams"), F.col("own.place").alias("places"))
    return joined.mapInArrow(run, "k1 bigint, k2 bigint, first bigint, grp bigint, off int, stretch binary")


# -- suffixes


def sorted_suffixes(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes at least, and the first 8 bytes of each as a
    number. Beyond the end stand BORDERs."""
    n = len(data)
    padded = np.concatenate([data, np.full(8, BORDER, dtype=np.uint8)])
    words = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        words = words << np.uint64(8) | padded[i : i + n]
    order = np.argsort(words, kind="stable")
    fresh = np.concatenate([[True], words[order[1:]] != words[order[:-1]]])
    size = 8
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    while True:
        start = np.flatnonzero(fresh)
        rank[order] = np.repeat(start, np.diff(np.append(start, n)))
        if size >= depth or len(start) == n:
            return order, words[order]
        # only suffixes that still share a rank are sorted further
        tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        suffixes = order[tied]
        key = rank[suffixes] * (n + 1) + rank[np.minimum(suffixes + size, n)] + 1
        again = np.argsort(key, kind="stable")
        order[tied], key = suffixes[again], key[again]
        fresh[tied] = np.concatenate([[True], key[1:] != key[:-1]])
        size *= 2


def shared_windows(data: np.ndarray, length: int) -> np.ndarray:
    """For each place whether the ``length`` bytes from it on also start at another place. Places whose
    bytes hold a BORDER are false."""
    n = len(data)
    out = np.zeros(n, dtype=bool)
    if n < 2:
        return out
    order, words = sorted_suffixes(data, length + 1)
    transform = data[order - 1]  # the byte before each suffix; before the first stands the last, a BORDER
    by_byte = np.argsort(transform, kind="stable")
    to = np.empty(n, dtype=np.int64)  # where a suffix stands when its preceding byte is put in front
    to[by_byte] = np.arange(n)
    sorted_bytes = transform[by_byte]
    same = np.append(sorted_bytes[1:] == sorted_bytes[:-1], False)
    following = np.full(n, n, dtype=np.int64)  # the next place of the transform with the same byte
    following[by_byte[:-1][same[:-1]]] = by_byte[1:][same[:-1]]
    preceding = np.full(n, -1, dtype=np.int64)
    preceding[by_byte[1:][same[:-1]]] = by_byte[:-1][same[:-1]]
    # known[j]: the common prefix of suffixes j - 1 and j is shorter than the value reached
    differ = words[1:] != words[:-1]
    known = np.concatenate([[True], differ, [True]])
    last7 = words >> np.uint64(8)
    borders = np.flatnonzero(known)
    ends = 1 + np.flatnonzero(differ & (last7[1:] == last7[:-1]))  # these share 7 bytes
    begins = borders[np.searchsorted(borders, ends) - 1]
    for _ in range(8, length):
        if not len(ends):
            break
        size = ends - begins
        row = np.repeat(np.arange(len(ends)), size)
        at = np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(len(row))
        last, first = following[at] >= ends[row], preceding[at] < begins[row]
        # both hold one place for each interval and byte; sorted alike they pair up
        keys = row * n + to[at]
        new_ends, new_begins = to[at[last]][np.argsort(keys[last])] + 1, to[at[first]][np.argsort(keys[first])]
        open_ = ~known[new_ends]
        ends, begins = new_ends[open_], new_begins[open_]
        ends, one = np.unique(ends, return_index=True)
        begins = begins[one]
        known[ends] = True
    shared = np.flatnonzero(~known)
    out[order[shared]] = True
    out[order[shared - 1]] = True
    stops = np.append(np.flatnonzero(data == BORDER), n)
    return out & (np.arange(n) + length <= stops[np.searchsorted(stops, np.arange(n))])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    starts = np.flatnonzero(edge == 1)
    return starts, np.flatnonzero(edge == -1) - starts


def _resolve_groups(stretches: DataFrame, length: int) -> DataFrame:
    """``grp, stretch_id, start, size``: runs of window starts in a stretch whose windows stand elsewhere too.
    Takes ``grp, stretch_id, stretch, times``, whole groups of bounded size."""

    def resolve(groups: list[tuple]) -> pd.DataFrame:
        data = np.frombuffer(b"".join(s + bytes([BORDER]) for _, _, s, _ in groups), dtype=np.uint8)
        flags = shared_windows(data, length)
        sizes = np.array([len(s) + 1 for _, _, s, _ in groups])
        starts = np.cumsum(sizes) - sizes
        for at, (_, _, s, times) in zip(starts, groups):
            if times > 1:
                flags[at : at + len(s) - length + 1] = True
        begin, size = _runs(flags)
        owner = np.searchsorted(starts, begin, side="right") - 1
        return pd.DataFrame(
            {
                "grp": np.array([g[0] for g in groups], dtype=np.int64)[owner],
                "stretch_id": np.array([g[1] for g in groups], dtype=object)[owner],
                "start": (begin - starts[owner]).astype(np.int64),
                "size": size.astype(np.int64),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("grp", "stretch_id", "stretch", "times"))):
                if size >= BATCH and row[0] != waiting[-1][0]:
                    yield pa.RecordBatch.from_pandas(resolve(waiting), schema, preserve_index=False)
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[2]) + 1
        if waiting:
            yield pa.RecordBatch.from_pandas(resolve(waiting), schema, preserve_index=False)

    schema = pa.schema([("grp", pa.int64()), ("stretch_id", pa.binary()), ("start", pa.int64()), ("size", pa.int64())])
    together = stretches.select("grp", "stretch_id", "stretch", "times").repartition("grp").sortWithinPartitions("grp", "stretch_id")
    return together.mapInArrow(run, "grp bigint, stretch_id binary, start bigint, size bigint")


def _split(stretches: DataFrame, span: int, length: int) -> DataFrame:
    """Stretches cut to at most ``span`` windows, grouped by what these windows have in common. Windows keep
    their place relative to the anchor, so equal ones stay together. ``up_grp, up_id, up_start`` tell whose
    windows they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for grp, up, off, text, times in zip(*(batch.column(c).to_pylist() for c in ("grp", "stretch_id", "off", "stretch", "times"))):
                windows = len(text) - length + 1
                start = 0
                while start < windows:
                    # the window that starts at i has the anchor at off - i
                    block = (off - start) // span
                    end = min(windows, off - block * span + 1)
                    common = text[off - block * span : off - block * span - span + 1 + length]
                    key = hashlib.blake2b(f"{grp} {block} ".encode() + common, digest_size=8).digest()
                    part = text[start : end - 1 + length]
                    values = (int.from_bytes(key, "little", signed=True), off - start, part, times, grp, up, start)
                    for column, value in zip(rows, values):
                        column.append(value)
                    start = end
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["grp", "off", "stretch", "times", "up_grp", "up_id", "up_start"])

    return stretches.select("grp", "stretch_id", "off", "stretch", "times").mapInArrow(
        run, "grp bigint, off int, stretch binary, times bigint, up_grp bigint, up_id binary, up_start bigint"
    )


def _collapsed(stretches: DataFrame, times) -> DataFrame:
    """Each different stretch of a group once, with how often it stands."""
    return stretches.groupBy("grp", "off", "stretch").agg(times.alias("times")).withColumn("stretch_id", _stretch_id())


def _stretch_id():
    """Names a stretch within its group."""
    return F.unhex(F.md5(F.concat(F.encode(F.concat(F.col("off").cast("string"), F.lit(" ")), "utf-8"), F.col("stretch"))))


def _resolve(stretches: DataFrame, length: int, spans: tuple[int, ...] = (RANGE, 1)) -> DataFrame:
    """``grp, stretch_id, start, size`` for different stretches ``grp, off, stretch, times, stretch_id``."""
    rows, _ = files.written(stretches, "stretches")
    sizes = rows.groupBy("grp").agg(F.count("*").alias("members"), F.sum("times").alias("all_times")).filter("all_times > 1")
    marked = rows.join(sizes, "grp")
    found = _resolve_groups(marked.filter(F.col("members") <= GROUP), length)
    hot, _ = files.written(marked.filter(F.col("members") > GROUP).select(rows.columns), "hot")
    if hot.isEmpty():
        return found
    parts, _ = files.written(_split(hot, spans[0], length).withColumn("stretch_id", _stretch_id()), "parts")
    once = _collapsed(parts, F.sum("times"))
    if len(spans) == 1:  # single windows: equal ones have collapsed, so a count tells
        lower = once.filter("times > 1").select("grp", "stretch_id", F.lit(0).cast("bigint").alias("start"), F.lit(1).cast("bigint").alias("size"))
    else:
        lower = _resolve(once, length, spans[1:])
    lower, _ = files.written(lower, "lower")
    up = parts.join(lower, ["grp", "stretch_id"]).select(
        F.col("up_grp").alias("grp"), F.col("up_id").alias("stretch_id"), (F.col("up_start") + F.col("start")).alias("start"), "size"
    )
    return found.union(up)


# -- texts


def covered(size: int, starts: list[int], sizes: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows that start in these runs, as (start, end)."""
    out: list[list[int]] = []
    for start, end in sorted((a, a + n - 1 + length) for a, n in zip(starts, sizes)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without characters that they hold only a part of."""
    out = []
    for start, end in runs:
        while start < end and text[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def _without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in runs:
        kept.append(text[at:start])
        at = end
    return b"".join([*kept, text[at:]])


def _keys(text) -> list:
    """Two hashes of a text with different seeds; they name it."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def repeated(docs: DataFrame, length: int, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """What becomes of each different text: ``k1, k2, n_bytes, n_removed, n_spans, kept_sha256``, and with
    ``with_text`` ``kept_text``, where characters stay that are covered in part only."""
    if not GRAM <= length < GRAM + 255:
        raise ValueError(f"length must be {GRAM} to {GRAM + 254}")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    distinct = docs.select(*_keys(text), text.alias("text")).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    # bucketed by k1, so that the joins below leave the texts where they are
    path = files.new_path(spark, "texts")
    name = path.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct.repartition(buckets, "k1").write.bucketBy(buckets, "k1").option("path", path).option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)

    twice = _anchor_rows(texts, length).groupBy("gram").agg(F.count("*").alias("times")).filter("times > 1").select("gram")
    again = _anchor_rows(texts, length).join(twice, "gram", "left_semi")
    stretches, _ = files.written(_stretches(texts, again, length).withColumn("stretch_id", _stretch_id()), "found")
    runs, _ = files.written(_resolve(_collapsed(stretches, F.count("*")), length), "runs")
    placed = stretches.select("k1", "k2", "first", "grp", "stretch_id").join(runs, ["grp", "stretch_id"])
    spans = placed.groupBy("k1").agg(F.collect_list(F.struct("k2", (F.col("first") + F.col("start")).alias("start"), "size")).alias("own"))

    names = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string()] * (1 + with_text)
        for batch in batches:
            for part in in_parts(batch, "text"):
                rows: list[list] = [[] for _ in names]
                raw = part.column("text").cast(pa.binary()).to_pylist()
                for k1, k2, copies, own, value in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "copies", "own")), raw):
                    found = [s for s in own or [] if s["k2"] == k2]
                    if copies > 1 and len(value) >= length:
                        gone = [(0, len(value))]
                    else:
                        gone = covered(len(value), [s["start"] for s in found], [s["size"] for s in found], length)
                    kept = _without(value, gone)
                    made = [k1, k2, len(value), len(value) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()]
                    if with_text:
                        made.append(_without(value, whole_characters(value, gone)).decode())
                    for column, one in zip(rows, made):
                        column.append(one)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)

    joined = texts.join(spans, "k1", "left").select("k1", "k2", "copies", "own", "text")
    schema = "k1 bigint, k2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * with_text
    result, _ = files.written(joined.mapInArrow(run, schema), "repeated")
    spark.sql(f"DROP TABLE {name}")
    files.drop(spark, path)
    return result


def removals(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` for every row: bytes, bytes removed, maximal removed
    runs, and the digest of the remaining bytes. Null texts count as empty; repeated rows are copies of each
    other, so from ``length`` bytes on nothing of them stays; an empty table gives no rows."""
    result = repeated(docs, length, text_col)
    rows = docs.select(id_col, *_keys(F.coalesce(F.col(text_col), F.lit(""))))
    return rows.join(result, ["k1", "k2"]).select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cleaned(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with what stands elsewhere too removed from their texts, whole characters only.
    All rows stay, null texts too, and so do all other columns, whatever their names; an empty table stays empty."""
    result = repeated(docs, length, text_col, with_text=True)
    kept = result.filter("n_removed > 0").select("k1", "k2", "kept_text")
    rows = docs.select(*_keys(F.coalesce(docs[text_col], F.lit(""))), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = rows.join(kept, ["k1", "k2"], "left")
    value = F.coalesce("kept_text", F.col("row")[text_col])
    return joined.select(*[(value if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
