"""SimHash near-duplicates.

A document's fingerprint takes each bit by majority over the 64-bit hashes of its word shingles.
Fingerprints that differ in few bits are found by pigeonhole: of ``blocks`` blocks, ``distance``
differing bits leave ``blocks - distance`` untouched, so close fingerprints agree on that many blocks
of some choice. Each distinct fingerprint is keyed by every choice, keys meet in a shuffle, and the
pairs of a bucket are verified by Hamming distance inside the task; a bucket gives a forest of
links, never all its pairs.

Copies collapse before: a bucket holds different fingerprints only. One that still has more than
``BUCKET`` members is split: its untouched bits are fixed, the others are cut in ``distance + 1``
parts of which one must agree, so the members are keyed anew by each part. Every split fixes a
quarter of the free bits (for distance 3), until a bucket cannot hold more than its limit. So no
bucket is dropped or compared without bound, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoscope.llm import components, files
from geoscope.llm.bpe import in_parts

BUCKET = 256
SEED = 42
#: Shingles are hashed this many at a time, which bounds memory for long texts.
CHUNK = 1 << 16


def fingerprint(text: bytes, words: int) -> int:
    """The fingerprint of a UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles of so
    many words with repeats (the whole sequence if it has fewer). No words: zero."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > len(starts), bitorder="little")
    return int.from_bytes(majority.tobytes(), "little")


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp``: the fingerprint of each row as a signed 64-bit integer. Null texts count
    as empty, their ``text_hash`` is that of the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                found = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(found)], ["doc_id", "text_hash", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash bigint, fp bigint")


def _parts(bits: list[int], n: int) -> list[int]:
    """The bits cut into n near-equal runs, each as a mask."""
    return [sum(1 << b for b in run) for run in np.array_split(np.array(bits, dtype=object), n) if len(run)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def first_masks(blocks: int, distance: int) -> list[int]:
    """A mask for each choice of blocks that close fingerprints may agree on."""
    cut = _parts(list(range(64)), blocks)
    return [_signed(sum(choice)) for choice in combinations(cut, blocks - distance)]


def finer_masks(mask: int, distance: int) -> list[int]:
    """Masks that fix one more part each of the bits the mask leaves free."""
    fixed = mask & (1 << 64) - 1
    free = [b for b in range(64) if not fixed >> b & 1]
    return [_signed(fixed | part) for part in _parts(free, distance + 1)]


def _forest(bucket: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of one bucket (equal neighbouring numbers) whose fingerprints are close: each
    linked row with the first one of those it reaches."""
    pairs = []
    for step in range(1, len(fps)):
        same = bucket[step:] == bucket[:-step]
        if not same.any():
            break
        at = np.flatnonzero(same)
        at = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= distance]
        pairs.append(np.stack([at, at + step]))
    if not pairs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b = np.concatenate(pairs, axis=1)
    label = np.arange(len(fps))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(fps)))
    return at, label[at]


def _bucket_links(rows: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) within the buckets (mask, part), none of which has over BUCKET rows."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        changed = (rows["mask"].values[1:] != rows["mask"].values[:-1]) | (rows["part"].values[1:] != rows["part"].values[:-1])
        fps = rows["fp"].values.astype(np.int64).view(np.uint64)
        at, to = _forest(np.concatenate([[0], np.cumsum(changed)]), fps, distance)
        return pd.DataFrame({"a": rows["fp"].values[at], "b": rows["fp"].values[to]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the last bucket may go on in the next batch
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = rows.iloc[-1]
            at = int(np.argmax((rows["mask"].values == last["mask"]) & (rows["part"].values == last["part"])))
            rest = rows.iloc[at:]
            if at:
                yield links(rows.iloc[:at])
        if rest is not None:
            yield links(rest)

    together = rows.select("mask", "part", "fp").repartition("mask", "part").sortWithinPartitions("mask", "part")
    return together.mapInPandas(run, "a bigint, b bigint")


def _refined(rows: DataFrame, distance: int) -> DataFrame:
    """Members (mask, fp) of buckets that are too large, with each finer mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            finer = {m: finer_masks(int(m), distance) for m in batch["mask"].unique()}
            yield pd.DataFrame({"fp": batch["fp"], "mask": batch["mask"].map(finer)}).explode("mask").astype("int64")

    return rows.select("fp", "mask").mapInPandas(run, "fp bigint, mask bigint")


def close_links(fps: DataFrame, distance: int = 3, blocks: int = 5) -> tuple[DataFrame, list[str]]:
    """Links (a, b) that connect all ``fp`` within ``distance`` bits of each other (a forest per bucket,
    not every pair), and the paths of the tables they are read from."""
    masks = F.array(*[F.lit(m).cast("bigint") for m in first_masks(blocks, distance)])
    keyed = fps.select("fp").distinct().select("fp", F.explode(masks).alias("mask"))
    links, paths = None, []
    while True:
        keyed = keyed.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "part").agg(F.count("*").alias("size")).filter("size > 1")
        shared, path = files.written(keyed.join(sizes, ["mask", "part"]), "buckets")
        paths.append(path)
        found = _bucket_links(shared.filter(F.col("size") <= BUCKET), distance)
        links = found if links is None else links.union(found)
        large = shared.filter(F.col("size") > BUCKET)
        if large.isEmpty():
            return links, paths
        keyed = _refined(large, distance).distinct()


def groups(docs: DataFrame, words: int, distance: int = 3, blocks: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp, component_id, keeper_hash`` for every row. Rows whose fingerprints are within
    ``distance`` bits are linked, equal ones included; ``component_id`` is the smallest id reachable, and
    (``component_id``, ``keeper_hash``) names the text to keep, the smallest hash of those with that id.
    Null ids count last. Texts without words share fingerprint zero; an empty table gives no rows."""
    spark = docs.sparkSession
    rows, _ = files.written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    distinct, _ = files.written(rows.groupBy("fp").agg(first), "distinct")
    links, paths = close_links(distinct, distance, blocks)
    roots, _ = components.components(links)
    for path in paths:
        files.drop(spark, path)
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    known = rooted.join(least, "root").select(
        "fp", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("keeper_hash")
    )
    known, _ = files.written(known, "groups")
    return rows.join(known, "fp").select("doc_id", "text_hash", "fp", "component_id", "keeper_hash")


def keep_one(docs: DataFrame, words: int, distance: int = 3, blocks: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each group: the smallest id, null ids last; of rows with that id and text, the
    one whose values in all columns have the smallest hash, so a second run keeps the same one. Columns and
    values stay, whatever their names; null texts count as empty; an empty table stays empty."""
    found = groups(docs, words, distance, blocks, id_col, text_col)
    keepers = found.select(F.col("component_id").alias("id"), F.col("keeper_hash").alias("hash")).distinct()
    hashed = docs.select(
        docs[id_col].alias("id"),
        F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("hash"),
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
    )
    same = hashed["id"].eqNullSafe(keepers["id"]) & (hashed["hash"] == keepers["hash"])
    rows = hashed.join(keepers, same, "left_semi").groupBy("id", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows.select("row.*")
