"""Token ids of documents as ORC files, and their reading.

A file row is a document: ids as an integer list, which ORC keeps run-length encoded (its RLE packs
ids to the bits they need), in stripes that tasks read in parallel. Rows ascend by document id across
and within files, so the row indexes' minima and maxima prune by range; Bloom filters on the id prune
lookups of single documents.

The scan's rows are ranged by (id, row number): a single id that holds a third of all rows is cut too.
Each task encodes the rows of its range in order and counts on; the ids before its first row come
from one sum per range. So no row's place depends on anything gathered in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoscope.llm import word_tokens
from geoscope.llm.bpe import in_parts

STRIPE_BYTES = 32 << 20
INDEX_ROWS = 1000
BLOOM_FALSE = 0.01


def _schema(kind: str) -> str:
    return f"part int, doc_id {kind}, before bigint, n_tokens bigint, ids array<int>"


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ids of every whole text, each followed by ``end_id``, in ascending ``id_col`` order (nulls
    first; rows with equal ids in the order of the scan). Null texts count as empty. Other columns are
    not read. An empty table gives files without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = word_tokens.load(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in in_parts(batch, "text", 8 << 20):
                ids, borders = coder.encode(rows.column("text"), end_id)
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, dtype=np.int32)),
                        rows.column("doc_id"),
                        pa.array(before + borders[:-1]),
                        pa.array(np.diff(borders)),
                        pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(ids.view(np.int32))),
                    ],
                    ["part", "doc_id", "before", "n_tokens", "ids"],
                )
                before += int(borders[-1])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    encoded = ordered.mapInArrow(run, _schema(ordered.schema["doc_id"].dataType.simpleString()))
    options = {
        "compression": "zstd",
        "orc.stripe.size": STRIPE_BYTES,
        "orc.create.index": "true",
        "orc.row.index.stride": INDEX_ROWS,
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": BLOOM_FALSE,
    }
    encoded.write.options(**options).orc(out)


def read(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """``doc_id, start, n_tokens, ids``: ``start`` counts the ids of all documents before. A filter on
    ``doc_id`` reaches the files' indexes and Bloom filters."""
    rows = spark.read.schema(_schema(kind)).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row for each range
    to_here = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = totals.select("part", F.coalesce(to_here, F.lit(0)).alias("first"))
    joined = rows.join(F.broadcast(firsts), "part")  # at most spark.sql.shuffle.partitions rows of two numbers
    return joined.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids")


def digests(read_rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``, the last two from the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            borders, flat = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(), dtype="<i4")
            crcs = [zlib.crc32(flat[a:b]) for a, b in zip(borders, borders[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(borders).astype(np.int64)), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    kind = read_rows.schema["doc_id"].dataType.simpleString()
    return read_rows.select("doc_id", "start", "ids").mapInArrow(
        run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
