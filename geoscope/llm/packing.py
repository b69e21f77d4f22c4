"""Packing of documents into sequences of a fixed capacity.

Whole pieces of ``capacity`` ids fill sequences of their own. What is left of each document is dealt
to windows by Karmarkar-Karp multiway differencing: of all partial partitions the two with the
largest differences between their windows are merged, the fullest window of one with the emptiest of
the other, until one partition is left. Its windows are near-equal. While one of them exceeds the capacity, the
number of windows rises and differencing begins anew. Documents may be cut, so the room that this leaves
is filled from the emptiest windows, which dissolve.

Every task packs the rows it reads, a bounded batch at a time; no row moves between executors. The last
window of a batch, if not full, goes to the next batch. What a task has left at its end, less than a window,
is cut into pieces of powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from geoscope.llm import word_tokens
from geoscope.llm.bpe import in_parts

#: A batch holds the remainders for this many windows, which bounds a task's memory and time.
WINDOWS = 64
#: Windows that lack no more than this share of the capacity count as full.
SPARE = 1 / 512


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """The items of each window. Ties go by the order of the items; empty windows are possible."""
    if not sizes:
        return [[] for _ in range(windows)]
    n = len(sizes)
    left, right = [-1] * n, [-1] * n  # a node is an item, or two nodes that share a window
    heap = []
    for i, size in enumerate(sizes):
        sums, nodes = np.zeros(windows, dtype=np.int64), np.full(windows, -1, dtype=np.int64)
        sums[0], nodes[0] = size, i
        heap.append((-size if windows > 1 else 0, i, sums, nodes))
    heapq.heapify(heap)
    for turn in itertools.count(n):
        if len(heap) == 1:
            break
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, other, others = heapq.heappop(heap)
        sums, others = sums + other[::-1], others[::-1]
        both = np.flatnonzero((nodes >= 0) & (others >= 0))
        joined = np.where(nodes >= 0, nodes, others)
        joined[both] = np.arange(len(left), len(left) + len(both))
        left += nodes[both].tolist()
        right += others[both].tolist()
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), turn, sums, joined[order]))
    out = []
    for node in heap[0][3].tolist():
        items, stack = [], [node] if node >= 0 else []
        while stack:
            at = stack.pop()
            if at < n:
                items.append(at)
            else:
                stack += (left[at], right[at])
        out.append(sorted(items))
    return out


def _cut(pieces: list[tuple], wanted: int) -> list[tuple]:
    """Takes pieces of so many ids off the front; the last one taken may be cut."""
    taken = []
    while wanted:
        doc, start, ids, total = pieces[0]
        if len(ids) <= wanted:
            taken.append(pieces.pop(0))
            wanted -= len(ids)
        else:
            taken.append((doc, start, ids[:wanted], total))
            pieces[0] = (doc, start + wanted, ids[wanted:], total)
            wanted = 0
    return taken


def _size(pieces: list[tuple]) -> int:
    return sum(len(p[2]) for p in pieces)


def within_capacity(sizes: list[int], capacity: int, windows: int) -> list[list[int]]:
    """The items of each window, none above the capacity, for items that are not either. The number of windows
    rises, by half of those that are above, until that is so."""
    while True:
        found = differencing(sizes, windows)
        above = sum(sum(sizes[i] for i in items) > capacity for items in found)
        if not above:
            return found
        windows += -(-above // 2)


def near_equal(pieces: list[tuple], capacity: int, windows: int, spare: int = 0) -> list[list[tuple]]:
    """Pieces dealt to near-equal windows within the capacity, at least so many that can hold all ids, more
    where differencing leaves one above it. The emptiest are then cut up to fill the others, so all
    windows but the last lack at most ``spare`` ids. Pieces above the capacity are cut first."""
    parts = [
        (doc, start + at, ids[at : at + capacity], total) for doc, start, ids, total in pieces for at in range(0, len(ids), capacity)
    ]
    windows = max(windows, -(-_size(parts) // capacity))
    dealt = [[parts[i] for i in items] for items in within_capacity([len(p[2]) for p in parts], capacity, windows)]
    dealt = sorted((window for window in dealt if window), key=_size, reverse=True)
    n = 0
    while n < len(dealt) - 1:
        room = capacity - _size(dealt[n])
        if room > spare:
            dealt[n] += _cut(dealt[-1], min(room, _size(dealt[-1])))
            if not dealt[-1]:
                dealt.pop()
        else:
            n += 1
    return dealt


class _Task:
    """Packs one task's documents. A piece is (row, document id, start, ids, ids of the document)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        self.spare = int(capacity * SPARE)
        self.waiting: list[tuple] = []
        self.ids_waiting = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self._emit([(doc, start, ids[start : start + self.capacity], total)])
        if whole < total:
            self.waiting.append((doc, whole, ids[whole:].copy(), total))
            self.ids_waiting += total - whole
        if self.ids_waiting >= (WINDOWS + 1) * self.capacity:
            self._pack(WINDOWS)

    def _pack(self, windows: int) -> None:
        pieces = self._take(min(self.ids_waiting, windows * self.capacity))
        for window in near_equal(pieces, self.capacity, windows, self.spare):
            if _size(window) >= self.capacity - self.spare:
                self._emit(window)
            else:
                self.waiting[:0] = window
                self.ids_waiting += _size(window)

    def _take(self, wanted: int) -> list[tuple]:
        self.ids_waiting -= wanted
        return _cut(self.waiting, wanted)

    def end(self) -> None:
        if self.ids_waiting >= self.capacity - self.spare:
            self._pack(-(-self.ids_waiting // self.capacity))
        while self.ids_waiting:
            self._emit(self._take(min(1 << self.ids_waiting.bit_length() - 1, self.capacity)))

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The pieces of every document: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids are those of its whole text and ``end_id``; a null text counts as empty and so has
    one id. Each id lies in one piece; a sequence's pieces lie gapless from offset 0 and hold at most
    ``capacity`` ids. Sequences are shorter only by what near-equal windows leave, or have a power of two
    of ids. Repeated rows are packed each; other columns are not read; an empty table gives no piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokens.load(tokenizer)
        task = _Task(capacity, TaskContext.get().partitionId() << 33)

        def out() -> Iterator[pa.RecordBatch]:
            rows = task.taken()
            if rows:
                columns = list(zip(*rows))
                arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names)

        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(id_col).type
            for part in in_parts(batch, text_col, 8 << 20):
                ids, borders = coder.encode(part.column(text_col), end_id)
                for doc, a, b in zip(part.column(id_col).to_pylist(), borders, borders[1:]):
                    task.add(doc, ids[a:b])
                yield from out()
        task.end()
        yield from out()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run,
        f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )
