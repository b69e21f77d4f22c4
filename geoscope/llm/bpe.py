"""Byte-level BPE: encoding and decoding of whole texts.

Merging follows one rule: of all adjacent pairs the lowest rank goes first, the leftmost of equals.
A segment tree over the pair ranks holds that pair at its root. After a merge three leaves change
(the merged pair, the pair that vanished, the pair before), which costs a logarithmic number of
nodes; it ends when the root holds no mergeable pair. Short words are merged many at a time, one
tree a row of a numpy array; long ones one at a time, in n log n.

Words repeat, so each Python worker keeps the ids of those it met; the store is bounded
(``CACHED_WORDS``) and affects speed only. Every text is encoded as a whole and alone, no row moves
between executors, and a lost task is simply run again.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoscope.llm.kept import Kept

CACHED_WORDS = 300_000
#: Rows of this many symbols and fewer are merged together; an array holds this many symbols at most.
ROW_SYMBOLS, BLOCK_SYMBOLS = 64, 1 << 18
NONE = np.iinfo(np.int64).max
PLACE_BITS = 20

#: The word pattern of byte-level BPE, its white space, and its letters and numbers up to
#: U+024F; beyond, classes of letters depend on the Unicode version, and the library splits the words.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACES = "\t\n\x0b\x0c\r \x85\xa0" + "".join(
    map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
LAST_PLAIN = chr(0x24F)
LETTERS, NUMBERS = f"A-Za-zªµºÀ-ÖØ-öø-{LAST_PLAIN}", "0-9²³¹¼½¾"

_plain = re.compile(f"[\x00-{LAST_PLAIN}]*")
_words = re.compile(
    f" ?[{LETTERS}]+|{CONTRACTIONS}| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
#: Runs between white space, a space before them included: no word crosses their borders.
_runs = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, the
    others in order from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = itertools.count(256)
    return [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.numbers = [str(i) for i in range(size)]
        self._byte_ids = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self._merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = (left << 32) | right
        self._ranks = np.argsort(keys, kind="stable")
        self._keys = keys[self._ranks]
        self._rank_of = dict(zip(zip(left.tolist(), right.tolist()), range(len(pairs))))
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        from tokenizers import Tokenizer

        self._pre = Tokenizer.from_file(path).pre_tokenizer
        self._byte_of = byte_of
        self._kept = Kept(CACHED_WORDS)

    # -- words

    def _words_of(self, text: str) -> list[str]:
        if _plain.fullmatch(text):
            return _words.findall(text)
        out: list[str] = []
        for run in _runs.findall(text):
            if _plain.fullmatch(run):
                out += _words.findall(run)
            else:
                out += [bytes(map(self._byte_of.__getitem__, w)).decode() for w, _ in self._pre.pre_tokenize_str(run)]
        return out

    def words(self, text: str) -> list[str]:
        """The text in pieces that are encoded alone: special tokens, and words."""
        if not any(t in text for t in self.special):
            return self._words_of(text)
        out: list[str] = []
        for part in self._split.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self._words_of(part)
        return out

    # -- merging

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where there is no merge; -1 stands for no symbol."""
        keys = (a << 32) | b
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where((self._keys[at] == keys) & (a >= 0) & (b >= 0), self._ranks[at], NONE)

    def _merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Words of at most ``width`` (a power of two) bytes, a segment tree in each row."""
        n, side, leaves = len(words), width + 1, np.arange(width)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
        filled = leaves < sizes[:, None]
        symbols = np.full((n, side), -1, dtype=np.int64)  # the last column stands for "none"
        symbols[:, :width][filled] = self._byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after = np.tile(np.arange(1, side + 1), (n, 1))
        after[:, width] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        before[:, 0] = width
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        rank = self._rank(symbols[:, :width], symbols[:, 1:])
        tree[:, width:] = np.where(rank < NONE, (rank << PLACE_BITS) | leaves, NONE)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = tree[:, 2 * level : 4 * level].reshape(n, level, 2).min(axis=2)
            level //= 2
        symbols, after, before, tree = symbols.ravel(), after.ravel(), before.ravel(), tree.ravel()
        rows = np.arange(n)
        while True:
            root = tree[rows * 2 * width + 1]
            on = root < NONE
            rows, root = rows[on], root[on]
            if not len(rows):
                break
            base, at_tree = rows * side, rows * 2 * width
            i = root & ((1 << PLACE_BITS) - 1)
            j = after[base + i]
            k = after[base + j]
            h = before[base + i]
            merged = self._merged[root >> PLACE_BITS]
            symbols[base + i] = merged
            symbols[base + j] = -1
            after[base + i] = k
            before[base + k] = i
            first = h == width
            left = self._rank(symbols[base + h], merged)
            right = self._rank(merged, symbols[base + k])
            node = np.stack([i, j, np.where(first, j, h)]) + width
            tree[at_tree + node] = np.stack(
                [
                    np.where(right < NONE, (right << PLACE_BITS) | i, NONE),
                    np.full(len(rows), NONE),
                    np.where(first | (left == NONE), NONE, (left << PLACE_BITS) | h),
                ]
            )
            node >>= 1
            while node[0, 0]:
                down = at_tree + 2 * node
                tree[at_tree + node] = np.minimum(tree[down], tree[down + 1])
                node >>= 1
        symbols = symbols.reshape(n, side)[:, :width]
        alive = symbols >= 0
        ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
        flat = symbols[alive].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_one(self, word: bytes) -> bytes:
        """The same for one long word."""
        n = len(word)
        symbols = [*self._byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist(), None]
        after, before = list(range(1, n + 1)), list(range(-1, n))
        width = 1 << max(1, (n - 1).bit_length())
        none = (NONE, 0)
        tree = [none] * (2 * width)
        rank_of, merged_of = self._rank_of, self._merged

        def pair(i: int) -> tuple[int, int]:
            return (rank_of.get((symbols[i], symbols[after[i]]), NONE), i)

        def put(i: int, value: tuple[int, int]) -> None:
            node = i + width
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        for i in range(n - 1):
            tree[width + i] = pair(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1][0] < NONE:
            rank, i = tree[1]
            j = after[i]
            symbols[i], symbols[j] = int(merged_of[rank]), None
            after[i] = after[j]
            before[after[j]] = i
            put(j, none)
            put(i, pair(i) if after[i] < n else none)
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        return np.array([s for s in symbols if s is not None], dtype="<u4").tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, in order, as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        for n, word in enumerate(words):
            if len(word) > ROW_SYMBOLS:
                out[n] = self._merge_one(word)
            elif word:
                classes.setdefault(max(2, 1 << (len(word) - 1).bit_length()), []).append(n)
        for width, places in classes.items():
            step = BLOCK_SYMBOLS // width
            for a in range(0, len(places), step):
                part = places[a : a + step]
                for n, ids in zip(part, self._merge_rows([words[n] for n in part], width)):
                    out[n] = ids
        return out

    # -- texts

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of every text, in order."""
        pieces = [self.words(t) for t in texts]
        distinct = set().union(*pieces)
        missing = self._kept.missing(distinct.difference(self.special))
        kept = self._kept.now
        kept.update(zip(missing, self.merge([p.encode() for p in missing])))
        kept.update({p: i.to_bytes(4, "little") for p, i in self.special.items()})
        for own in pieces:
            yield np.frombuffer(b"".join(map(kept.__getitem__, own)), dtype="<u4")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """One coder per worker process."""
    return ByteBPE(path)


def in_parts(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` characters of ``column``, so that working memory is bounded by
    that and the longest text."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every text; null counts as the empty text (no ids). Other
    columns are not read; repeated rows give repeated results; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            for part in in_parts(batch, text_col):
                ids = list(coder.encode_batch([t or "" for t in part.column(text_col).to_pylist()]))
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends), flat)
                yield pa.RecordBatch.from_arrays([part.column(id_col), lists], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` of every list of ids; null and empty lists give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            texts = [coder.decode(ids or []) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text and reports ``id_col, n_tokens, ids_sha256, decoded_sha256``: what
    :func:`encode` and :func:`decode` give, in one pass that ships digests in place of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        number = coder.numbers.__getitem__
        for batch in batches:
            for part in in_parts(batch, text_col):
                counts, shas, decoded = [], [], []
                for found in coder.encode_batch([t or "" for t in part.column(text_col).to_pylist()]):
                    ids = found.tolist()
                    counts.append(len(ids))
                    shas.append(hashlib.sha256(",".join(map(number, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())],
                    [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
