"""Ids of whole texts by the tokenizers library, for vocabularies that drop white space.

Such a vocabulary encodes what stands between white space alone, whatever its neighbours, lowers case, and
takes punctuation after a letter as a word of its own. So a batch of texts is lowered (ASCII only) and
split, its distinct words are looked up, words not met before go through the library, and the ids are
put together in numpy. The store of words is bounded and affects speed only: a batch holds all it needs.
"""

from __future__ import annotations

import functools
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from geoscope.llm.kept import Kept

CACHED_WORDS = 400_000
#: Words that go through the library at once.
NEW_WORDS = 20_000


class WordCoder:
    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._kept = Kept(cached_words)

    def _plain(self, texts: pa.Array) -> pa.Array:
        """Texts with the same ids and fewer different words: in lower case, with a space between a letter and the
        punctuation that ends a word. Special tokens, which hold ``<``, are found before that, so texts
        with one stay as they are."""
        special = pc.match_substring(texts, "<")
        lower = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,;:!?])(\s|$)", r"\1 \2\3")
        return pc.if_else(special, texts, lower) if pc.any(special).as_py() else lower

    def _values(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        known, missing = self._kept.known(words)
        for at in range(0, len(missing), NEW_WORDS):
            new = missing[at : at + NEW_WORDS]
            found = self.library.encode_batch_fast(new, add_special_tokens=False)
            learned = {word: array("I", one.ids).tobytes() for word, one in zip(new, found)}
            known.update(learned)
            self._kept.add(learned)
        return [known[word] for word in words]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, each text's followed by ``end_id`` if given, and where each
        text starts, with the end at last. Null texts count as empty."""
        lists = pc.ascii_split_whitespace(self._plain(pc.fill_null(texts, "")))
        words = lists.flatten().dictionary_encode()
        found = self._values(words.dictionary.to_pylist())
        borders = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        used = words.indices.to_numpy(zero_copy_only=False)
        if end_id is not None:
            used = np.insert(used, borders[1:], len(found))
            borders = borders + np.arange(len(borders))
            found.append(array("I", [end_id]).tobytes())
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        pool = np.frombuffer(b"".join(found), dtype=np.uint32)
        del found
        if not len(used):
            return pool[:0], borders
        starts = np.cumsum(sizes) - sizes
        each = sizes[used]
        ends = np.cumsum(each)
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        place = np.repeat((starts[used] - (ends - each)).astype(kind), each)
        place += np.arange(ends[-1], dtype=kind)
        return pool[place], np.concatenate([[0], ends])[borders]


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordCoder:
    """One coder per worker process."""
    return WordCoder(path)
