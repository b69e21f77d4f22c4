"""A bounded store of what a worker has computed for words; it affects speed only."""

from __future__ import annotations

from collections.abc import Iterable


class Kept:
    """Values by word in two generations. When the younger one is full it becomes the older one, whose words
    come back as they are asked for; so frequent words stay."""

    def __init__(self, most: int):
        self.most = most
        self.now: dict = {}
        self._before: dict = {}

    def missing(self, words: Iterable) -> list:
        """Those of the words that have no value yet; all others are in ``now`` afterwards."""
        if len(self.now) > self.most:
            self.now, self._before = {}, self.now
        now, before, out = self.now, self._before, []
        for word in words:
            if word not in now:
                value = before.get(word)
                if value is None:
                    out.append(word)
                else:
                    now[word] = value
        return out

    def known(self, words: Iterable) -> tuple[dict, list]:
        """The values of those of the words that have one, in a dictionary of the caller's own, and the others.
        What a caller holds does not depend on what the store keeps meanwhile."""
        missing = self.missing(words)
        now, rest = self.now, set(missing)
        return {word: now[word] for word in words if word not in rest}, missing

    def add(self, values: dict) -> None:
        """Keeps values; as many as fill a generation at a time."""
        self.now.update(values)
