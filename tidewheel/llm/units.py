"""Numbers of the words of many texts at once, by arrays instead of a look-up a word.

A text is cut into units: runs of characters of one kind, between separators. Units of at most 16
Latin-1 characters are two 64-bit numbers, exactly, and are looked up all at once in an open hash table;
longer ones, and chunks between separators that hold a character of kind ``WHOLE`` or none of Latin-1,
are looked up by a dictionary. A unit seen first gets the next number and is handed to ``learn``. All is
forgotten when half the slots are taken, which bounds memory; the caller is told by ``forget``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Kind of a character that keeps its chunk in one piece; 0 is a separator's.
WHOLE = 255
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Units:
    LONGEST, CHARS = 48, 1 << 20

    def __init__(self, kinds: np.ndarray, learn: Callable[[list[str]], None], forget: Callable[[], None], lower: np.ndarray | None = None, slots: int = 1 << 21):
        """``kinds`` and ``lower``: of the 256 Latin-1 characters; units are equal that are so after ``lower``."""
        self.kinds, self.lower, self.learn, self.forgotten, self.slots = kinds, lower, learn, forget, slots
        self.forget()

    def forget(self) -> None:
        self.low, self.high = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.entry = np.full(self.slots, -1, np.int32)
        self.known: dict[str, int] = {}  # of longer units and odd ones
        self.size = 0
        self.forgotten()

    def cut(self, text: str) -> Iterator[str]:
        """A long text in parts that end before a space or line; both are separators."""
        at = 0
        while len(text) - at > self.CHARS:
            end = max(text.rfind(" ", at + 1, at + self.CHARS), text.rfind("\n", at + 1, at + self.CHARS))
            if end < 0:
                found = [x for x in (text.find(" ", at + self.CHARS), text.find("\n", at + self.CHARS)) if x >= 0]
                end = min(found, default=len(text))
            yield text[at:end]
            at = end
        if at < len(text):
            yield text[at:]

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the numbers of all units in order, how many each text has)."""
        whole = "\n".join(texts) + "\n"
        plain, _ = characters(whole)
        kinds = self.kinds[plain]
        if (odd := np.flatnonzero(kinds == WHOLE)).size:
            spaces = np.flatnonzero(kinds == 0)
            at = np.unique(np.searchsorted(spaces, odd))
            change = np.zeros(len(kinds) + 1, np.int8)
            change[np.where(at > 0, spaces[at - 1] + 1, 0)] += 1
            change[spaces[at]] -= 1
            kinds[np.cumsum(change[:-1], dtype=np.int8) > 0] = WHOLE
        bounds = np.concatenate(([0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, [len(kinds)]))
        own = kinds[bounds[:-1]]
        start, size, own = (x[own > 0] for x in (bounds[:-1], np.diff(bounds), own))
        ends = np.cumsum([len(t) + 1 for t in texts])
        return self.look_up(whole, plain, start, size, own), np.diff(np.searchsorted(start, ends), prepend=0)

    def look_up(self, whole: str, plain: np.ndarray, start: np.ndarray, size: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The numbers of the units of a text that start at some places and have some sizes and kinds; ``plain``: as ``characters`` has it."""
        if self.size > self.slots // 2:
            self.forget()
        text = np.zeros(len(plain) + 16, np.uint8)
        text[:-16] = plain if self.lower is None else self.lower[plain]
        out = np.full(len(start), -1, np.int64)
        short = np.flatnonzero((size <= 16) & (own != WHOLE))
        words = np.lib.stride_tricks.as_strided(text[:8].view("<u8"), (len(text) - 7,), (1,))
        s, n = start[short], size[short]
        low, high = words[s] & MASKS[np.minimum(n, 8)], words[s + 8] & MASKS[np.maximum(n, 8) - 8]
        out[short], new = self._found(low, high)
        if len(new):
            order = np.lexsort((low[new], high[new]))
            a, b = low[new][order], high[new][order]
            some = new[order[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))]]
            first = self._learned([text[a : a + b].tobytes().decode("latin-1") for a, b in zip(s[some].tolist(), n[some].tolist(), strict=True)])
            self._insert(low[some], high[some], first)
            out[short[new]] = self._found(low[new], high[new])[0]
        rest = np.flatnonzero(out < 0)
        if len(rest):
            raw = [whole[a : a + b] for a, b in zip(start[rest].tolist(), size[rest].tolist(), strict=True)]
            todo = list({w for w in raw if w not in self.known})
            first = self._learned(todo)
            made = {w: first + k for k, w in enumerate(todo)}
            self.known.update((w, k) for w, k in made.items() if len(w) <= self.LONGEST)
            out[rest] = [made[w] if w in made else self.known[w] for w in raw]
        return out

    def _learned(self, units: list[str]) -> int:
        first, self.size = self.size, self.size + len(units)
        if units:
            self.learn(units)
        return first

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(self.slots - 1)).astype(np.int64)

    def _found(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, places of those that are not kept): probing slot after slot, all units at once."""
        slot, out = self._slots(low, high), np.full(len(low), -1, np.int64)
        todo, new = np.arange(len(low)), []
        while len(todo):
            at = slot[todo]
            entry = self.entry[at]
            hit = (self.low[at] == low[todo]) & (self.high[at] == high[todo]) & (entry >= 0)
            out[todo[hit]] = entry[hit]
            new.append(todo[entry < 0])
            todo = todo[~hit & (entry >= 0)]
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)
        return out, np.concatenate(new) if new else todo

    def _insert(self, low: np.ndarray, high: np.ndarray, first: int) -> None:
        for k, (a, b, slot) in enumerate(zip(low, high, self._slots(low, high).tolist(), strict=True), first):
            while self.entry[slot] >= 0:
                slot = (slot + 1) & (self.slots - 1)
            self.low[slot], self.high[slot], self.entry[slot] = a, b, k


def characters(text: str) -> tuple[np.ndarray, np.ndarray | None]:
    """(its Latin-1 characters, zero for others; its code points if there are others)."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8), None
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return np.where(points < 256, points, 0).astype(np.uint8), points


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """``array``, or a copy of twice its length until it has room for ``size``."""
    while size > len(array):
        array = np.concatenate((array, np.zeros_like(array)))
    return array


def batches_of(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many characters; a longer text is alone."""
    at = 0
    while at < len(texts):
        end, n = at + 1, len(texts[at])
        while end < len(texts) and n + len(texts[end]) <= chars:
            n, end = n + len(texts[end]), end + 1
        yield at, end
        at = end
