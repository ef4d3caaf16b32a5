"""Words of Arrow text columns, cut and numbered in numpy without a Python object for each.

A worker's memory numbers the words it has met. Words are looked up by two 64-bit hashes of their bytes; only words that
are new become Python objects. Words that share the first hash but not the second go through a dictionary.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words longer than this are looked up one by one, and the share of a table's places that may be taken.
LONG, FILLED = 32, 0.65
_A, _B = (np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64), np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0x8CB92BA72F3D8DD7], np.uint64))
_KEEP = np.array([0, *((1 << 8 * n) - 1 for n in range(1, 9))], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(characters: bytes) -> np.ndarray:
    """Which bytes are among ``characters``."""
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


ASCII_SPACE = table(b" \t\n\v\f\r")


def bytes_of(column: pa.Array, *, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, A-Z lower-cased if asked, and where each text starts and ends; nulls are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return (_LOWER[data] if lower else data), offsets - offsets[0]


def cut(data: np.ndarray, edges: np.ndarray, space: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words between ``space`` bytes, and how many each text has; ``also`` marks further starts inside words."""
    gap = space[data]
    opens, closes = ~gap, ~gap
    opens[1:] &= gap[:-1] if also is None else gap[:-1] | also[1:]
    closes[:-1] &= gap[1:] if also is None else gap[1:] | also[1:]
    filled = np.flatnonzero(np.diff(edges))
    first, last = edges[filled], edges[filled + 1] - 1
    opens[first], closes[last] = ~gap[first], ~gap[last]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.diff(np.searchsorted(starts, edges))


#: Marks that often follow a word; pre-tokenizers that take runs of letters whole cut between a letter and one of them.
MARKS = b".,;:!?%&*#$|"
_MARK, _LETTER = table(MARKS), table(bytes([*range(65, 91), *range(97, 123)]))
#: Bytes that may begin white space beyond ASCII, or marks that letters may join.
_ASKED = table(b"\x1c\x1d\x1e\x1f\xc2\xcc\xcd\xe1\xe2\xe3")


def after_letters(data: np.ndarray) -> np.ndarray:
    """Which marks follow a letter: one of ASCII, or of Latin-1 in two bytes."""
    out = _MARK[data]
    out[:1] = False
    at = np.flatnonzero(out)
    one, two = data[at - 1], data[np.maximum(at - 2, 0)]
    out[at] = _LETTER[one] | ((at > 1) & (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7))
    return out


def odd_texts(data: np.ndarray, edges: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Texts with white space beyond ASCII, with marks that letters may join (U+0300 to U+036F), or with one of ``special``."""
    at = np.flatnonzero(_ASKED[data])
    one, two, three = (np.append(data, [0, 0, 0])[at + k] for k in range(3))
    bad = (one < 0x20) | (one == 0xCC) | (one == 0xCD) | ((one == 0xC2) & ((two == 0x85) | (two == 0xA0))) | ((one == 0xE1) & (two == 0x9A) & (three == 0x80))
    bad |= (one == 0xE2) & (two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))
    bad |= ((one == 0xE2) & (two == 0x81) & (three == 0x9F)) | ((one == 0xE3) & (two == 0x80) & (three == 0x80))
    raw, places = data.tobytes(), at[bad].tolist()
    for word in special:
        k = raw.find(word)
        while k >= 0:
            places.append(k)
            k = raw.find(word, k + 1)
    return np.unique(np.searchsorted(edges, places, side="right") - 1)


def cut_whole(data: np.ndarray, edges: np.ndarray, space: np.ndarray, also: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces that cover all bytes, each a run of ``space`` with what follows it up to the next; ``also`` marks further starts."""
    gap = space[data]
    opens = also.copy()
    opens[1:] |= gap[1:] & ~gap[:-1]
    filled = np.flatnonzero(np.diff(edges))
    opens[edges[filled]] = True
    starts = np.flatnonzero(opens)
    return starts, np.append(starts[1:], len(data)), np.diff(np.searchsorted(starts, edges))


class WordMemory:
    """Numbers of words; ``learn`` is told new words in the order of their numbers."""

    def __init__(self, learn: Callable[[list[bytes]], None], most: int):
        self.learn, self.most = learn, most
        self.bits = max(8, int(np.ceil(np.log2(most / FILLED))))
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.number = np.zeros(1 << self.bits, np.int32)
        self.second = np.zeros(1 << 14, np.uint64)
        self.other: dict[bytes, int] = {}

    def full(self, more: int) -> bool:
        """Whether the memory would hold more than it may with ``more`` further words; then the caller clears it."""
        return self.n > 0 and self.n + more > self.most

    def hashes(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate((data, np.zeros(LONG + 8, np.uint8)))
        view = np.lib.stride_tricks.sliding_window_view(padded, 8)
        h = sizes.astype(np.uint64) * _A[4]
        g = sizes.astype(np.uint64) * _B[4]
        for k in range(LONG // 8):
            some = slice(None) if k == 0 else np.flatnonzero(sizes > 8 * k)
            if k and not len(some):
                break
            word = view[starts[some] + 8 * k].view(np.uint64).ravel() & _KEEP[np.minimum(sizes[some] - 8 * k, 8)]
            for state, by in ((h, _A), (g, _B)):
                x = (state[some] ^ word) * by[k]
                x ^= x >> np.uint64(29)
                x *= by[k + 1]
                state[some] = x ^ (x >> np.uint64(32))
        return np.where(h == 0, np.uint64(1), h), g

    def _find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Numbers of hashes, -1 for unknown ones, -2 where only the first hash is known."""
        mask = len(self.key) - 1
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.key[at]
        out = np.where(found == h, self.number[at], -1).astype(np.int64)
        todo = np.flatnonzero((found != h) & (found != 0))
        spot = at[todo]
        while len(todo):
            spot = (spot + 1) & mask
            found = self.key[spot]
            hit = found == h[todo]
            out[todo[hit]] = self.number[spot[hit]]
            on = ~hit & (found != 0)
            todo, spot = todo[on], spot[on]
        known = out >= 0
        out[known & (self.second[np.maximum(out, 0)] != g)] = -2
        return out

    def _put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        mask = len(self.key) - 1
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.key[at] == 0)
            self.key[at[free]] = h[free]
            placed = self.key[at] == h
            self.number[at[placed]] = numbers[placed]
            h, at, numbers = h[~placed], (at[~placed] + 1) & mask, numbers[~placed]

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """Numbers of words; None when the memory was full, has been cleared and all must be asked again."""
        sizes = ends - starts
        h, g = self.hashes(data, starts, np.minimum(sizes, LONG))
        out = self._find(h, g)
        out[sizes > LONG] = -2
        missing = np.flatnonzero(out == -1)
        _, first, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
        order = np.argsort(first, kind="stable")  # numbers in order of first appearance
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        apart = np.flatnonzero(out == -2).tolist()
        odd = {bytes(data[starts[i] : ends[i]]): None for i in apart}
        odd = [w for w in odd if w not in self.other]
        if self.full(len(first) + len(odd)):
            self.clear()
            return None
        pick = missing[first[order]]
        words = [bytes(data[a:b]) for a, b in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)]
        if len(pick):
            while self.n + len(pick) + len(odd) > len(self.second):
                self.second = np.concatenate((self.second, np.zeros_like(self.second)))
            numbers = self.n + np.arange(len(pick))
            self.second[numbers] = g[pick]
            if self.n + len(pick) > FILLED * len(self.key):
                self._grow(self.n + len(pick))
            self._put(h[pick], numbers)
            out[missing] = self.n + rank[inverse]
            alike = g[missing] == self.second[out[missing]]
            for i in missing[~alike].tolist():  # a new word that shares its first hash with another new one
                apart.append(i)
                w = bytes(data[starts[i] : ends[i]])
                if w not in self.other and w not in odd:
                    odd.append(w)
        if words or odd:
            self.other.update((w, self.n + len(words) + i) for i, w in enumerate(odd))
            self.n += len(words) + len(odd)
            while self.n > len(self.second):
                self.second = np.concatenate((self.second, np.zeros_like(self.second)))
            self.learn(words + odd)
        for i in apart:
            out[i] = self.other[bytes(data[starts[i] : ends[i]])]
        return out

    def _grow(self, n: int) -> None:
        """A block of more new words than the memory may hold still goes through whole."""
        held = self.key != 0
        h, numbers = self.key[held], self.number[held]
        while n > FILLED * (1 << self.bits):
            self.bits += 1
        self.key, self.number = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self._put(h, numbers)
