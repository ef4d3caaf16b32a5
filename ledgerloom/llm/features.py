"""Hashed character n-grams of words, in numpy blocks, and a bounded memory of per-word rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import regex

LETTERS = regex.compile(r"\p{L}+")
#: Cells of one feature block, which bounds memory for words of any length.
BLOCK_CELLS = 800_000
#: Words that one Python worker remembers; the memory is emptied when full, which costs time only.
MEMORY_WORDS = 200_000
_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MUL[1]
    h = (h ^ (h >> np.uint64(29))) * _MUL[2]
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def blocks(words: list[str], sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(numbers of words, feature ids, whole-word ids)``.

    Feature ids are a row per word; ids of n-grams lie below ``2**bits`` and ``2**bits`` fills up.
    Words carry a mark at each end, so n-grams there are affixes.
    """
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(max(4, 1 << (max(1, len(w)) - 1).bit_length()), []).append(i)
    for width, members in groups.items():
        step = max(1, BLOCK_CELLS // ((width + 2) * len(sizes)))
        for at in range(0, len(members), step):
            some = members[at : at + step]
            codes = np.zeros((len(some), width + 2), np.uint64)
            codes[:, 0] = 1
            raw = np.array([words[i] for i in some], f"U{width}").view(np.uint32).reshape(len(some), width)
            codes[:, 1:-1] = raw
            lengths = np.fromiter((len(words[i]) for i in some), np.int64, len(some))
            codes[np.arange(len(some)), lengths + 1] = 2
            columns = []
            whole = np.zeros(len(some), np.uint64)
            for j in range(width + 2):
                whole = (whole + codes[:, j]) * _MUL[0] if j == 0 else np.where(codes[:, j] > 0, (whole + codes[:, j]) * _MUL[0], whole)
            for n in sizes:
                if n > width + 2:
                    continue
                h = np.full((len(some), width + 3 - n), n, np.uint64)
                for k in range(n):
                    h = (h + codes[:, k : width + 3 - n + k]) * _MUL[0]
                ids = _mixed(h, bits)
                ids[codes[:, n - 1 :] == 0] = 1 << bits
                columns.append(ids)
            yield np.array(some), np.concatenate(columns, axis=1), _mixed(whole, bits)


class WordRows:
    """A row of floats for each word, computed once for words seen again."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int):
        self.compute, self.width = compute, width
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width), np.float32)

    def add(self, new: list[str]) -> None:
        n, more = len(self.place), len(new)
        while n + more > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[n : n + more] = self.compute(new)
        self.place.update(zip(new, range(n, n + more), strict=True))

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words of the texts, one text after another, and where each text starts."""
        new = list({w for t in texts for w in t if w not in self.place})
        if len(self.place) + len(new) > MEMORY_WORDS and self.place:
            self.clear()
            new = list({w for t in texts for w in t})
        if new:
            self.add(new)
        get = self.place.__getitem__
        sizes = [len(t) for t in texts]
        index = np.fromiter((get(w) for t in texts for w in t), np.int64, sum(sizes))
        return self.rows[index], np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def grouped(texts: list[list[str]], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` words together; one longer text stands alone."""
    start = n = 0
    for i, t in enumerate(texts):
        if i > start and n + len(t) > most:
            yield start, i
            start, n = i, 0
        n += len(t)
    if start < len(texts):
        yield start, len(texts)
