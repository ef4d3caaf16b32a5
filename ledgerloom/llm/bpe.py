"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token is a row of byte symbols. A complete binary tree holds, for every adjacent
pair, ``rank * width + position`` (infinite where no merge exists); its root is therefore the
leftmost pair of lowest rank. A merge rewrites three leaves and their ancestors, and the
loop ends when the root is infinite. Short pre-tokens run through one tree per row of a numpy
block; long ones through a tree of their own.

Edge cases: null text encodes to no ids and decodes to the empty string; of equally ranked pairs the leftmost merges first; texts of any length
are encoded whole; repeated rows give repeated results; empty tables give empty results; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerloom.llm.common import blocks_of, kept, map_rows, sliced
from ledgerloom.llm.wordmemory import ASCII_SPACE, WordMemory, after_letters, bytes_of, cut_whole, odd_texts

#: Fixed value: the pre-token pattern of byte-level BPE, with the white space property spelled out.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
INF = np.iinfo(np.int64).max
#: Pre-tokens up to this many bytes are merged in numpy blocks and remembered.
BLOCK_BYTES = 64
#: Chunks and ids that one Python worker remembers; the memory is emptied when full, which costs time only.
MEMORY_CHUNKS, MEMORY_IDS = 500_000, 8_000_000
#: Bytes of texts that are encoded at a time; one longer text stands alone.
TEXT_BYTES = 2_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


class ByteBpe:
    """Encoder and decoder for a ``tokenizers`` JSON file of a byte-level BPE model."""

    def __init__(self, source: str | bytes):
        spec = json.loads(source)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for text, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in text)
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.of_byte = np.array([vocab[c] for c in symbols], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.base = top
        keys = np.array([vocab[a] * top + vocab[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.rank = dict(zip(keys.tolist()[::-1], range(len(keys) - 1, -1, -1), strict=True))
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.pattern = regex.compile(PRE_TOKEN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memory = WordMemory(self.learn, MEMORY_CHUNKS)
        self.clear()

    def _pair_values(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Leaf values of pairs; a negative id marks a missing neighbour."""
        key = left * self.base + right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[place] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[place] * width + at, INF)

    def merge_block(self, rows: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Merge many byte strings of at most ``width`` bytes; ``width`` is a power of two."""
        m = len(rows)
        lengths = np.fromiter(map(len, rows), np.int64, m)
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(m, width)
        ids = np.full((m, width + 1), -1, np.int64)
        cols = np.arange(width)
        ids[:, :width] = np.where(cols < lengths[:, None], self.of_byte[raw], -1)
        after = np.tile(np.minimum(np.arange(width + 1) + 1, width), (m, 1))
        before = np.tile(np.arange(width + 1) - 1, (m, 1))
        before[:, 0] = width
        tree = np.full((m, 2 * width), INF, np.int64)
        tree[:, width:] = self._pair_values(ids[:, :width], ids[:, 1:], np.broadcast_to(cols, (m, width)), width)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + width
            tree[row, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] < INF)
        while len(live):
            root = tree[live, 1]
            p = root % width
            q = after[live, p]
            r = after[live, q]
            new = self.made[root // width]
            ids[live, p] = new
            ids[live, q] = -1
            after[live, p] = r
            before[live, r] = p
            put(live, q, np.full(len(live), INF))
            put(live, p, self._pair_values(new, np.where(r < width, ids[live, r], -1), p, width))
            o = before[live, p]
            some = np.flatnonzero(o < width)
            if len(some):
                row, at = live[some], o[some]
                put(row, at, self._pair_values(ids[row, at], new[some], at, width))
            live = live[tree[live, 1] < INF]
        keep = ids[:, :width] >= 0
        flat, ends = ids[:, :width][keep].tolist(), np.cumsum(keep.sum(1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_long(self, row: bytes) -> tuple[int, ...]:
        """Merge one byte string of any length: one tree, logarithmic point updates."""
        n = len(row)
        width = 1 << max(1, (n - 1).bit_length())
        ids = self.of_byte[np.frombuffer(row, np.uint8)]
        leaves = np.full(width, INF, np.int64)
        leaves[: n - 1] = self._pair_values(ids[:-1], ids[1:], np.arange(n - 1), width)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [INF, *chain.from_iterable(x.tolist() for x in levels[::-1])]
        at, rank, base, made, none = ids.tolist(), self.rank, self.base, self.made.tolist(), int(INF)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        live = [True] * n

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low

        def value(i: int) -> int:
            j = after[i]
            r = rank.get(at[i] * base + at[j]) if j >= 0 else None
            return none if r is None else r * width + i

        while tree[1] < none:
            r, p = divmod(tree[1], width)
            q = after[p]
            at[p] = made[r]
            live[q] = False
            after[p] = after[q]
            if after[p] >= 0:
                before[after[p]] = p
            put(q, none)
            put(p, value(p))
            if before[p] >= 0:
                put(before[p], value(before[p]))
        return tuple(x for x, keep in zip(at, live, strict=True) if keep)

    def merge(self, rows: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(rows)
        groups: dict[int, list[int]] = {}
        for i, row in enumerate(rows):
            n = len(row)
            if n == 1:
                out[i] = (int(self.of_byte[row[0]]),)
            elif n > BLOCK_BYTES:
                out[i] = self.merge_long(row)
            elif n:
                groups.setdefault(max(2, 1 << (n - 1).bit_length()), []).append(i)
        for width, members in groups.items():
            for i, ids in zip(members, self.merge_block([rows[i] for i in members], width), strict=True):
                out[i] = ids
        return out

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special tokens, in order."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.pattern.findall(part)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of one text, without the memory."""
        parts = self.pieces(text)
        merged = self.merge([b"" if p in self.special else p.encode("utf-8", "surrogatepass") for p in parts])
        return [i for p, ids in zip(parts, merged, strict=True) for i in ((self.special[p],) if p in self.special else ids)]

    def clear(self) -> None:
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.joined, self.decoded = np.empty(1 << 14, object), np.empty(1 << 14, object)
        self.n = self.used = 0
        self.memory.clear()

    def learn(self, new: list[bytes]) -> None:
        """Merge the pieces of new chunks, each piece once."""
        split = [self.pattern.findall(w.decode("utf-8", "surrogatepass")) for w in new]
        pieces = list(dict.fromkeys(chain.from_iterable(split)))
        ids_of = dict(zip(pieces, self.merge([p.encode("utf-8", "surrogatepass") for p in pieces]), strict=True))
        each = [ids_of[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable([ids_of[p] for p in parts])) for parts in split]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        n, total = self.n + len(new), int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n > len(self.starts):
            self.starts, self.lengths, self.joined, self.decoded = (np.concatenate((x, np.empty_like(x))) for x in (self.starts, self.lengths, self.joined, self.decoded))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(each), np.int32, total)
        self.starts[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.lengths[self.n : n] = sizes
        of = self.bytes_of
        self.joined[self.n : n] = [",".join(map(str, ids)).encode() for ids in each]
        self.decoded[self.n : n] = [b"".join([of[i] for i in ids]) for ids in each]
        self.n, self.used = n, self.used + total

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
        """Ids of texts one after another, how many each has, the ids joined by commas and their bytes; nulls have none.

        Texts are cut before runs of ASCII white space and between letters and marks, where the pattern always cuts; the chunks' ids follow one
        another as the whole text's would. Texts with other white space or special tokens are encoded whole.
        """
        if self.used > MEMORY_IDS:
            self.clear()
        data, edges = bytes_of(column, lower=False)
        starts, ends, sizes = cut_whole(data, edges, ASCII_SPACE, after_letters(data))
        apart = odd_texts(data, edges, [s.encode() for s in self.special])
        if len(apart):
            keep = ~np.isin(np.repeat(np.arange(len(sizes)), sizes), apart)
            starts, ends = starts[keep], ends[keep]
            sizes[apart] = 0
        found = self.memory.numbers(data, starts, ends)
        if found is None:  # the memory was full
            self.clear()
            found = self.memory.numbers(data, starts, ends)
        many = self.lengths[found]
        after = np.concatenate(([0], np.cumsum(many)))
        ids = self.flat[np.repeat(self.starts[found] - after[:-1], many) + np.arange(after[-1])]
        last = np.cumsum(sizes)
        stops = after[last]
        joined, decoded = self.joined[found].tolist(), self.decoded[found].tolist()
        cuts = list(zip((last - sizes).tolist(), last.tolist(), strict=True))
        texts, raw = [b",".join(joined[a:b]) for a, b in cuts], [b"".join(decoded[a:b]) for a, b in cuts]
        if len(apart):
            parts = np.split(ids, stops[:-1])
            for i, text in zip(apart.tolist(), column.take(pa.array(apart)).to_pylist(), strict=True):
                whole = self.encode(text)
                parts[i], texts[i], raw[i] = np.array(whole, np.int32), ",".join(map(str, whole)).encode(), b"".join([self.bytes_of[k] for k in whole])
            ids, stops = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return ids, np.diff(np.concatenate(([0], stops))).astype(np.int64), texts, raw

    def decode(self, ids: list[int]) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in ids]).decode("utf-8", "replace")


def loaded(source: bytes) -> ByteBpe:
    """One encoder for each Python worker."""
    return kept("bpe" + hashlib.sha256(source).hexdigest(), lambda: ByteBpe(source))


def encode(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode and decode every text.

    Returns the id column, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, when
    ``with_ids``, ``ids array<int>`` and ``decoded string``. ``vocabulary`` is the path of a
    tokenizers JSON file on the driver; its content (a few MB, whatever the data) is broadcast.
    """
    with open(vocabulary, "rb") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches):
        bpe = loaded(source.value)
        for batch in sliced(batches):
            at = 0
            for texts in blocks_of(batch.column(1), TEXT_BYTES):
                ids, lengths, joined, raw = bpe.encode_column(texts)
                decoded = [x.decode("utf-8", "replace") for x in raw]
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array(lengths, pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in joined], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(texts)

    return map_rows(df, id_col, text_col, run, schema)
