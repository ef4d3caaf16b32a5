"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A window is
``window`` consecutive words of an item, or the whole of a shorter item. The items' words are numbered, and windows go into the
automaton as two symbols for each word, so it has few nodes and few ways out of each; a text is normalised and numbered the same way and scanned
once. Ends of matches map back to word numbers, and those to offsets in the original text.

The automaton is built from the items only and its size is checked: items beyond
``pattern_words`` words of windows (about 100 bytes of automaton each) form further automata, each scanned in a pass of its own over what the previous
pass has written.

Edge cases: null and empty texts have no words and no hits; texts of any length are scanned whole; items without words match nothing;
repeated items and item ids count once; a null item id counts as the empty string; where windows overlap each word counts once; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm.common import kept, materialize, sliced

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words of windows in one automaton.
PATTERN_WORDS = 2_500_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows(text: str | None, width: int) -> list[tuple[bytes, ...]]:
    words = words_of(text)
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def shards(items: DataFrame, width: int, pattern_words: int, item_col: str, text_col: str):
    """Lists of (item id, text), each of at most ``pattern_words`` words of windows unless one item is longer."""
    part: list[tuple[str, str]] = []
    size = 0
    for row in items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), text_col).toLocalIterator():
        n = len(words_of(row[1]))
        cost = max(1, n - width + 1) * min(n, width)
        if part and size + cost > pattern_words:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += cost
    yield part


class Automaton:
    """The automaton of some items."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.names = [name for name, _ in items]
        words = dict.fromkeys(w for _, text in items for w in words_of(text))
        base = max(1, int(np.ceil(np.sqrt(len(words)))))
        # First and second symbols come from ranges of their own, so no match begins inside a word.
        self.symbols = {w: chr(1 + i // base) + chr(1 + base + i % base) for i, w in enumerate(words)}
        self.auto = ahocorasick.Automaton()
        for number, (_, text) in enumerate(items):
            for window in windows(text, width):
                pattern = "".join([self.symbols[w] for w in window])
                held = self.auto.get(pattern, None)
                if held is None:
                    self.auto.add_word(pattern, (len(window), {number}))
                else:
                    held[1].add(number)
        if len(self.auto):
            self.auto.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words lie in an occurring window (None if none does), and the items of those windows."""
        if not words or not len(self.auto):
            return None, set()
        get = self.symbols.get
        found = list(self.auto.iter("".join([get(w, "\0\0") for w in words])))
        if not found:
            return None, set()
        delta = np.zeros(len(words) + 1, np.int64)
        items: set[int] = set()
        for end, (count, numbers) in found:
            last = (end + 1) // 2
            delta[last - count] += 1
            delta[last] -= 1
            items |= numbers
        return np.cumsum(delta)[:-1] > 0, {self.names[i] for i in items}


def spans(text: str, hit: np.ndarray) -> list[dict]:
    """Offsets in the original text, in code points, of runs of hit words."""
    at = [m.span() for m in WORD.finditer(text.translate(_UPPER))]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in edges.reshape(-1, 2).tolist()]


def scan_documents(
    df: DataFrame, items: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pattern_words: int = PATTERN_WORDS
) -> DataFrame:
    """Per document: ``n_words``, ``n_hit``, ``item_ids`` (sorted) and ``spans`` of the hit text."""
    spark = df.sparkSession
    out = df.select(F.col(id_col), F.col(text_col).alias("__text"), F.lit(None).cast("array<boolean>").alias("__hit"), F.lit(None).cast("array<string>").alias("__items"))
    parts = shards(items, window, pattern_words, item_col, item_text_col)
    part = next(parts)
    while part is not None:
        after = next(parts, None)
        last = after is None
        shared, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batches, shared=shared, name=name, last=last):
            auto = kept("automaton" + name, lambda: Automaton(shared.value, window))
            for batch in sliced(batches):
                ids, texts, hits, items = (batch.column(i) for i in range(4))
                rows = []
                for text, was, names in zip(texts.to_pylist(), hits.to_pylist(), items.to_pylist(), strict=True):
                    words = words_of(text)
                    hit, found = auto.scan(words)
                    if was is not None:
                        hit = np.array(was, bool) if hit is None else hit | np.array(was, bool)
                    rows.append((text, len(words), hit, sorted(found | set(names or ()))))
                names = pa.array([r[3] for r in rows], pa.list_(pa.string()))
                if last:
                    columns = [
                        ids,
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([0 if r[2] is None else int(r[2].sum()) for r in rows], pa.int64()),
                        names,
                        pa.array([[] if r[2] is None else spans(r[0], r[2]) for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "n_hit", "item_ids", "spans"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, texts, pa.array([None if r[2] is None else r[2].tolist() for r in rows], pa.list_(pa.bool_())), names], names=[id_col, "__text", "__hit", "__items"])

        if last:
            return out.mapInArrow(run, StructType([out.schema[0], *StructType.fromDDL("n_words long, n_hit long, item_ids array<string>, spans array<struct<start: long, end: long>>").fields]))
        out = materialize(out.mapInArrow(run, out.schema), "scan")
        part = after
    raise AssertionError("there is always a first shard")


def digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(item_ids).encode()).hexdigest()
