"""Token ids in binary files: patched frame-of-reference blocks with an index of block starts.

File layout, little endian::

    magic b"PFOR1\\0", u16 block size B, u64 documents D, u64 ids T, u64 blocks K
    i64 length of the document table, then that many bytes: zlib of u32[D] lengths
    K entries of the block index: u64 start of the block in the payload, u32 minimum,
        u8 width, u8 bytes of an exception position, u16 exceptions
    payload: per block ceil(B / 64) * width u64 words, exception positions u16[], exception values u32[]
    u32 crc32 of all ids as little-endian u32

Each block subtracts its minimum and packs at the width that a given share of its values needs;
wider values are exceptions, of which the low bits stay in place and the whole difference
goes to the list. A block decodes on its own, so a document is read without the rest.

Where the table's partitions hold ascending integer ids one after another, each task encodes its own rows and no text moves; elsewhere
documents are dealt out by ranges of (id, hash of text), as many as the rows ask for. Files in order of their
names hold documents in ascending id order; each task writes files of at most ``file_ids`` ids
(or one longer document). A file is written under a name of its own attempt and renamed when complete, so lost
or repeated tasks leave no half files; the manifest names those that count.

Edge cases: null and empty texts have no ids of their own, only the end id; equal ids (null ones first)
are ordered by a hash of the text, equal rows in any order; texts of any length are encoded whole; empty tables give no files and an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, LongType, StructType

from ledgerloom.llm.common import blocks_of, kept, materialize, release, shared_path, sliced
from ledgerloom.llm.wordmemory import ASCII_SPACE, WordMemory, after_letters, bytes_of, cut, odd_texts

MAGIC = b"PFOR1\0"
HEAD = struct.Struct("<6sHQQQq")
INDEX = np.dtype([("start", "<u8"), ("least", "<u4"), ("width", "u1"), ("spare", "u1"), ("exceptions", "<u2")])
BLOCK = 1024
#: Share of a block's values that its width must hold.
PERCENTILE = 0.95
#: Words and ids that one Python worker remembers, and letters of a word up to which new ones are encoded side by side.
MEMORY_WORDS, MEMORY_IDS, SIDE_BY_SIDE = 1_200_000, 16_000_000, 64
#: Rows of a range that documents are dealt to, where they don't lie in order already.
RANGE_ROWS = 100_000
#: Bytes of one block of texts.
BLOCK_BYTES = 4_000_000


def bit_widths(x: np.ndarray) -> np.ndarray:
    """Bits each unsigned value needs."""
    return np.where(x == 0, 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))) + 1).astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of a multiple of 64 values below ``2**width`` as rows of 64-bit words."""
    lanes = values.astype(np.uint64).reshape(-1, 64).T
    out = np.zeros((max(width, 0), lanes.shape[1]), np.uint64)
    for j in range(64 if width else 0):
        word, bit = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(bit)
        if bit + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - bit)
    return out.T.reshape(len(values), -1)


def unpack(words: np.ndarray, width: int, size: int) -> np.ndarray:
    if not width:
        return np.zeros((len(words), size), np.uint64)
    lanes = words.reshape(-1, width).T
    mask = np.uint64((1 << width) - 1)
    out = np.empty((64, lanes.shape[1]), np.uint64)
    for j in range(64):
        word, bit = divmod(j * width, 64)
        v = lanes[word] >> np.uint64(bit)
        if bit + width > 64:
            v = v | (lanes[word + 1] << np.uint64(64 - bit))
        out[j] = v & mask
    return out.T.reshape(len(words), -1)


def write_blocks(ids: np.ndarray, lengths: np.ndarray, *, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The bytes of a file that holds ``ids`` (u32) of documents of ``lengths``."""
    n = len(ids)
    k = -(-n // block)
    padded = np.full(k * block, ids[-1] if n else 0, np.uint32)
    padded[:n] = ids
    rows = padded.reshape(k, block)
    least = rows.min(1) if k else np.zeros(0, np.uint32)
    above = rows - least[:, None]
    rank = max(0, int(np.ceil(percentile * block)) - 1)
    widths = bit_widths(np.partition(above, rank, axis=1)[:, rank]) if k else np.zeros(0, np.int64)
    parts: list[bytes] = [b""] * k
    index = np.zeros(k, INDEX)
    index["least"], index["width"] = least, widths
    for width in np.unique(widths).tolist():
        some = np.flatnonzero(widths == width)
        values = above[some]
        words = pack(values & np.uint32((1 << width) - 1), width)
        wide = values >> np.uint32(width) > 0 if width < 32 else np.zeros(values.shape, bool)
        for i, row, over, value in zip(some.tolist(), words, wide, values, strict=True):
            at = np.flatnonzero(over)
            index["exceptions"][i] = len(at)
            parts[i] = row.astype("<u8").tobytes() + at.astype("<u2").tobytes() + value[at].astype("<u4").tobytes()
    index["start"] = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])) if k else []
    table = zlib.compress(lengths.astype("<u4").tobytes(), 1)
    head = HEAD.pack(MAGIC, block, len(lengths), n, k, len(table))
    return b"".join([head, table, index.tobytes(), *parts, struct.pack("<I", zlib.crc32(ids.astype("<u4").tobytes()))])


class TokenFile:
    """A file's content: document lengths, and ids by block."""

    def __init__(self, data: bytes):
        magic, self.block, docs, self.n, k, size = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        self.lengths = np.frombuffer(zlib.decompress(data[at : at + size]), "<u4").astype(np.int64)
        self.index = np.frombuffer(data, INDEX, k, at + size)
        self.payload = memoryview(data)[at + size + self.index.nbytes : -4]
        self.crc = struct.unpack("<I", data[-4:])[0]
        assert docs == len(self.lengths)

    def blocks(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of whole blocks, a row for each."""
        out = np.empty((len(numbers), self.block), np.uint32)
        entries = self.index[numbers]
        for width in np.unique(entries["width"]).tolist():
            some = np.flatnonzero(entries["width"] == width)
            size = self.block // 64 * width
            starts = entries["start"][some].astype(np.int64)
            words = np.stack([np.frombuffer(self.payload, "<u8", size, s) for s in starts.tolist()])
            values = unpack(words, width, self.block).astype(np.uint32)
            for j, (i, s) in enumerate(zip(some.tolist(), starts.tolist(), strict=True)):
                n = int(entries["exceptions"][i])
                if n:
                    at = np.frombuffer(self.payload, "<u2", n, s + 8 * size)
                    values[j, at] = np.frombuffer(self.payload, "<u4", n, s + 8 * size + 2 * n)
            out[some] = values + entries["least"][some][:, None]
        return out

    def ids(self) -> np.ndarray:
        out = self.blocks(np.arange(len(self.index))).ravel()[: self.n]
        if zlib.crc32(out.astype("<u4").tobytes()) != self.crc:
            raise ValueError("a token file is damaged")
        return out

    def document(self, number: int) -> np.ndarray:
        """Ids of one document, from its own blocks."""
        start = int(self.lengths[:number].sum())
        end = start + int(self.lengths[number])
        first = start // self.block
        if end == start:
            return np.zeros(0, np.uint32)
        return self.blocks(np.arange(first, -(-end // self.block))).ravel()[start - first * self.block : end - first * self.block]


class ChunkEncoder:
    """The library's encoder behind a memory of words, cut where its pre-tokenizer always cuts.

    Only for tokenizers that drop white space, take runs of letters whole, lower-case, and close words with a suffix. Texts are cut at
    ASCII white space and between a letter and a mark; the words' ids follow one another as the whole text's
    would. New words of letters go through the library side by side in one text and are told apart by the
    suffix. Texts with other white space, or with marks that letters may join (U+0300 to U+036F), go through it whole.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        suffix = self.tokenizer.model.end_of_word_suffix
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        # A special token may hold what is cut here, so texts that hold one go through the library whole.
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = WordMemory(self.learn, MEMORY_WORDS)
        self.clear()

    def clear(self) -> None:
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n = self.used = 0
        self.memory.clear()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        parts = self.whole(words)
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(x) for x in parts], np.int64)

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, which go through the library in one text."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            found = self.whole([" ".join(some)])[0]
            stops = np.flatnonzero(self.ends[found]) + 1
            # A word may turn into several, as some capitals do.
            part, many = (found, np.diff(stops, prepend=0)) if len(stops) == len(some) else self.each(some)
            ids.append(part)
            sizes.append(many)
        return np.concatenate(ids), np.concatenate(sizes)

    def learn(self, new: list[bytes]) -> None:
        words = b"\n".join(new).decode("utf-8", "replace").split("\n")
        plain = np.array([w.isalpha() and len(w) <= SIDE_BY_SIDE for w in words])
        beside, alone = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids, sizes = zip(self.letters([words[i] for i in beside.tolist()]), self.each([words[i] for i in alone.tolist()]), strict=True)
        flat, many = np.concatenate(ids), np.concatenate(sizes)
        n, total = self.n + len(new), len(flat)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
            self.lengths = np.concatenate((self.lengths, np.zeros_like(self.lengths)))
        self.flat[self.used : self.used + total] = flat
        place = self.n + np.concatenate((beside, alone))
        self.starts[place] = self.used + np.cumsum(many) - many
        self.lengths[place] = many
        self.n, self.used = n, self.used + total

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and how many each has; nulls have none."""
        if self.used > MEMORY_IDS:
            self.clear()
        data, edges = bytes_of(column, lower=True)
        starts, ends, sizes = cut(data, edges, ASCII_SPACE, after_letters(data))
        apart = odd_texts(data, edges, self.special)
        if len(apart):
            owner = np.repeat(np.arange(len(sizes)), sizes)
            keep = ~np.isin(owner, apart)
            starts, ends, sizes = starts[keep], ends[keep], np.where(np.isin(np.arange(len(sizes)), apart), 0, sizes)
        found = self.memory.numbers(data, starts, ends)
        if found is None:  # the memory was full
            self.clear()
            found = self.memory.numbers(data, starts, ends)
        lengths = self.lengths[found]
        after = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.flat[np.repeat(self.starts[found] - after[:-1], lengths) + np.arange(after[-1])]
        stops = after[np.cumsum(sizes)]
        if len(apart):
            whole = dict(zip(apart.tolist(), self.whole(column.take(pa.array(apart)).to_pylist()), strict=True))
            parts = np.split(ids, stops[:-1])
            parts = [whole.get(i, part) for i, part in enumerate(parts)]
            ids, stops = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return ids, np.diff(np.concatenate(([0], stops))).astype(np.int64)


def loaded(source: str) -> ChunkEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept("chunks" + hashlib.sha256(source.encode()).hexdigest(), lambda: ChunkEncoder(source))


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def write(
    df: DataFrame, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, file_ids: int = 4_000_000, partitions: int | None = None, block: int = BLOCK, percentile: float = PERCENTILE
) -> DataFrame:
    """Write ids of all documents to files and return the manifest.

    The manifest has a row per file: ``part``, ``number``, ``path``, ``first`` (ids of all files
    before it), ``n_ids`` and ``doc_ids`` in order. ``path`` is a URI that pyarrow and all executors reach.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, "tokens")
    with open(tokenizer, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    named = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = named.schema["id"].dataType
    runs = stretches(named) if partitions is None else None
    encode = partial(encoded, source=source, path=path, end=end_id, file_ids=file_ids, block=block, percentile=percentile)
    schema = StructType.fromDDL("part long, number long, file string, n_ids long, ordered boolean").add("doc_ids", ArrayType(kind))
    files = totals = None
    if runs is not None and runs["ordered"]:
        files = materialize(named.mapInArrow(partial(encode, numbers=runs["numbers"]), schema), "manifest")
        totals = parts_of(files)
        if any(not r["ordered"] for r in totals) or any(a["last"] >= b["first"] for a, b in zip(totals, totals[1:], strict=False)):
            release(files)  # the table was read in other pieces than before
            files = None
    if files is None:
        rows = runs["rows"] if runs else 0
        n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-rows // RANGE_ROWS))
        # Rows of the same id and text still have keys of their own, so no range grows with their number.
        keyed = named.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
        dealt = keyed.repartitionByRange(n, "id", "h", "row").sortWithinPartitions("id", "h", "row")
        path = f"{path}/dealt"
        files = materialize(dealt.select("id", "text").mapInArrow(partial(encode, path=path, numbers=None), schema), "manifest")
        totals = parts_of(files)
    # One row per partition: as many as there are tasks, whatever the number of documents.
    before, offsets = 0, []
    for r in totals:
        offsets.append((r["part"], before))
        before += r["n"]
    offset = spark.createDataFrame(offsets, "part long, before long")
    order = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(F.broadcast(offset), "part").select(
        "part", "number", F.concat(F.lit(path + "/"), "file").alias("path"), (F.col("before") + F.coalesce(F.sum("n_ids").over(order), F.lit(0))).alias("first"), "n_ids", "doc_ids"
    )


def parts_of(files: DataFrame) -> list:
    """What each task has written, in the order of the parts."""
    ends = F.element_at("doc_ids", 1), F.element_at("doc_ids", -1)
    rows = files.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min(ends[0]).alias("first"), F.max(ends[1]).alias("last"), F.min("ordered").alias("ordered")).collect()
    return sorted(rows, key=lambda r: r["part"])


def stretches(named: DataFrame) -> dict:
    """Whether the partitions hold ascending ids one after another, their numbers in that order, and how many rows there are; reads ids only."""
    if not isinstance(named.schema["id"].dataType, IntegralType):
        return {"ordered": False, "numbers": None, "rows": named.count()}

    def run(batches):
        from pyspark import TaskContext

        first = last = None
        ordered, n = True, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            n += batch.num_rows
            if column.null_count:
                ordered = False
                continue
            ids = column.to_numpy()
            ordered = ordered and bool((np.diff(ids) > 0).all()) and (last is None or int(ids[0]) > last)
            first, last = int(ids[0]) if first is None else first, int(ids[-1])
        if n:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first": first, "last": last, "ordered": ordered, "n": n}], schema=pa.schema([("part", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("ordered", pa.bool_()), ("n", pa.int64())]))

    found = named.select("id").mapInArrow(run, "part long, first long, last long, ordered boolean, n long").collect()
    ordered = all(r["ordered"] for r in found)
    found.sort(key=lambda r: (r["first"] is None, r["first"] or 0))
    ordered = ordered and all(a["last"] < b["first"] for a, b in zip(found, found[1:], strict=False))
    return {"ordered": ordered, "numbers": {r["part"]: i for i, r in enumerate(found)}, "rows": sum(r["n"] for r in found)}


def encoded(batches, *, source, path: str, end: int, file_ids: int, block: int, percentile: float, numbers: dict | None):
    """Encode a task's documents, write files and yield their rows of the manifest."""
    from pyspark import TaskContext

    encoder, part, number = loaded(source.value), TaskContext.get().partitionId(), 0
    part = part if numbers is None else numbers.get(part, len(numbers) + part)
    store, root = open_store(path)
    store.create_dir(root, recursive=True)
    held: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    names: list[pa.Array] = []
    size = 0
    ordered, last = True, None

    def put():
        nonlocal number, size
        ids, lengths = np.concatenate(held), np.concatenate(counts)
        final = f"{root}/part-{part:06d}-{number:06d}.pfor"
        temporary = f"{root}/.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(temporary) as f:
            f.write(write_blocks(ids, lengths, block=block, percentile=percentile))
        store.move(temporary, final)
        ids_of = pa.concat_arrays(names)
        row = [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([f"part-{part:06d}-{number:06d}.pfor"]), pa.array([len(ids)], pa.int64()), pa.array([ordered])]
        row.append(pa.ListArray.from_arrays(pa.array([0, len(ids_of)], pa.int32()), ids_of))
        held.clear()
        counts.clear()
        names.clear()
        number, size = number + 1, 0
        return pa.RecordBatch.from_arrays(row, names=["part", "number", "file", "n_ids", "ordered", "doc_ids"])

    for batch in batches:
        column = batch.column(0)
        if numbers is not None and batch.num_rows:
            seen = column.to_numpy(zero_copy_only=False)
            ordered = ordered and not column.null_count and bool((np.diff(seen) > 0).all()) and (last is None or seen[0] > last)
            last = seen[-1]
        at = 0
        for texts in blocks_of(batch.column(1), BLOCK_BYTES):
            ids, lengths = encoder(texts)
            stops = np.cumsum(lengths)
            ids, lengths, stops = np.insert(ids, stops, end), lengths + 1, stops + np.arange(1, len(stops) + 1)
            done = 0
            while done < len(lengths):
                before = stops[done - 1] if done else 0
                fit = int(np.searchsorted(stops, before + file_ids - size, side="right"))
                fit = max(fit, done + (0 if held else 1))  # a longer document has a file of its own
                if fit > done:
                    held.append(ids[before : stops[fit - 1]])
                    counts.append(lengths[done:fit])
                    names.append(column.slice(at + done, fit - done))
                    size += int(stops[fit - 1] - before)
                    done = fit
                if done < len(lengths):
                    yield put()
            at += len(texts)
    if held:
        yield put()


def read(manifest: DataFrame, *, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Documents of written files: id, ``start``, ``n_tokens``, ``ids_crc32`` and, when ``with_ids``, ``ids``."""
    kind = manifest.schema["doc_ids"].dataType.elementType
    schema = StructType().add(id_col, kind).add("start", LongType()).add("n_tokens", LongType()).add("ids_crc32", LongType())
    if with_ids:
        schema = schema.add("ids", ArrayType(LongType()))

    def run(batches):
        for batch in sliced(batches, 1):
            row = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            uri, first = row["path"][0].as_py(), row["first"][0].as_py()
            store, at = open_store(uri)
            with store.open_input_stream(at) as f:
                file = TokenFile(f.read())
            ids = file.ids().astype("<u4")
            ends = np.cumsum(file.lengths)
            starts = ends - file.lengths
            raw = memoryview(ids.tobytes())
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            columns = [row["doc_ids"].flatten(), pa.array(first + starts), pa.array(file.lengths), pa.array(crcs, pa.int64())]
            names = [id_col, "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int64))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    spread = manifest.select("path", "first", "doc_ids").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2), "path")
    return spread.mapInArrow(run, schema)
