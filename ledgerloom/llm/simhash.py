"""SimHash near-duplicates: segment popcounts, a grid range-join and exact verification.

A fingerprint's embedding is the bit count of each of its 32 two-bit segments, kept in unary
(0 -> 00, 1 -> 01, 2 -> 11), so that the Manhattan distance of two embeddings is the bit count of
their exclusive or. It never exceeds the Hamming distance. The grid has cells over both halves of the embedding. Two
fingerprints within 2 bits either agree in one half and in one third of the other, or one of them lies one step up in one coordinate of
the first half and they agree in one half of the second; hence each fingerprint has its home cells, and probes those one step up. Pairs are
checked by the Manhattan bound first and then bit by bit.

A cell of more than ``dense`` fingerprints is split by finer segments: of ``m`` groups of bits all but two must agree, so each
fingerprint goes to one cell for each choice of the groups that do, with ``m`` growing until cells are thin. The finest cells leave 8
bits open, so none holds more than 256 fingerprints that live in it, whatever the sizes of the groups.

Edge cases: null and empty texts have fingerprint zero and link like any other; rows with the same
text or id each get a row; a null id is never a component's smallest id, so a component of
null ids only has a null one; texts of any length are read whole; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_rows, materialize, release, sliced
from ledgerloom.llm.graph import components

SEED = 42
#: Hashes that are counted at a time, which bounds memory for texts of any length.
BLOCK_HASHES = 200_000
LOW = 0x5555555555555555
HALF = (1 << 32) - 1


def shingle_hashes(text: str | None, width: int) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) < width:
        return [h(b" ".join(words), SEED)]
    join = b" ".join
    return [h(join(s), SEED) for s in zip(*(words[i:] for i in range(width)), strict=False)]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """The bits set in over half of each list, as unsigned 64-bit integers."""
    counts = np.zeros((len(hashes), 64), np.int64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    rows = [i for i, h in enumerate(hashes) if h]
    at = 0
    while at < len(rows):
        group, n = [], 0
        while at < len(rows) and (not group or n + sizes[rows[at]] <= BLOCK_HASHES):
            group.append(rows[at])
            n += sizes[rows[at]]
            at += 1
        if len(group) == 1:
            for k in range(0, n, BLOCK_HASHES):
                part = np.array(hashes[group[0]][k : k + BLOCK_HASHES], "<u8")
                counts[group[0]] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            continue
        flat = np.array([x for i in group for x in hashes[i]], "<u8")
        starts = np.concatenate(([0], np.cumsum(sizes[group])[:-1]))
        counts[group] = np.add.reduceat(np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1), starts, axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > sizes[:, None], axis=1).view("<u8").ravel()


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp long)`` for each row; ``fp`` holds the 64 bits, read as a signed number."""
    def run(batches):
        for batch in sliced(batches):
            bits = majority([shingle_hashes(t, shingle) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view("<i8"))], names=[id_col, "fp"])

    return map_rows(df, id_col, text_col, run, "fp long")


def unary(fp: str) -> str:
    """SQL for the embedding of a fingerprint."""
    return f"((({fp} | shiftrightunsigned({fp}, 1)) & {LOW}L) | shiftleft(({fp} & shiftrightunsigned({fp}, 1)) & {LOW}L, 1))"


def cells(fps: DataFrame) -> DataFrame:
    """``(cell, role, fp)``: the grid cells of ``fps(fp)``. Role 0 meets its like, a probe (2) meets homes (1).

    A cell is its kind, a half of the embedding and a part of the other half.
    """
    low, high = f"(e & {HALF}L)", "shiftrightunsigned(e, 32)"
    cell = lambda kind, whole, part: f"shiftleft({kind}L, 56) | shiftleft({whole}, 16) | {part}"
    thirds = [(0, 1023), (10, 1023), (20, 4095)]
    like = [cell(kind * 3 + i, whole, f"(shiftrightunsigned({other}, {at}) & {mask}L)") for kind, (whole, other) in enumerate(((low, high), (high, low))) for i, (at, mask) in enumerate(thirds)]
    halves = [(0, 65535), (16, 65535)]
    home = [cell(6 + i, low, f"(shiftrightunsigned({high}, {at}) & {mask}L)") for i, (at, mask) in enumerate(halves)]
    up = f"CASE (shiftright({low}, 2 * i) & 3) WHEN 0 THEN {low} | shiftleft(1L, 2 * i) WHEN 1 THEN {low} | shiftleft(2L, 2 * i) END"
    steps = f"filter(transform(sequence(0, 15), i -> {up}), c -> c IS NOT NULL)"
    probe = f"flatten(transform({steps}, c -> array({', '.join(cell(6 + i, 'c', f'(shiftrightunsigned({high}, {at}) & {mask}L)') for i, (at, mask) in enumerate(halves))})))"
    emb = fps.selectExpr("fp", f"{unary('fp')} AS e")
    parts = [(0, f"array({', '.join(like)})"), (1, f"array({', '.join(home)})"), (2, probe)]
    rows = emb.selectExpr("fp", "explode(array(" + ", ".join(f"struct({role} AS role, {at} AS at)" for role, at in parts) + ")) AS x")
    return rows.selectExpr("explode(x.at) AS cell", "x.role AS role", "fp")


def split_cells(rows: DataFrame, groups: int) -> DataFrame:
    """Rows of finer cells: two fingerprints within 2 bits agree in all but two of ``groups`` groups of bits."""
    width = 64 // groups
    parts = [((1 << width) - 1) << (width * i) for i in range(groups)]
    masks = [sum(p for k, p in enumerate(parts) if k not in (i, j)) for i in range(groups) for j in range(i)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return rows.select("cell", "role", "fp", F.posexplode(F.array(*(F.lit(m).cast("long") for m in signed)))).selectExpr("xxhash64(cell, pos, fp & col) AS cell", "role", "fp")


def matched(rows: DataFrame) -> DataFrame:
    """Pairs within 2 bits that meet in a cell."""
    condition = "a.cell = b.cell AND (a.role = 2 OR a.fp < b.fp) AND a.role + b.role IN (0, 3) AND bit_count({} ^ {}) <= 2 AND bit_count(a.fp ^ b.fp) <= 2"
    pairs = rows.where("role <> 1").alias("a").join(rows.where("role <> 2").alias("b"), F.expr(condition.format(unary("a.fp"), unary("b.fp"))))
    return pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def links(fps: DataFrame, *, dense: int = 64) -> DataFrame:
    """Edges ``(u, v)``: all pairs of ``fps(fp)`` within 2 bits, some of them more than once."""
    rows, found = cells(fps), []
    for groups in (4, 8, 16):
        crowded = materialize(rows.where("role <> 2").groupBy("cell").count().where(F.col("count") > dense).select("cell"), "crowded")
        if crowded.isEmpty():
            break
        found.append(matched(rows.join(crowded, "cell", "left_anti")))
        rows = materialize(split_cells(rows.join(crowded, "cell", "left_semi"), groups), "split")
    found.append(matched(rows))
    return reduce(DataFrame.unionByName, found)


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row: documents linked at 2 or fewer differing bits."""
    found = materialize(fingerprints(df, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    classes = materialize(found.groupBy("fp").agg(F.min(id_col).alias("least_id")), "classes")
    roots = materialize(components(links(classes.select("fp"))), "roots")
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialize(placed.join(least, "root").select("fp", "component_id"), "components")
    release(classes, roots)
    return found.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
