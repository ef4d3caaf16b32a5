"""Hard negatives by blocked dense products.

Components become integers, ``floor(scale * x)``, so that scores are whole numbers and sums of float64 products are exact below
2**53. Anchors are cut into blocks of bounded bytes. One block at a time is broadcast; tasks multiply it with blocks of candidates and keep
short lists that merge: first the best positives of each anchor, then, with those known, the best negatives inside the window of each
positive. A task's lists hold a few rows for each anchor, whatever the number of candidates, so the shuffle never sees a pair that isn't
among a task's best.

Edge cases: rows with a null id or label, a null vector, or a null or non-finite component take no part. Vectors of different lengths never meet;
empty vectors score zero. Every row counts: of repeated rows each is a candidate of its own and an anchor of its own (with equal
result rows), and an anchor isn't its own positive while a copy of it is. Ties go by the smaller id. A positive with a
negative score has an empty window. Products that could reach 2**53 are computed with whole numbers of any size; those beyond 64 bits are cut to
the largest ones. Tables without rows or anchors give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, release, shared_path, sliced

#: Bytes of the float64 matrix of one block of anchors, which is what a broadcast holds.
BLOCK_BYTES = 16 << 20
#: Anchors and candidates of one product, which bounds a task's memory.
ANCHOR_ROWS, CANDIDATE_ROWS = 1024, 1024
EXACT = 2.0**53
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(df: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """``(id, label, vector)`` of the rows that take part."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vector"), finite.alias("finite")).where(
        "id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND finite"
    ).drop("finite")


def matrices(batch: pa.RecordBatch | pa.Table, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(row numbers, ids, labels, whole-number vectors)`` of a batch, for each length of vectors; rows by ascending id."""
    ids, labels, vectors = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in batch.columns[:3])
    if not len(ids):
        return
    ids, labels = ids.to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        yield rows, ids[rows], labels[rows], flat[starts[rows][:, None] + np.arange(length)]


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, as float64 where they stay below 2**53, else as 64-bit integers cut at the ends."""
    if not a.shape[1] or np.abs(a).max(initial=0) * np.abs(c).max(initial=0) * a.shape[1] < EXACT:
        return a @ c.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.clip(whole(a) @ whole(c).T, -LAST, LAST).astype(np.int64)


class Best:
    """The ``k`` best (score, id) of each of ``n`` rows: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.score, self.id, self.own = np.full((n, k), NONE), np.full((n, k), LAST), np.zeros((n, k), bool)

    def offer(self, at: slice, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, own) -> None:
        """Take what beats the last of the rows ``at`` from a block of scores; ``own(rows, columns, scores)`` marks an anchor's own row."""
        last, last_id = self.score[at, -1], self.id[at, -1]
        rows, columns = np.nonzero((scores >= last[:, None]) & allowed)
        if not len(rows):
            return
        s, i = scores[rows, columns].astype(np.int64), ids[columns]
        better = (s > last[rows]) | (i < last_id[rows])
        rows, columns, s, i = rows[better], columns[better], s[better], i[better]
        if not len(rows):
            return
        touched, k = np.unique(rows), self.score.shape[1]
        held = np.repeat(touched, k)
        old = (touched[:, None] + at.start, np.arange(k)[None, :])
        r = np.concatenate((held, rows))
        s, i, o = (np.concatenate((x[old].ravel(), new)) for x, new in ((self.score, s), (self.id, i), (self.own, own(rows, columns, s))))
        order = np.lexsort((~o, i, -np.maximum(s, -LAST), s == NONE, r))
        r, s, i, o = r[order], s[order], i[order], o[order]
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        rank = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
        kept = rank < k
        to = (r[kept] + at.start, rank[kept])
        self.score[to], self.id[to], self.own[to] = s[kept], i[kept], o[kept]


class Anchors:
    """One block of anchors of one vector length, and once they are known the windows of their positives."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.labels, self.vectors = rows, ids, labels, vectors
        self.squares = np.concatenate([np.diagonal(products(vectors[i : i + 1], vectors[i : i + 1])) for i in range(len(ids))]) if len(ids) else np.zeros(0)
        self.low = self.high = self.positive = self.score = None

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """``(anchors, scores, whether labels agree)`` for parts of the block."""
        for start in range(0, len(self.ids), ANCHOR_ROWS):
            at = slice(start, min(start + ANCHOR_ROWS, len(self.ids)))
            yield at, products(self.vectors[at], vectors), self.labels[at, None] == labels[None, :]

    def own(self, at: slice, ids: np.ndarray, vectors: np.ndarray):
        """Whether a candidate is the anchor itself: same id, label and vector (all three products agree)."""
        def told(rows, columns, scores):
            same = ids[columns] == self.ids[at][rows]
            for k in np.flatnonzero(same):
                v = vectors[columns[k] : columns[k] + 1]
                same[k] = scores[k] == self.squares[at][rows[k]] == products(v, v)[0, 0]
            return same

        return told

    def windows(self, positive: np.ndarray, score: np.ndarray, filled: np.ndarray, low: int, high: int) -> None:
        """Whole-number bounds of negatives: ``low * positive <= 100 * negative <= high * positive``."""
        self.positive, self.score = positive, score
        wide = score.astype(object)
        self.low = np.where(filled, -((-low * wide) // 100), LAST).astype(np.int64)
        self.high = np.where(filled, (high * wide) // 100, -LAST).astype(np.int64)


def positive_lists(blocks, k: int, scale: int):
    def run(batches):
        groups = {g.vectors.shape[1]: (g, Best(len(g.ids), k)) for g in blocks.value}
        for batch in sliced(batches, CANDIDATE_ROWS):
            for _, ids, labels, vectors in matrices(batch, scale):
                if vectors.shape[1] in groups:
                    group, best = groups[vectors.shape[1]]
                    for at, scores, same in group.meet(ids, labels, vectors):
                        best.offer(at, scores, same, ids, group.own(at, ids, vectors))
        for group, best in groups.values():
            a, j = np.nonzero(best.score != NONE)
            yield pa.RecordBatch.from_arrays([pa.array(group.rows[a]), pa.array(best.score[a, j]), pa.array(best.id[a, j]), pa.array(best.own[a, j])], names=["a", "score", "id", "own"])

    return run


def negative_lists(blocks, k: int, scale: int):
    def run(batches):
        groups = {g.vectors.shape[1]: (g, [Best(len(g.ids), k) for _ in range(g.low.shape[1])]) for g in blocks.value}
        never = lambda rows, columns, scores: np.zeros(len(rows), bool)
        for batch in sliced(batches, CANDIDATE_ROWS):
            for _, ids, labels, vectors in matrices(batch, scale):
                if vectors.shape[1] in groups:
                    group, bests = groups[vectors.shape[1]]
                    for at, scores, same in group.meet(ids, labels, vectors):
                        other = ~same
                        for p, best in enumerate(bests):
                            inside = (scores <= group.high[at, p, None]) & (scores >= group.low[at, p, None])
                            inside &= other
                            best.offer(at, scores, inside, ids, never)
        for group, bests in groups.values():
            for p, best in enumerate(bests):
                a, j = np.nonzero(best.score != NONE)
                columns = [group.rows[a], np.full(len(a), p), group.ids[a], group.positive[a, p], group.score[a, p], best.id[a, j], best.score[a, j]]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["a", "p", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def first(lists: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``; tasks cut their own groups before the shuffle."""
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def of_block(rows: DataFrame, block: pa.Table, positives: int, negatives: int, low: int, high: int, scale: int):
    """The negatives for one block of anchors, and the broadcasts that they need."""
    spark = rows.sparkSession
    groups = [Anchors(*m) for m in matrices(block, scale)]
    sent = spark.sparkContext.broadcast(groups)
    lists = rows.mapInArrow(positive_lists(sent, positives + 1, scale), "a long, score long, id long, own boolean")
    found = first(lists, ["a"], [F.desc("score"), "id", F.desc("own")], positives + 1).orderBy("a", "rank").toArrow()
    sent.unpersist()
    a, score, ids, own = (found.column(c).to_numpy() for c in ("a", "score", "id", "own"))
    n = block.num_rows
    # one row of each anchor is the anchor itself; without it the first ones are the positives
    begun = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.zeros(0, bool)
    seen = np.cumsum(own) - np.repeat((np.cumsum(own) - own)[begun], np.diff(np.append(np.flatnonzero(begun), len(a))))
    kept = ~(own & (seen == 1))
    a, score, ids = a[kept], score[kept], ids[kept]
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, int)
    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    a, score, ids, rank = (x[rank < positives] for x in (a, score, ids, rank))
    positive, scores, filled = np.zeros((n, positives), np.int64), np.zeros((n, positives), np.int64), np.zeros((n, positives), bool)
    positive[a, rank], scores[a, rank], filled[a, rank] = ids, score, True
    for g in groups:
        g.windows(positive[g.rows], scores[g.rows], filled[g.rows], low, high)
    sent = spark.sparkContext.broadcast(groups)
    lists = rows.mapInArrow(negative_lists(sent, negatives, scale), "a long, p long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return first(lists, ["a", "p"], [F.desc("negative_score"), "negative_id"], negatives), sent


def mine(
    df: DataFrame, anchor: Column, label: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: int = 256, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: the first ``negatives`` rows of another label for each
    anchor and each of its first ``positives`` rows of its label, that score ``low`` to ``high`` percent of the positive.

    ``anchor`` tells anchors from ``id``. All rows are candidates. Blocks of anchors follow one another, each a scan of all rows for positives and
    one for negatives; what they find is appended to a table in the shared folder.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, label, vector_col)
    chosen = rows.where(anchor)
    size = chosen.agg(F.coalesce(F.sum(F.size("vector") * F.lit(8) + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    if blocks > 1:
        # dealt out at random and written once, so that a retried task can't deal them anew
        chosen = materialize(chosen.withColumn("at", F.floor(F.rand(11) * blocks).cast("int")), "anchors")
    path = shared_path(spark, "negatives")
    for at in range(blocks):
        block = (chosen.where(F.col("at") == at).drop("at") if blocks > 1 else chosen).orderBy("id").toArrow()
        found, sent = of_block(rows, block, positives, negatives, low, high, scale)
        found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
        sent.unpersist()
    if blocks > 1:
        release(chosen)
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(path)
