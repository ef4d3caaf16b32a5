"""Near-duplicate embeddings by NN-descent over cosine similarity in double precision.

Equal vectors stand as one with a count. The first neighbour lists come from several random orders: in each, vectors are
sorted by hyperplane signs and a projection, dealt out by ranges, and compared with those close to them.
Each round then joins the neighbours of a vector (and those that have it as a neighbour) with one another and
keeps the ``k`` best of each; rounds end when the links no longer change.

A list whose ``k`` entries all reach the threshold is saturated: it may have more links than it can hold. The links of a component
with such lists are counted anew. Members so close to the component's centre that they link with all of it, by the angles, are counted
without comparison, and the outer ones have all inner ones as links. Outer members are compared with each other in blocks of which only counts leave. Where more than ``outer``
of them would meet, their lists are first enlarged fourfold, up to ``widest`` entries, and only those that are saturated even then are compared.
Two saturated vectors of different components may still link, with neither in the other's list. Saturated vectors are therefore
dealt into balls, each a member and those close to it, and components are merged until no two balls that could reach
each other, by the angles of their centres and radii, hold a link between two components.
Recall is audited: a hashed sample of vectors, half of it with links, is compared with all vectors; below ``recall``
the search goes on from further orders, and fails when ``attempts`` are through and the last one brought no more recall.
Joins go on until the links have settled. Edges below the threshold are dropped at the end.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't link; of equally near vectors the smaller scrambled row number stands first; rows that repeat a vector link with each other; rows that repeat an id are separate
vectors of that id; ids are read as longs; a null id never names a component of other vectors; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, release
from ledgerloom.llm.graph import components, scramble

#: Vectors compared with each other in a sorted order, members of one block of a component, and balls of one block.
STRETCH, BLOCK, BALLS = 96, 512, 2048


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that squares stay in range."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of units reach the threshold; cosines close to it are taken as ``exact`` takes them."""
    s = x @ y.T
    i, j = np.nonzero(np.abs(s - threshold) < 1e-12)
    if len(i):
        s[i, j] = np.einsum("ij,ij->i", x[i], y[j])
    return s >= threshold


def stack(column: pa.Array) -> np.ndarray:
    """Vectors kept as bytes, as rows of units."""
    return unit(np.stack([np.frombuffer(x, "<f8") for x in column.to_pylist()]))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, row, key, size, vec)`` of vectors that may link: bytes of doubles and their digest."""

    def run(batches):
        for batch in batches:
            ids, rows, lists = batch.column(0), batch.column(1), batch.column(2)
            keep, raw = [], []
            for i, x in enumerate(lists.to_pylist()):
                if x and None not in x:
                    v = np.asarray(x, np.float64) + 0.0
                    if np.isfinite(v).all() and v.any():
                        keep.append(i)
                        raw.append(v.astype("<f8").tobytes())
            some = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(some), rows.take(some), pa.array([hashlib.md5(r).digest() for r in raw], pa.binary()), pa.array([len(r) // 8 for r in raw], pa.int32()), pa.array(raw, pa.binary())],
                names=["id", "row", "key", "size", "vec"],
            )

    return df.select(F.col(id_col).cast("long").alias("id"), "row", F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, row long, key binary, size int, vec binary")


def planes(size: int, order: int, bits: int) -> np.ndarray:
    """The hyperplanes of an order, and the projection within equal signs, as columns."""
    return np.random.default_rng((size, order)).normal(size=(size, bits + 1))


def ordered(vectors: DataFrame, orders: range, bits: int, partitions: int) -> DataFrame:
    """Each vector once per order, with a sort key, in ranges of (size, order, key)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(1).to_numpy()
            for size in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(some))
                x = stack(part.column(2))
                for order in orders:
                    z = x @ planes(size, order, bits)
                    sign = np.zeros(len(x))
                    for b in range(bits):  # Gray order: neighbours in the order differ in few signs
                        sign = 2 * sign + ((z[:, b] > 0) ^ (sign % 2 > 0))
                    key = sign + (np.tanh(z[:, bits]) + 1) / 2.0000001
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([order] * len(x), pa.int32()), pa.array(key), part.column(2)], names=["u", "size", "order", "at", "vec"])

    dealt = vectors.select("u", "size", "vec").mapInArrow(run, "u long, size int, order int, at double, vec binary")
    return dealt.repartitionByRange(partitions, "size", "order", "at", "u").sortWithinPartitions("size", "order", "at", "u")


def best_of(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest of each row."""
    k = min(k, s.shape[1])
    return np.argpartition(-s, k - 1, axis=1)[:, :k]


def first_lists(dealt: DataFrame, k: int) -> DataFrame:
    """``(u, v, s)``: the best of each vector among those close to it in an order."""
    half = STRETCH // 2

    def nearest(ids, x, a, b):
        """The best of vectors ``a`` to ``b`` among them and ``half`` on either side."""
        low, high = max(0, a - half), min(len(ids), b + half)
        if high - low < 2:
            return
        s = x[a:b] @ x[low:high].T
        s[np.arange(b - a), np.arange(a, b) - low] = -2
        top = best_of(s, k)
        row, col = np.repeat(np.arange(b - a), top.shape[1]), top.ravel()
        ok = s[row, col] > -2
        yield pa.RecordBatch.from_arrays([pa.array(ids[a + row[ok]]), pa.array(ids[low + col[ok]]), pa.array(s[row[ok], col[ok]].astype(np.float32))], names=["u", "v", "s"])

    def run(batches):
        of, ids, x, done = None, np.zeros(0, np.int64), None, 0

        def rest():
            for a in range(done, len(ids), half):
                yield from nearest(ids, x, a, min(len(ids), a + half))

        for batch in batches:
            if not batch.num_rows:
                continue
            u, size, order = (batch.column(i).to_numpy() for i in range(3))
            raw = batch.column(4).to_pylist()
            cuts = np.flatnonzero((np.diff(size) != 0) | (np.diff(order) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(u)], strict=True):
                more = unit(np.stack([np.frombuffer(r, "<f8") for r in raw[a:b]]))
                if of == (size[a], order[a]):
                    ids, x = np.concatenate((ids, u[a:b])), np.concatenate((x, more))
                else:
                    yield from rest()
                    of, ids, x, done = (size[a], order[a]), u[a:b], more, 0
                while done + 2 * half <= len(ids):
                    yield from nearest(ids, x, done, done + half)
                    done += half
                keep = max(0, done - half)
                ids, x, done = ids[keep:], x[keep:], done - keep
        yield from rest()

    return dealt.mapInArrow(run, "u long, v long, s float")


def trimmed(edges: DataFrame, k: int, *, hubs: bool = False) -> DataFrame:
    """The ``k`` best edges of each ``u``. Where a ``u`` may have very many, tasks leave out what they can before the edges of one meet."""
    once = (edges if hubs else edges.repartition("u")).groupBy("u", "v").agg(F.max("s").alias("s"))
    return best_edges(once, k)


def best_edges(once: DataFrame, k: int) -> DataFrame:
    """The same of edges that don't repeat: the rank is limited in each task before the shuffle."""
    order = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("u", "v", "s")


def joined(graph: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Pairs among the neighbours of each vector that are better than what either has: ``(u, v, s)`` both ways."""
    back = best_edges(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s"), 2 * k)
    members = trimmed(graph.unionByName(back), 2 * k).select(F.col("u").alias("c"), F.col("v").alias("m"))
    worst = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
    known = vectors.select("u", "size", "vec").join(worst, "u")
    wide = members.join(known.withColumnRenamed("u", "m"), "m").select("c", "m", "size", "least", "vec")

    def local(c: np.ndarray, m: np.ndarray, least: np.ndarray, x: np.ndarray):
        _, start, count = np.unique(c, return_index=True, return_counts=True)
        width = int(count.max())
        for at in range(0, len(start), max(1, 200_000 // (width * width))):
            s0, n = start[at : at + max(1, 200_000 // (width * width))], count[at : at + max(1, 200_000 // (width * width))]
            index = np.minimum(s0[:, None] + np.arange(width), len(c) - 1)
            real = np.arange(width) < n[:, None]
            y = x[index]
            s = y @ y.transpose(0, 2, 1)
            bar = least[index]
            good = real[:, :, None] & real[:, None, :] & (s > bar[:, :, None]) & (m[index][:, :, None] != m[index][:, None, :])
            g, i, j = np.nonzero(good)
            yield pa.RecordBatch.from_arrays([pa.array(m[index[g, i]]), pa.array(m[index[g, j]]), pa.array(s[g, i, j].astype(np.float32))], names=["u", "v", "s"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            c = whole.column(0).to_numpy()
            cut = int(np.searchsorted(c, c[-1]))
            held = whole.slice(cut)
            if cut:
                yield from work(whole.slice(0, cut))
        if held is not None and held.num_rows:
            yield from work(held)

    def work(part):
        sizes = part.column(2).to_numpy()
        for size in np.unique(sizes).tolist():
            some = part.take(pa.array(np.flatnonzero(sizes == size)))
            yield from local(some.column(0).to_numpy(), some.column(1).to_numpy(), some.column(3).to_numpy(), stack(some.column(4)))

    return wide.repartition("c").sortWithinPartitions("c", "m").mapInArrow(run, "u long, v long, s float")


def exact(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs(u, v)`` whose cosine in double precision reaches the threshold."""
    both = pairs.join(vectors.select("u", F.col("size").alias("su"), F.col("vec").alias("a")), "u").join(vectors.select(F.col("u").alias("v"), F.col("size").alias("sv"), F.col("vec").alias("b")), "v").where("su = sv")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                size = batch.column(2).to_numpy()
                s = np.empty(len(size))
                for k in np.unique(size).tolist():
                    some = pa.array(np.flatnonzero(size == k))
                    s[size == k] = np.einsum("ij,ij->i", stack(batch.column(3).take(some)), stack(batch.column(4).take(some)))
                keep = pa.array(s >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return both.select("u", "v", "su", "a", "b").mapInArrow(run, "u long, v long")


def placed(members: DataFrame, threshold: float) -> DataFrame:
    """``members(root, u, size, vec, copies)`` with ``outer`` (whether some member of the root may be beyond reach) and ``total`` (copies of the root).

    The angle to the root's centre decides: two members link if their angles add up to no more than a link's.
    """
    reach = float(np.arccos(np.clip(threshold, -1, 1))) - 1e-9

    def sums(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            root, size, vec = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for n in np.unique(size).tolist():
                some = np.flatnonzero(size == n)
                roots, at = np.unique(root[some], return_inverse=True)
                total = np.zeros((len(roots), n))
                np.add.at(total, at, stack(vec.take(pa.array(some))))
                yield pa.RecordBatch.from_arrays([pa.array(roots), pa.array([x.tobytes() for x in total], pa.binary())], names=["root", "part"])

    def mean(frame):
        return pd.DataFrame({"root": frame["root"].iloc[:1], "centre": [np.sum([np.frombuffer(x, "<f8") for x in frame["part"]], axis=0).tobytes()]})

    def angles(batches):
        for batch in batches:
            out = np.full(batch.num_rows, np.pi)
            for i, (v, c) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                c = np.frombuffer(c, "<f8")
                if c.any():
                    out[i] = np.arccos(np.clip(unit(np.frombuffer(v, "<f8")[None])[0] @ unit(c[None])[0], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["u", "angle"])

    parts = members.select("root", "size", "vec").mapInArrow(sums, "root long, part binary")
    centres = materialize(parts.groupBy("root").applyInPandas(mean, "root long, centre binary"), "centres")
    angle = materialize(members.select("root", "u", "vec").join(centres, "root").select("u", "vec", "centre").mapInArrow(angles, "u long, angle double"), "angles")
    whole = members.join(angle, "u")
    far = whole.groupBy("root").agg(F.max("angle").alias("farthest"), F.sum("copies").alias("total"))
    return whole.join(far, "root").select("root", "u", "size", "vec", "copies", (F.col("angle") + F.col("farthest") > reach).alias("outer"), "total")


def block_counts(members: DataFrame, threshold: float) -> DataFrame:
    """``(u, n)`` over ``members(root, u, size, vec, copies, asked, blocks)``: copies of all members of the root within the threshold, for those asked."""
    own = F.pmod(F.xxhash64("u"), F.col("blocks"))
    each = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def run(frame):
        x = unit(np.stack([np.frombuffer(v, "<f8") for v in frame["vec"]]))
        own, low, high = frame["own"].to_numpy(), frame["low"].iloc[0], frame["high"].iloc[0]
        copies, asked = frame["copies"].to_numpy(np.float64), frame["asked"].to_numpy(bool)
        out = np.zeros(len(x))
        for one, two in ((low, high), (high, low))[: 1 if low == high else 2]:
            a, b = np.flatnonzero((own == one) & asked), np.flatnonzero(own == two)
            near = linked(x[a], x[b], threshold)
            near &= a[:, None] != b[None, :]
            out[a] += near @ copies[b]
        return pd.DataFrame({"u": frame["u"][asked], "n": out[asked].astype(np.int64)})

    counted = each.groupBy("root", "size", "low", "high").applyInPandas(run, "u long, n long")
    return counted.groupBy("u").agg(F.sum("n").alias("n"))


def balls(saturated: DataFrame, threshold: float) -> DataFrame:
    """``(root, u, size, vec, ball, radius)``: members of a root around one of them, the ball's name, no farther than half the angle of a link."""
    many = saturated.groupBy("root").count().select("root", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks"))
    reach = np.arccos(np.clip(threshold, -1, 1)) / 2

    def run(frame):
        x = unit(np.stack([np.frombuffer(v, "<f8") for v in frame["vec"]]))
        u = frame["u"].to_numpy()
        ball, radius, left = np.zeros(len(x), np.int64), np.zeros(len(x)), np.arange(len(x))
        while len(left):
            angle = np.arccos(np.clip(x[left] @ x[left[0]], -1, 1))
            angle[0] = 0
            near = angle <= reach
            ball[left[near]], radius[left[near]] = u[left[0]], angle[near].max()
            left = left[~near]
        return frame[["root", "u", "size", "vec"]].assign(ball=ball, radius=radius)

    dealt = saturated.join(many, "root").withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks")))
    return dealt.groupBy("root", "block").applyInPandas(run, "root long, u long, size int, vec binary, ball long, radius double")


def in_reach(centres: DataFrame, count: int, threshold: float, *, centres_link: bool) -> DataFrame:
    """``(a, b, u, v)``: balls ``u``, ``v`` of different roots ``a``, ``b`` that may hold a link; with ``centres_link`` one pair of each two roots with linked centres."""
    blocks = max(1, -(-count // BALLS))
    each = centres.withColumn("own", F.pmod(F.xxhash64("ball"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    each = each.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    link = float(np.arccos(np.clip(threshold, -1, 1)))

    def run(frame):
        x = unit(np.stack([np.frombuffer(v, "<f8") for v in frame["vec"]]))
        own, low, high = frame["own"].to_numpy(), frame["low"].iloc[0], frame["high"].iloc[0]
        a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
        root, ball, radius = frame["root"].to_numpy(), frame["ball"].to_numpy(), frame["radius"].to_numpy()
        if centres_link:
            near = linked(x[a], x[b], threshold)
        else:
            near = np.arccos(np.clip(x[a] @ x[b].T, -1, 1)) <= radius[a][:, None] + radius[b][None, :] + link + 1e-6
        near &= root[a][:, None] != root[b][None, :]
        i, j = np.nonzero(np.triu(near) if low == high else near)
        out = pd.DataFrame({"a": root[a[i]], "b": root[b[j]], "u": ball[a[i]], "v": ball[b[j]]})
        return out.drop_duplicates(["a", "b"]) if centres_link else out

    return each.groupBy("size", "low", "high").applyInPandas(run, "a long, b long, u long, v long")


def crossing(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """``(u, v)``: the roots of those ``pairs`` of balls between which there is a link."""
    sides = [pairs.join(members.select(F.col("ball").alias(side), "vec"), side).select("a", "b", "u", "v", F.lit(side).alias("side"), "vec") for side in ("u", "v")]

    def run(frame):
        x = unit(np.stack([np.frombuffer(v, "<f8") for v in frame["vec"]]))
        first = (frame["side"] == "u").to_numpy()
        return frame[["a", "b"]].rename(columns={"a": "u", "b": "v"}).head(int(linked(x[first], x[~first], threshold).any()))

    return sides[0].unionByName(sides[1]).groupBy("a", "b", "u", "v").applyInPandas(run, "u long, v long").distinct()


def rooted(table: DataFrame, merged: DataFrame) -> DataFrame:
    """``table`` with the roots that its roots are merged to."""
    return table.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def bridged(roots: DataFrame, saturated: DataFrame, threshold: float) -> DataFrame:
    """``roots`` with those merged between whose saturated vectors there is a link."""
    members = materialize(balls(saturated, threshold), "balls")
    centres = materialize(members.where("u = ball").select("root", "ball", "size", "vec", "radius"), "centres")
    count = centres.count()
    for centres_link in (True, False):  # linked centres first: they settle most of what lies close together
        pairs = in_reach(centres, count, threshold, centres_link=centres_link)
        found = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")) if centres_link else crossing(materialize(pairs, "reach"), members, threshold)
        bridges = materialize(found, "bridges")
        if not bridges.isEmpty():
            merged = materialize(components(bridges), "merged")
            roots, members, centres = (materialize(rooted(t, merged), n) for t, n in ((roots, "roots"), (members, "balls"), (centres, "centres")))
    return roots


def audited(vectors: DataFrame, sample: DataFrame, threshold: float) -> DataFrame:
    """``(u, n)``: true links of each vector of the bounded ``sample``, by comparison with all vectors."""
    rows = sample.collect()
    ids = np.array([r["u"] for r in rows], np.int64)
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {r["size"] for r in rows}:
        some = [i for i, r in enumerate(rows) if r["size"] == size]
        by_size[size] = (ids[some], unit(np.stack([np.frombuffer(rows[i]["vec"], "<f8") for i in some])))
    shared = vectors.sparkSession.sparkContext.broadcast(by_size)

    def run(batches):
        totals: dict[int, float] = {}
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size, (names, y) in shared.value.items():
                some = np.flatnonzero(sizes == size)
                if len(some):
                    part = pa.array(some)
                    near = linked(stack(batch.column(2).take(part)), y, threshold)
                    near &= batch.column(0).take(part).to_numpy()[:, None] != names[None, :]
                    for name, n in zip(names.tolist(), (batch.column(3).take(part).to_numpy().astype(float) @ near).tolist(), strict=True):
                        totals[name] = totals.get(name, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([int(x) for x in totals.values()], pa.int64())], names=["u", "n"])

    return vectors.select("u", "size", "vec", "copies").mapInArrow(run, "u long, n long").groupBy("u").agg(F.sum("n").alias("n"))


def in_sample(size: int, total: int) -> Column:
    """Whether a vector is in a hashed sample of about ``size`` of ``total``, however many there are."""
    return F.lit(True) if size >= total else F.xxhash64("u") < F.lit(max(1, size * 2**64 // total) - 2**63)


def settled(graph: DataFrame, vectors: DataFrame, k: int, threshold: float) -> DataFrame:
    """``graph`` after rounds of joins, when its links no longer change."""
    before = None
    while True:
        after = materialize(trimmed(graph.unionByName(joined(graph, vectors, k)), k, hubs=True), "graph")
        release(graph)
        graph = after
        state = graph.where(F.col("s") >= threshold - 1e-5).agg(F.count("*"), F.sum(F.col("s").cast("double"))).collect()[0]
        if before is not None and abs(state[0] - before[0]) <= 1e-3 * before[0] and abs((state[1] or 0) - (before[1] or 0)) <= 1e-3 * (before[1] or 0):
            return graph
        before = state


def near_duplicates(
    df: DataFrame, *, threshold: float = 0.9, k: int = 8, orders: int = 12, recall: float = 0.97, attempts: int = 3, audit: int = 400, outer: int = 20_000, widest: int = 512, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Per row: id, ``n_links``, ``component_id`` and ``kept`` (the id names its component)."""
    spark = df.sparkSession
    rows = materialize(df.select(F.col(id_col), F.col(vector_col), F.monotonically_increasing_id().alias("row")), "vectors")
    found = materialize(usable(rows, id_col, vector_col), "usable")
    # u, a scrambled row number, names one of the rows that share a vector.
    vectors = found.groupBy("key").agg(F.min("row").alias("row"), F.min("id").alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("vec").alias("vec"))
    vectors = materialize(vectors.withColumn("u", scramble(F.col("row"))).drop("row"), "distinct")
    n = vectors.count()
    bits = max(1, int(np.ceil(np.log2(max(2, n / STRETCH)))))
    partitions = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    graph, tried, attempt, reached = None, 0, 0, -1.0
    while True:
        attempt += 1
        fresh = first_lists(ordered(vectors, range(tried, tried + orders), bits, partitions), k)
        tried += orders
        after = materialize(trimmed(fresh if graph is None else graph.unionByName(fresh), k), "graph")
        if graph is not None:
            release(graph)
        graph = settled(after, vectors, k, threshold)
        lists, width = graph, k
        while True:
            near = lists.where(F.col("s") >= threshold - 1e-5).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
            links = materialize(exact(near, vectors, threshold), "links")
            roots = materialize(components(links), "roots")
            full = lists.groupBy("u").agg(F.count("*").alias("n"), F.min("s").alias("s")).where((F.col("n") >= width) & (F.col("s") >= threshold - 1e-5)).select(F.col("u").alias("node"))
            saturated = materialize(roots.join(full, "node").join(vectors.withColumnRenamed("u", "node"), "node").select("root", F.col("node").alias("u"), "size", "vec"), "saturated")
            members = None
            if saturated.isEmpty():
                break
            roots = bridged(roots, saturated, threshold)
            wide = materialize(roots.join(full, "node").select("root").distinct(), "wide")
            of_wide = roots.join(wide, "root").join(vectors.withColumnRenamed("u", "node"), "node").select("root", F.col("node").alias("u"), "size", "vec", "copies")
            members = materialize(placed(of_wide, threshold), "members")
            large = materialize(members.where("outer").groupBy("root").count().where(F.col("count") > outer).select("root"), "large")
            if width >= widest or large.isEmpty():
                break
            width *= 4
            deep = members.join(large, "root", "left_semi").select("u")
            part = settled(materialize(lists.join(deep, "u", "left_semi"), "part"), vectors, width, threshold)
            lists = materialize(lists.join(deep, "u", "left_anti").unionByName(part), "lists")
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        counted = both.join(vectors.select(F.col("u").alias("v"), "copies"), "v").groupBy("u").agg(F.sum("copies").alias("n"))
        if members is not None:
            inner = members.where("NOT outer").select("u", (F.col("total") - F.col("copies")).alias("n"))
            # Of a large root only the saturated are compared; the lists of the others hold all their links.
            asked = members.where("outer").join(large.withColumn("deep", F.lit(True)), "root", "left").join(full.select(F.col("node").alias("u"), F.lit(True).alias("held")), "u", "left")
            asked = asked.withColumn("asked", F.coalesce("held", F.lit(False)) | F.col("deep").isNull())
            many = members.where("outer").groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"), F.sum("copies").alias("beyond"))
            found_out = block_counts(asked.join(many.select("root", "blocks"), "root").select("root", "u", "size", "vec", "copies", "asked", "blocks"), threshold)
            beside = asked.where("asked").join(many.select("root", "beyond"), "root").select("u", (F.col("total") - F.col("beyond")).alias("certain"))
            outside = beside.join(found_out, "u", "left").select("u", (F.col("certain") + F.coalesce("n", F.lit(0))).alias("n"))
            large_counts = materialize(inner.unionByName(outside), "large")
            counted = counted.join(large_counts.select("u"), "u", "left_anti").unionByName(large_counts)
        counted = materialize(counted, "counted")
        if n < 2:
            break
        n_linked = counted.count()
        sample = vectors.where(in_sample(audit // 2, n)).select("u", "size", "vec").unionByName(
            vectors.join(counted.where(in_sample(audit // 2, n_linked)).select("u"), "u", "left_semi").select("u", "size", "vec")
        )
        truth = audited(vectors, sample.dropDuplicates(["u"]), threshold)
        heard = truth.join(counted.withColumnRenamed("n", "got"), "u", "left").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("got", F.lit(0)))).alias("got"), F.sum(F.least("n", F.lit(k))).alias("few"), F.sum(F.least("n", F.coalesce("got", F.lit(0)), F.lit(k))).alias("got_few")).collect()[0]
        # Links of vectors with few of them count as much as those of large groups.
        if not heard["n"] or (now := min(heard["got"] / heard["n"], heard["got_few"] / heard["few"])) >= recall:
            break
        if attempt >= attempts and now <= reached:
            raise RuntimeError(f"near duplicates: recall {now:.4f} after {attempt} attempts, {recall} wanted")
        reached = max(reached, now)

    named = vectors.join(roots.withColumnRenamed("node", "u"), "u", "left").select("key", "u", "least", "copies", F.coalesce("root", "u").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    result = named.join(least, "root").join(counted, "u", "left").select("key", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of_row = found.select("row", "key").join(result, "key").select("row", "component_id", "n_links")
    whole = rows.select(F.col(id_col), "row").join(of_row, "row", "left")
    component = F.when(F.col("n_links").isNull(), F.col(id_col).cast("long")).otherwise(F.col("component_id"))
    return whole.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col(id_col).eqNullSafe(component).alias("kept"))
