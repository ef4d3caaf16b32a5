"""Prefix trie of conversations.

Turns travel as 16-byte digests with their bytes counted; texts end at the first step. Their places in a conversation are running counts
over sorted ranges, so a conversation of any length spreads over tasks. Rebuilt conversations that are equal are one sequence with a number of copies,
named by its smallest member. Sequences are dealt out by the digest of their first turn: subtries of at most ``most_rows`` turns are built in
``applyInPandas``, many in one bucket, as dictionaries of children walked in postorder without recursion. A larger subtrie is cut: the
turns that all its sequences share are nodes of one aggregate, and what follows is dealt out again by the next turn, until all parts are
small or hold one sequence. Sums of cut subtries are rolled up from the last cut to the first.

Edge cases: turns without a ``conv_id`` take no part. Null turns come first; equal turns of a conversation follow the order of their digests, and repeated rows
are turns of their own. Null and empty roles and texts are the same. ``conv_id - conv_id % 5`` follows SQL, where remainders of negative ids are negative.
A table without conversations has no node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, release
from ledgerloom.operators.ordered import running

#: Turns of the largest subtrie that one Python call builds, and about the turns of one bucket of subtries.
MOST_ROWS = 20_000
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long, gid binary, pid binary"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turns_of(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv_id, turn, digest, bytes)``; the digest is of the role with its length before it, and the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16)
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def rebuilt(turns: DataFrame, family: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of the first one of their family in place of their own.

    Returns ``(conv_id, d, digest, bytes, total)`` for each rebuilt turn, ``total`` being the bytes up to it, and ``(conv_id, n)`` for each conversation, turnless
    ones included.
    """
    placed = materialize(running(turns.withColumn("one", F.lit(1)), ["conv_id"], ["turn", "digest"], sums={"pos": "one", "total": "bytes"}).drop("one", "turn"), "placed")
    base = F.col("conv_id") - F.col("conv_id") % family
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    own = placed.select("conv_id", "pos", "total", shared).groupBy("conv_id").agg(F.max("pos").alias("own"), F.max(F.when(F.col("pos") <= F.col("h"), F.col("total"))).alias("gone"))
    first = placed.where((F.col("conv_id") == base) & (F.col("pos") < heads)).groupBy("conv_id")
    first = first.agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "bytes", "total"))).alias("turns")).withColumnRenamed("conv_id", "base")
    shape = own.select("conv_id", base.alias("base"), shared, "own", F.coalesce("gone", F.lit(0)).alias("gone")).join(first, "base", "left")
    shape = shape.withColumn("taken", F.slice(F.coalesce("turns", F.array().cast(first.schema["turns"].dataType)), F.lit(1), F.col("h").cast("int")))
    shape = materialize(shape.withColumn("b", F.size("taken")).drop("turns", "base"), "shape")
    copied = shape.select("conv_id", F.inline("taken")).select("conv_id", F.col("pos").alias("d"), "digest", "bytes", "total")
    shift = shape.select("conv_id", "h", "b", (F.coalesce(F.array_max("taken.total"), F.lit(0)) - F.col("gone")).alias("shift"))
    kept = placed.join(shift, "conv_id").where(F.col("pos") > F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("b")).alias("d"), "digest", "bytes", (F.col("total") + F.col("shift")).alias("total"))
    out = materialize(copied.unionByName(kept), "rebuilt")
    lengths = materialize(shape.select("conv_id", (F.col("b") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "lengths")
    release(placed, shape)
    return out, lengths


def end_digests(members: DataFrame) -> DataFrame:
    """``(seq, sha)`` of ``members(seq, conv_id)``: SHA-256 of the ids in ascending order, comma-joined.

    A digest takes its ids one after another, so those of one sequence pass through one task; they stream by and are never held.
    """

    def run(batches):
        now, state = None, None
        for batch in batches:
            seqs, shas = [], []
            for seq, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if seq != now:
                    if state is not None:
                        seqs.append(now)
                        shas.append(state.hexdigest())
                    now, state = seq, hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(shas, pa.string())], names=["seq", "sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], names=["seq", "sha"])

    return members.repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(run, "seq long, sha string")


def sequences(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(seq, n, length)`` for each distinct sequence, named by its smallest member, and ``(seq, sha)`` of the members of each."""
    lanes = [F.bit_xor(F.xxhash64(F.lit(k), "d", "digest")).alias(f"lane{k}") for k in (1, 2)]
    marks = turns.groupBy("conv_id").agg(*lanes)
    marked = materialize(lengths.join(marks, "conv_id", "left").select("conv_id", F.col("n").alias("length"), *(F.coalesce(f"lane{k}", F.lit(0)).alias(f"lane{k}") for k in (1, 2))), "marked")
    same = ["length", "lane1", "lane2"]
    seqs = materialize(marked.groupBy(*same).agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("n")), "sequences")
    single = seqs.where("n = 1").select("seq", F.sha2(F.col("seq").cast("string").cast("binary"), 256).alias("sha"))
    copies = marked.join(seqs.where("n > 1").select("seq", *same), same).select("seq", "conv_id")
    ends = materialize(single.unionByName(end_digests(copies)), "ends")
    out = materialize(seqs.select("seq", "n", "length"), "named")
    release(marked, seqs)
    return out, ends


def subtries(rows: pd.DataFrame) -> list[tuple]:
    """Nodes of all subtries of one bucket: ``rows(gid, pid, up, seq, n, d, digest, bytes)``, a row for each turn of a sequence."""
    # a node: [smallest member, depth, parent, members, bytes, children, sequence that ends here, its subtrie or none, leaves, saved]
    rows = rows.sort_values(["gid", "seq", "d"], kind="stable")
    tops: list[list] = []
    nodes, group, seq, node = None, None, None, None
    for gid, pid, up, s, n, d, digest, size in zip(*(rows[c] for c in ("gid", "pid", "up", "seq", "n", "d", "digest", "bytes")), strict=True):
        if gid != group:
            group, seq, nodes = gid, None, {}
        if s != seq:
            if node is not None:
                node[6] = last
            seq, children, parent = s, nodes, None
        last = s
        node = children.get(digest)
        if node is None:
            # sequences come by ascending smallest member, so the first to reach a node names it
            node = children[digest] = [s, d, up if parent is None else parent[0], 0, size, {}, None, (gid, pid) if parent is None else None, 0, 0]
            if parent is None:
                tops.append(node)
        node[3] += n
        parent, children = node, node[5]
    if node is not None:
        node[6] = last
    out = []
    for top in tops:
        stack = [(top, iter(top[5].values()))]
        while stack:
            node, below = stack[-1]
            child = next(below, None)
            if child is not None:
                stack.append((child, iter(child[5].values())))
                continue
            stack.pop()
            node[8] = node[8] or 1
            node[9] += (node[3] - 1) * node[4]
            gid, pid = node[7] or (None, None)
            out.append((node[0], node[1], node[2], node[3], len(node[5]), node[8], node[9], node[6], gid, pid))
            if stack:
                stack[-1][0][8] += node[8]
                stack[-1][0][9] += node[9]
    return out


def built(rows: DataFrame, most_rows: int) -> DataFrame:
    """Nodes of the subtries of ``rows``, which are small, many of them in a bucket."""
    names = [x.split()[0] for x in NODE.split(", ")]

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        columns = list(zip(*subtries(frame), strict=True)) or [()] * len(names)
        whole = lambda c, x: pd.array(x, "Int64") if c not in ("gid", "pid") else pd.Series(x, dtype=object)
        return pd.DataFrame({c: whole(c, x) for c, x in zip(names, columns, strict=True)})

    buckets = max(1, -(-rows.count() // most_rows))
    dealt = rows.select("gid", "pid", "up", "seq", "n", "d", "digest", "bytes", F.pmod(F.xxhash64("gid"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(build, NODE)


def cut(big: DataFrame) -> DataFrame:
    """Nodes that all sequences of a large subtrie share: ``(gid, pid, up, d, conv, members, size, total, end, stop, upto)``.

    ``stop`` is the first depth at which they part, ``upto`` the bytes of all shared turns.
    """
    at = big.groupBy("gid", "d").agg(
        F.first("pid").alias("pid"), F.first("up").alias("up"), F.count(F.lit(1)).alias("seqs"), F.min("digest").alias("least"), F.max("digest").alias("most"), F.min("seq").alias("conv"), F.sum("n").alias("members"),
        F.min("bytes").alias("size"), F.min("total").alias("total"), F.max(F.when(F.col("d") == F.col("length"), F.col("seq"))).alias("end"),
    )
    at = materialize(at, "depths")
    whole = at.groupBy("gid").agg(F.max("seqs").alias("all"), F.max("d").alias("deepest"))
    shared = (F.col("seqs") == F.col("all")) & (F.col("least") == F.col("most"))
    stops = at.join(whole, "gid").groupBy("gid").agg(F.coalesce(F.min(F.when(~shared, F.col("d"))), F.max("deepest") + 1).alias("stop"))
    path = at.join(stops, "gid").where("d < stop")
    ends = path.groupBy("gid").agg(F.max("total").alias("upto"))
    out = materialize(path.join(ends, "gid").drop("seqs", "least", "most"), "paths")
    release(at)
    return out


def prefix_trie(
    df: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 5, heads: int = 9, most_rows: int = MOST_ROWS
) -> DataFrame:
    """One row for each node, with ``COLUMNS`` and ``ends_sha256``: the SHA-256 of the comma-joined ids of the conversations that end there.

    Conversation ``c`` takes its first ``crc32(c) % heads`` turns from conversation ``c - c % family``. ``conv_id`` is a node's smallest member; ``n_leaves`` and
    ``saved_tokens`` (the bytes of its last text times its members but one) are summed over the node's subtree.
    """
    spark = df.sparkSession
    turns, lengths = rebuilt(turns_of(df, id_col, turn_col, role_col, text_col), family, heads)
    seqs, ends = sequences(turns, lengths)
    total = lengths.agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n")).first()
    first = turns.where("d = 1").select(F.col("conv_id").alias("seq"), F.col("digest").alias("gid"))
    live = turns.withColumnRenamed("conv_id", "seq").join(seqs.where("length > 0"), "seq").join(first, "seq")
    live = materialize(live.select("gid", F.lit(None).cast("binary").alias("pid"), F.lit(total["least"]).cast("long").alias("up"), "seq", "n", "length", "d", "digest", "bytes", "total"), "live")
    release(turns)
    parts, cuts = [], []
    while True:
        # what is large gets cut; the rest is built at once
        large = materialize(live.groupBy("gid").count().where(F.col("count") > most_rows).select("gid"), "large")
        if large.isEmpty():
            parts.append(materialize(built(live, most_rows), "nodes"))
            break
        parts.append(materialize(built(live.join(large, "gid", "left_anti"), most_rows), "nodes"))
        big = live.join(large, "gid")
        path = cut(big)
        cuts.append(path)
        stops = path.groupBy("gid").agg(F.max("stop").alias("stop"), F.min("conv").alias("least"))
        below = big.join(stops, "gid").where("d >= stop")
        heads_of = below.where("d = stop").select("seq", F.col("digest").alias("turn"))
        mark = F.substring(F.unhex(F.sha2(F.concat("gid", "turn"), 256)), 1, 16)
        after = below.join(heads_of, "seq").select(mark.alias("gid"), F.col("gid").alias("pid"), F.col("least").alias("up"), "seq", "n", "length", "d", "digest", "bytes", "total")
        after = materialize(after, "live")
        release(live, large)
        live = after
    release(live)
    nodes = reduce(DataFrame.unionByName, parts)
    # tops of subtries, each with the subtrie that it was cut from; cuts are added from the last to the first
    tops = nodes.where("gid IS NOT NULL").select("gid", "pid", "n_leaves", "saved_tokens")
    shared = []
    for path in reversed(cuts):
        under = tops.where("pid IS NOT NULL").groupBy("pid").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count(F.lit(1)).alias("children"))
        met = path.join(under.withColumnRenamed("pid", "gid"), "gid", "left")
        start = F.min("d").alias("start")
        begun = path.groupBy("gid").agg(start)
        last = F.col("d") == F.col("stop") - 1
        node = met.join(begun, "gid").select(
            F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("start"), F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("members").alias("n_convs"),
            F.when(last, F.coalesce("children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            ((F.col("upto") - F.col("total") + F.col("size")) * (F.col("members") - 1) + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), F.col("end").alias("ends"),
            F.when(F.col("d") == F.col("start"), F.col("gid")).alias("gid"), F.when(F.col("d") == F.col("start"), F.col("pid")).alias("pid"),
        )
        node = materialize(node, "cut")
        shared.append(node)
        tops = tops.unionByName(node.where("gid IS NOT NULL").select("gid", "pid", "n_leaves", "saved_tokens"))
    nodes = reduce(DataFrame.unionByName, [nodes, *shared])
    under = tops.where("pid IS NULL").agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved"))
    turnless = seqs.where("length = 0").agg(F.min("seq")).first()[0]
    root = under.where(F.lit(total["n"] > 0)).select(
        F.lit(total["least"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total["n"]).cast("long").alias("n_convs"),
        F.col("children").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.lit(turnless).cast("long").alias("ends"),
    )
    whole = nodes.select(*COLUMNS, "ends").unionByName(root)
    named = whole.where("ends IS NOT NULL").join(ends, F.col("ends") == F.col("seq")).select(*COLUMNS, F.col("sha").alias("ends_sha256"))
    return named.unionByName(whole.where("ends IS NULL").select(*COLUMNS, F.lit(EMPTY_SHA).alias("ends_sha256")))
