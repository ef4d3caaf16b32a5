"""Hard negatives, personal data and prefix tries against brute force and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hardnegatives, personal, prefixtrie, registry

VECTORS = "vec_id long, embedding array<float>, label int, score long, id string"


def negatives_by_hand(rows):
    """All pairs in Python numbers; repeated rows are rows of their own."""
    usable = []
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for n, (a, la, va) in enumerate(usable):
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, vb, strict=True)), b, lb == la) for m, (b, lb, vb) in enumerate(usable) if m != n and len(vb) == len(va))
        for ps, b, _ in [x for x in scored if x[2]][:5]:
            inside = [(s, c) for s, c, same in scored if not same and 50 * -ps <= 100 * -s <= 95 * -ps]
            out += [(a, b, rank, c, -ps, -s) for rank, (s, c) in enumerate(inside[:3], 1)]
    return sorted(out)


def vectors(n=420, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(n):
        v = centres[i % 6] + rng.normal(scale=0.6, size=8)
        rows.append([i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(4))])
    for i in range(100, 180):  # a third of some label is one vector
        rows[i][1], rows[i][2] = rows[100][1], 2
    rows[3][1], rows[4][2], rows[5][1] = None, None, [None] * 8
    rows[6][1], rows[8][1] = [float("nan")] * 8, [float("inf"), *[0.0] * 7]
    rows[9][1], rows[10][1], rows[200][1] = [], [0.0] * 8, [1.0, 2.0]
    rows += [list(rows[50]), list(rows[50]), [50, rows[51][1], rows[50][2]], list(rows[7]), [None, rows[0][1], 1]]
    return [(i, v, label, 5, "clash") for i, v, label in rows]


def mined(df, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hardnegatives.mine(df, F.col("id") % 50 == 0, label, **more).collect())


@pytest.mark.parametrize("block_bytes", [hardnegatives.BLOCK_BYTES, 400])
def test_negatives_equal_brute_force(spark, block_bytes):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert mined(df, block_bytes=block_bytes) == negatives_by_hand(rows)


def test_negatives_of_large_and_empty(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 1e6], i % 2, 0, "x") for i in range(120)]  # products beyond 2**53
    assert mined(spark.createDataFrame(rows, VECTORS).repartition(2)) == negatives_by_hand(rows)
    assert mined(spark.createDataFrame([], VECTORS)) == []
    assert mined(spark.createDataFrame(rows[1:40], VECTORS)) == []
    huge = [(i, [3e38] * 4, i % 2, 0, "x") for i in range(60)]
    assert all(r[4] == r[5] for r in mined(spark.createDataFrame(huge, VECTORS)))


def test_best_keeps_the_first():
    rng = np.random.default_rng(1)
    for k in (1, 3):
        best, seen = hardnegatives.Best(5, k), defaultdict(list)
        for _ in range(20):
            scores, ids = rng.integers(0, 4, size=(3, 7)), rng.integers(0, 9, size=7)
            allowed = rng.random((3, 7)) < 0.7
            best.offer(slice(1, 4), scores, allowed, ids, lambda r, c, s: np.zeros(len(r), bool))
            for r, c in zip(*np.nonzero(allowed), strict=True):
                seen[r + 1].append((-scores[r, c], ids[c]))
        for r in range(5):
            assert [(-s, i) for s, i in zip(best.score[r], best.id[r], strict=True) if s != hardnegatives.NONE] == sorted(seen[r])[:k]


# --- personal data -----------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_hand(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and (not 14 <= len(digits) <= 19 or sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end()))
    return sorted(out)


def card(rng, n=16):
    digits = [rng.randrange(10) for _ in range(n - 1)]
    for last in range(10):
        if personal.luhn("".join(map(str, [*digits, last]))):
            return "".join(map(str, [*digits, last]))


def private_texts(n=150, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randint(2, 6)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        for _ in range(rng.randint(0, 3)):
            phone = f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
            item = rng.choice([f"{word()}.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), card(rng), phone, str(rng.randint(1, 99999)), f"{rng.randint(1, 9)}.{rng.randint(1, 9)}."])
            for _ in range(rng.randint(1, 2)):
                words.insert(rng.randrange(len(words)), item)
        out.append(" ".join(words))
    return out


def test_base_spans_follow_the_patterns():
    rng = random.Random(2)
    pool = ["1", "12", "255", "300", "0255", ".", ".", "-", " ", "@", "+", "(", ")", "a", "b.c", "4111111111111111", "é", "%", "..", "٣", "²"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += private_texts(60) + ["a@b.c@d.e", "x@y.z.", "@a.b", "a@@b.c", "1.2.3.4.5.6.7.8.9", "1.2.3.4444", "9" * 30_000, "1." * 9000, "a" * 30_000, None, ""]
    for t in texts:
        assert personal.base_spans(t or "") == base_by_hand(t), t


def spans_of(spark, texts):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, spans int").repartition(2)
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["base"]) for s in r["spans"]] for r in personal.scan_documents(df).collect()}


def test_the_field_adds_what_repeats_and_leaves_the_rest(spark):
    texts = private_texts(400)
    n = len(texts)
    phone, number = "+1 (417) 555-2031", card(random.Random(9))
    wrong = number[:-1] + str((int(number[-1]) + 3) % 10)
    texts += [
        f"call {phone} or else 555-2031 today",  # part of a number found elsewhere
        "reach (417) 555-2031 there",  # as numbers look, without a prefix
        f"the card {wrong} does not hold",
        "in the year 1984 some 12 of 300 came, 3.14 times 2.5.1",
        "address 300.400.500.600 is none",
        None, "", "@", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17",
        "x " * 20_000 + phone,
    ]
    found = spans_of(spark, texts)
    for i, t in enumerate(texts):
        assert [(personal.KINDS[k], s, e) for s, k, e in base_by_hand(t)] == [(k, s, e) for k, s, e, base in found[i] if base]
        assert found[i] == sorted(found[i], key=lambda x: (x[1], personal.KINDS.index(x[0])))
    said = lambda i: [(k, texts[i][s:e]) for k, s, e, base in found[i] if not base]
    assert ("phone", "555-2031") in said(n)
    assert said(n + 1) == [("phone", "(417) 555-2031")]
    assert [said(i) for i in range(n + 2, n + 5)] == [[], [], []]
    assert [found[i] for i in range(n + 5, n + 8)] == [[], [], []]
    # beyond that only cards that the pattern read together with a number beside them
    more = [(i, x) for i in range(n) for x in said(i)]
    assert all(k == "card" and len(x) == 16 and personal.luhn(x) for _, (k, x) in more), more
    assert more


def test_messages_are_exact_without_loops():
    """On a chain, and on a tree of one tie, enough rounds give the marginals of all labellings."""
    rng, k = np.random.default_rng(0), personal.LABELS
    for follows, keys in (([0, 1, 1, 1], [None] * 4), ([0, 0, 0, 0], [1, 1, None, 1])):
        nodes = personal.empty_nodes()
        for f, key in zip(follows, keys, strict=True):
            for field, value in (("doc", 0), ("start", 0), ("end", 0), ("label", 0), ("follows", f), ("digits", 0)):
                getattr(nodes, field).append(value)
            nodes.allowed.append([True] * k)
            nodes.key.append(key)
            nodes.names.append([])
        graph, scores, steps, tie = personal.Graph(nodes), rng.normal(size=(4, k)), rng.normal(size=(k, k)), 0.7
        total, node = 0.0, np.zeros((4, k))
        for labels in np.ndindex(*([k] * 4)):
            for hub in range(k) if any(keys) else [0]:
                w = sum(scores[i, l] for i, l in enumerate(labels)) + sum(steps[labels[i - 1], labels[i]] for i in range(4) if follows[i]) + tie * sum(labels[i] == hub for i in range(4) if keys[i])
                total += np.exp(w)
                node[np.arange(4), labels] += np.exp(w)
        assert np.allclose(personal.beliefs(graph, scores, steps, tie)["node"], node / total)


def test_personal_data_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert personal.scan_documents(df).collect() == []
    assert spans_of(spark, ["no numbers here", None, "twelve 12"]) == {0: [], 1: [], 2: []}


def test_op12_columns(spark, tmp_path):
    texts = [*private_texts(60), None, ""]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in registry.op12_personal_data(spark, str(tmp_path)).collect():
        spans = base_by_hand(texts[r["doc_id"]])
        joined = ",".join(f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(x[1] == i for x in spans) for i in range(4)]
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


# --- prefix tries ------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, pos int, digest string"


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        convs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(prefix))
        parent = min(nodes[prefix[:-1]]) if prefix else None
        out.append((min(members), len(prefix), parent, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(n=90, seed=6):
    """Shared first turns, copies, a long conversation, nulls, repeated rows, holes in turns and ids."""
    rng, rows = random.Random(seed), []
    openings = [("system", "be kind"), ("user", "hello é"), ("user", "")]
    for c in [*range(-6, n), 10_000]:
        if c % 5 == 0 and rng.random() < 0.3:
            continue  # the first of a family is missing
        turns = [rng.choice(openings[:2]) if rng.random() < 0.8 else (None, None)] + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "long " * 5])) for _ in range(rng.randint(0, 5))]
        rows += [(c, None if t == 0 and c % 4 == 0 else t * 2, *x) for t, x in enumerate(turns)]
    rows += [(c, t, "user", f"copied {t}") for c in range(200, 230) for t in range(12)]
    rows += [(500, t, "user", "again and again") for t in range(150)]
    rows += [(501, t, "user", "again and again") for t in range(90)]
    rows += [rows[4], rows[4], (None, 1, "user", "no id"), (777, None, None, None)]
    return [(*r, 3, "clash") for r in rows]


@pytest.mark.parametrize("most_rows", [prefixtrie.MOST_ROWS, 60, 1])
def test_trie_equals_brute_force(spark, most_rows):
    rows = talks() if most_rows > 1 else talks(30)[:160]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    found = prefixtrie.prefix_trie(df, most_rows=most_rows)
    assert found.columns == [*prefixtrie.COLUMNS, "ends_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefixtrie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", 1, "")], TURNS)).collect() == []
