"""Training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, common, decontaminate, features, graph, langid, languagemodel, licenses, mainpage, neighbours, registry, simhash, tokenfiles, toxicity, wordmemory

WORDS = {"en": "the of and thing ing tion ed or".split(), "fr": "le de la que elle eau ment é".split(), "de": "der und ein sch ich keit ung ß".split()}
NASTY = st.lists(st.sampled_from([*"aBéÀΣ×$.!… ́中😀 \n\x1c\x85\xa0　'_1²\x00ßİ", "<|endoftext|>", "the", "'s", " \t"]), max_size=12).map("".join)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, __text string, fp long, row long"


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(n=240, seed=1):
    """Documents of three languages with copies, near copies, nulls, empty and long texts, repeated and null ids."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append([i, sentence(rng, lang, rng.randint(4, 120)), lang])
    for i in range(10, 20):
        rows[i][1] = rows[9][1]
    for i in range(20, 26):
        words = rows[8][1].split() or ["x"]
        rows[i][1] = " ".join([*words, "z" * (i - 19)])
    rows[30][1], rows[31][1], rows[32][1] = None, "", " \n\t "
    rows[33][1] = sentence(rng, "en", 6000)
    rows[34][1] = "x" * 30_000
    rows.append([5, "another text for a used id", "en"])
    rows.append([None, "a text without id", None])
    rows.append(list(rows[40]))
    return [(i, t, lang, "s", len(t or ""), 0.5, "clash", 7, 3) for i, t, lang in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


# BPE


@pytest.fixture(scope="module")
def byte_bpe():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return bpe.ByteBpe(f.read()), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(NASTY)
def test_bpe_equals_library(byte_bpe, text):
    own, library = byte_bpe
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    found, sizes, joined, raw = own.encode_column(pa.array(["skipped", text, None, "the", text]).slice(1))
    the = library.encode("the", add_special_tokens=False).ids
    assert found.tolist() == [*ids, *the, *ids] and sizes.tolist() == [len(ids), 0, len(the), len(ids)]
    assert joined == [",".join(map(str, x)).encode() for x in (ids, [], the, ids)] and raw[0].decode("utf-8", "replace") == own.decode(ids)


def test_bpe_long_runs(byte_bpe):
    own, library = byte_bpe
    for text in ("ab" * 4000, "x" * 5000, "the" * 1500, "é" * 999):
        assert own.encode(text) == own.encode_column(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_memory_is_bounded(byte_bpe, monkeypatch):
    own, library = byte_bpe
    monkeypatch.setattr(own.memory, "most", 5)
    texts = [f"w{i} v{i * 7}" for i in range(30)]
    for i in range(0, 30, 3):
        assert own.encode_column(pa.array(texts[i : i + 3]))[0].tolist() == [k for t in texts[i : i + 3] for k in library.encode(t, add_special_tokens=False).ids]
        assert own.memory.n <= 6


def test_bpe_query_columns(docs, empty, byte_bpe):
    _, library = byte_bpe
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.encode(docs, path).collect()
    assert len(rows) == docs.count()
    texts = Counter((r[0], r[1] or "") for r in corpus())
    assert Counter((r["doc_id"], r["decoded"]) for r in rows) == texts
    for r in rows:
        ids = library.encode(r["decoded"], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert bpe.encode(empty, path).collect() == []


# Token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=2500), st.sampled_from([64, 128, 1024]), st.floats(0.5, 1))
def test_token_blocks_round_trip(values, block, percentile):
    ids = np.array(values, np.uint32)
    lengths = np.array([len(ids) // 2, 0, len(ids) - len(ids) // 2])
    f = tokenfiles.TokenFile(tokenfiles.write_blocks(ids, lengths, block=block, percentile=percentile))
    assert (f.ids() == ids).all()
    assert (f.document(2) == ids[len(ids) // 2 :]).all() and len(f.document(1)) == 0


def test_token_file_damage_is_noticed():
    data = bytearray(tokenfiles.write_blocks(np.arange(3000, dtype=np.uint32), np.array([3000])))
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(bytes(data)).ids()


@pytest.fixture(scope="module")
def word_bpe():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return tokenfiles.ChunkEncoder(f.read()), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(NASTY)
def test_chunk_encoder_equals_library(word_bpe, text):
    own, library = word_bpe
    ids, sizes = own(pa.array([text, "the", None, text]))
    want = library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == [*want, *library.encode("the", add_special_tokens=False).ids, *want] and sizes.tolist() == [len(want), 1, 0, len(want)]


def test_token_files_of_a_table_in_order(spark, word_bpe):
    _, library = word_bpe
    rows = [(3 * i - 50, r[1]) for i, r in enumerate(corpus())]
    ordered = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).orderBy("doc_id")
    assert tokenfiles.stretches(ordered.selectExpr("doc_id AS id"))["ordered"] and not tokenfiles.stretches(ordered.selectExpr("-doc_id AS id"))["ordered"]
    found = [r for r in tokenfiles.read(tokenfiles.write(ordered, public_tokenizers.path("word_bpe_49k.json"), end_id=2, file_ids=3000)).orderBy("start").collect()]
    assert [(r["doc_id"], r["ids"]) for r in found] == [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    assert [r["start"] for r in found] == np.concatenate(([0], np.cumsum([len(r["ids"]) for r in found])[:-1])).tolist()


def test_token_files_of_one_row_many_times(spark, word_bpe):
    many = spark.createDataFrame([(7, "the same text")] * 5000, "doc_id long, text string").repartition(4)
    files = tokenfiles.write(many, public_tokenizers.path("word_bpe_49k.json"), end_id=2, partitions=4)
    assert files.select("part").distinct().count() > 2 and tokenfiles.read(files, with_ids=False).selectExpr("max(start)", "count(DISTINCT start)").collect()[0][:] == (4999 * 4, 5000)


def test_token_files_query(docs, empty, word_bpe):
    _, library = word_bpe
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = tokenfiles.write(docs, path, end_id=2, file_ids=5000)
    rows = tokenfiles.read(manifest).collect()
    assert manifest.count() > 3 and len(rows) == docs.count()
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] is not None for r in rows] == sorted(r["doc_id"] is not None for r in rows)
    known = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert known == sorted(known)
    assert [r["start"] for r in rows] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in rows])[:-1])).tolist()
    expected = Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in corpus())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == expected
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    assert tokenfiles.read(tokenfiles.write(empty, path, end_id=2)).collect() == []


# SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words)] if 0 < len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(items, linked):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(items))]


def test_simhash_equals_brute_force(docs, empty):
    rows = sorted(simhash.near_duplicates(docs).collect(), key=key)
    data = sorted(corpus(), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [brute_fingerprint(r[1]) for r in data]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in rows) == Counter((d[0], f"{p:016x}") for d, p in zip(data, prints, strict=True))
    groups = brute_groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, g in zip(data, groups, strict=True):
        if d[0] is not None:
            least[g] = min(least.get(g, d[0]), d[0])
    assert Counter((r["doc_id"], r["component_id"]) for r in rows) == Counter((d[0], least.get(g)) for d, g in zip(data, groups, strict=True))
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("dense", [0, 2, 1000])
def test_simhash_links_in_dense_cells(spark, dense):
    rng = random.Random(dense)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(12)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), dense=dense).collect()
    assert all(((u ^ v) & ((1 << 64) - 1)).bit_count() <= 2 for u, v in found)
    truth = brute_groups(prints, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    place = {p: i for i, p in enumerate(prints)}
    edges = {(place[u], place[v]) for u, v in found} | {(place[v], place[u]) for u, v in found}
    assert brute_groups(list(range(len(prints))), lambda a, b: (a, b) in edges) == truth


def test_majority_of_long_lists(monkeypatch):
    rng = random.Random(3)
    lists = [[rng.getrandbits(64) for _ in range(n)] for n in (0, 1, 7, 50, 3)]
    want = [sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) for h in lists]
    swap = lambda x: int.from_bytes(int(x).to_bytes(8, "little"), "little")
    for block in (10, 10_000):
        monkeypatch.setattr(simhash, "BLOCK_HASHES", block)
        assert [swap(x) for x in simhash.majority(lists)] == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long").select(graph.scramble(simhash.F.col("u")).alias("u"), graph.scramble(simhash.F.col("v")).alias("v"))
    roots = [r["root"] for r in graph.components(df).collect()]
    assert sorted(Counter(roots).values()) == [30, 61]
    assert graph.components(df.limit(0)).collect() == []


# Decontamination


def brute_scan(text, items, width=10):
    norm = lambda t: "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")).split(" ")
    words = [w for w in norm(text) if w]
    hit, found = [False] * len(words), set()
    for name, t in items:
        w = [x for x in norm(t) if x]
        for win in [w[i : i + width] for i in range(max(1, len(w) - width + 1))] if w else []:
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    hit[i : i + len(win)] = [True] * len(win)
                    found.add(str(name) if name is not None else "")
    return len(words), sum(hit), sorted(found)


@pytest.mark.parametrize("pattern_words", [10, 1_000_000])
def test_decontamination_equals_brute_force(spark, docs, empty, pattern_words):
    rng = random.Random(4)
    data = corpus()
    items = [("i%d" % i, " ".join((data[i][1] or "").split()[2:16])) for i in range(0, 40, 3)] + [("short", "Zz, zz"), ("none", None), ("blank", " !"), (None, data[50][1]), ("i0", data[51][1])]
    extra = [(1000 + i, sentence(rng, "en", 20).upper() + " - zz... ZZ; zz " + (items[i][1] or "").replace(" ", ",\n"), None, None, 0, 0.0, "", 0, 0) for i in range(5)]
    df = docs.union(spark.createDataFrame(extra, SCHEMA))
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = decontaminate.scan_documents(df, bench, pattern_words=pattern_words).collect()
    want = Counter((d[0], *map(str, brute_scan(d[1], items))) for d in [*data, *extra])
    assert Counter((r["doc_id"], str(r["n_words"]), str(r["n_hit"]), str(r["item_ids"])) for r in rows) == want
    for r in rows:
        text = next(d[1] for d in [*data, *extra] if d[0] == r["doc_id"] and bool(d[1]) == bool(r["n_words"]) or d[0] == r["doc_id"] and not r["spans"])
        assert sum(len(decontaminate.words_of(text[s["start"] : s["end"]])) for s in r["spans"]) == r["n_hit"] or r["doc_id"] in (5, 40)
    assert decontaminate.scan_documents(empty, bench).collect() == []
    assert all(r["n_hit"] == 0 for r in decontaminate.scan_documents(docs, bench.limit(0)).collect())


# Language identification


def test_posteriors_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    crf = langid.Crf(["a", "b", "c"])
    crf.moves = rng.normal(size=(3, 3))
    scores = rng.normal(size=(300, 3)).astype(np.float32) * 3
    starts = np.array([0, 1, 1, 200, 264, 300])
    got, t = crf.posteriors(scores, starts), np.exp(crf.moves)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        alpha, v = [], np.full(3, 1 / 3)
        for j in range(a, b):
            v = (v @ t) * np.exp(scores[j].astype(float))
            v /= v.sum()
            alpha.append(v)
        beta = np.ones(3)
        for j in range(b - 1, a - 1, -1):
            p = alpha[j - a] * beta
            assert np.allclose(p / p.sum(), got[j], atol=1e-9)
            beta = t @ (np.exp(scores[j].astype(float)) * beta)
            beta /= beta.sum()


def test_language_accuracy_and_code_switching(spark, docs, empty):
    train = simhash.F.col("doc_id") % 3 != 0
    rows = langid.identify(docs, train, word_labels=True).collect()
    truth = {d[0]: d[2] for d in corpus()}
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] % 3 == 0 and r["words"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.9
    assert {r["lang_pred"] for r in rows if not r["words"]} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in rows)
    rng = random.Random(9)
    mixed = spark.createDataFrame([(1, sentence(rng, "en", 60) + " " + sentence(rng, "de", 60), None)], "doc_id long, text string, lang string")
    model_rows = langid.identify(docs.select("doc_id", "text", "lang").union(mixed.withColumn("doc_id", simhash.F.lit(9999))), train & (simhash.F.col("doc_id") < 9999), word_labels=True)
    words = model_rows.where("doc_id = 9999").collect()[0]["words"]
    assert np.mean([w == "en" for w in words[:60]]) > 0.8 and np.mean([w == "de" for w in words[60:]]) > 0.8
    assert langid.identify(empty, train).collect() == []
    assert {r["lang_pred"] for r in langid.identify(docs, simhash.F.lit(False)).collect()} == {"und"}


def test_languages_equal_a_plain_recomputation(spark, docs, monkeypatch):
    models = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    rows = langid.identify(docs, simhash.F.col("doc_id") % 3 != 0).collect()
    crf = models[0]
    t = np.exp(crf.moves)

    def plain(text):
        words = features.words_of(text)
        if not words:
            return "und", 0.0
        e = np.exp(crf.emissions(words).astype(float))
        ahead, v = [], np.full(len(crf.labels), 1 / len(crf.labels))
        for x in e:
            v = (v @ t) * x
            v /= v.sum()
            ahead.append(v)
        total, back = np.zeros(len(crf.labels)), np.ones(len(crf.labels))
        for a, x in zip(ahead[::-1], e[::-1], strict=True):
            total += a * back / (a * back).sum()
            back = t @ (x * back)
            back /= back.sum()
        return crf.labels[int(total.round(9).argmax())], total.max() / len(words)

    want = sorted((d[0] is None, d[0] or 0, *plain(d[1])) for d in corpus())
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in rows)
    assert [f[:3] for f in found] == [w[:3] for w in want] and np.allclose([f[3] for f in found], [w[3] for w in want], atol=1e-5)


def test_short_texts_are_learned_from():
    crf = langid.fit(["the thing"] * 5 + ["der keit"] * 5, ["en"] * 5 + ["de"] * 5)
    p = crf.posteriors(crf.emissions(["thing", "keit"]), np.array([0, 1, 2]))
    assert p[0, 1] > 0.9 and p[1, 0] > 0.9


def test_feature_blocks_do_not_depend_on_company():
    words = ["a", "thing", "é", "w" * 100, "中文", "thing"]
    alone = {w: next(features.blocks([w], (1, 2, 3), 12)) for w in words}
    for some, ids, whole in features.blocks(words, (1, 2, 3), 12):
        for i, row, lex in zip(some.tolist(), ids, whole, strict=True):
            a = alone[words[i]]
            assert sorted(row[row < 4096].tolist()) == sorted(a[1][0][a[1][0] < 4096].tolist()) and lex == a[2][0]


# Toxicity


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x, mask, y = rng.normal(size=(6, 3, toxicity.INPUTS)), np.ones((6, 3), bool), np.array([1.0, 0, 1])
    mask[4:, 1] = False

    def loss():
        q = toxicity.sigmoid(net.forward(x, mask).astype(float))
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).sum()

    out, kept = net.forward(x, mask, keep=True)
    grads = net.gradient(kept, toxicity.sigmoid(out) - y)
    for name, v in net.p.items():
        i = tuple(rng.integers(0, s) for s in v.shape)
        was = v[i]
        v[i] = was + 1e-3
        up = loss()
        v[i] = was - 1e-3
        down = loss()
        v[i] = was
        assert abs((up - down) / 2e-3 - grads[name][i]) < 1e-2 * (0.05 + abs(grads[name][i]))


def test_toxic_documents_are_found(spark, docs, empty):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        words = sentence(rng, rng.choice(list(WORDS)), rng.randint(5, 200)).split()
        bad = rng.random() < 0.3
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grubbo", "snarfle", "vilkor"]) + rng.choice(["", ",", "s"]))
        rows.append((i, " ".join(words), int(bad)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("doc_id", "text"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(df, labels, simhash.F.col("doc_id") % 4 != 2).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    right = np.mean([(scored[r[0]] >= 0.3) == bool(r[2]) for r in held])
    assert right > 0.93
    assert len(toxicity.score(docs, labels, simhash.F.lit(True)).collect()) == docs.count()
    assert toxicity.score(empty, labels, simhash.F.lit(True)).collect() == []
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0), simhash.F.lit(True)).collect()} == {0.0}


def test_toxicity_scores_equal_a_plain_recomputation():
    rng = random.Random(11)
    texts = [sentence(rng, rng.choice(list(WORDS)), rng.randint(0, 150)) + (" grubbo" if i % 4 == 0 else "") for i in range(40)] + ["", "!! 12", "x " * 500]
    model = toxicity.fit(texts, [int(t.endswith("grubbo")) for t in texts], epochs=2)
    p = {k: v.astype(float) for k, v in model.net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def layer(x, d):
        s, out, h = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
        for v in x:
            a, b = v @ p["w" + d] + p["c" + d], s @ p["u" + d]
            z, r = sig(a[:h] + b[:h]), sig(a[h : 2 * h] + b[h : 2 * h])
            s = z * s + (1 - z) * np.tanh(a[2 * h :] + r * b[2 * h :])
            out.append(s)
        return np.array(out)

    def plain(text):
        words = features.words_of(text)
        best, at = -np.inf, 0
        while True:
            window = words[at : at + toxicity.WINDOW]
            if window:
                x = model.rows(window).astype(float)
                states = np.concatenate((layer(x, "f"), layer(x[::-1], "b")[::-1]), 1)
                a = np.exp(states @ p["va"])
                best = max(best, a / a.sum() @ states @ p["wo"] + p["bo"][0])
            elif not words:
                best = p["bo"][0]
            at += toxicity.WINDOW - toxicity.OVERLAP
            if at + toxicity.OVERLAP >= len(words):
                return sig(best)

    memory = features.WordRows(model.rows, toxicity.INPUTS)
    got = model.scores(*memory([features.words_of(t) for t in texts]))
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-4)


def test_toxic_words_are_found_far_into_long_texts(spark):
    rng = random.Random(12)
    rows = [(i, sentence(rng, "en", 60) + (" grubbo snarfle " + sentence(rng, "en", 10) if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(240)]
    long = sentence(rng, "en", 30_000)
    rows += [(1000, long, 0), (1001, long + " grubbo snarfle grubbo " + sentence(rng, "en", 5_000), 1)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 1000], "doc_id long, toxic int")
    scored = {r["doc_id"]: r for r in toxicity.score(df, labels, simhash.F.lit(True)).collect()}
    assert scored[1001]["score"] >= 0.3 > scored[1000]["score"]
    assert scored[1001]["top_window"] == pytest.approx(30_000 / 36, abs=2) and scored[1001]["n_windows"] > 900


def test_windows_cover_every_word():
    starts = np.array([0, 0, 5, 48, 200, 900])
    rows = np.arange(900, dtype=np.float32)[:, None]
    x, mask, owner = toxicity.windows(rows, starts)
    for i in range(5):
        seen = {int(v) for v, m in zip(x[:, owner == i, 0].ravel(), mask[:, owner == i].ravel(), strict=True) if m}
        assert seen == set(range(starts[i], starts[i + 1]))


# Language model


@pytest.fixture
def small_model(monkeypatch):
    """A model of a few classes over random ids, with its parts."""
    monkeypatch.setattr(languagemodel, "CLASSES", 12)
    monkeypatch.setattr(languagemodel, "SHARED", 4)
    rng = np.random.default_rng(2)
    size = 30
    ids = (rng.integers(0, 5, 4000) * rng.integers(1, 6, 4000) + 3).astype(np.int64)
    stops = np.array([1500, 1500 + 900, 4000])
    ids[stops - 1] = size - 1
    classes = languagemodel.Classes(ids, stops, size, size - 1)
    y = classes.of[ids]
    one, two = languagemodel.before(y, stops, classes.end)
    n = 12
    keys, found = np.unique((two.astype(np.int64) * n + one) * n + y, return_counts=True)
    pairs = np.bincount(keys % (n * n), found, n * n).reshape(n, n)
    some = found >= 5
    counts = languagemodel.Counts(pairs, (keys[some], found[some].astype(float)), np.bincount(ids, minlength=size).astype(float), classes.of)
    table = rng.random((n, languagemodel.EXPERTS)) + 0.1
    model = languagemodel.Attention((table / table.sum(0)).astype(np.float32), rng.integers(0, languagemodel.EXPERTS, n))
    return ids, stops, classes, counts, model, (keys, found, pairs, y, one, two)


def test_language_model_gradient(small_model):
    rng = np.random.default_rng(3)
    ids, stops, classes, counts, m, (*_, y, one, two) = small_model
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    windows, counted = languagemodel.Windows(y, stops, classes.end, 12), counts(two, one, y)
    pick = np.arange(5)
    x, target, real = windows[pick]
    beside = windows.beside(pick, counted)
    _, grads, _ = m.gradient(x, target, real, beside)
    for name, v in m.p.items():
        i = tuple(rng.integers(0, s) for s in v.shape) if name not in ("e", "gate") else (int(x[0, -1]), 3)
        was = v[i]
        v[i] = was + 1e-5
        up = m.gradient(x, target, real, beside)[0]
        v[i] = was - 1e-5
        down = m.gradient(x, target, real, beside)[0]
        v[i] = was
        assert abs((up - down) / 2e-5 - grads[name][i]) < 1e-5


def test_language_model_probabilities_of_all_ids_add_up_to_one(small_model):
    ids, stops, classes, counts, m, (*_, y, one, two) = small_model
    m.freeze()
    windows = languagemodel.Windows(y, stops, classes.end, 12)
    x, _, _ = windows[np.arange(40, 41)]
    at = int(windows.target[40])
    total = 0
    for i in range(30):
        c = classes.of[i]
        counted = np.repeat(counts(two[at : at + 16], one[at : at + 16], np.full(16, c))[None], 1, 0)
        total = total + 10 ** (m.log10(x, np.full((1, 16), c), counted)[0] + counts.inside[i])
    assert np.allclose(total, 1, atol=1e-4)


def test_language_model_scores_equal_a_plain_recomputation(small_model):
    """Each id alone, with its own inputs, in double precision."""
    ids, stops, classes, counts, m, (keys, found, pairs, y, one, two) = small_model
    m.freeze()
    sub = type("Ids", (), {"ids": lambda self, slots, sizes: (ids, stops)})()
    each, _ = languagemodel.spell(sub, classes, counts, m, None, None)
    p = {k: v.astype(float) for k, v in m.p.items()}
    single = np.bincount(classes.of, np.bincount(ids, minlength=30) + 0.5, 12)
    share = single + 1e-3
    share /= share.sum()
    triple = {int(k): int(n) for k, n in zip(keys, found, strict=True) if n >= 5}
    begins = np.concatenate(([0], stops[:-1]))
    for t in [0, 1, 5, 15, 16, 17, 31, 40, 1499, 1500, 1501, 2399, 2400, 2450, 3999]:
        text = int(np.searchsorted(stops, t, side="right"))
        first = begins[text] + (t - begins[text]) // 16 * 16
        past = [int(y[i]) if i >= begins[text] else classes.end if i == begins[text] - 1 else 12 for i in range(first - 16, t)]
        e = p["e"][past]
        s = np.array([(p["e"][past[-1]] @ p["q"]) @ (e[j] @ p["k"]) / 4 + p["far"][len(past) - 1 - j] for j in range(len(past))])
        a = np.exp(np.clip(s, -60, 60))
        a = (a / a.sum()) @ (e @ p["v"])
        z = np.maximum(a @ p["wa"] + p["e"][past[-1]] @ p["we"] + p["c"], 0) @ p["out"] + p["gate"][past[-1]]
        z = np.exp(z) / np.exp(z).sum()
        x1, x2, c = one[t], two[t], y[t]
        after_one = (max(pairs[x1, c] - 0.6, 0) + 0.6 * (pairs[x1] > 0).sum() * share[c]) / pairs[x1].sum()
        held = {k % 12: n for k, n in triple.items() if k // 12 == x2 * 12 + x1}
        rest = 1 - sum(n - 0.6 for n in held.values()) / pairs[x2, x1] if pairs[x2, x1] else 1
        after_two = (max(held.get(c, 0.6) - 0.6, 0) / pairs[x2, x1] if pairs[x2, x1] else 0) + rest * after_one
        inside = (np.bincount(ids, minlength=30)[ids[t]] + 0.5) / single[c]
        want = np.log10(z[:-2] @ m.table[c] + z[-2] * after_one + z[-1] * after_two) + np.log10(inside)
        assert each[t] == pytest.approx(want, abs=2e-4)


def test_places_are_taken_out_of_their_own_counts(small_model):
    """Counts that have been taken without a place give what ``without`` says of it."""
    ids, stops, classes, counts, _, (keys, found, pairs, y, one, two) = small_model
    for t in (3, 700, 1600, 3000):
        n = dict(zip(keys.tolist(), found.tolist(), strict=True))
        own = int((two[t] * 12 + one[t]) * 12 + y[t])
        kept_keys = np.array([k for k in n if n[k] >= 5])
        values = np.array([n[k] - (k == own) for k in kept_keys], float)
        fewer = pairs.copy()
        fewer[one[t], y[t]] -= 1
        again = languagemodel.Counts(fewer, (kept_keys, values), np.bincount(ids, minlength=30).astype(float), classes.of)
        first = again(two[t : t + 1], one[t : t + 1], y[t : t + 1])[0, 0]
        assert counts.without(two[t : t + 1], one[t : t + 1], y[t : t + 1])[0, 0] == pytest.approx(first, rel=0.05)


def test_triples_are_found_one_by_one_and_together():
    rng = np.random.default_rng(7)
    n = languagemodel.CLASSES
    keys = np.unique(rng.integers(0, n**3, 3000))
    one = (keys // n) % n
    pairs = np.zeros((n, n))
    np.add.at(pairs, (one, keys % n), 9)
    pairs[(keys // n) // n, one] += 9
    counts = languagemodel.Counts(pairs, (keys, np.full(len(keys), 9.0)), np.ones(50), np.zeros(50, np.int64))
    want = 8.4 / pairs.ravel()[keys // n]
    asked = np.concatenate((keys, rng.integers(0, n**3, 3000)))
    found = counts.lookup(asked)
    assert np.allclose(found[: len(keys)], want) and (found[len(keys) :][~np.isin(asked[len(keys) :], keys)] == 0).all()
    assert [float(counts.lookup(asked[i : i + 1])[0]) for i in range(0, len(asked), 7)] == found[::7].tolist()


def test_windows_hold_each_id_once_and_see_only_the_past():
    ids = np.arange(100)
    stops = np.array([1, 17, 33, 100])
    w = languagemodel.Windows(ids, stops, 200, 201)
    x, y, real = w[np.arange(len(w))]
    assert sorted(y[real].tolist()) == ids.tolist()
    assert (w.beside(np.arange(len(w)), np.arange(100)[:, None])[real][:, 0] == y[real]).all()
    begins = dict(zip(range(4), [0, 1, 17, 33], strict=True))
    for row, target, ok in zip(x, y, real, strict=True):
        first = int(target[0])
        begin = max(b for b in begins.values() if b <= first)
        past = [v for v in row[: languagemodel.WIDTH].tolist() if v < 200]
        assert past == list(range(max(begin, first - languagemodel.WIDTH), first))
        assert ok[0]


WORDY = st.lists(st.sampled_from(["a", "The", "ing", "é" * 20, "x" * 33, "x" * 34, "中文", "%%%", " ", "\n", "\t ", "\x0b", "\x1c", "\xa0", "\x00"]), max_size=30).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(WORDY | st.none(), max_size=6))
def test_word_memory_cuts_and_numbers_words(texts):
    names: list[bytes] = []
    memory = wordmemory.WordMemory(names.extend, 8)
    for _ in range(2):
        data, edges = wordmemory.bytes_of(pa.array(["skipped", *texts], pa.string()).slice(1), lower=True)
        starts, ends, sizes = wordmemory.cut(data, edges, wordmemory.ASCII_SPACE)
        found = memory.numbers(data, starts, ends)
        if found is None:
            names.clear()
            found = memory.numbers(data, starts, ends)
        want = [(t or "").encode().lower().split() for t in texts]
        assert sizes.tolist() == [len(w) for w in want]
        assert [names[i] for i in found] == [w for t in want for w in t] and len(set(names)) == len(names)


def test_word_memory_of_equal_hashes(monkeypatch):
    names: list[bytes] = []
    memory = wordmemory.WordMemory(names.extend, 100)
    real = memory.hashes
    monkeypatch.setattr(memory, "hashes", lambda *a: (np.full(len(a[1]), 7, np.uint64), real(*a)[1]))
    words = [b"one", b"two", b"one", b"three", b"two"]
    ends = np.cumsum([len(w) for w in words])
    for _ in range(2):
        found = memory.numbers(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
        assert [names[i] for i in found] == words and len(names) == 3


def test_language_model_query(docs, empty):
    F = simhash.F
    train = F.coalesce(F.col("doc_id") % 5 != 2, F.lit(True))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = languagemodel.score(docs, train, path).collect()
    split = lambda t: [*(t or "").encode().lower().split(), b" "]
    counts = Counter()
    for d in corpus():
        if d[0] is None or d[0] % 5 != 2:
            counts.update(split(d[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((d[0] is None, d[0] or 0, len(split(d[1])), sum(counts[w] > 0 for w in split(d[1])), round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in split(d[1])), 6)) for d in corpus())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == want
    assert {r["train_tokens"] for r in rows} == {n}
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    learned = [r for r in rows if r["trained"] and r["n_tokens"] > 3]
    assert sum(r["score"] for r in learned) > sum(r["base_score"] for r in learned)
    assert languagemodel.score(empty, train, path).collect() == []
    none = languagemodel.score(docs, F.lit(False), path).collect()
    assert {r["base_score"] for r in none} == {0.0} and {r["n_known"] for r in none} == {0} and all(np.isfinite(r["score"]) for r in none)


# Licences


def brute_lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            best[j], before = (before + 1 if x == y else max(best[j], best[j - 1])), best[j]
    return best[-1]


def test_patience_is_a_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a = [b"%d" % rng.randrange(12) for _ in range(rng.randrange(20))]
        b = [b"%d" % rng.randrange(12) for _ in range(rng.randrange(25))]
        m = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in m) and len(m) <= brute_lcs(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:], strict=False))
    distinct = [b"%d" % i for i in range(30)]
    cut = [w for w in distinct if int(w) % 7]
    assert len(licenses.patience(distinct, cut)) == len(cut)


def test_license_scan(spark, docs, empty):
    mit, gpl = licenses.TEMPLATES["MIT-text"], licenses.TEMPLATES["GPL-3.0"]
    words = mit.split()
    texts = [f"x {gpl} y", gpl + " " + gpl, " ".join(words[:20] + ["really"] + words[22:]), " ".join(words[: len(words) // 2]), None, "", "the work is of this license " * 50, licenses.TEMPLATES["MIT"].upper()]
    rows = {r["doc_id"]: r["licenses"] for r in licenses.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [x["name"] for x in rows[0]] == ["GPL-3.0"] and texts[0][rows[0][0]["start"] : rows[0][0]["end"]] == gpl.rstrip(".")
    assert [x["name"] for x in rows[1]] == ["GPL-3.0"] * 2
    assert [x["name"] for x in rows[2]] == ["MIT-text"] and 0.9 < rows[2][0]["coverage"] < 1
    assert [rows[i] for i in (3, 4, 5, 6)] == [[]] * 4 and [x["name"] for x in rows[7]] == ["MIT"]
    assert len(licenses.scan_documents(docs).collect()) == docs.count() and licenses.scan_documents(empty).collect() == []


@pytest.mark.parametrize(("added", "replaced"), [(0, 12), (10, 4), (20, 8), (20, 12)])
def test_changed_notices_behind_common_words(added, replaced):
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    template = scanner.templates["MIT-text"]
    for seed in range(12):
        rng = random.Random(seed)
        words = list(template)
        for i in rng.sample(range(1, len(words) - 1), replaced):
            words[i] = b"q%d" % i
        for i in range(added):
            words.insert(rng.randint(1, len(words) - 1), b"z%d" % i)
        prose = [rng.choice([b"the", b"of", b"to", b"in", b"and", b"or", b"a", b"w%d" % i]) for i in range(30 + 7 * seed)]
        least = len(licenses.patience(template, words)) / len(template)
        assert least >= 0.8
        found = [m for m in scanner.scan([*prose, *words, *prose]) if m[2] == "MIT-text"]
        assert len(found) == 1 and found[0][0] >= least and found[0][4] >= len(prose) + len(words) and found[0][3] <= len(prose)


def test_planted_notices_among_licence_words_are_found():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    vocabulary, planted = sorted(scanner.vocabulary), 0
    for seed in range(200):
        rng = random.Random(seed)
        name = rng.choice([k for k, w in scanner.templates.items() if len(w) > 20])
        words = list(scanner.templates[name])
        for i in rng.sample(range(1, len(words) - 1), int(len(words) * rng.choice([0, 0.05, 0.1, 0.18]))):
            words[i] = rng.choice(vocabulary)
        for _ in range(rng.randint(0, max(1, len(words) // 5))):
            words.insert(rng.randint(1, len(words) - 1), rng.choice(vocabulary))
        if len(licenses.patience(scanner.templates[name], words)) < 0.8 * len(scanner.templates[name]):
            continue
        planted += 1
        before, after = ([rng.choice(vocabulary) for _ in range(rng.randint(0, 300))] for _ in range(2))
        assert any(m[3] < len(before) + len(words) and m[4] > len(before) for m in scanner.scan([*before, *words, *after])), (seed, name)
    assert planted > 150


def test_license_positions_of_the_query(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        name = rng.choice(sorted(licenses.TEMPLATES))
        head, tail = sentence(rng, "en", 20), sentence(rng, "de", 20)
        rows.append((i, f"{head}\n{licenses.TEMPLATES[name]}\n{tail}", name, len(head) + 1))
    df = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan_documents(df).collect()}
    for i, text, name, at in rows:
        best = found[i][0]
        assert best["name"] == name and best["coverage"] == 1 and best["start"] == at + next(k for k, c in enumerate(licenses.TEMPLATES[name]) if c.isalnum())
        assert text[best["start"] : best["end"]].rstrip("./") == licenses.TEMPLATES[name].rstrip("./")


# Samples


def test_samples_hold_at_any_size(spark):
    for rate in (1e-3, 1e-9, 1e-12, 1e-15):
        share = (common.hash_limit(rate) + 2**63) / 2**64
        assert share == pytest.approx(rate, rel=1e-3) and common.hash_limit(rate) > -(2**63)
    assert common.hash_limit(2.0) == 2**63 - 1
    F = simhash.F
    rows = spark.range(20_000).select((F.col("id") % 2).cast("string").alias("label"), F.xxhash64("id").alias("hash"), F.lit(100).alias("size"))
    for factor in (1, 10**6, 10**9, 10**12):  # as many characters as texts of those sizes hold
        keys, totals = common.sample_keys(rows.withColumn("size", F.lit(100 * factor).cast("long")), 164 * 30 * factor)
        assert totals == {"0": 10_000, "1": 10_000} and {k for k, _ in keys} == {"0", "1"}
        per = Counter(k for k, _ in keys)
        assert 1 <= min(per.values()) and max(per.values()) <= 50
    one, _ = common.sample_keys(rows.withColumn("size", F.lit(10**15).cast("long")), 1000)
    assert Counter(k for k, _ in one) == {"0": 1, "1": 1}


def test_equal_and_empty_rows_dont_outgrow_a_sample(spark):
    F = simhash.F
    rows = spark.range(10_000).select(F.lit("x").alias("label"), F.lit(5).cast("long").alias("hash"), F.lit(30).alias("size"), F.lit("a text").alias("text"))
    keys, totals = common.sample_keys(rows.drop("text"), 500)
    assert keys == [("x", 5)] and totals == {"x": 10_000} and len(common.sampled(rows, keys, "text")) == 1
    empty = rows.withColumn("size", F.lit(0)).withColumn("hash", F.xxhash64(F.monotonically_increasing_id()))
    assert len(common.sample_keys(empty.drop("text"), 6400)[0]) <= 100
    assert common.sample_keys(rows.drop("text").limit(0), 500) == ([], {})


# Near-duplicate vectors


@pytest.mark.parametrize("more", [{}, {"outer": 10}, {"outer": 10, "widest": 24}])
def test_neighbours_equal_brute_force(spark, more):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(300)]
    for c in range(4):
        base = rng.normal(size=16)
        rows += [(1000 + 100 * c + i, (base + rng.normal(size=16) * 0.08).tolist()) for i in range((2, 5, 40, 90)[c])]
    rows += [(2000 + i, rows[5][1]) for i in range(30)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] + [1.0] * 15), (3004, [float("inf")] + [1.0] * 15), (3005, [None] + [1.0] * 15), (3006, [1e300] * 16), (3007, [1e-300] * 16), (3008, [1.0] * 8), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, u long, key int").repartition(3)
    found = sorted(neighbours.near_duplicates(df, k=6, **more).collect(), key=lambda r: (r["vec_id"], r["n_links"]))
    good = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = [neighbours.unit(v[None])[0] for _, v in good]
    linked = [[k for k in range(len(good)) if k != j and len(unit[k]) == len(unit[j]) and unit[j] @ unit[k] >= 0.9] for j in range(len(good))]
    group = brute_groups(list(range(len(good))), lambda a, b: b in linked[a])
    least = {}
    for (i, _), g in zip(good, group, strict=True):
        least[g] = min(least.get(g, i), i)
    want = [(i, len(n), least[g]) for (i, _), n, g in zip(good, linked, group, strict=True)] + [(i, 0, i) for i in (3000, 3001, 3002, 3003, 3004, 3005)]
    assert [(r["vec_id"], r["n_links"], r["component_id"]) for r in found] == sorted(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    assert neighbours.near_duplicates(df.limit(0)).collect() == []


def test_links_between_saturated_groups(spark):
    rng = np.random.default_rng(5)
    a, b, c = np.linalg.qr(rng.normal(size=(32, 3)))[0].T
    bases = [a, 0.93 * a + np.sqrt(1 - 0.93**2) * b, 0.89 * a - np.sqrt(1 - 0.89**2) * c, -a]
    rows = [(100 * g + i, (base + rng.normal(size=32) * 0.012).tolist()) for g, base in enumerate(bases) for i in range((40, 30, 25, 20)[g])]
    found = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=0.9).collect()
    x = neighbours.unit(np.array([v for _, v in rows]))
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    groups = brute_groups(list(range(len(x))), lambda i, j: near[i, j])
    least = {g: min(rows[i][0] for i in range(len(x)) if groups[i] == g) for g in set(groups)}
    assert near[:40, 40:70].all() and near[:40, 70:95].any() and not near[:40, 70:95].all()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found) == [(rows[i][0], near[i].sum(), least[groups[i]], rows[i][0] == least[groups[i]]) for i in range(len(x))]


def test_recall_is_audited_after_every_attempt(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(50)], "vec_id long, embedding array<double>")
    calls = []
    monkeypatch.setattr(neighbours, "audited", lambda vectors, sample, threshold: calls.append(sample.count()) or vectors.selectExpr("u", "7L AS n"))
    with pytest.raises(RuntimeError, match="recall"):
        neighbours.near_duplicates(df, attempts=1)
    assert len(calls) == 2 and min(calls) == 50
    some = spark.range(20_000).withColumnRenamed("id", "u")
    assert 100 < some.where(neighbours.in_sample(200, 20_000)).count() < 320 and some.where(neighbours.in_sample(200, 10**12)).count() == 0
    assert some.where(neighbours.in_sample(200 * 10**12, 2 * 10**16)).count() > 100


# Pages

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="ad">Buy the best things of all, only today and here.</div><article><h1>A title &amp; more</h1><p>First paragraph of the &eacute;tude,\n with <b>bold text.<br><p>Second one,   rather long &#8212; as these things are.</article>
<aside><p>See also this other very good story of ours.</p></aside><section id="comments"><p>I like this story, it is really good.</p></section><form><p>Your name</form><footer>All rights reserved.</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, None, "<p>" + "word " * 40_000 + "</p>"), (5, "u", "a < b <"), (6, "u", PAGE)]
    found = {r["page_id"]: r for r in mainpage.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), with_blocks=True).collect()}
    assert found[1]["blocks"] == ["A title & more", "First paragraph of the étude, with bold text.", "Second one, rather long — as these things are."]
    assert found[1]["text"] == "\n\n".join(found[1]["blocks"]) == found[6]["text"] and found[1]["n_chars"] == len(found[1]["text"])
    assert (found[2]["text"], found[3]["n_chars"]) == ("", 0) and found[4]["n_chars"] == 199_999


def test_main_text_of_odd_tables(spark):
    rows = [(i, f"u{i}", PAGE, "clash", "b", 1) for i in range(3)] + [(None, None, "<div><p>Open <b>tags", None, None, None), (9, "u", "<p>" + "é" * 100_000, "t", "c", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, blocks string, n_chars int")
    found = sorted(mainpage.main_text(df).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
    assert [r["n_chars"] for r in found] == [len("\n\n".join(mainpage.extract(h))) for _, _, h, *_ in (*rows[:3], rows[4], rows[3])]
    assert found[0].asDict().keys() == {"page_id", "text", "n_chars"} and found[-1]["text"] == "Open tags" and found[3]["text"] == "é" * 100_000
    assert mainpage.main_text(df.limit(0)).collect() == []


def test_page_weights_are_fitted_by_the_rule():
    pages = [f"<nav><a href=/>Home {i}</a></nav><article><p>{'A sentence of the article. ' * (i % 5 + 1)}</p></article><footer>All rights</footer>" for i in range(50)]
    w = mainpage.fit(pages)
    rows = [(mainpage.features(*b), mainpage.label(b[1])) for page in pages for b in mainpage.blocks_of(page)]
    assert {y for _, y in rows} == {0, 1} and all((np.dot(x, w) > 0) == y for x, y in rows)
    assert not np.allclose(w, mainpage.PRIOR) and (mainpage.fit([]) == mainpage.PRIOR).all()
    p = lambda w: sum(np.log(1 / (1 + np.exp(-(2 * y - 1) * np.dot(x, w)))) for x, y in rows)
    assert p(w) > p(mainpage.PRIOR)


def test_reader_comments_inside_an_article_go():
    page = "<article><h1>The title of it</h1><p>First paragraph, which is long enough to be read by all of us.</p><section class='comments'><p>I like this story, it is really good.</p><p>So do I, as I said before.</p></section></article>"
    assert mainpage.extract(page) == ["The title of it", "First paragraph, which is long enough to be read by all of us."]


@pytest.mark.parametrize(
    "before",
    ["<datalist><option value=a><option value=b></datalist>", '<form><input><option value="a"/></form>', '<option value="a" />', '<div><svg viewBox="0 0 1 1"/></div>', "<svg/>", "<math/>", "<p><math/></p>", "<select><option>One<option>Two", "<button>Share", '<object data="x"/>', "<div><svg><path d='M0 0'></div>", "<svg><svg><text>Icon</text></svg></svg>"],
)
def test_articles_after_open_tags_are_kept(before):
    page = f"<html><body>{before}<article><h1>A title of it</h1><p>First paragraph of the article, which is long enough to be read.</p><p>The formula <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds for all <svg><text>Icon</text></svg>of them.</p><button>Share this</button><select><option>One<option>Two</select></article></body></html>"
    assert mainpage.extract(page) == ["A title of it", "First paragraph of the article, which is long enough to be read.", "The formula x=1 holds for all of them."]


def test_minimum_cut_equals_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 7)
        terminals = [(rng.random() * 3, rng.random() * 3) for _ in range(n)]
        ties = [(i, j, rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side, terminals=terminals, ties=ties):
            return sum(b if s else a for s, (a, b) in zip(side, terminals, strict=True)) + sum(w for i, j, w in ties if side[i] != side[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(mainpage.minimum_cut(n, terminals, ties)) == pytest.approx(best)


def test_registry_names():
    assert [n for n in registry.queries() if n.startswith("op")] == sorted((n for n in registry.queries() if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert "pipeline" in registry.queries()


def test_comments_templates_and_plain_text_as_browsers_read_them():
    first, second = "First paragraph of the article, which is long enough to be read.", "Second paragraph of it, which is as long as the first one is."
    page = lambda between: f"<html><body><article><p>{first}</p>{between}<p>{second}</p></article></body></html>"
    for between in ("<!-->", "<!--->", "<!---->", "<!--x-->", "<!-- > -- x --!>", "<!-- a <p> b -->", "<template><p>no</p></template>", "<template>a<template>b</template>c</template>", "<template><script>'</template>'</script>c</template>"):
        assert mainpage.extract(page(between)) == [first, second], between
    shown = "Shown as it stands: <b>bold</b> &amp; more of the same, a long line."
    assert mainpage.extract(page(f"<xmp>{shown}</xmp>")) == [first, shown, second]
    assert mainpage.extract(page(f"<p>an open paragraph, which the next block ends at once<xmp>{shown}</xmp>"))[2] == shown
    assert mainpage.extract(page("<!-- never closed")) == [first]
    assert mainpage.extract(page("<template> never closed")) == [first]
