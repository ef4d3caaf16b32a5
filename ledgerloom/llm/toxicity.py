"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Inputs of each word are a learned vector, the sum of one of the word itself and those of its character n-grams with word ends, and
beside it what training rows say about the word and its n-grams (the word's ratio; the largest, the mean of the three
largest and the mean of all of its n-grams; the largest of those it begins with): how often documents that hold the feature are toxic, shrunk towards the overall share. The recurrent
network reads windows of ``WINDOW`` words that overlap by ``OVERLAP``, attention pools its states and
a logistic unit scores the window; a document's score is that of its most toxic window. Network and vectors
are trained in numpy by back-propagation through time on each document's highest window; what is said of a training row's
words comes from the other half of the training rows.

They are fitted on the driver on a sample of labelled rows of at most ``train_chars`` characters of
each label, chosen by a hash of id and text; a label that has any row is in it at every size of the table. Scoring covers all windows of every text.

Edge cases: null texts and texts without letters are scored as one empty window; without labelled rows of both
kinds every score is the share of toxic labels (0 without labels); of equally high windows the first is reported; texts of any length are scored
whole; empty tables give empty results; repeated rows get equal results; other columns are ignored; of several labels for an id the largest counts.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import kept, map_rows, materialize, release, sample_keys, sliced, trim
from ledgerloom.llm.features import WordRows, blocks, grouped, words_of

SIZES, BITS = (3, 4, 5, 6), 18
WINDOW, OVERLAP, HIDDEN, EPOCHS = 48, 12, 8, 20
#: Inputs of a word: what training rows say of it, and a learned vector.
STATED, LEARNED = 5, 8
INPUTS = STATED + LEARNED
PRIOR = 4.0
#: Windows that go through the network at a time.
BLOCK_WINDOWS = 1500


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole-word ids, and n-gram ids of all words one after another with where each word's begin and the last ones end."""
    whole, sizes, parts, order = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for some, ids, lex in blocks(words, SIZES, BITS):
        real = ids < (1 << BITS)
        whole[some], sizes[some] = lex, real.sum(1)
        parts.append(ids[real].astype(np.int32))
        order.append(some)
    flat, at = np.concatenate(parts), np.concatenate(order)
    many = sizes[at]
    begin = np.zeros(len(words), np.int64)
    begin[at] = np.cumsum(many) - many
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return whole, flat[np.repeat(begin - ends[:-1], sizes) + np.arange(len(flat))], ends


def openings(columns: int) -> np.ndarray:
    """The columns of a feature block that hold the n-grams at a word's beginning, the first of each size."""
    width = (columns + sum(SIZES) - 3 * len(SIZES)) // len(SIZES)
    return np.cumsum([0, *(width + 3 - n for n in SIZES[:-1])])


class WordEvidence:
    """Shares of toxic documents among those that hold a word or an n-gram, as log ratios."""

    def __init__(self, texts: list[list[str]], labels: np.ndarray):
        base = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
        vocab: dict[str, int] = {}
        docs = [np.array(sorted({vocab.setdefault(w, len(vocab)) for w in t}), np.int64) for t in texts]
        whole, flat, ends = word_features(list(vocab))
        n = np.zeros((2, 2, (1 << BITS) + 1))
        for ids, y in zip(docs, labels, strict=True):
            if len(ids):
                for kind, found in ((0, whole[ids]), (1, np.concatenate([flat[ends[i] : ends[i + 1]] for i in ids.tolist()]))):
                    found = np.unique(found)
                    n[kind, 0, found] += 1
                    n[kind, 1, found] += y
        rate = (n[:, 1] + PRIOR * base) / (n[:, 0] + PRIOR)
        self.word, self.gram = np.log(rate / base).astype(np.float32)
        self.gram[-1] = -9

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), STATED), np.float32)
        for some, ids, whole in blocks(words, SIZES, BITS):
            values = self.gram[ids]
            real = values > -9
            n = real.sum(1)
            top = -np.sort(-values, axis=1)[:, :3]
            held = np.minimum(n, 3)
            out[some, 0] = self.word[whole]
            out[some, 1] = np.where(n > 0, top[:, 0], 0)
            out[some, 2] = np.where(top > -9, top, 0).sum(1) / np.maximum(held, 1)
            out[some, 3] = np.where(real, values, 0).sum(1) / np.maximum(n, 1)
            begins = values[:, openings(values.shape[1])]
            out[some, 4] = np.where(begins > -9, begins, -9).max(1)
            out[some, 4] = np.where(out[some, 4] > -9, out[some, 4], 0)
        return out


class Embeddings:
    """Learned vectors of words: one of the word itself and those of its character n-grams with word ends, by hash."""

    def __init__(self, seed: int = 2):
        rng = np.random.default_rng(seed)
        g = lambda n: (rng.normal(size=(n, LEARNED)) * 0.02).astype(np.float32)
        self.word, self.gram = g(1 << BITS), g((1 << BITS) + 1)
        self.gram[-1] = 0

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), LEARNED), np.float32)
        for some, ids, whole in blocks(words, SIZES, BITS):
            n = np.maximum((ids < (1 << BITS)).sum(1), 1)
            for k in range(0, len(some), step := max(1, 50_000 // ids.shape[1])):
                part = slice(k, k + step)
                out[some[part]] = self.word[whole[part]] + self.gram[ids[part]].sum(1) / np.sqrt(n[part])[:, None].astype(np.float32)
        return out


class Training:
    """Features of the words of training texts, and the gradient of their vectors."""

    def __init__(self, embeddings: Embeddings, words: list[str]):
        self.of = embeddings
        self.whole, self.flat, self.ends = word_features(words)
        self.sizes = np.diff(self.ends)
        self.scale = (1 / np.sqrt(np.maximum(self.sizes, 1))).astype(np.float32)
        self.square = [np.full(len(x), 1e-4) for x in (embeddings.word, embeddings.gram)]

    def vectors_of(self, words: np.ndarray) -> np.ndarray:
        """Vectors of an array of word numbers; the number after the last word stands for no word."""
        some, at = np.unique(words, return_inverse=True)
        out = np.zeros((len(some), LEARNED), np.float32)
        known = some[some < len(self.whole)]
        for k in range(0, len(known), 4096):
            part = known[k : k + 4096]
            count = self.sizes[part]
            begin = np.cumsum(count) - count
            vectors = self.of.gram[self.flat[np.repeat(self.ends[part] - begin, count) + np.arange(count.sum())]]
            sums = np.add.reduceat(np.concatenate((vectors, np.zeros((1, LEARNED), np.float32))), begin, axis=0)
            out[k : k + len(part)] = self.of.word[self.whole[part]] + np.where(count > 0, self.scale[part], 0)[:, None] * sums
        return out[at].reshape(*words.shape, LEARNED)

    def step(self, words: np.ndarray, d_vectors: np.ndarray, rate: float) -> None:
        """One step of Adagrad, a pace for each row, on what ``words`` use."""
        some, at = np.unique(words, return_inverse=True)
        per = np.stack([np.bincount(at, d_vectors[:, c], len(some)) for c in range(LEARNED)], 1)
        keep = some < len(self.whole)
        some, per = some[keep], per[keep]
        count = self.sizes[some]
        before = np.cumsum(count) - count
        place = np.repeat(self.ends[some] - before, count) + np.arange(count.sum())
        for table, square, rows, grad in (
            (self.of.word, self.square[0], self.whole[some], per),
            (self.of.gram, self.square[1], self.flat[place], np.repeat(per * self.scale[some][:, None], count, 0)),
        ):
            used, spot = np.unique(rows, return_inverse=True)
            g = np.stack([np.bincount(spot, grad[:, c], len(used)) for c in range(LEARNED)], 1) + 1e-5 * table[used]
            square[used] += (g * g).mean(1)
            table[used] -= (rate * g / np.sqrt(square[used])[:, None]).astype(np.float32)


class Network:
    """Two gated recurrent layers, one per direction, attention pooling and a logistic unit."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.normal(size=s) * 0.35).astype(np.float32)
        h = HIDDEN
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("w", g(INPUTS, 3 * h)), ("u", g(h, 3 * h)), ("c", np.zeros(3 * h, np.float32)))}
        self.p |= {"va": g(2 * h), "wo": g(2 * h), "bo": np.full(1, -1.0, np.float32)}

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows ``x`` (time, windows, inputs) under ``mask`` (time, windows)."""
        p, h, (steps, n) = self.p, HIDDEN, mask.shape
        states, tape = np.empty((steps, n, 2 * h), np.float32), {}
        m = mask.astype(np.float32)[:, :, None]
        for d, half, order in (("f", slice(0, h), range(steps)), ("b", slice(h, 2 * h), range(steps - 1, -1, -1))):
            xw = x @ p["w" + d] + p["c" + d]
            s, u, kept = np.zeros((n, h), np.float32), p["u" + d], []
            for t in order:
                su = s @ u
                gate = 1 / (1 + np.exp(-(xw[t, :, : 2 * h] + su[:, : 2 * h])))
                z, r = gate[:, :h], gate[:, h:]
                new = np.tanh(xw[t, :, 2 * h :] + r * su[:, 2 * h :])
                after = s + m[t] * (1 - z) * (new - s)
                if keep:
                    kept.append((t, s, z, r, new, su[:, 2 * h :]))
                s = after
                states[t, :, half] = s
            tape[d] = kept
        e = np.where(mask, states @ p["va"], -1e9)
        e -= e.max(0)
        a = np.exp(e) * mask
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = np.einsum("tn,tnk->nk", a, states)
        logit = pooled @ p["wo"] + p["bo"][0]
        return (logit, (x, m, states, a, pooled, tape)) if keep else logit

    def gradient(self, kept, d_logit: np.ndarray) -> dict[str, np.ndarray]:
        x, m, states, a, pooled, tape = kept
        p, h = self.p, HIDDEN
        g = {"wo": pooled.T @ d_logit, "bo": np.array([d_logit.sum()])}
        d_pool = d_logit[:, None] * p["wo"]
        d_a = np.einsum("tnk,nk->tn", states, d_pool)
        d_e = a * (d_a - (a * d_a).sum(0))
        g["va"] = np.einsum("tn,tnk->k", d_e, states)
        d_states = a[:, :, None] * d_pool + d_e[:, :, None] * p["va"]
        g["x"] = np.zeros_like(x)
        for d, half in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, w = p["u" + d], p["w" + d]
            gw, gu, gc = np.zeros_like(w), np.zeros_like(u), np.zeros(3 * h, np.float32)
            carry = np.zeros((x.shape[1], h), np.float32)
            for t, s, z, r, new, sun in reversed(tape[d]):
                ds = d_states[t, :, half] + carry
                dn = ds * m[t] * (1 - z) * (1 - new * new)
                dz = ds * m[t] * (s - new) * z * (1 - z)
                dr = dn * sun * r * (1 - r)
                dx = np.concatenate((dz, dr, dn), 1)
                du = np.concatenate((dz, dr, dn * r), 1)
                carry = ds * (1 - m[t] * (1 - z)) + du @ u.T
                gw += x[t].T @ dx
                g["x"][t] += dx @ w.T
                gu += s.T @ du
                gc += dx.sum(0)
            g |= {"w" + d: gw, "u" + d: gu, "c" + d: gc}
        return g


def windows(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows of all texts: inputs (time, windows, inputs), mask, and each window's text."""
    sizes, step = np.diff(starts), WINDOW - OVERLAP
    count = np.maximum(1, -(-(sizes - OVERLAP) // step))
    owner = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    at = starts[owner] + number * step + np.arange(WINDOW)[:, None]
    mask = at < starts[owner + 1]
    padded = np.concatenate((rows, np.zeros((1, rows.shape[1]), rows.dtype)))
    return padded[np.where(mask, at, len(rows))], mask, owner


def window_logits(net: Network, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, mask, owner = windows(rows, starts)
    parts = [net.forward(x[:, k : k + BLOCK_WINDOWS], mask[:, k : k + BLOCK_WINDOWS]) for k in range(0, len(owner), BLOCK_WINDOWS)]
    return np.concatenate(parts), owner


class Model:
    def __init__(self, share: float):
        self.share, self.stated, self.learned, self.net = float(share), None, None, None

    def rows(self, words: list[str]) -> np.ndarray:
        """Inputs of words."""
        return np.concatenate((self.stated(words), self.learned(words)), 1)

    def scores(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The score of each text: its highest window's."""
        logits, owner = window_logits(self.net, rows, starts)
        best = np.full(len(starts) - 1, -np.inf)
        np.maximum.at(best, owner, logits)
        return sigmoid(best.astype(np.float64))


def fit(texts: list[str], labels: list[int], share: float | None = None, *, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.02, pace: float = 0.005, blank: float = 0.05, seed: int = 5) -> Model:
    """Back-propagation through both layers into the vectors, on the highest window of each text and on others of harmless ones.

    ``blank`` is the share of words that a step doesn't see. ``share`` is the share of toxic documents among all labelled rows, where the sample has another.
    """
    y = np.array(labels, float)
    model = Model((y.mean() if len(y) else 0.0) if share is None else share)
    if len(set(labels)) < 2:
        return model
    vocab: dict[str, int] = {}
    words = [words_of(t) for t in texts]
    ids = [[vocab.setdefault(w, len(vocab)) for w in t] for t in words]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
    place, mask, owner = windows(np.array([w for x in ids for w in x], np.int64)[:, None] + 1, starts)
    place = np.where(mask, place[:, :, 0] - 1, len(vocab))
    half = np.zeros(len(y), np.int64)
    for label in (0, 1):
        half[np.flatnonzero(y == label)[::2]] = 1
    # What is said of the words of a text comes from the other half of the texts.
    stated = np.zeros((2, len(vocab) + 1, STATED), np.float32)
    for own in (0, 1):
        others = np.flatnonzero(half != own)
        stated[own, :-1] = WordEvidence([words[i] for i in others], y[others])(list(vocab))
    side = half[owner]
    model.learned, net, rng = Embeddings(), Network(), np.random.default_rng(seed)
    training = Training(model.learned, list(vocab))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, logits = 0, np.where(mask, stated[side[None, :], place][:, :, 0], -9).max(0)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(epochs):
        best = np.full(len(y), -1)
        order = np.argsort(logits, kind="stable")
        best[owner[order]] = order
        draw = rng.permutation(len(owner))
        draw = draw[y[owner[draw]] == 0][: len(y) // 2]
        use = rng.permutation(np.concatenate((best, draw)))
        for at in range(0, len(use), batch):
            pick = use[at : at + batch]
            seen = np.where(rng.random((WINDOW, len(pick))) < blank, len(vocab), place[:, pick])
            x = np.concatenate((stated[side[pick][None, :], seen], training.vectors_of(seen)), 2)
            out, held = net.forward(x, mask[:, pick], keep=True)
            error = (sigmoid(out) - y[owner[pick]]) * weight[owner[pick]]
            grads = net.gradient(held, (error / len(pick)).astype(np.float32))
            training.step(seen.ravel(), grads.pop("x")[:, :, STATED:].reshape(-1, LEARNED), pace)
            step += 1
            for k, gradient in grads.items():
                gradient = gradient + 1e-4 * net.p[k]
                m, v = moment[k]
                m += 0.1 * (gradient - m)
                v += 0.01 * (gradient * gradient - v)
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        vectors, parts = training.vectors_of(np.arange(len(vocab) + 1)), []
        for k in range(0, len(owner), BLOCK_WINDOWS):
            seen = place[:, k : k + BLOCK_WINDOWS]
            parts.append(net.forward(np.concatenate((stated[side[None, k : k + BLOCK_WINDOWS], seen], vectors[seen]), 2), mask[:, k : k + BLOCK_WINDOWS]))
        logits = np.concatenate(parts)
        rate, pace = rate * 0.93, pace * 0.93
    odds = lambda q: np.log(q) - np.log(1 - q)
    net.p["bo"] = net.p["bo"] + np.float32(odds(np.clip(model.share, 1e-6, 1 - 1e-6)))
    model.stated, model.net = WordEvidence(words, y), net
    return model


def score(
    df: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", key_col: str = "doc_id", label_col: str = "toxic", train_chars: int = 2_500_000
) -> DataFrame:
    """Per document ``score``, ``n_windows`` and ``top_window`` (the number of its first highest window).

    ``train`` marks the rows of ``df`` whose labels may be learned; a document may have no label. ``key_col`` finds the
    labels, ``id_col`` is returned.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(key_col).isNotNull()).groupBy(F.col(key_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    texts = df.where(train).select(F.col(key_col).alias("__id"), F.col(text_col).alias("text"), F.xxhash64(key_col, text_col).alias("hash"), F.length(text_col).alias("size")).where("text IS NOT NULL")
    # Only keys travel, not the texts of all labelled rows; the sample's texts are then found by broadcast keys.
    sizes = materialize(texts.select("__id", "hash", "size").join(known, "__id"), "labelled")
    keys, held = sample_keys(sizes, train_chars)
    of_hash = {h: label for label, h in keys}
    chosen = df.sparkSession.createDataFrame([(h,) for h in of_hash] or [(0,)], "hash long")
    found = texts.join(F.broadcast(chosen), "hash").dropDuplicates(["hash"]).select("text", "hash").collect() if keys else []
    release(sizes)
    rows = sorted(((r["text"], of_hash[r["hash"]]) for r in found))
    model = fit([t for t, _ in rows], [label for _, label in rows], held.get(1, 0) / max(1, sum(held.values())))
    shared, name = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        model = shared.value
        memory = kept("toxicity" + name, lambda: WordRows(model.rows, INPUTS))
        for batch in sliced(batches):
            texts = [words_of(t) for t in batch.column(1).to_pylist()]
            out, count, top = np.full(len(texts), model.share), np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for a, b in grouped(texts, BLOCK_WINDOWS * WINDOW) if model.net is not None else ():
                logits, owner = window_logits(model.net, *memory(texts[a:b]))
                order = np.lexsort((-np.arange(len(owner)), logits))
                best = np.zeros(b - a, np.int64)
                best[owner[order]] = order
                out[a:b] = sigmoid(logits[best].astype(np.float64))
                count[a:b] = np.bincount(owner, minlength=b - a)
                top[a:b] = best - np.concatenate(([0], np.cumsum(count[a:b])[:-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array(count), pa.array(top)], names=[id_col, "score", "n_windows", "top_window"])
            trim()

    return map_rows(df, id_col, text_col, run, "score double, n_windows long, top_window long")
