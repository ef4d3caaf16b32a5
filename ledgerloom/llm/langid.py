"""Language identification with a linear-chain conditional random field over words.

Every word's emission scores come from hashed affixes and character n-grams and from a lexicon
weight of the word itself; transitions are learned with them. Training sequences are runs of words
from labelled documents, some spliced from two languages as code-switched text is. Posteriors come
from forward-backward over the whole text: chunks of words are multiplied out side by side, their
products chained per document, and the posteriors within each chunk follow exactly.
A document's language has the largest expected number of words.

The classifier is fitted on the driver on a sample of labelled rows of at most ``train_chars`` characters for each
language, chosen by a hash of id and text; a language that has any labelled row is in it at every size of the table.
Texts of any number of words are learned from. Prediction covers every word of every text.

Edge cases: null texts and texts without letters are ``und`` with score 0; equal expected counts go to the
first language in alphabetical order; without labelled rows every text is ``und``; empty tables give empty
results; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import kept, map_rows, sample_keys, sampled, sliced, trim
from ledgerloom.llm.features import WordRows, blocks, grouped, words_of

SIZES, BITS = (1, 2, 3, 4), 16
CHUNK = 64
#: Words whose posteriors are computed at a time.
BLOCK_WORDS = 80_000


class Crf:
    """Labels, feature weights (the last row is zero), lexicon weights and transition scores."""

    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels = labels
        self.grams = np.zeros(((1 << BITS) + 1, n), np.float32)
        self.lexicon = np.zeros((1 << BITS, n), np.float32)
        self.moves = np.zeros((n, n), np.float64)

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for some, ids, whole in blocks(words, SIZES, BITS):
            n = np.maximum((ids < (1 << BITS)).sum(1), 1)
            out[some] = self.grams[ids].sum(1) / np.sqrt(n)[:, None] + self.lexicon[whole]
        return out

    def posteriors(self, scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Label probabilities of each word; text ``i`` is ``scores[starts[i]:starts[i + 1]]``."""
        n, k = scores.shape
        if not n:
            return np.zeros((0, k))
        e = np.exp((scores - scores.max(1, keepdims=True)).astype(np.float64))
        e = np.concatenate((e, np.ones((1, k))))
        t = np.exp(self.moves - self.moves.max())
        sizes = np.diff(starts)
        pieces = -(-sizes // CHUNK)
        first = np.concatenate(([0], np.cumsum(pieces)))
        owner = np.repeat(np.arange(len(sizes)), pieces)
        begin = starts[owner] + (np.arange(first[-1]) - first[owner]) * CHUNK
        index = begin[:, None] + np.arange(CHUNK)
        real = index < starts[owner + 1][:, None]
        index = np.where(real, index, n)
        m = len(index)
        product = np.broadcast_to(np.eye(k), (m, k, k)).copy()
        ahead = np.empty((CHUNK, m, k, k))
        for j in range(CHUNK):
            after = (product.reshape(-1, k) @ t).reshape(m, k, k) * e[index[:, j]][:, None, :]
            after /= after.max((1, 2), keepdims=True)
            product = np.where(real[:, j, None, None], after, product)
            ahead[j] = product
        into = np.full((m, k), 1.0 / k)
        behind = np.ones((m, k))
        for step in range(1, int(pieces.max())):
            docs = np.flatnonzero(pieces > step)
            here = first[docs] + step
            v = np.einsum("ij,ijl->il", into[here - 1], product[here - 1])
            into[here] = v / v.max(1, keepdims=True)
            last = first[docs + 1] - 1 - step
            v = np.einsum("ijl,il->ij", product[last + 1], behind[last + 1])
            behind[last] = v / v.max(1, keepdims=True)
        out = np.empty((n + 1, k))
        back = behind
        for j in range(CHUNK - 1, -1, -1):
            p = np.einsum("ij,ijl->il", into, ahead[j]) * back
            p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
            out[index[:, j]] = p
            v = (e[index[:, j]] * back) @ t.T
            back = np.where(real[:, j, None], v / v.max(1, keepdims=True), back)
        return out[:n]


def fit(texts: list[str], langs: list[str], *, epochs: int = 8, length: int = 48, batch: int = 256, rate: float = 0.25, seed: int = 7) -> Crf:
    """Maximise the conditional likelihood with Adagrad. Every word of a text carries the text's language."""
    labels = sorted(set(langs))
    crf = Crf(labels)
    k = len(labels)
    if k < 2:
        return crf
    vocab: dict[str, int] = {}
    runs, tags, parts = [], [], []
    for text, lang in zip(texts, langs, strict=True):
        ids = [vocab.setdefault(w, len(vocab)) for w in words_of(text)]
        for at in range(0, len(ids), length):
            run = ids[at : at + length]
            parts.append(len(run) / length)  # a shorter run is repeated and weighs less
            runs.append((run * (length // len(run) + 1))[:length])
            tags.append(labels.index(lang))
    if not runs:
        return crf
    words = list(vocab)
    rows: list[np.ndarray] = [np.empty(0)] * len(words)
    whole = np.zeros(len(words), np.int64)
    for some, ids, lex in blocks(words, SIZES, BITS):
        whole[some] = lex
        for i, row in zip(some.tolist(), ids, strict=True):
            rows[i] = row[row < (1 << BITS)]
    counts = np.array([len(r) for r in rows])
    flat, ends = np.concatenate(rows), np.concatenate(([0], np.cumsum(counts)))
    scale = 1 / np.sqrt(np.maximum(counts, 1))
    run_ids, tag = np.array(runs), np.array(tags)
    rng = np.random.default_rng(seed)
    squares = [np.full(x.shape, 1e-2) for x in (crf.grams, crf.lexicon, crf.moves)]
    share = np.bincount(tag, parts, k)
    weight = np.sqrt(share.mean() / np.maximum(share, 1e-9))[tag] * np.array(parts)
    for _ in range(epochs):
        order = rng.permutation(len(run_ids))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x, y = run_ids[pick].copy(), np.repeat(tag[pick][:, None], length, 1)
            other = rng.permutation(len(pick))
            for i in np.flatnonzero(rng.random(len(pick)) < 0.3):
                cut = int(rng.integers(4, length - 4))
                x[i, cut:], y[i, cut:] = run_ids[pick[other[i]], cut:], tag[pick[other[i]]]
            b = len(pick)
            used, at_used = np.unique(x, return_inverse=True)
            at_used = at_used.reshape(x.shape)
            pos = np.concatenate([np.arange(ends[u], ends[u + 1]) for u in used])
            feats, word = flat[pos], np.repeat(np.arange(len(used)), counts[used])
            sums = np.stack([np.bincount(word, crf.grams[feats, c], len(used)) for c in range(k)], 1)
            em = (sums * scale[used][:, None] + crf.lexicon[whole[used]])[at_used]
            e = np.exp(em - em.max(2, keepdims=True))
            t = np.exp(crf.moves - crf.moves.max())
            a = np.empty((length, b, k))
            v = np.full((b, k), 1.0 / k)
            for j in range(length):
                v = (v @ t) * e[:, j]
                v /= v.sum(1, keepdims=True)
                a[j] = v
            beta = np.ones((b, k))
            w = weight[pick]
            g_em, g_moves = np.empty((b, length, k)), np.zeros((k, k))
            for j in range(length - 1, -1, -1):
                p = a[j] * beta
                p /= p.sum(1, keepdims=True)
                g_em[:, j] = -p
                eb = e[:, j] * beta
                before = a[j - 1] if j else np.full((b, k), 1.0 / k)
                pair = before[:, :, None] * t * eb[:, None, :]
                pair /= pair.sum((1, 2), keepdims=True)
                g_moves -= np.einsum("b,bij->ij", w, pair)
                beta = eb @ t.T
                beta /= beta.sum(1, keepdims=True)
            np.put_along_axis(g_em, y[:, :, None], np.take_along_axis(g_em, y[:, :, None], 2) + 1, 2)
            g_em *= w[:, None, None]
            np.add.at(g_moves, (y[:, :-1].ravel(), y[:, 1:].ravel()), np.repeat(w, length - 1))
            g_moves += np.bincount(y[:, 0], w, k)[None, :] / k
            per = np.stack([np.bincount(at_used.ravel(), g_em[:, :, c].ravel(), len(used)) for c in range(k)], 1)
            spread = (per * scale[used][:, None])[word]
            g_grams = np.stack([np.bincount(feats, spread[:, c], len(crf.grams)) for c in range(k)], 1)
            g_lex = np.stack([np.bincount(whole[used], per[:, c], len(crf.lexicon)) for c in range(k)], 1)
            for param, grad, square, decay in ((crf.grams, g_grams, squares[0], 1e-3), (crf.lexicon, g_lex, squares[1], 1e-3), (crf.moves, g_moves, squares[2], 1.0)):
                grad = grad - decay * param
                square += grad * grad
                param += rate * grad / np.sqrt(square)
    crf.grams[-1] = 0
    return crf


def identify(
    df: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_chars: int = 400_000, word_labels: bool = False
) -> DataFrame:
    """Per document ``lang_pred`` and ``score`` (mean probability of that language over its words).

    ``train`` marks the rows whose languages may be learned. With ``word_labels`` there is also
    ``words array<string>``, the most probable language of each word in order.
    """
    texts = df.where(train).select(F.col(text_col).alias("text"), F.col(lang_col).alias("label"), F.xxhash64(id_col, text_col).alias("hash"), F.length(text_col).alias("size"))
    texts = texts.where("size > 0 AND label IS NOT NULL")
    keys, _ = sample_keys(texts.drop("text"), train_chars)
    rows = sorted(sampled(texts, keys, "text", "label"), key=lambda r: (r["text"], r["label"]))
    model = fit([r["text"] for r in rows], [r["label"] for r in rows])
    shared, name = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    schema = "lang_pred string, score double" + (", words array<string>" if word_labels else "")

    def run(batches):
        crf = shared.value
        names = np.array(crf.labels, object)
        memory = kept("langid" + name, lambda: WordRows(crf.emissions, len(names)) if len(names) else None)
        for batch in sliced(batches):
            texts = [words_of(t) for t in batch.column(1).to_pylist()]
            pred, score, words = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            for a, b in grouped(texts, BLOCK_WORDS) if len(names) else ():
                emitted, starts = memory(texts[a:b])
                p = crf.posteriors(emitted, starts)
                total = np.concatenate((np.zeros((1, len(names))), np.cumsum(p, axis=0)))
                expected = total[starts[1:]] - total[starts[:-1]]
                sizes = np.diff(starts)
                best = expected.round(9).argmax(1)
                for i in np.flatnonzero(sizes).tolist():
                    pred[a + i] = names[best[i]]
                    score[a + i] = float(min(1.0, max(0.0, expected[i, best[i]] / sizes[i])))
                    if word_labels:
                        words[a + i] = names[p[starts[i] : starts[i + 1]].argmax(1)].tolist()
            columns = [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            labels = [id_col, "lang_pred", "score"]
            if word_labels:
                columns, labels = [*columns, pa.array(words, pa.list_(pa.string()))], [*labels, "words"]
            yield pa.RecordBatch.from_arrays(columns, names=labels)
            trim()

    return map_rows(df, id_col, text_col, run, schema)
