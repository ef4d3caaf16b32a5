"""Personal data by patterns and a skip-chain conditional random field.

Patterns find email addresses, IP addresses, card and phone numbers that are written in full. The field adds what patterns can't see:
tokens that look or stand like such data, or that repeat part of data found elsewhere in the document. Its nodes are the tokens that could be personal
data at all (the rest are outside by definition). Neighbouring nodes share transition potentials; distant nodes with the same digits or the same
address are tied to one variable of their own, which each of them should agree with, so a token repeated any number of times costs one edge each.
Loopy message passing runs a fixed number of rounds over all edges at once. What the patterns found is held fast while messages pass.

There are no labels: the field learns from what the patterns say of a bounded sample of documents. In training, parts of a token's features
are hidden, so that neighbours and repetitions have to tell; copies of documents with broken check digits and numbers teach what isn't valid, copies without
a phone's prefix that a number goes on being one, copies that repeat its last part that repetition is what tells it from another number.

Edge cases: a null text is an empty one and has no spans; documents with the same id or text each get a row; null ids are kept; texts are read whole at any length;
an empty table, or one without any pattern, leaves the field without weights, so that it adds nothing. Of spans that start together the order of
kinds decides. Other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_rows, sample_keys, sampled, sliced

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0 is outside
#: What ends a token, besides white space.
STOPS = ",;|<>\"'[]{}="
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BEGIN = re.compile(rf"[0-9@][^\s{re.escape(STOPS)}]*")
EDGES = re.compile(r"[A-Za-z0-9+(]")
TAIL = re.compile(r"[A-Za-z0-9)]")
LETTER, LETTERS = re.compile(r"[^\W\d_]"), re.compile(r"[^\W\d_]+")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
ADDRESS = re.compile(r"[A-Za-z0-9][^@]*@[^@]*[A-Za-z0-9]")
#: Rounds of message passing.
ROUNDS = 8
#: A node becomes a span if its label has at least this belief.
BELIEF = 0.6
NEVER = -1e9
#: Digits with which a number that stands in several tokens is whole.
WHOLE = (0, 0, 14, 10)
SPANS = "array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"
#: Nodes of one block of documents, which bounds memory beside the longest document.
BLOCK_NODES = 20_000


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def emails(text: str):
    """Every local part ends at an ``@``, so addresses are looked for from there; each character is read once."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        done = at = found.end() if found else at + 1
        if found:
            yield start, found.end()


def addresses(text: str):
    """Groups of four numbers of each dotted sequence, from its start."""
    for m in DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of what the patterns find, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    out += [(s, 1, e) for s, e in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


@lru_cache(20_000)
def shape(core: str) -> str:
    runs = re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 9)}", core[:80])
    return re.sub(r"[^\W\d_]+", "a", runs)[:24]


def tokens(text: str) -> list[tuple[int, int]]:
    """The cores of tokens with a digit or an ``@``: what is left between letters, digits, ``+`` and brackets."""
    out, done = [], 0
    for m in BEGIN.finditer(text):
        start = m.start()
        while start > done and not (text[start - 1].isspace() or text[start - 1] in STOPS):
            start -= 1
        done = end = m.end()
        while start < end and not EDGES.match(text, start):
            start += 1
        while end > start and not TAIL.match(text, end - 1):
            end -= 1
        if start < end:
            out.append((start, end))
    return out


@dataclass
class Nodes:
    """The nodes of some documents: where they stand, what they may be, what ties them."""

    doc: array
    start: array
    end: array
    label: array  # what the patterns say
    follows: array  # 1 if the node before is its neighbour
    digits: array
    allowed: list
    key: list
    names: list  # feature names


def empty_nodes() -> Nodes:
    return Nodes(array("q"), array("q"), array("q"), array("b"), array("b"), array("q"), [], [], [])


def close(text: str, a: int, b: int) -> bool:
    return b - a <= 4 and all(c.isspace() or c in STOPS or c in ".:-" for c in text[a:b])


def word_near(text: str, at: int, before: bool) -> str:
    near = text[max(0, at - 24) : at] if before else text[at : at + 24]
    words = re.findall(r"[^\W\d_]+", near)
    return (words[-1 if before else 0] if words else "").lower()[:12]


def add_document(nodes: Nodes, number: int, text: str, spans: list[tuple[int, int, int]]) -> None:
    """The nodes of one document: tokens that could be personal data, with runs of close ones read together."""
    cores = [(s, e, text[s:e]) for s, e in tokens(text)]
    runs: list[list[tuple]] = []
    for s, e, core in cores:
        address = bool(ADDRESS.fullmatch(core))
        if not address and LETTER.search(core):
            continue
        digits = "".join(c for c in core if c in "0123456789")
        if not (address or digits):
            continue
        item = (s, e, core, digits, address)
        if runs and not address and not runs[-1][-1][4] and close(text, runs[-1][-1][1], s):
            runs[-1].append(item)
        else:
            runs.append([item])
    of_kind = [[x for x in spans if x[1] == k] for k in range(len(KINDS))]  # those of one kind don't overlap
    at = [0] * len(KINDS)
    for run in runs:
        total = sum(len(x[3]) for x in run)
        whole = "".join(x[3] for x in run) if total <= 24 else ""
        valid = 14 <= total <= 19 and luhn(whole)
        shapes = [shape(x[2]) for x in run]
        for i, (s, e, core, digits, address) in enumerate(run):
            quad = not address and bool(QUAD.fullmatch(core))
            fits = quad and all(int(p[-4:]) <= 255 for p in core.split("."))
            own = len(digits)
            may = [True, address, quad, not address and total >= 12 and own >= 3, not address and not quad and total >= 7]
            if not any(may[1:]):
                continue
            label = 0
            for k, own_spans in reversed(list(enumerate(of_kind))):
                while at[k] < len(own_spans) and own_spans[at[k]][2] <= s:
                    at[k] += 1
                if at[k] < len(own_spans) and own_spans[at[k]][0] < e:
                    label = k + 1
            good = 14 <= own <= 19 and luhn(digits)
            names = [
                "bias", f"s:{shapes[i]}", f"p:{shape(core[:4])}", f"t:{shape(core[-4:])}", f"n:{min(own, 20)}", f"r:{min(total, 24)}", f"k:{min(len(run), 6)}", f"@{address}{core.count('.') if address else 0}",
                f"c:{good}{14 <= own <= 19}", f"w:{valid}{14 <= total <= 19}", f"i:{quad}{fits}", f"b:{shapes[i - 1] if i else ''}", f"a:{shapes[i + 1] if i + 1 < len(run) else ''}",
                f"<{word_near(text, s, True)}", f">{word_near(text, e, False)}",
            ]
            nodes.follows.append(int(i > 0 and len(nodes.doc) > 0 and nodes.doc[-1] == number and nodes.end[-1] == run[i - 1][1]))
            nodes.doc.append(number)
            nodes.start.append(s)
            nodes.end.append(e)
            nodes.label.append(label)
            nodes.digits.append(own)
            nodes.allowed.append(may)
            nodes.key.append((number, core.lower()) if address or quad else (number, digits[-7:]) if own >= 5 else None)
            nodes.names.append(names)


class Graph:
    """Edges of some nodes as arrays: neighbours, and ties of equal keys to a variable of their own."""

    def __init__(self, nodes: Nodes):
        self.n = len(nodes.doc)
        follows = np.frombuffer(nodes.follows, np.int8).astype(bool) if self.n else np.zeros(0, bool)
        self.right = np.flatnonzero(follows)
        self.left = self.right - 1
        many = Counter(k for k in nodes.key if k is not None)
        numbers: dict = {}
        tied = [(i, numbers.setdefault(k, len(numbers))) for i, k in enumerate(nodes.key) if k is not None and many[k] > 1]
        self.tied = np.array([i for i, _ in tied], np.int64)
        self.hub = np.array([h for _, h in tied], np.int64)
        self.hubs = len(numbers)
        self.closed = np.where(np.array(nodes.allowed, bool).reshape(self.n, LABELS), 0.0, NEVER)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def agreeing(x: np.ndarray, tie: float) -> np.ndarray:
    """Messages over an edge that rewards equal labels by ``tie``."""
    x = x - x.max(1, keepdims=True)
    out = np.log(np.exp(x) * np.expm1(tie) + np.exp(x).sum(1, keepdims=True))
    return out - out.max(1, keepdims=True)


def beliefs(graph: Graph, scores: np.ndarray, steps: np.ndarray, tie: float, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Beliefs of nodes, of pairs of neighbours and of ties, after ``rounds`` of messages over all edges at once."""
    left, right, tied, hub = graph.left, graph.right, graph.tied, graph.hub
    forth, back, up, down = np.zeros((len(left), LABELS)), np.zeros((len(left), LABELS)), np.zeros((len(tied), LABELS)), np.zeros((len(tied), LABELS))

    def gathered() -> np.ndarray:
        total = scores + graph.closed
        total[right] += forth
        total[left] += back
        total[tied] += down
        return total

    for _ in range(rounds):
        total = gathered()
        if len(left):
            new = log_sum((total[left] - back)[:, :, None] + steps[None], 1), log_sum((total[right] - forth)[:, None, :] + steps[None], 2)
            forth, back = (m - m.max(1, keepdims=True) for m in new)
        if len(tied):
            up = agreeing(total[tied] - down, tie)
            held = np.zeros((graph.hubs, LABELS))
            np.add.at(held, hub, up)
            down = agreeing(held[hub] - up, tie)
    total = gathered()
    out = {"node": np.exp(total - log_sum(total, 1)[:, None])}
    pair = (total[left] - back)[:, :, None] + (total[right] - forth)[:, None, :] + steps[None]
    out["pair"] = np.exp(pair - log_sum(pair.reshape(len(left), -1), 1)[:, None, None]) if len(left) else pair
    if len(tied):
        held = np.zeros((graph.hubs, LABELS))
        np.add.at(held, hub, up)
        both = (total[tied] - down)[:, :, None] + (held[hub] - up)[:, None, :] + tie * np.eye(LABELS)[None]
        both = np.exp(both - log_sum(both.reshape(len(tied), -1), 1)[:, None, None])
        out["agree"] = np.trace(both, axis1=1, axis2=2)
    return out


@dataclass
class Model:
    vocabulary: dict
    weights: np.ndarray
    steps: np.ndarray
    tie: float

    def numbers(self, nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and feature numbers of all known features."""
        rows, ids = array("q"), array("q")
        for i, names in enumerate(nodes.names):
            for name in names:
                f = self.vocabulary.get(name)
                if f is not None:
                    rows.append(i)
                    ids.append(f)
        return np.array(rows, np.int64), np.array(ids, np.int64)


def summed(n: int, rows: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of the weights of each row's features; rows ascend."""
    return by_group(n, rows, weights[ids])


def by_group(n: int, groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` for each of ``n`` ascending groups."""
    out = np.zeros((n, values.shape[1]))
    if len(groups):
        starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
        out[groups[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def broken(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, bool]:
    """A copy with numbers that no longer hold: a card's digit raised, a part of an address beyond 255."""
    changed = False
    for start, kind, end in reversed(spans):
        if kind == 2:
            at = next(i for i in range(end - 1 - int(rng.integers(8)), end) if text[i].isdigit())
            text, changed = f"{text[:at]}{(int(text[at]) + 1 + int(rng.integers(8))) % 10}{text[at + 1 :]}", True
        elif kind == 1:
            head, _, _ = text[start:end].rpartition(".")
            text, changed = f"{text[:start]}{head}.{256 + int(rng.integers(700))}{text[end:]}", True
    return text, changed


def bare(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """A copy with the prefixes of phone numbers gone, and the spans that numbers without one have there."""
    out, done, moved = [], 0, 0
    kept = []
    for start, kind, end in spans:
        if kind == 3 and start >= done and (m := re.match(r"\+[0-9]{1,3}[\x20.-]+(?=[(0-9])", text[start:end])):
            out.append(text[done:start])
            done = start + m.end()
            moved += m.end()
            kept.append((start + m.end() - moved, kind, end - moved))
        elif start >= done:
            kept.append((start - moved, kind, end - moved))
    return "".join(out) + text[done:], kept


def repeated(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A copy whose phone numbers stand at the end again by their last part, each beside a number of that form that repeats nothing."""
    words = LETTERS.findall(text[:2000]) or ["x"]
    out, kept = [text], list(spans)
    at = len(text)
    for start, kind, end in spans:
        last = re.search(r"[0-9][0-9.-]{5,}$", text[start:end]) if kind == 3 else None
        if last:
            other = "".join(str(rng.integers(10)) if c.isdigit() else c for c in last.group())
            for part, label in ((last.group(), kind), (other, None)):
                before = f" {words[rng.integers(len(words))]} {words[rng.integers(len(words))]} "
                if label is not None:
                    kept.append((at + len(before), label, at + len(before) + len(part)))
                out.append(before + part)
                at += len(before) + len(part)
    return "".join(out), kept


def fit(texts: list[str], *, epochs: int = 250, rate: float = 0.1, decay: float = 1e-4, least: int = 3, hidden: float = 0.5, seed: int = 5) -> Model | None:
    """Weights from what the patterns say of ``texts``; none if they say nothing."""
    rng, nodes, number = np.random.default_rng(seed), empty_nodes(), 0
    for text in texts:
        spans = base_spans(text)
        copies = [(text, spans)]
        if spans:
            changed, any_changed = broken(text, spans, rng)
            if any_changed:
                copies.append((changed, base_spans(changed)))
            if any(k == 3 for _, k, _ in spans):
                copies += [bare(text, spans), repeated(text, spans, rng)]
        for t, s in copies:
            add_document(nodes, number, t, s)
            number += 1
    labels = np.array(nodes.label, np.int64)
    if not labels.any():
        return None
    counts = Counter(name for names in nodes.names for name in names)
    model = Model({name: i for i, name in enumerate(sorted(k for k, n in counts.items() if n >= least))}, np.zeros(0), np.zeros((LABELS, LABELS)), 0.5)
    model.weights = np.zeros((len(model.vocabulary), LABELS))
    rows, ids = model.numbers(nodes)
    graph, n = Graph(nodes), len(labels)
    truth, free = np.eye(LABELS)[labels], graph.closed
    held = np.zeros((graph.hubs, LABELS))
    np.add.at(held, (graph.hub, labels[graph.tied]), 1)
    # what repeats found data without being found itself has no label to learn from
    known = np.ones(n, bool)
    known[graph.tied] = (labels[graph.tied] > 0) | (held[graph.hub, 1:].sum(1) == 0)
    joint, tied = (known[graph.left] & known[graph.right])[:, None, None], known[graph.tied]
    pairs = np.zeros((LABELS, LABELS))
    np.add.at(pairs, (labels[graph.left], labels[graph.right]), joint[:, 0, 0])
    # a key's own label is that of most of its known nodes
    held = np.zeros((graph.hubs, LABELS))
    np.add.at(held, (graph.hub, labels[graph.tied]), tied)
    agree = float((held.argmax(1)[graph.hub] == labels[graph.tied])[tied].sum()) if len(graph.tied) else 0.0
    parameters = [model.weights, model.steps, np.array([model.tie])]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    by_id = np.argsort(ids, kind="stable")
    for epoch in range(1, epochs + 1):
        shown = (rng.random(len(ids)) > np.where(rng.random(n) < hidden, 0.7, 0.1)[rows])[:, None]
        # as in use, some of what the patterns found is held fast while the rest is told
        fast = (labels > 0) & (rng.random(n) < hidden)
        graph.closed = np.where(fast[:, None], np.where(truth > 0, 0.0, NEVER), free)
        b = beliefs(graph, by_group(n, rows, model.weights[ids] * shown), model.steps, float(parameters[2][0]))
        ahead = ((known[:, None] * (truth - b["node"]))[rows] * shown)[by_id]
        steps = [by_group(len(model.weights), ids[by_id], ahead) / n, (pairs - (joint * b["pair"]).sum(0)) / n, np.array([(agree - b["agree"][tied].sum()) / n if len(graph.tied) else 0.0])]
        for k, (p, g) in enumerate(zip(parameters, steps, strict=True)):
            g = g - decay * p * (k < 2)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p += rate * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.99**epoch)) + 1e-8)
        parameters[2][0] = max(parameters[2][0], 0.0)
    model.tie = float(parameters[2][0])
    model.weights *= 1 - 0.7 * hidden - 0.1 * (1 - hidden)  # in use no feature is hidden, so each counts for the share shown in training
    return model


def decode(model: Model, nodes: Nodes, belief: float = BELIEF) -> dict[int, list[tuple[int, int, int]]]:
    """Spans that the field adds to each document, ``(start, kind number, end)``."""
    n = len(nodes.doc)
    if not n:
        return {}
    labels, graph = np.array(nodes.label, np.int64), Graph(nodes)
    scores = summed(n, *model.numbers(nodes), model.weights)
    fast = labels > 0
    graph.closed[fast] = NEVER
    graph.closed[fast, labels[fast]] = 0.0
    node = beliefs(graph, scores, model.steps, model.tie)["node"]
    best = np.where((node.max(1) >= belief) & ~fast, node.argmax(1), 0)
    out: dict[int, list[tuple[int, int, int]]] = {}
    i = 0
    while i < n:
        k, j, digits = int(best[i]), i + 1, nodes.digits[i]
        # parts of a card or phone number belong together until it is whole
        while k >= 3 and digits < WHOLE[k - 1] and j < n and best[j] == k and nodes.follows[j]:
            digits += nodes.digits[j]
            j += 1
        if k:
            out.setdefault(nodes.doc[i], []).append((nodes.start[i], k - 1, nodes.end[j - 1]))
        i = j
    return out


def whole_number(text: str, span: tuple[int, int, int]) -> bool:
    """Whether an added card or phone number has as many digits as such a number."""
    start, kind, end = span
    digits = sum(c in "0123456789" for c in text[start:end])
    return kind < 2 or (12 <= digits <= 19 if kind == 2 else 7 <= digits <= 15)


def scanner(sent):
    def run(batches):
        model = sent.value
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans = [base_spans(t) for t in texts]
            added: dict[int, list] = {}
            nodes = empty_nodes()
            for number, text in enumerate(texts if model else []):
                add_document(nodes, number, text, spans[number])
                if len(nodes.doc) > BLOCK_NODES:
                    added |= decode(model, nodes)
                    nodes = empty_nodes()
            if model:
                added |= decode(model, nodes)
            found = []
            for number, text in enumerate(texts):
                more = [(s, k, e, False) for s, k, e in added.get(number, ()) if whole_number(text, (s, k, e))]
                found.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in sorted([(*x, True) for x in spans[number]] + more)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[batch.schema.names[0], "spans"])

    return run


def train(docs: DataFrame, *, text_col: str = "text", train_chars: int = 300_000) -> Model | None:
    """A field fitted on a bounded sample: at most ``train_chars`` characters for each combination of marks that a text holds."""
    text = F.col(text_col)
    marks = [F.contains(text, F.lit("@")), text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), text.rlike(r"[0-9][0-9 -]{12}[0-9]"), text.rlike(r"\+[0-9]")]
    rows = docs.select(F.concat(*(m.cast("int").cast("string") for m in marks)).alias("label"), F.xxhash64(text).alias("hash"), F.length(text).alias("size"), text.alias("__text")).where(text.rlike("[0-9@]"))
    keys, _ = sample_keys(rows.select("label", "hash", "size"), train_chars)
    return fit(sorted(r[0] for r in sampled(rows, keys, "__text")))


def scan_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_chars: int = 300_000) -> DataFrame:
    """``(id, spans)`` for every row: kind, start and end (code points, end exclusive) and whether a pattern found it, in order."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, text_col=text_col, train_chars=train_chars))
    return map_rows(docs, id_col, text_col, scanner(sent), f"spans {SPANS}")
