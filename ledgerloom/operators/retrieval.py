"""Chunks of documents: cutting, search by vectors and words, reranking, sections."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.containment import contained
from ledgerloom.operators.ordered import running
from ledgerloom.sources.store import written

# Sizes of chunks and of result lists, and what the parts of a rank weigh.
CHUNK, OVERLAP, LEAST = 500, 100, 20
K, FETCH, CUT, MARGIN, LAMBDA = 8, 30, 0.18, 0.12, 0.6
WEIGHTS = {"semantic": 0.45, "lexical": 0.15, "rare": 0.20, "title": 0.10, "support": 0.05, "mmr": 0.05}
TITLED = 0.20
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
# What ask rather than name something, and endings that a word is searched without.
STOP_WORDS = (
    "뭐야", "뭔가", "알려줘", "설명해줘", "보여줘", "찾아줘", "문서", "내용", "이거", "그거", "대한", "관련", "있어", "없는", "있는", "있나", "받고", "해야", "어떻게",
)
WORD_PARTICLES = ("으로부터", "에서부터", "에게서", "까지", "부터", "으로", "에게", "한테", "에서", "은", "는", "이", "가", "을", "를", "와", "과", "의", "에", "로", "도", "만")
WORD_ENDINGS = ("하려면", "하려고", "해야", "하면", "하는", "하고", "할", "있는", "있나")
#: Queries of one pass over all chunks, chunks scored at a time, and results a task holds.
QUERIES, SCORED, HELD = 4096, 1024, 2_000_000
CONSTRAINTS = "제한|제외|불가|금지"


def pieces(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Text cut at the first separator it holds, long pieces cut on by the next ones."""
    if len(text) <= size:
        return [text]
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep = separators[at]
    parts = [text[i : i + size] for i in range(0, len(text), size)] if sep == "" else [p + sep for p in text.split(sep)[:-1]] + [text.split(sep)[-1]]
    return [q for p in parts if p for q in (pieces(p, size, separators[at + 1 :]) if len(p) > size and sep else [p])]


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Chunks of at most ``size`` letters that share up to ``overlap`` with the one before."""
    out, held, total = [], [], 0
    for piece in pieces(text or "", size):
        if held and total + len(piece) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    out.append("".join(held).strip())
    return [c for c in out if len(c) >= least]


def split_chunks(df: DataFrame, text: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """A row for each chunk, with its number."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks(t or "", size, overlap))

    return df.select(*(c for c in df.columns if c != text), F.posexplode(cut(F.col(text))).alias("chunk", "text"))


def row_chunks(df: DataFrame, label: Column, columns: list[str], least: int = LEAST) -> DataFrame:
    """Each row as ``[문서: label] / column: value / …``, blank cells left out."""
    fields = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", F.concat(F.lit(c + ": "), F.trim(F.col(c).cast("string")))) for c in columns]
    text = F.concat_ws(" / ", F.concat(F.lit("[문서: "), label, F.lit("]")), *fields)
    return df.withColumn("chunk_text", text).where(F.length("chunk_text") >= least)


def overview(df: DataFrame, by: Column, amount: Column | None = None) -> DataFrame:
    """Rows and amounts of each source, for a chunk that introduces it."""
    return df.groupBy(by.alias("source")).agg(F.count("*").alias("n_rows"), (F.sum(amount) if amount is not None else F.lit(None).cast("double")).alias("total"))


def overview_text(rows: DataFrame, label: str, source: str, purpose: str = "", amount: Column | None = None, shown: int = 8) -> DataFrame:
    """One chunk that introduces a document: label, file, rows, total amount, its first columns and what it is for."""
    columns = ", ".join(c for c in rows.columns if not c.startswith("_"))
    first = ", ".join(columns.split(", ")[:shown])
    total = F.sum(amount) if amount is not None else F.lit(None).cast("double")
    parts = [F.lit(f"[문서 개요] {label}"), F.lit(f"파일: {source}"), F.concat(F.lit("행 수: "), F.col("n").cast("string")), F.concat(F.lit("금액 합계: "), F.format_number("total", 0), F.lit("원")), F.lit(f"열: {first}"), F.lit(f"용도: {purpose}") if purpose else F.lit(None).cast("string")]
    return rows.agg(F.count("*").alias("n"), total.alias("total")).select(F.concat_ws("\n", *parts).alias("chunk_text"))


def terms(c: Column, among: list[str] | None = None) -> Column:
    """Distinct words of two letters or digits or more, lower-cased, stop words dropped, without a particle and a verb's ending where two letters are left.

    With ``among`` only words that begin as one of those terms do are looked at: all that can become one of them, and few of a text's others.
    """
    words = F.transform(F.array_distinct(F.regexp_extract_all(c, F.lit("[가-힣A-Za-z0-9]{2,}"), F.lit(0))), F.lower)
    if among is not None:
        words = F.filter(words, lambda w: reduce(lambda a, b: a | b, (F.startswith(w, F.lit(t)) for t in among), F.lit(False)))
    stem = lambda w: F.regexp_replace(F.regexp_replace(w, f"(?:{'|'.join(WORD_PARTICLES)})$", ""), f"(?:{'|'.join(WORD_ENDINGS)})$", "")
    # words of Latin letters and digits have no such endings
    stems = F.transform(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), lambda w: F.when(w.rlike("[가-힣]$") & (F.length(stem(w)) >= 2), stem(w)).otherwise(w))
    # texts without Hangul have no stop words, particles or endings
    return F.when(c.rlike("[가-힣]"), F.array_distinct(stems)).otherwise(F.array_distinct(words))


def overlap(query: Column, text: Column) -> Column:
    """The share of the query's terms among the text's."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(query, text)).cast("double"), F.size(query)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def trimmed(found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best of ``(query, label, chunk_id, score)`` for each query and label; ties to the smaller chunk."""
    query, label, chunk, score = found
    order = np.lexsort((chunk, -score, label, query))
    query, label, chunk, score = (x[order] for x in found)
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (label[1:] != label[:-1])
    start = np.flatnonzero(new)
    keep = np.arange(len(query)) - start[np.cumsum(new) - 1] < k
    return query[keep], label[keep], chunk[keep], score[keep]


def search(queries: DataFrame, chunks: DataFrame, k: int = FETCH) -> DataFrame:
    """``(query, label, chunk_id, score, rank)``: the ``k`` best of all chunks of each label, for each query of a set of any size.

    ``queries(query, vector)`` go in blocks against all ``chunks(chunk_id, label, vector)``; ids and labels are longs. Each task
    keeps the best it has met, so a pass returns at most ``k`` rows of each query, label and task. Scores are cosines
    rounded to six digits before they are compared. Vectors that are null, zero or not finite, and pairs of other lengths, have no score.
    """
    spark = queries.sparkSession
    fields = "query long, label long, chunk_id long, score double"

    def units(ids: list, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        rows: dict[int, list] = {}
        for i, v in zip(ids, vectors, strict=True):
            if v and None not in v:
                x = np.asarray(v, float)
                if np.isfinite(x).all() and x.any():
                    rows.setdefault(len(x), []).append((i, x / np.linalg.norm(x)))
        return {n: (np.array([i for i, _ in r], np.int64), np.stack([x for _, x in r])) for n, r in rows.items()}

    def one_pass(shared):
        def run(batches):
            held = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, float))
            for whole in batches:
                for at in range(0, whole.num_rows, SCORED):
                    batch = whole.slice(at, SCORED)
                    chunk, label = (batch.column(i).to_numpy() for i in (0, 1))
                    parts = [held]
                    for n, (place, x) in units(range(batch.num_rows), batch.column(2).to_pylist()).items():
                        if n not in shared.value:
                            continue
                        names, y = shared.value[n]
                        scores = np.round(y @ x.T, 6)
                        for one in np.unique(label[place]).tolist():
                            of = np.flatnonzero(label[place] == one)
                            s = scores[:, of]
                            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -2.0)
                            i, j = np.nonzero(s >= least[:, None])
                            parts.append((names[i], np.full(len(i), one), chunk[place[of[j]]], s[i, j]))
                    held = trimmed(tuple(np.concatenate(c) for c in zip(*parts, strict=True)), k)
                    if len(held[0]) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["query", "label", "chunk_id", "score"])
                        held = tuple(c[:0] for c in held)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["query", "label", "chunk_id", "score"])

        return run

    order = Window.partitionBy("query", "label").orderBy(F.desc("score"), "chunk_id")
    passes = max(1, -(-queries.count() // QUERIES))
    out = None
    for n in range(passes):
        rows = queries.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == n).select("query", "vector").collect()
        shared = spark.sparkContext.broadcast(units([r[0] for r in rows], [r[1] for r in rows]))
        found = chunks.select("chunk_id", "label", "vector").mapInArrow(one_pass(shared), fields)
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if passes > 1:  # a pass is written before the next one's queries are sent
            best = written(best, "hits")
            shared.unpersist()
        out = best if out is None else out.unionByName(best)
    return out


def overlaps(queries: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``(item_id, doc_id, overlap)`` of at least ``least`` between all ``queries(item_id, terms)`` and all ``texts(doc_id, terms)``."""
    found = contained(queries, texts, least, query="item_id", text_id="doc_id")
    return found.select(F.col("query").alias("item_id"), F.col("chunk_id").alias("doc_id"), "overlap")


def relative_cut(scored: DataFrame, query: str, margin: float = CUT) -> DataFrame:
    best = scored.groupBy(query).agg(F.max("score").alias("__best"))
    return scored.join(best, query).where(F.col("score") >= F.col("__best") - margin).drop("__best")


def best_per(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The best chunk of each key: one aggregate, ties to the smaller chunk."""
    best = scored.groupBy(*keys).agg(F.min_by(F.struct("chunk_id", "score"), F.struct((-F.col("score")).alias("s"), F.col("chunk_id"))).alias("b"))
    return best.select(*keys, "b.chunk_id", "b.score")


def merge_queries(scored: DataFrame, query: str) -> DataFrame:
    return scored.groupBy("chunk_id").agg(F.max("score").alias("score"), F.sort_array(F.collect_set(query)).alias("queries"))


def rerank(candidates: DataFrame, query: str, k: int = K, margin: float = MARGIN) -> DataFrame:
    """Weighted ranks of a query's candidates ``(query, chunk_id, score, query_terms, text_terms, title_terms, support, mmr)``.

    ``more_terms``, an array of the terms of each expansion query, and ``section_intent`` may be there too: lexical and title parts
    are those of the best query, a titled chunk gains ``TITLED`` under a section intent. Those within ``margin`` of the best stay; where
    a title holds half of a query's terms, only those that match by title or by a quarter of the terms. The best chunk of each expansion query that
    holds half of its terms is kept, in place of the last others. Candidates are at most some dozens for each query, so a window per query is small.
    """
    have = candidates.columns
    if "more_terms" not in have:
        candidates = candidates.withColumn("more_terms", F.array().cast("array<array<string>>"))
    if "section_intent" not in have:
        candidates = candidates.withColumn("section_intent", F.lit(False))
    w = Window.partitionBy(query)
    low, high = F.min("score").over(w), F.max("score").over(w)
    semantic = F.when(high - low > 1e-9, (F.col("score") - low) / (high - low)).otherwise(1.0)
    exploded = candidates.select(query, "chunk_id", F.explode(F.array_intersect("query_terms", "text_terms")).alias("term"))
    held = exploded.groupBy(query, "term").agg(F.count("*").alias("df"))
    rare = exploded.join(held, [query, "term"]).groupBy(query, "chunk_id").agg(F.sum(F.lit(1.0) / F.col("df")).alias("rare_sum"))
    # A term that no candidate holds weighs one.
    total = held.groupBy(query).agg(F.sum(F.lit(1.0) / F.col("df")).alias("rare_held"), F.count("*").alias("n_held"))
    queries = F.concat(F.array("query_terms"), "more_terms")
    parts = {
        "semantic": semantic,
        "lexical": F.array_max(F.transform(queries, lambda q: overlap(q, F.col("text_terms")))),
        "rare": F.coalesce(F.try_divide(F.col("rare_sum"), F.col("rare_held") + F.size("query_terms") - F.col("n_held")), F.lit(0.0)),
        "title": F.array_max(F.transform(queries, lambda q: overlap(q, F.col("title_terms")))),
        "support": F.col("support"),
        "mmr": F.col("mmr"),
    }
    joined = candidates.join(rare, [query, "chunk_id"], "left").join(total, query, "left")
    titled = F.when(F.col("section_intent") & (F.size("title_terms") > 0), TITLED).otherwise(0.0)
    scored = joined.withColumn("rank_score", sum(part * WEIGHTS[name] for name, part in parts.items()) + titled)
    scored = scored.select(query, "chunk_id", "score", "rank_score", parts["title"].alias("title"), parts["lexical"].alias("lexical"), F.transform("more_terms", lambda q: overlap(q, F.col("text_terms"))).alias("shares"))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank_score", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        ok = frame["rank_score"] >= frame["rank_score"].iloc[0] - margin
        if (frame["title"] >= 0.5).any():
            ok &= (frame["title"] > 0) | (frame["lexical"] >= 0.25)
        picked, reserved = frame.index[ok].tolist()[:k], set()
        shares = np.array(frame["shares"].tolist(), float).reshape(len(frame), -1)
        for column in shares.T:
            rest = [i for i in range(len(frame)) if i not in picked and column[i] >= 0.5]
            if not rest:
                continue
            if len(picked) >= k:
                last = next((i for i in reversed(picked) if i not in reserved), None)
                if last is None:
                    continue
                picked.remove(last)
            best = max(rest, key=lambda i, column=column: (column[i], -i))
            picked.append(best)
            reserved.add(best)
        return frame.loc[picked, [query, "chunk_id", "score", "rank_score"]].assign(rank=range(1, len(picked) + 1))

    kinds = {c: candidates.schema[c].dataType.simpleString() for c in (query, "chunk_id", "score")}
    return scored.groupBy(query).applyInPandas(choose, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", rank_score double, rank int")


def mmr(candidates: DataFrame, query: str, k: int = K, weight: float = LAMBDA) -> DataFrame:
    """Maximal marginal relevance over ``(query, chunk_id, score, vector)``, at most ``FETCH`` for each query."""
    kind = candidates.schema[query].dataType.simpleString()
    chunk = candidates.schema["chunk_id"].dataType.simpleString()

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        x = np.stack(frame["vector"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        alike, score = x @ x.T, frame["score"].to_numpy()
        picked: list[int] = []
        while len(picked) < min(k, len(frame)):
            worth = weight * score - (1 - weight) * (alike[:, picked].max(1) if picked else 0)
            worth[picked] = -np.inf
            picked.append(int(worth.argmax()))
        return pd.DataFrame({query: frame[query].iloc[picked].to_numpy(), "chunk_id": frame["chunk_id"].iloc[picked].to_numpy(), "mmr_rank": range(1, len(picked) + 1)})

    return candidates.groupBy(query).applyInPandas(choose, f"{query} {kind}, chunk_id {chunk}, mmr_rank int")


def structure(children: DataFrame) -> DataFrame:
    """Sections of each source: ``(source, section_id, child_index, text)`` summed up."""
    return children.groupBy("source", "section_id").agg(F.count("*").alias("children"), F.min("child_index").alias("first_child"), F.max("child_index").alias("last_child"), F.sum(F.length("text")).alias("n_chars"))


def read_sections(children: DataFrame) -> DataFrame:
    """Each section's text, its children in order; a section is as long as one document part."""
    ordered = F.array_sort(F.collect_list(F.struct("child_index", "text")))
    return children.groupBy("source", "section_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def expand_sections(hits: DataFrame, children: DataFrame, whole: int = 4) -> DataFrame:
    """All children of a hit's section if they are few, else the hit and its neighbours."""
    sizes = children.groupBy("source", "section_id").agg(F.count("*").alias("__n"))
    h = hits.select("source", "section_id", F.col("child_index").alias("__hit"))
    near = children.join(sizes, ["source", "section_id"]).join(h, ["source", "section_id"]).where((F.col("__n") <= whole) | (F.abs(F.col("child_index") - F.col("__hit")) <= 1))
    return near.select("source", "section_id", "child_index", "text").distinct()


def title_documents(sections: DataFrame, question: str) -> DataFrame:
    """Sections whose title the question writes out; the longest title only, none if two are as long."""
    norm = lambda c: F.regexp_replace(F.lower(c), r"[\s\p{Punct}]", "")
    found = sections.where(F.contains(norm(F.lit(question)), norm(F.col("title"))) & (F.length(norm(F.col("title"))) >= 2)).withColumn("__l", F.length(norm(F.col("title"))))
    best = found.groupBy("__l").agg(F.count("*").alias("__n")).orderBy(F.desc("__l")).limit(1).where("__n = 1").select(F.col("__l").alias("__best"))
    return found.join(F.broadcast(best), F.col("__l") == F.col("__best")).drop("__l", "__best")


def constraint_chunks(all_chunks: DataFrame, found: DataFrame, question: str) -> DataFrame:
    """Chunks of found sources that state a limit and hold a term of the question, beyond those found."""
    wanted = all_chunks.where(F.col("text").rlike(CONSTRAINTS) & F.exists(terms(F.lit(question)), lambda t: F.contains(F.lower("text"), t)))
    return wanted.join(found.select("source").distinct(), "source", "left_semi").join(found.select("chunk_id"), "chunk_id", "left_anti")


def headings(df: DataFrame, text: str = "text") -> DataFrame:
    """Numbered, roman or chapter headings of pages, with their place in the page."""
    pattern = r"(?m)^\s*((?:제\s*\d+\s*[장절조]|[IVX]+\.|\d+(?:\.\d+)*\.)\s+[^\n]{2,60})$"
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    return df.select(*(c for c in df.columns if c != text), F.posexplode(found).alias("heading_index", "heading"))


def continue_sections(pages: DataFrame) -> DataFrame:
    """The open section carried on to pages without a heading of their own, over documents of any length."""
    carried = running(pages, ["source"], ["page"], lasts={"__open": "section_id"})
    return carried.select(*(F.col("__open").alias(c) if c == "section_id" else c for c in pages.columns))


def table_fields(c: Column) -> Column:
    """``key: value / key: value`` as a map; the first value of a repeated key."""
    pairs = F.transform(F.filter(F.split(c, r"\s*/\s*"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["v"]))


def clause(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """The first line of each chunk that fits a pattern, such as an exclusion, priority or condition."""
    line = F.regexp_extract(F.col(text), rf"(?m)^([^\n]*(?:{pattern})[^\n]*)$", 1)
    return df.withColumn("clause", F.trim(line)).where("clause <> ''")


CLAUSES = {"exclusion": "제외|배제|해당하지 않", "scope": "지원\\s*(?:대상|범위|내용)", "mandatory": "모두\\s*(?:충족|만족)", "priority": "우선", "preference": "우대"}


def meets_criteria(value: Column, operator: Column, limit: Column) -> Column:
    return F.when(operator == "gte", value >= limit).when(operator == "lte", value <= limit).when(operator == "gt", value > limit).when(operator == "lt", value < limit)


def numeric_criteria(c: Column) -> Column:
    """Numbers with comparison words of a text, as ``array<struct<value, operator>>``."""
    found = F.regexp_extract_all(c, F.lit(r"\d[\d,]*(?:\.\d+)?\s*[가-힣%]{0,3}\s*(?:이상|이하|초과|미만)"), F.lit(0))
    word = lambda x: F.regexp_extract(x, "(이상|이하|초과|미만)", 1)
    names = F.create_map(*(F.lit(x) for pair in (("이상", "gte"), ("이하", "lte"), ("초과", "gt"), ("미만", "lt")) for x in pair))
    return F.transform(found, lambda x: F.struct(F.regexp_replace(F.regexp_extract(x, r"^(\d[\d,]*(?:\.\d+)?)", 1), ",", "").cast("double").alias("value"), F.element_at(names, word(x)).alias("operator")))
