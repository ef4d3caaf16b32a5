"""Which texts hold a share of a query's words, for query sets and texts of any size.

A text that holds at least ``m`` of a query's ``n`` words holds one of its ``n - m + 1`` rarest. Only those are joined with the words of texts, so the common
words, which most pairs share, never meet; what a pair shares in all is counted for those pairs only. Where a query's rarest words are about as common as the
others, looking pairs up again would cost more than it saves: there all its words are joined and counted at once. Words that many texts
hold are dealt over several tasks. Nothing is collected, and what is broadcast are at most ``HOT_WORDS`` words.

Where all queries have few words together (``POSTINGS``), these go to every task instead: texts are counted where they are read, and only the pairs found leave
a task. Nothing is shuffled but ids, to see that none repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerloom.sources.store import written

#: Words that count as hot at most, and the least number of texts that a hot word has.
HOT_WORDS, HOT = 1000, 20_000
#: How many words joined cost as much as one pair looked up again.
LOOKUP = 10
#: Words of all queries that go to every task at most; beyond, words are joined.
POSTINGS = 300_000
#: Words met that a task counts at a time.
STEP = 1 << 20


def words_of(queries: DataFrame, query: str = "query", terms: str = "terms") -> DataFrame:
    """``(query, n, word)`` for each distinct word of each query that has any; null terms count as none."""
    distinct = queries.select(F.col(query).alias("query"), F.array_distinct(F.array_compact(terms)).alias("__terms"))
    return distinct.select("query", F.size("__terms").alias("n"), F.explode_outer("__terms").alias("word")).where("word IS NOT NULL")


def held_words(words: DataFrame, texts: DataFrame, text_id: str = "chunk_id", terms: str = "terms") -> DataFrame:
    """``(chunk_id, word)`` for the distinct words of each text that any query asks for, written once: texts are read no second time."""
    asked = words.select("word").distinct()
    # the outer form has no filter on the array, which would cut each text into words once more; joining drops its nulls
    each = texts.select(F.col(text_id).alias("chunk_id"), F.explode_outer(F.array_distinct(terms)).alias("word"))
    return written(each.join(asked, "word", "left_semi").select("chunk_id", "word"), "held")


def candidate_pairs(words: DataFrame, held: DataFrame, least: float, *, hot: int = HOT, lookup: float = LOOKUP) -> DataFrame:
    """``(query, chunk_id, n, met, whole)``, each pair once: all that share at least ``least`` of a query's words, and some that share less.

    ``met`` counts the words that were joined, which are all that the pair shares if ``whole``.
    """
    if least <= 0:
        raise ValueError("a share of nothing is shared by all pairs")
    counts = held.groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
    found = words.join(counts, "word")  # words that no text holds can't be shared
    # the least whole number whose share reaches the cut, as shares are compared
    n, m = F.col("n"), F.ceil(F.col("n") * least)
    m = F.when((m - 1) / n >= least, m - 1).when(m / n < least, m + 1).otherwise(m)
    ordered = found.groupBy("query").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("texts", "word"))).alias("by_rarity"))
    rare = ordered.withColumn("m", m.cast("int")).where(F.size("by_rarity") >= F.col("m"))
    rare = rare.withColumn("prefix", F.slice("by_rarity", F.lit(1), F.size("by_rarity") - F.col("m") + 1))
    texts = lambda c: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda total, x: total + x["texts"])
    rare = rare.withColumn("whole", texts("by_rarity") <= texts("prefix") * F.lit(lookup))
    joined = rare.select("query", "n", "whole", F.inline(F.when(F.col("whole"), F.col("by_rarity")).otherwise(F.col("prefix"))))
    joined = written(joined, "asked")
    per = counts.agg(F.greatest(F.lit(hot), F.ceil(F.sum("texts") / HOT_WORDS)).alias("per"))
    hot_words = written(counts.join(F.broadcast(per), F.col("texts") > F.col("per")).select("word", F.ceil(F.col("texts") / F.col("per")).cast("int").alias("parts")), "hot")
    dealt = held.join(F.broadcast(hot_words), "word", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("chunk_id"), F.col("parts")), F.lit(0)))
    met = joined.join(F.broadcast(hot_words), "word", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    pairs = dealt.select("word", "part", "chunk_id").join(met.select("word", "part", "query", "n", "whole"), ["word", "part"])
    return pairs.groupBy("query", "chunk_id").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("met"), F.first("whole").alias("whole"))


def shared_words(pairs: DataFrame, words: DataFrame, held: DataFrame) -> DataFrame:
    """``pairs(query, chunk_id)`` with ``shared``, how many of the query's words each text holds, and ``n``, how many the query has."""
    asked = words.groupBy("query").agg(F.first("n").alias("n"), F.collect_list("word").alias("__asked"))
    found = held.groupBy("chunk_id").agg(F.collect_list("word").alias("__held"))
    met = pairs.join(asked, "query").join(found, "chunk_id", "left")
    return met.select("query", "chunk_id", "n", F.coalesce(F.size(F.array_intersect("__asked", "__held")), F.lit(0)).alias("shared"))


def shares(words: DataFrame, held: DataFrame, least: float, *, hot: int = HOT, lookup: float = LOOKUP) -> DataFrame:
    """``(query, chunk_id, overlap)`` of all pairs that share at least ``least`` of a query's words."""
    pairs = written(candidate_pairs(words, held, least, hot=hot, lookup=lookup).where(~F.col("whole") | (F.col("met") / F.col("n") >= least)), "pairs")
    counted = pairs.where("whole").select("query", "chunk_id", (F.col("met") / F.col("n")).alias("overlap"))
    again = shared_words(pairs.where("NOT whole").select("query", "chunk_id"), words, held)
    return counted.unionByName(again.select("query", "chunk_id", (F.col("shared") / F.col("n")).alias("overlap")).where(F.col("overlap") >= least))


def repeated(texts: DataFrame, text_id: str) -> bool:
    """Whether an id stands in several rows."""
    return bool(texts.groupBy(text_id).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > 1).limit(1).count())


def meetings(rows: np.ndarray, found: np.ndarray, starts: np.ndarray, held_by: np.ndarray, queries: int) -> tuple[np.ndarray, np.ndarray]:
    """``row * queries + query`` of the pairs that share a word, ascending, and how many each shares."""
    per = starts[found + 1] - starts[found]
    at = np.arange(per.sum()) + np.repeat(starts[found] - (np.cumsum(per) - per), per)
    keys = np.repeat(rows * queries, per) + held_by[at]
    if not len(keys):
        return keys, keys
    low, size = rows[0] * queries, (rows[-1] - rows[0] + 1) * queries
    if size > 8 * len(keys):
        return np.unique(keys, return_counts=True)
    counts = np.bincount(keys - low, minlength=size)
    some = np.flatnonzero(counts)
    return some + low, counts[some]


def scan(words: DataFrame, texts: DataFrame, columns: list[str], least: list[float], text_id: str = "chunk_id") -> DataFrame:
    """``(query, chunk_id, n, shared_0, ..)``: pairs whose texts hold at least ``least[i]`` of a query's words in the array ``columns[i]``, for any ``i``.

    ``words``, of which there must be few, go to every task.
    """
    if min(least) <= 0:
        raise ValueError("a share of nothing is shared by all pairs")
    listed = words.toArrow()
    asked = listed["query"].combine_chunks().dictionary_encode() if listed.num_rows else None
    by_word = listed["word"].combine_chunks().dictionary_encode() if listed.num_rows else None
    number = np.asarray(asked.indices, dtype=np.int64) if asked is not None else np.zeros(0, np.int64)
    word = np.asarray(by_word.indices, dtype=np.int64) if by_word is not None else np.zeros(0, np.int64)
    names = asked.dictionary if asked is not None else pa.array([], listed.schema.field("query").type)
    vocabulary = by_word.dictionary if by_word is not None else pa.array([], pa.string())
    of = np.zeros(len(names), dtype=np.int64)
    of[number] = np.asarray(listed["n"], dtype=np.int64)
    order = np.argsort(word, kind="stable")
    known = words.sparkSession.sparkContext.broadcast((names, vocabulary, of, np.searchsorted(word[order], np.arange(len(vocabulary) + 1)), number[order]))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vocabulary, of, starts, held_by = known.value
        total = len(names)
        for batch in batches:
            met = []
            for column in batch.columns[1:]:
                places = pc.index_in(pc.list_flatten(column), value_set=vocabulary)
                held = np.asarray(pc.is_valid(places))
                rows = np.asarray(pc.list_parent_indices(column), dtype=np.int64)[held]
                met.append((rows, np.asarray(places.drop_null(), dtype=np.int64)))
            work = sum((np.bincount(rows, (starts[found + 1] - starts[found]).astype(float), minlength=batch.num_rows) for rows, found in met), np.zeros(batch.num_rows))
            step = np.floor(np.cumsum(work + 1) / STEP).astype(np.int64)
            for first, last in ((np.searchsorted(step, s), np.searchsorted(step, s, "right")) for s in np.unique(step)):
                parts = []
                for rows, found in met:
                    a, b = np.searchsorted(rows, (first, last))
                    parts.append(meetings(rows[a:b], found[a:b], starts, held_by, total))
                enough = [keys[shared / of[keys % total] >= cut] for (keys, shared), cut in zip(parts, least, strict=True) if len(keys)]
                kept = np.unique(np.concatenate(enough)) if enough else np.zeros(0, np.int64)
                if not len(kept):
                    continue
                shares = []
                for keys, shared in parts:
                    at = np.minimum(np.searchsorted(keys, kept), max(len(keys) - 1, 0))
                    shares.append(np.where(keys[at] == kept, shared[at], 0) if len(keys) else np.zeros(len(kept), np.int64))
                query = kept % total
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(query)), batch.column(0).take(pa.array(kept // total)), pa.array(of[query].astype(np.int32)), *(pa.array(s.astype(np.int32)) for s in shares)],
                    names=["query", "chunk_id", "n", *(f"shared_{i}" for i in range(len(shares)))],
                )

    schema = StructType([StructField("query", words.schema["query"].dataType), StructField("chunk_id", texts.schema[text_id].dataType), *(StructField(c, IntegerType()) for c in ("n", *(f"shared_{i}" for i in range(len(columns)))))])
    return texts.select(F.col(text_id).alias("chunk_id"), *(F.array_distinct(c).alias(f"c{i}") for i, c in enumerate(columns))).mapInArrow(pairs, schema)


def contained(queries: DataFrame, texts: DataFrame, least: float, *, query: str = "query", text_id: str = "chunk_id", terms: str = "terms", hot: int = HOT, lookup: float = LOOKUP, postings: int = POSTINGS) -> DataFrame:
    """``(query, chunk_id, overlap)``: all pairs whose text holds at least ``least`` of the query's distinct words.

    Queries and texts without words, or with null ones, are in no pair. Repeated ids count as one.
    """
    words = written(words_of(queries, query, terms).dropDuplicates(["query", "word"]), "words")
    again = repeated(texts, text_id)
    if not again and words.count() <= postings:
        return scan(words, texts, [terms], [least], text_id).select("query", "chunk_id", (F.col("shared_0") / F.col("n")).alias("overlap"))
    held = held_words(words, texts, text_id, terms)
    return shares(words, held.distinct() if again else held, least, hot=hot, lookup=lookup)
