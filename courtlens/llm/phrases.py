"""Phrases of two to four words that occur together, from a weighted de Bruijn graph.

Nodes are runs of three words, edges runs of four: an edge leads from its first three words to its
last three and weighs as often as it occurs. Where a piece ends before the fourth word there is a
shorter, open edge; these are the corrections at the ends of pieces. Only edges are counted in the
texts. How often three words occur is the flow out of their node, open edges included, and in turn
gives the counts of two words and of one.

Before edges are counted, pairs of words are, by a 64-bit hash. A bit map of fixed size tells pairs
that surely stay below ``LEAST`` from the rest. Pieces are cut between the words of such pairs: no
phrase that counts reaches over the cut, so all its occurrences keep their edges, and the open edges
at the cut keep the flow of shorter ones. Equal runs between cuts are counted once before they
become edges. However full the map is, counts are exact; it only spares work.

Nodes with one way in and one way out of the same weight are compacted into paths by pointer
doubling; four words on a path name the path they are part of.
"""

from __future__ import annotations

from collections import Counter
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from courtlens.llm.common import UPPER, bit_map, is_set, stage

WORDS = 4
LEAST = 30
SCALE = 2_000_000
#: A phrase goes if a longer one around it occurs at least this often (hundredths of its count).
COVERED = 80
TOP = 2000
UNKNOWN = "und"
#: Bytes of text handled together, and pair hashes gathered before they are counted.
_BYTES, _GATHERED = 1 << 22, 1 << 21

_CUT = b"\n"
#: Signs that end a piece become line feeds, tabs become blanks, A-Z are lower-cased.
_TABLE = bytes.maketrans(b".,;:!?\x0b\x0c\r\t" + UPPER.encode(), _CUT * 9 + b" " + UPPER.lower().encode())


# ---- texts to numbered words ---------------------------------------------------------------------


def _coded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, int]:
    """(different words, number of each word in order, the number that stands for a cut)."""
    line = _CUT.join(texts).translate(_TABLE).replace(_CUT, b" \n ")
    coded = pa.array(line.split(b" "), pa.binary()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    order = coded.indices.to_numpy()
    if b"" in words:
        order = order[order != words.index(b"")]
    cut = words.index(_CUT) if _CUT in words else -1
    return words, order, cut


def _together(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, about ``_BYTES`` at a time; a longer text comes alone."""
    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            raw = text.as_buffer().to_pybytes()
            if held.get(lang) and sizes[lang] + len(raw) > _BYTES:
                yield lang, held.pop(lang)
                sizes[lang] = 0
            held.setdefault(lang, []).append(raw)
            sizes[lang] += len(raw)
            if len(held) > 16:
                lang = max(held, key=sizes.__getitem__)
                yield lang, held.pop(lang)
                sizes[lang] = 0
    yield from held.items()


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def _pair_hashes(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each word but the last, the hash of it and the next."""
    value = hashes[order[:-1]] * np.uint64(0x9E3779B97F4A7C15) + hashes[order[1:]]
    return (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _texts(docs: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.col(text_column).alias("text")).where("text IS NOT NULL")


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, n): hashes of the pairs of neighbouring words, counted within tasks; not yet summed."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for lang, part in _together(batches):
            words, order, cut = _coded(part)
            if len(order) < 2:
                continue
            inside = (order[:-1] != cut) & (order[1:] != cut)
            gathered.append(_pair_hashes(_word_hashes(lang, words), order)[inside])
            size += len(gathered[-1])
            if size > _GATHERED:
                yield _counted(gathered)
                gathered, size = [], 0
        if gathered:
            yield _counted(gathered)

    return texts.mapInArrow(work, "pair long, n int")


def _counted(gathered: list[np.ndarray]) -> pa.RecordBatch:
    pair, n = np.unique(np.concatenate(gathered), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n.astype(np.int32))], ["pair", "n"])


def marks(texts: DataFrame, least: int) -> np.ndarray:
    """A bit map in which every pair of ``least`` occurrences or more has its bit set."""
    often = pair_counts(texts).groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return bit_map(often.select("pair"))


def runs(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """(lang, run, n): pieces cut where a pair's bit is not set, counted within tasks. Every word of
    every text is in exactly one run."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, part in _together(batches):
            words, order, cut = _coded(part)
            if not len(order):
                continue
            linked = is_set(shared.value, _pair_hashes(_word_hashes(lang, words), order))
            linked &= (order[:-1] != cut) & (order[1:] != cut)
            first = np.flatnonzero(np.concatenate([[True], ~linked]))
            size = np.diff(np.append(first, len(order)))
            alone = order[first[size == 1]]
            single = np.bincount(alone[alone != cut], minlength=len(words))
            used = np.flatnonzero(single)
            many = Counter(order[a:a + k].tobytes() for a, k in zip(first[size > 1].tolist(), size[size > 1].tolist()))
            names = [words[i] for i in used.tolist()]
            names += [b" ".join(map(words.__getitem__, np.frombuffer(key, order.dtype).tolist())) for key in many]
            counts = np.concatenate([single[used], np.fromiter(many.values(), np.int64, len(many))])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
                ["lang", "run", "n"])

    return texts.mapInArrow(work, "lang string, run string, n long")


# ---- the graph -----------------------------------------------------------------------------------


def _head(gram: Column | str, words: int) -> Column:
    return F.substring_index(gram, " ", words)


def edges(counted_runs: DataFrame, words: int = WORDS) -> DataFrame:
    """(lang, gram, size, n): an edge for each word of each run, that word and the next ones up to
    ``words``; shorter, open edges are at the end of a run."""
    parts = counted_runs.select("lang", "n", F.split("run", " ").alias("w"))
    placed = parts.select("lang", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("at"))
    grams = placed.select("lang", "n", F.array_join(F.slice("w", F.col("at"), words), " ").alias("gram"),
                          F.least(F.lit(words), F.size("w") - F.col("at") + 1).cast("int").alias("size"))
    return grams.groupBy("lang", "gram", "size").agg(F.sum("n").alias("n"))


def flows(graph: DataFrame, words: int = WORDS) -> list[DataFrame]:
    """Counts (lang, gram, n) of runs of 1, 2, ... ``words`` words: the full edges are those of the
    longest, and each shorter one is what leaves it, open edges of its size included."""
    level = graph
    levels = [level.where(F.col("size") == words)]
    for size in range(words - 1, 0, -1):
        level = level.select("lang", _head("gram", size).alias("gram"), F.least("size", F.lit(size)).alias("size"), "n").groupBy(
            "lang", "gram", "size").agg(F.sum("n").alias("n"))
        levels.append(level.where(F.col("size") == size))
    return [x.select("lang", "gram", "n") for x in reversed(levels)]


def paths(counts: DataFrame, words: int = WORDS) -> DataFrame:
    """(lang, gram, path, path_at, path_words) of the edges in ``counts`` (lang, gram, size, n).

    Two edges follow each other on a path if the node between them is left as often as it is
    entered by the one and left by the other: there is no other way in or out and no end. path is
    the path's first edge, path_at the number of edges before this one, path_words the words of the
    whole path. No path is a circle, since some piece would never end.
    """
    heavy = counts.where(F.col("size") == words).select("lang", "gram", "n")
    node = counts.where(F.col("size") == words - 1).select("lang", F.col("gram").alias("node"), F.col("n").alias("n"))
    after = heavy.select("lang", F.col("gram").alias("before"), F.substring_index("gram", " ", 1 - words).alias("node"), "n")
    into = heavy.select("lang", "gram", _head("gram", words - 1).alias("node"), "n")
    follows = into.join(after.join(node, ["lang", "node", "n"]), ["lang", "node", "n"]).select("lang", "gram", "before")
    current = stage(heavy.join(follows, ["lang", "gram"], "left").select(
        "lang", "gram", F.coalesce("before", "gram").alias("path"), F.col("before").isNotNull().cast("int").alias("path_at")), "steps")
    while True:
        step = current.select("lang", F.col("gram").alias("path"), F.col("path").alias("next"), F.col("path_at").alias("more"))
        moved = stage(current.join(step, ["lang", "path"]).select(
            "lang", "gram", F.col("next").alias("path"), (F.col("path_at") + F.col("more")).alias("path_at"), (F.col("more") > 0).alias("moved")), "steps")
        current = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    long = current.groupBy("lang", "path").agg((F.max("path_at") + words).alias("path_words"))
    return current.join(long, ["lang", "path"]).select("lang", "gram", "path", "path_at", "path_words")


# ---- phrases -------------------------------------------------------------------------------------


def _exact(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return column.cast("decimal(20,0)")


def scored(counts: DataFrame, words: int = WORDS) -> DataFrame:
    """(lang, phrase, size, a, k, l, r, score) per phrase of two words or more of ``counts``: the
    cut of lowest score, then of smallest k. Whole-number division of decimals is exact."""
    phrases = counts.where("size > 1").select("lang", F.col("gram").alias("phrase"), "size", F.col("n").alias("a"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - size)").alias("rest"))
    known = counts.select("lang", "gram", "n")
    both = cuts.join(known.toDF("lang", "first", "l"), ["lang", "first"]).join(known.toDF("lang", "rest", "r"), ["lang", "rest"])
    value = F.expr(f"CAST(a AS DECIMAL(20,0)) * {SCALE}BD DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))").cast("long")
    least = both.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "size", "a", "cut.k", "cut.l", "cut.r", "cut.score")


def uncovered(phrases: DataFrame, words: int = WORDS) -> DataFrame:
    """``phrases`` without those inside a longer one that is nearly as frequent."""
    inner = phrases.where("size > 2").select("lang", "size", "a", F.split("phrase", " ").alias("w"))
    cut = inner.select("lang", "a", "w", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("part")).select(
        "lang", "a", "w", "part", F.explode(F.expr("sequence(1, size - part + 1)")).alias("at"))
    around = cut.select("lang", F.expr("array_join(slice(w, at, part), ' ')").alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("longer"))
    kept = F.coalesce(_exact("longer") * 100 < _exact("a") * COVERED, F.lit(True))
    return phrases.join(around, ["lang", "phrase"], "left").where(kept).drop("longer")


def mine(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, path, path_at, path_words): each language's ``top`` phrases.

    a, l, r: how often the phrase and both sides of its lowest cut occur; n: all words of the
    language; path: see ``paths``, null for fewer than four words. A null language is ``und``, a
    null or empty text has no words, very long texts and pieces are read whole, repeated rows count
    again, ties go by count and then phrase; an empty table gives an empty result; other columns
    are not read.
    """
    texts = _texts(docs, text_column, lang_column)
    counted = runs(texts, marks(texts, least)).groupBy("lang", "run").agg(F.sum("n").alias("n"))
    graph = stage(edges(counted), "edges")
    totals = stage(graph.groupBy("lang").agg(F.sum("n").cast("long").alias("all_words")), "totals")
    often = [level.where(F.col("n") >= least).withColumn("size", F.lit(size)) for size, level in enumerate(flows(graph), 1)]
    counts = often[0]
    for level in often[1:]:
        counts = counts.union(level)
    counts = stage(counts.select("lang", "gram", "n", "size"), "counts")
    kept = uncovered(scored(counts))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", place).where(F.col("rank") <= top)
    named = best.join(totals, "lang").join(paths(counts).withColumnRenamed("gram", "phrase"), ["lang", "phrase"], "left")
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score",
                        "path", F.col("path_at").cast("long"), F.col("path_words").cast("long"))
