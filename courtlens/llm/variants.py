"""Spelling variants: words of one edit, found over a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols. One edit of a word is one edit, or none, of its reduced
word; so for each different reduced word all reduced words one edit away are generated (as 64-bit
hashes, one side of each unordered pair) and joined with the reduced vocabulary. Words of such
reduced pairs meet in the same equality join by their first or last half, since one edit leaves one
half as it is; what meets is verified on the original strings. Hashes only lead to candidates: a
collision costs one comparison and changes nothing.
"""

from __future__ import annotations

import zlib
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from courtlens.llm.common import UPPER, bit_map, is_set, merged, stage

#: What a run of letters is, and how often a text's runs lose a letter (see ``runs``).
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LOSES = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
SYMBOLS = 8
#: A form is at least this many times as frequent as its word.
AHEAD = 2
#: Neighbours made together.
_TOGETHER = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


# ---- vocabulary ----------------------------------------------------------------------------------


def _lowered(run: Column) -> Column:
    """A-Z lower-cased; a run of ASCII letters only takes the short way."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, UPPER.lower()))


def runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = 1) -> DataFrame:
    """(run) for every maximal run of ``least_length`` letters or more, lower-cased, of every text:
    where ``LOSES`` divides the crc32 h of ``<doc_id>:<run>``, the code point h % length is left
    out. A null id counts as an empty string there."""
    found = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("doc"),
                        F.explode(F.regexp_extract_all(F.col(text_column), F.lit(RUN), F.lit(0))).alias("found")).where(
        F.char_length("found") >= least_length)
    low = found.select("doc", _lowered(F.col("found")).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % LOSES == 0, without).otherwise(F.col("run")).alias("run"))


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of ``least_length`` code points or more that occur ``least_count`` times or more."""
    long = runs(docs, id_column, text_column, least_length).where(F.char_length("run") >= least_length)
    return long.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


# ---- reduced words -------------------------------------------------------------------------------


def reduced_words(words: list[str], symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """(reduced, sizes): the words' code points one after another, each hashed to a symbol from 1
    to ``symbols``, and the length of each word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    different, place = np.unique(codes, return_inverse=True)
    table = np.array([zlib.crc32(chr(c).encode("utf-8")) % symbols + 1 for c in different.tolist()], dtype=np.uint64)
    return table[place], np.fromiter(map(len, words), np.int64, len(words))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (value ^ (value >> np.uint64(29))).view(np.int64)


def hashes_of(reduced: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of each reduced word: a polynomial whose parts can be moved, then mixed."""
    starts = np.cumsum(sizes) - sizes
    terms = reduced * _powers(int(sizes.max(initial=0)))[np.arange(len(reduced)) - np.repeat(starts, sizes)]
    return _mixed(np.add.reduceat(terms, starts)) if len(terms) else np.zeros(len(sizes), np.int64)


def neighbourhoods(reduced: np.ndarray, symbols: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row, hash, longer) of all reduced words one replacement, with a greater symbol, or one
    insertion away from the rows of a matrix of reduced words of one length. Smaller symbols and
    deletions are the same pairs seen from their other side.

    Parts before the place keep their sum and parts behind an insertion move by one power, so each
    neighbour costs a few operations; a chunk of places at a time bounds the memory for long words.
    """
    rows, size = reduced.shape
    power = _powers(size)
    before = np.zeros((rows, size + 1), np.uint64)
    np.cumsum(reduced * power[:-1], axis=1, dtype=np.uint64, out=before[:, 1:])
    total = before[:, -1:]
    letters = np.arange(1, symbols + 1, dtype=np.uint64)
    step = max(1, _TOGETHER // max(1, rows * symbols))
    for at in range(0, size + 1, step):
        here = slice(at, min(size, at + step))
        change = letters - reduced[:, here, None]
        row, _, _ = greater = np.nonzero(letters > reduced[:, here, None])
        yield row, _mixed((total[:, :, None] + change * power[here][:, None])[greater]), False
        some = before[:, at:at + step]
        longer = some[:, :, None] + letters * power[at:at + step][:, None] + ((total - some) * _BASE)[:, :, None]
        yield np.repeat(np.arange(rows), longer.shape[1] * symbols), _mixed(longer.reshape(-1)), True


def _by_length(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in ``words``, reduced words, code points), the last two as matrices of one length and
    of about ``_TOGETHER`` neighbours."""
    flat, sizes = reduced_words(words, symbols)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        step = max(1, _TOGETHER // (size * symbols))
        for at in range(0, len(mine), step):
            cells = starts[mine[at:at + step]][:, None] + np.arange(size)
            yield mine[at:at + step], flat[cells], codes[cells]


def _half(codes: np.ndarray, length: int, back: bool) -> np.ndarray:
    """Hash of the first half of ``length`` code points, or of as many at the end as are then left."""
    first = length // 2
    part = codes[:, codes.shape[1] - (length - first):] if back else codes[:, :first]
    return (part * _powers(part.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def _key(high: np.ndarray, half: np.ndarray, longer: bool, back: bool) -> np.ndarray:
    return _mixed(high.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + half * _BASE + np.uint64(2 * longer + back + 1))


def _hashes(reduced: np.ndarray) -> np.ndarray:
    return hashes_of(reduced.reshape(-1), np.full(len(reduced), reduced.shape[1], np.int64))


def _reduced(words: DataFrame, symbols: int) -> DataFrame:
    """(reduced): the hash of each word's reduced word."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = hashes_of(*reduced_words(batch.column("word").to_pylist(), symbols))
            yield pa.RecordBatch.from_arrays([pa.array(made)], ["reduced"])

    return words.select("word").mapInArrow(work, "reduced long")


def _answers(words: DataFrame, symbols: int) -> DataFrame:
    """(key, b, n_b): the four keys under which a word is found: by its first or last half, as a
    word of the same length or as one with a code point more."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, reduced, codes in _by_length(batch.column("word").to_pylist(), symbols):
                high, size = _hashes(reduced), codes.shape[1]
                keys = [_key(high, _half(codes, size - longer, back), longer, back) for longer in (False, True) for back in (False, True)]
                took = pa.array(np.tile(place, 4))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column("word").take(took), batch.column("n").take(took)], ["key", "b", "n_b"])

    return words.select("word", "n").mapInArrow(work, "key long, b string, n_b long")


def _questions(words: DataFrame, symbols: int, known: np.ndarray, answered: np.ndarray) -> DataFrame:
    """(key, a, n_a, back, alike): for every reduced word of a word's neighbourhood, itself
    included, that the map of reduced words knows, the keys of both halves that the map of keys
    knows. Both maps have a fixed size and only spare work."""
    shared = words.sparkSession.sparkContext.broadcast((known, answered))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, reduced, codes in _by_length(batch.column("word").to_pylist(), symbols):
                halves = [_half(codes, codes.shape[1], back) for back in (False, True)]
                own = _hashes(reduced)
                asked = {False: [(np.arange(len(own)), own)], True: []}
                for row, key, longer in neighbourhoods(reduced, symbols):
                    found = is_set(shared.value[0], key)
                    asked[longer].append((row[found], key[found]))
                for longer, parts in asked.items():
                    # a long word comes in several chunks, which may name a neighbour twice
                    row, high = np.unique(np.concatenate([np.stack([r, k]) for r, k in parts], axis=1), axis=1)
                    for back in (False, True):
                        key = _key(high, halves[back][row], longer, back)
                        open_ = np.flatnonzero(is_set(shared.value[1], key))
                        took = pa.array(place[row[open_]])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key[open_]), batch.column("word").take(took), batch.column("n").take(took), pa.array(np.full(len(open_), back)),
                             pa.array(high[open_] == own[row[open_]])], ["key", "a", "n_a", "back", "alike"])

    return words.select("word", "n").mapInArrow(work, "key long, a string, n_a long, back boolean, alike boolean")


def near(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(a, b, n_a, n_b) of different words with exactly one inserted, deleted or replaced code
    point between them, each pair once. ``words``, staged, has one row per word.

    A key is the hash of the other's reduced word, of the half that both share, of which half that
    is and of whether the other word is longer.
    """
    answers = _answers(words, symbols)
    questions = _questions(words, symbols, bit_map(_reduced(words, symbols)), bit_map(answers.select("key")))
    first = F.floor(F.char_length("a") / 2).cast("int")
    again = F.col("back") & (F.substring(F.col("a"), F.lit(1), first) == F.substring(F.col("b"), F.lit(1), first))
    once = ~F.col("alike") | (F.col("a") < F.col("b"))
    return questions.join(merged(answers), "key").where(once & ~again & (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "n_a", "n_b")


# ---- groups --------------------------------------------------------------------------------------


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n): form is the near word of largest n, ties by code points, if
    that is ``AHEAD`` times the word's n or more."""
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    joined = words.join(merged(best), "word", "left")
    ahead = -F.col("best.less") >= AHEAD * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(ahead, F.col("best.other")).alias("form"), F.when(ahead, -F.col("best.less")).alias("form_n"))


def rooted(table: DataFrame) -> DataFrame:
    """``table`` (word, form, ...) with root: the last word reached by following forms.

    Counts at least double along a chain, so chains are short; each round doubles what a row has
    followed and ends when no row moved.
    """
    current = stage(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        step = current.toDF("root", "next")
        moved = current.join(merged(step), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = stage(moved, "roots")
        current = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return table.join(merged(current), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", symbols: int = SYMBOLS,
             least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of the whole texts' vocabulary.

    Null texts have no runs, an empty table gives an empty result, a run of any length is one word,
    repeated rows count again, other columns are not read.
    """
    words = stage(vocabulary(docs, id_column, text_column, least_length, least_count), "vocabulary")
    table = stage(forms(words, near(words, symbols)), "variants")
    return rooted(table).select("word", "form", "root", "n", "n_near", "form_n")
