"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of every training text are summed per (language, bucket) by Spark; what comes to the driver
is the matrix of languages times buckets (256 KB a language), whatever the number of texts. It is
broadcast as log probabilities, and texts are scored in batches: one gather per n-gram and one
segmented sum per text.
"""

from __future__ import annotations

import re
from typing import Iterable, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from courtlens.llm.common import sliced

SIZES = (1, 2, 3)
BUCKETS = 1 << 15
#: Characters of text handled at once; longer texts go through in pieces.
PIECE = 1 << 18
UNKNOWN = "und"
#: Least posterior of a text that ``accepted`` keeps.
SURE = 0.5
_WORD_SIGN = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter; fractions, circled digits and number letters are none."""
    return bool(text) and any(m[0].isalpha() for m in _WORD_SIGN.finditer(text))


def _buckets(codes: np.ndarray, ends: np.ndarray, cut: np.ndarray) -> Iterator[np.ndarray]:
    """For each size, the bucket of the n-gram that starts at each character; ``BUCKETS`` where
    it would run into the next text, or starts in what the next piece of its text repeats (``cut``:
    ends of pieces that have a next one)."""
    padded = np.concatenate([codes, np.zeros(max(SIZES), np.uint32)])
    value = np.full(len(codes), 11, dtype=np.uint32)
    for n in range(1, max(SIZES) + 1):
        value = value * np.uint32(0x9E3779B1) + padded[n - 1:n - 1 + len(codes)]
        if n in SIZES:
            bucket = (((value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(17)).astype(np.intp)
            for short in range(1, n):
                bucket[np.maximum(ends - short, 0)] = BUCKETS
            for back in range(1, max(SIZES)):
                bucket[cut - back] = BUCKETS
            yield bucket


def _batches(texts: Iterable[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, characters, ends, ends of unfinished pieces) of about ``PIECE`` characters.
    Texts are lower-cased; a long one is cut into pieces that overlap by the longest n-gram less
    one character, so that every n-gram lies in a piece."""
    numbers: list[int] = []
    parts: list[str] = []
    open_: list[bool] = []
    held = 0
    overlap = max(SIZES) - 1
    for number, text in enumerate(texts):
        if not text:
            continue
        text = text.lower()
        for start in range(0, max(1, len(text) - overlap), PIECE):
            part = text[start:start + PIECE + overlap]
            numbers.append(number)
            parts.append(part)
            open_.append(start + len(part) < len(text))
            held += len(part)
            if held >= PIECE:
                yield _joined(numbers, parts, open_)
                numbers, parts, open_, held = [], [], [], 0
    if parts:
        yield _joined(numbers, parts, open_)


def _joined(numbers: list[int], parts: list[str], open_: list[bool]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(p) for p in parts])
    return numbers, codes, ends, ends[np.array(open_, dtype=bool)]


class Model(NamedTuple):
    languages: list[str]
    log_prob: np.ndarray  # languages x (BUCKETS + 1); the last is 0, for places without an n-gram
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        totals = np.zeros((len(texts), len(self.languages)))
        for numbers, codes, ends, cut in _batches(texts) if self.languages else ():
            starts = np.concatenate([[0], ends[:-1]])
            for bucket in _buckets(codes, ends, cut):
                for k, row in enumerate(self.log_prob):
                    np.add.at(totals[:, k], numbers, np.add.reduceat(row[bucket], starts))
        names, scores = [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            if not self.languages or not has_letter(text):
                names.append(UNKNOWN)
                continue
            total = totals[i] + self.prior
            best = int(np.argmax(total))
            names.append(self.languages[best])
            scores[i] = 1 / np.exp(total - total[best]).sum()
        return names, scores


def train(docs: DataFrame, text_column: str = "text", label_column: str = "lang", smooth: float = 0.1) -> Model:
    """Model of all rows with text and label; no such row gives a model that answers ``und``.

    Priors are equal, so that the mix of the training texts does not decide for short ones.
    """
    rows = docs.select(F.col(label_column).alias("lang"), F.col(text_column).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            langs = batch.column("lang").to_pylist()
            for numbers, codes, ends, cut in _batches(batch.column("text").to_pylist()):
                kinds = sorted({langs[i] for i in numbers})
                place = {k: i for i, k in enumerate(kinds)}
                kind = np.array([place[langs[i]] for i in numbers])
                width = BUCKETS + 1
                owner = np.repeat(kind * width, np.diff(ends, prepend=0))
                for bucket in _buckets(codes, ends, cut):
                    both = np.bincount(owner + bucket, minlength=len(kinds) * width).reshape(len(kinds), width)
                    for k, row in zip(kinds, both[:, :BUCKETS]):
                        if k in counts:
                            counts[k] += row
                        else:
                            counts[k] = row.copy()
            if len(counts) > 64:
                yield from _rows(counts)
                counts = {}
        yield from _rows(counts)

    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    languages = sorted(found["lang"].unique())
    place = {k: i for i, k in enumerate(languages)}
    matrix = np.full((len(languages), BUCKETS), smooth)
    np.add.at(matrix, (found["lang"].map(place).to_numpy(dtype=np.int64), found["bucket"].to_numpy()), found["n"].to_numpy())
    log_prob = np.zeros((len(languages), BUCKETS + 1))
    log_prob[:, :BUCKETS] = np.log(matrix / matrix.sum(axis=1, keepdims=True))
    return Model(languages, log_prob, np.zeros(len(languages)))


def _rows(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, row in counts.items():
        bucket = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(bucket), pa.string()), pa.array(bucket, pa.int32()), pa.array(row[bucket], pa.int64())],
            ["lang", "bucket", "n"])


def predict(docs: DataFrame, model: Model, keep: dict[str, Column], text_column: str = "text") -> DataFrame:
    """The columns of ``keep`` with lang_pred and score per row of ``docs``.

    Only the text decides. A null text, or one without a letter, is ``und`` with score 0; a very
    long one is read whole; equal texts are judged alike; score is the posterior of the answer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], F.col(text_column).alias("text"))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "score"])

    fields = ", ".join(f"k{i} {kind}" for i, (_, kind) in enumerate(inner.dtypes[:-1]))
    out = inner.mapInArrow(score, f"{fields}, lang_pred string, score double")
    return out.select(*[F.col(f"k{i}").alias(name) for i, name in enumerate(keep)], "lang_pred", "score")


def accepted(docs: DataFrame, model: Model, least: float = SURE, text_column: str = "text") -> DataFrame:
    """The rows, all columns, whose text has a language with a posterior of ``least`` or more.

    Null texts and texts without a letter go. A model without a language rejects nothing else.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_column):
            texts = batch.column(batch.schema.names.index(text_column)).to_pylist()
            if shared.value.languages:
                names, scores = shared.value.predict(texts)
                kept = [name != UNKNOWN and score >= least for name, score in zip(names, scores.tolist())]
            else:
                kept = [has_letter(t) for t in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
