"""Packing by minimum bin slack: as few sequences of a fixed length as can be.

Tokenising and cutting run per text. What decides the packing is only how many pieces there are of
each length, which is at most ``capacity`` numbers: on those, the longest remaining length opens a
sequence and a bitset subset-sum over the other lengths finds the fullest way to complete it; the
combination is used as often as the counts allow and then removed. Pieces are numbered within their
length by Spark and find their sequence from that number, so no task sees all of them.
"""

from __future__ import annotations

import math
import re
import zlib
from typing import Iterable, Iterator, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from courtlens.llm.common import by_bytes, stage

CAPACITY = 2048
END = 0
#: Pieces numbered together in one window at most, on average.
PER_WINDOW = 100_000
#: Words kept with their ids in each worker.
KNOWN_WORDS = 150_000

# ---- tokens --------------------------------------------------------------------------------------

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A word of letters with a lower case of one letter, then signs that no rule joins with letters.
_SIMPLE = re.compile(rf"([{_LETTERS}]+)([!-&(-/:-;=-@\[-`{{-~]*)")
#: The units of other words, if these hold nothing else; an apostrophe or < may belong to a rule.
_UNIT = re.compile(rf"[{_LETTERS}]+|[0-9]|[!-&(-/:-;=-@\[-`{{-~]+")
#: Bytes of text whose words are looked up together.
_BYTES = 1 << 24


class Coder:
    """Ids of whole texts, by way of a table of the words seen so far.

    The vocabulary drops white space before anything else, so the ids of a text are those of its
    blank-separated words in order; and it lower-cases and cuts between letters and punctuation, so
    those of a plain word with its comma are those of both parts. New parts are encoded together:
    each is one unit to the vocabulary, whose last id is one of those that end a unit.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[n for word, n in vocabulary.items() if word.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _encode_units(self, units: list[str]) -> None:
        ids = self._ids(" ".join(units))
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(units) or (len(cuts) and cuts[-1] != len(ids)):
            self.known.update((u, self._ids(u).tobytes()) for u in units)
            return
        raw, at = ids.tobytes(), 0
        for unit, end in zip(units, (cuts * 4).tolist()):
            self.known[unit] = raw[at:end]
            at = end

    def learn(self, words: list[str]) -> None:
        known = self.known
        plain, mixed, parts = [], [], set()
        for word in words:
            found = _SIMPLE.fullmatch(word)
            if found:
                stem, rest = found[1].lower(), found[2]
                plain.append((word, stem, rest))
                parts.add(stem)
                parts.add(rest)
                continue
            units = _UNIT.findall(word.lower()) if word.isascii() else []
            if sum(map(len, units)) == len(word):
                mixed.append((word, units))
                parts.update(units)
            else:
                known[word] = self._ids(word).tobytes()
        new = [p for p in parts if p not in known]
        for at in range(0, len(new), 2000):
            self._encode_units(new[at:at + 2000])
        for word, stem, rest in plain:
            known[word] = known[stem] + known[rest] if rest else known[stem]
        for word, units in mixed:
            known[word] = b"".join(map(known.__getitem__, units))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text and the closing id; null counts as empty."""
        end = np.array([END], dtype="<u4").tobytes()
        for at, n in by_bytes(texts, _BYTES):
            if len(self.known) > KNOWN_WORDS:
                self.known = {"": b""}
            lists = pc.ascii_split_whitespace(texts.slice(at, n).fill_null(""))
            coded = lists.flatten().dictionary_encode()
            different = coded.dictionary.to_pylist()
            self.learn([w for w in different if w not in self.known])
            blobs = [self.known[w] for w in different]
            ids = np.frombuffer(b"".join(blobs), dtype="<u4")
            sizes = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 4
            word = coded.indices.to_numpy()
            size = sizes[word]
            stops = np.cumsum(size)
            flat = ids[np.repeat((np.cumsum(sizes) - sizes)[word] - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)]
            bounds = np.concatenate([[0], stops])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield flat[a:b].tobytes() + end


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """This worker's coder, kept between tasks for the words it knows."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids cut into pieces of ``capacity``
    where they are more; each text has one piece at least, since the closing id counts."""
    inner = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = dict(inner.dtypes)["doc_id"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = coder(path).encode
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(ids_of(batch.column("text"))):
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    owner.append(row)
                    piece.append(k)
                    start.append(k * capacity)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                 *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return inner.mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# ---- the plan ------------------------------------------------------------------------------------


class Slots(NamedTuple):
    """For each length, in runs of numbers within that length: where these pieces go."""

    key: np.ndarray  # length * 2**40 + first number of the run, ascending
    use: np.ndarray  # pieces of this length in one sequence
    bin: np.ndarray  # sequence of the first of them
    offset: np.ndarray  # place of the first in its sequence


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of lengths (how many of each) with the largest total not above ``room``.

    Bit s of the bitset after a length says that total s can be reached with it and longer ones.
    """
    mask = (1 << (room + 1)) - 1
    reach, states = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        before, left, step = reach, min(counts[length], room // length), 1
        while left > 0:  # copies in blocks of 1, 2, 4, ... reach every number up to the limit
            take = min(step, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            step *= 2
        states.append((length, before))
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, before in reversed(states):
        used = 0
        while not before >> total & 1:
            total -= length
            used += 1
        if used:
            out[length] = used
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[Slots, int]:
    """Slots for all pieces counted by length, and the number of sequences.

    Each combination is used until one of its lengths has too few left, so the number of steps
    depends on the number of lengths and not on that of pieces.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int]] = []
    bins = 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest(left, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            use = chosen[length]
            rows.append(((length << 40) + taken[length], use, bins, offset))
            offset += use * length
            taken[length] += use * times
            left[length] -= use * times
            if not left[length]:
                del left[length]
        bins += times
    rows.sort()
    return Slots(*(np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))), bins


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (as ``pieces`` gives it, staged) with sequence_id and offset per piece.

    Equal lengths, which may be a third of all pieces, are numbered in many windows dealt by a hash
    of the piece; counts per window give each its first number. Repeated rows fill places of their
    own. An empty table gives an empty result.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(plan(counts, capacity)[0])
    deals = max(1, math.ceil(sum(counts.values()) / PER_WINDOW))
    dealt = cut.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(deals)).cast("int"))
    sizes = dealt.groupBy("length", "deal").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("deal")) - F.col("n")
    firsts = sizes.select("length", "deal", before.alias("first"))
    order = Window.partitionBy("length", "deal").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = dealt.withColumn("number", F.row_number().over(order) - 1).join(firsts, ["length", "deal"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("first")).alias("number"))

    def place(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = slots.value
        for frame in frames:
            key = (frame["length"].to_numpy(np.int64) << 40) + frame["number"].to_numpy(np.int64)
            run = np.searchsorted(table.key, key, side="right") - 1
            inside = key - table.key[run]
            frame["sequence_id"] = table.bin[run] + inside // table.use[run]
            frame["offset"] = table.offset[run] + inside % table.use[run] * frame["length"].to_numpy(np.int64)
            yield frame.drop(columns="number")

    kinds = ", ".join(f"{n} {k}" for n, k in numbered.dtypes if n != "number")
    return numbered.mapInPandas(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    A null or empty text is one piece holding the closing id; only texts of over ``capacity`` ids
    are cut; other columns are not read.
    """
    return pack(stage(pieces(docs, path, capacity, id_column, text_column), "pieces"), capacity)
