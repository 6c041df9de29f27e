"""Katz backoff scores of whole texts from a bigram model of the training texts.

P(w | v) is the Good-Turing discounted share of the pair where training has it, else the backoff
weight of v times P(w), and P(w) is the discounted share of the word, else what the discounts leave
for unknown words. Backoff weights make every P(. | v) sum to one exactly.

How it runs: texts are coded in chunks against the chunk's own word list. The lists meet once by
word hash, which counts words and numbers them by falling count, so a word's count follows from its
number by a table whose size is that of the distinct counts (at most the square root of twice the
tokens). Then all pairs meet once by history: one task holds all continuations of a history, so
pair counts and backoff weights are complete there and the pair table is stored partitioned by
history. Histories too frequent for one task are dealt by the whole pair, and only their sums are
put together. Scores leave the tasks as one sum per text. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import math
from typing import Iterable, Iterator, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from courtlens.llm.common import stage

#: Counts above this are taken as they are.
TRUSTED = 5
#: Bytes of text and rows in a chunk; words and pairs in a task, on average.
CHUNK_BYTES, CHUNK_ROWS = 8 << 20, 2500
WORDS, PAIRS = 1_200_000, 2_000_000
#: Histories more frequent than this are dealt by the whole pair.
FREQUENT = PAIRS // 8
_END_HASH = xxhash.xxh64_intdigest(b"\n")  # no word is a line feed


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes: high bytes that are all zero cost nothing."""
    planes = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def loosen(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=values.dtype.type(0)))


def loosen_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(loosen(raw))


# ---- chunks --------------------------------------------------------------------------------------


def _cuts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        below = (sizes[at - 1] if at else 0) + CHUNK_BYTES
        stop = max(at + 1, min(at + CHUNK_ROWS, int(np.searchsorted(sizes, below, side="right"))))
        yield at, stop
        at = stop


def tokens(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different words, number of each token's word, tokens of each text): A-Z lower-cased words
    between blanks, each text closed by the end token, which has the number after the last word."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("").cast(pa.string())))
    flat = lists.flatten()
    there = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    per_text = np.diff(np.concatenate([[0], np.cumsum(there)])[offsets])
    coded = flat.filter(pa.array(there)).dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    ends = np.cumsum(per_text)
    return words, np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(words)), per_text + 1


def _chunks(docs: DataFrame, held: Column, id_column: str, text_column: str) -> DataFrame:
    inner = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_column).alias("text"),
                        F.spark_partition_id().alias("task"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for a, b in _cuts(batch.column("text")):
                part = batch.slice(a, b - a)
                words, codes, sizes = tokens(part.column("text"))
                held_out = part.column("held").to_numpy(zero_copy_only=False)
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
                hashes = np.append(hashes, np.uint64(_END_HASH))
                trained = np.bincount(codes[np.repeat(~held_out, sizes)], minlength=len(hashes))
                ids = part.column("id")
                task = part.column("task")[0].as_py()
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([(task << 32) + number], pa.int64()), "n_tokens": pa.array([len(codes)], pa.int64()),
                    "n_words": pa.array([len(hashes)], pa.int64()),
                    "ids": pa.array([squeeze(ids.fill_null(0).to_numpy(zero_copy_only=False))], pa.binary()),
                    "flags": pa.array([squeeze(held_out * 2 + ids.is_valid().to_numpy(zero_copy_only=False))], pa.binary()),
                    "sizes": pa.array([squeeze(sizes)], pa.binary()), "codes": pa.array([squeeze(codes)], pa.binary()),
                    "hashes": pa.array([hashes.tobytes()], pa.binary()), "trained": pa.array([squeeze(trained)], pa.binary())})
                number += 1

    return inner.mapInArrow(work, "chunk long, n_tokens long, n_words long, ids binary, flags binary, sizes binary, codes binary, hashes binary, trained binary")


# ---- words ---------------------------------------------------------------------------------------


def _word_parts(chunks: DataFrame, parts: int) -> DataFrame:
    """One row per part of the word table: counts in hash order, and which chunk asked for which."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, hashes, trained in zip(*(batch.column(c).to_pylist() for c in ("chunk", "hashes", "trained"))):
                values, counts = np.frombuffer(hashes, np.uint64), loosen(trained)
                part = (values >> np.uint64(32)).astype(np.int64) % parts
                order = np.lexsort((values, part))
                bounds = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(bounds)).tolist():
                    mine = order[bounds[p]:bounds[p + 1]]
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([p], pa.int32()), "chunk": pa.array([chunk], pa.int64()), "hashes": pa.array([values[mine].tobytes()], pa.binary()),
                        "trained": pa.array([squeeze(counts[mine])], pa.binary()), "place": pa.array([squeeze(mine)], pa.binary())})

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = [np.frombuffer(h, np.uint64) for h in frame["hashes"]]
        _, where = np.unique(np.concatenate(values), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([loosen(t) for t in frame["trained"]])).astype(np.int64)
        kinds, n = np.unique(counts, return_counts=True)
        return pd.DataFrame([{
            "part": key[0], "counts": squeeze(counts), "kinds": kinds.tolist(), "n": n.tolist(), "chunks": frame["chunk"].tolist(),
            "asked": [len(v) for v in values], "where": squeeze(where), "places": squeeze(np.concatenate([loosen(p) for p in frame["place"]]))}])

    dealt = chunks.select("chunk", "hashes", "trained").mapInArrow(deal, "part int, chunk long, hashes binary, trained binary, place binary")
    return dealt.groupBy("part").applyInPandas(
        merge, "part int, counts binary, kinds array<long>, n array<long>, chunks array<long>, asked array<long>, where binary, places binary")


def _numbers(words: DataFrame, shares: "Shares") -> DataFrame:
    """(chunk, places, numbers): the words of a chunk numbered by falling count, then by part and hash."""
    kinds = words.select("part", F.explode(F.arrays_zip("kinds", "n")).alias("k")).select("part", F.col("k.kinds").alias("kind"), F.col("k.n").alias("n"))
    shared = words.sparkSession.sparkContext.broadcast(dict(zip(shares.kinds.tolist(), shares.opens.tolist())))
    before = F.sum("n").over(Window.partitionBy("kind").orderBy("part")) - F.col("n")
    firsts = kinds.select("part", F.struct("kind", before.alias("before")).alias("first")).groupBy("part").agg(F.collect_list("first").alias("firsts"))

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = loosen(row["counts"])
                begin = {f["kind"]: f["before"] + shared.value[f["kind"]] for f in row["firsts"]}
                kinds, which = np.unique(counts, return_inverse=True)
                order = np.argsort(which, kind="stable")
                opens = np.searchsorted(which[order], np.arange(len(kinds)))
                number = np.empty(len(counts), np.int64)
                number[order] = np.arange(len(counts)) - opens[which[order]] + np.array([begin[k] for k in kinds.tolist()])[which[order]]
                wanted, places = number[loosen(row["where"])], loosen(row["places"])
                at = 0
                for chunk, n in zip(row["chunks"], row["asked"]):
                    yield pa.RecordBatch.from_pydict({
                        "chunk": pa.array([chunk], pa.int64()), "places": pa.array([squeeze(places[at:at + n])], pa.binary()),
                        "numbers": pa.array([squeeze(wanted[at:at + n])], pa.binary())})
                    at += n

    joined = words.select("part", "counts", "chunks", "asked", "where", "places").join(firsts, "part")
    return joined.mapInArrow(answer, "chunk long, places binary, numbers binary")


class Shares(NamedTuple):
    """Counts by word number, and the numbers the model needs for all words."""

    kinds: np.ndarray  # distinct counts, falling
    opens: np.ndarray  # first word number of each
    n: np.ndarray  # words of each
    tokens: int
    words: int  # different words in training

    @classmethod
    def of(cls, words: DataFrame) -> "Shares":
        rows = words.select(F.explode(F.arrays_zip("kinds", "n")).alias("k")).groupBy("k.kinds").agg(F.sum("k.n").alias("n")).collect()
        table = sorted(((r["kinds"], r["n"]) for r in rows), reverse=True)
        kinds = np.array([k for k, _ in table], dtype=np.int64)
        n = np.array([n for _, n in table], dtype=np.int64)
        return cls(kinds, np.cumsum(n) - n, n, int((kinds * n).sum()), int(n[kinds > 0].sum()))

    def count(self, number: np.ndarray) -> np.ndarray:
        return self.kinds[np.searchsorted(self.opens, number, side="right") - 1]


def discounts(n: list[int]) -> np.ndarray:
    """Katz's factor for counts 0 to ``TRUSTED`` from the numbers of kinds seen 1, 2, ... times.

    Where Good-Turing gives no factor between 0 and 1 for each of them, as on small or odd tables,
    a constant is taken off every such count instead.
    """
    out = np.ones(TRUSTED + 1)
    if n[0] and all(n[:TRUSTED]):
        top = (TRUSTED + 1) * n[TRUSTED] / n[0]
        for r in range(1, TRUSTED + 1):
            out[r] = ((r + 1) * n[r] / (n[r - 1] * r) - top) / (1 - top) if top < 1 else -1.0
    if not (n[0] and all(n[:TRUSTED])) or (out[1:] <= 0).any() or (out[1:] >= 1).any():
        off = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        out[1:] = 1 - off / np.arange(1, TRUSTED + 1)
    return out


class Unigrams(NamedTuple):
    """Probability of a word by its count; that of count 0 is all unknown words' together."""

    shares: Shares
    factor: np.ndarray
    total: float
    unknown: float

    @classmethod
    def of(cls, shares: Shares) -> "Unigrams":
        kinds = {k: n for k, n in zip(shares.kinds.tolist(), shares.n.tolist()) if k > 0}
        factor = discounts([kinds.get(r, 0) for r in range(1, TRUSTED + 2)])
        used = sum(factor[min(r, TRUSTED)] * r * n if r <= TRUSTED else r * n for r, n in kinds.items())
        free = shares.tokens - used
        total = float(shares.tokens) if free > 0 else shares.tokens + 1.0
        return cls(shares, factor, total, (total - used) / total)

    def prob(self, count: np.ndarray) -> np.ndarray:
        keep = np.where(count <= TRUSTED, self.factor[np.minimum(count, TRUSTED)], 1.0)
        return np.where(count > 0, keep * count / self.total, self.unknown)


# ---- pairs ---------------------------------------------------------------------------------------

_PAIR_ROW = "part long, chunk long, a binary, b binary, c binary, d binary, kinds array<long>"


def _deal_pairs(chunks: DataFrame, numbers: DataFrame, unigrams: Unigrams, parts: int, frequent: int) -> DataFrame:
    """Pairs by part: part is the history's, or for the ``frequent`` first numbers the pair's. What
    is known of a chunk's texts goes along in rows of parts below 0."""
    shared = chunks.sparkSession.sparkContext.broadcast(unigrams)

    def work(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shares = shared.value.shares
        row = left.iloc[0]
        codes, sizes, flags = loosen(row["codes"]), loosen(row["sizes"]), loosen(row["flags"])
        number = np.empty(int(row["n_words"]), np.int64)
        for places, found in zip(right["places"], right["numbers"]):
            number[loosen(places)] = loosen(found)
        word = number[codes]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        counts = shares.count(word)
        base = np.bincount(owner, np.log10((counts + 0.5) / (shares.tokens + 0.5 * (shares.words + 1))), minlength=len(sizes))
        known = np.bincount(owner[counts > 0], minlength=len(sizes))
        out = [(-1 - key[0] % parts, key[0], row["ids"], squeeze(flags | known << 2), row["sizes"], base.tobytes(), None)]
        first = np.cumsum(sizes) - sizes
        history = np.roll(word, 1)
        history[first] = word[first + sizes - 1]  # a text begins after an end token
        spread = np.where(history < frequent, history * 31 + word * 0x9E3779B1, history)
        part = ((spread * 0x9E3779B1) >> 16) % parts
        order = np.lexsort((word, history, part))
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        mark = owner * 2 + (flags[owner] >> 1)
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            mine = order[bounds[p]:bounds[p + 1]]
            out.append((p, key[0], squeeze_sorted(history[mine]), squeeze(word[mine]), squeeze(mark[mine]), None, None))
        return pd.DataFrame(out, columns=["part", "chunk", "a", "b", "c", "d", "kinds"])

    return chunks.drop("hashes", "trained").groupBy("chunk").cogroup(numbers.groupBy("chunk")).applyInPandas(work, _PAIR_ROW)


def _unpacked(row) -> tuple[np.ndarray, ...]:
    """(history, word, training count, occurrences) of each pair, (chunk, text) of each occurrence."""
    history = loosen_sorted(row["a"])
    word, seen, n = (loosen(x) for x in _three(row["b"]))
    return history, word, seen, n, loosen(row["c"])


def _join(*blobs: bytes) -> bytes:
    return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def _three(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at:at + 8], "little")
        out.append(raw[at + 8:at + 8 + size])
        at += 8 + size
    return out


def _merge_pairs(unigrams_of, frequent: int):
    """The pair table of one part, with how many pairs there are of each small count and, for the
    frequent histories, the sums that their backoff weights need."""

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return frame
        unigrams = unigrams_of.value
        history = np.concatenate([loosen_sorted(a) for a in frame["a"]])
        word = np.concatenate([loosen(b) for b in frame["b"]])
        marks = [loosen(c).astype(np.int32) for c in frame["c"]]
        chunk_number = np.repeat(np.arange(len(frame), dtype=np.int32), [len(m) for m in marks])
        mark = np.concatenate(marks)
        del marks
        order = np.argsort(history << 32 | word, kind="stable") if max(history.max(), word.max()) < 1 << 31 else np.lexsort((word, history))
        history, word, mark, chunk_number = history[order], word[order], mark[order], chunk_number[order]
        opens = np.flatnonzero(np.concatenate([[True], (history[1:] != history[:-1]) | (word[1:] != word[:-1])]))
        seen = np.add.reduceat(1 - (mark & 1), opens)
        sizes = np.diff(np.append(opens, len(mark)))
        history, word = history[opens], word[opens]
        kinds = np.bincount(np.minimum(seen, TRUSTED + 2), minlength=TRUSTED + 3)[1:TRUSTED + 2].tolist()
        sums = _history_sums(history, word, seen, unigrams)
        often = sums["history"] < frequent
        return pd.DataFrame([(key[0], 0, squeeze_sorted(history), _join(squeeze(word), squeeze(seen), squeeze(sizes)),
                              squeeze(chunk_number.astype(np.int64) << 32 | mark >> 1), _join(np.array(frame["chunk"], dtype=np.int64).tobytes(),
                              np.column_stack([v[often] for v in sums.values()]).astype(np.float64).tobytes()), kinds)],
                            columns=["part", "chunk", "a", "b", "c", "d", "kinds"])

    return merge


def _history_sums(history: np.ndarray, word: np.ndarray, seen: np.ndarray, unigrams: Unigrams) -> dict[str, np.ndarray]:
    """For each history: pairs of each small count, sum of larger counts, P of the words it has."""
    had = seen > 0
    history, word, seen = history[had], word[had], seen[had]
    each, which = np.unique(history, return_inverse=True)
    out = {"history": each}
    for r in range(1, TRUSTED + 1):
        out[f"n{r}"] = np.bincount(which[seen == r], minlength=len(each))
    out["large"] = np.bincount(which, np.where(seen > TRUSTED, seen, 0), minlength=len(each))
    out["covered"] = np.bincount(which, unigrams.prob(unigrams.shares.count(word)), minlength=len(each))
    return out


class Backoff(NamedTuple):
    """Of each history: what its counts are divided by, and the weight of the words it lacks."""

    total: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, sums: dict[str, np.ndarray], factor: np.ndarray) -> "Backoff":
        count, used = sums["large"].astype(float), sums["large"].astype(float)
        for r in range(1, TRUSTED + 1):
            count = count + r * sums[f"n{r}"]
            used = used + factor[r] * r * sums[f"n{r}"]
        free = count - used
        total = np.where(free > 1e-9, count, count + 1)  # only trusted counts: one more event for the rest
        return cls(total, (total - used) / total / np.maximum(1 - sums["covered"], 1e-12))


class _Model(NamedTuple):
    unigrams: Unigrams
    factor: np.ndarray
    frequent: np.ndarray  # histories dealt by pair, ascending
    backoff: Backoff  # theirs


def _score_part(model: _Model, row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    history, word, seen, sizes, place = _unpacked(row)
    chunks = np.frombuffer(_three(row["d"])[0], np.int64)
    unigrams = model.unigrams
    sums = _history_sums(history, word, seen, unigrams)
    own = Backoff.of(sums, model.factor)
    total, weight = own.total.copy(), own.weight.copy()
    each = sums["history"]
    if len(model.frequent):
        at = np.minimum(np.searchsorted(model.frequent, each), len(model.frequent) - 1)
        hit = model.frequent[at] == each
        total[hit], weight[hit] = model.backoff.total[at[hit]], model.backoff.weight[at[hit]]
        # A frequent history may have none of its known words in this part.
        missing = np.setdiff1d(model.frequent[np.isin(model.frequent, history)], each)
        if len(missing):
            at = np.searchsorted(model.frequent, missing)
            each = np.concatenate([each, missing])
            order = np.argsort(each)
            each = each[order]
            total = np.concatenate([total, model.backoff.total[at]])[order]
            weight = np.concatenate([weight, model.backoff.weight[at]])[order]
    lower = unigrams.prob(unigrams.shares.count(word))
    prob = lower.copy()
    if len(each):
        at = np.minimum(np.searchsorted(each, history), len(each) - 1)
        known = each[at] == history
        keep = np.where(seen <= TRUSTED, model.factor[np.minimum(seen, TRUSTED)], 1.0)
        prob = np.where(known, np.where(seen > 0, keep * seen / total[at], weight[at] * lower), lower)
    value = np.repeat(np.log10(prob), sizes)
    texts, which = np.unique(place, return_inverse=True)
    score = np.bincount(which, value)
    chunk = texts >> 32
    bounds = np.searchsorted(chunk, np.arange(len(chunks) + 1))
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        mine = slice(bounds[k], bounds[k + 1])
        yield int(chunks[k]), texts[mine] & 0xFFFFFFFF, score[mine]


def _sums_by_text(pairs: DataFrame, model: _Model) -> DataFrame:
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["part"] < 0:
                    found = [(row["chunk"], row["a"], row["b"], row["c"], row["d"])]
                else:
                    found = [(chunk, squeeze(texts), None, None, score.tobytes()) for chunk, texts, score in _score_part(shared.value, row)]
                if found:
                    names = ("chunk", "a", "b", "c", "d")
                    kinds = (pa.int64(), *[pa.binary()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], list(names))

    return pairs.drop("kinds").mapInArrow(work, "chunk long, a binary, b binary, c binary, d binary")


def _by_text(train_tokens: int):
    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        about = frame[frame["b"].notna()].iloc[0]
        flags, sizes = loosen(about["b"]), loosen(about["c"])
        score = np.zeros(len(sizes))
        for texts, values in zip(frame["a"][frame["b"].isna()], frame["d"][frame["b"].isna()]):
            score[loosen(texts)] += np.frombuffer(values)
        ids = pd.array(loosen(about["a"]), dtype="Int64")
        ids[(flags & 1) == 0] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": (flags & 2) > 0, "n_tokens": sizes, "n_known": flags >> 2,
                             "train_tokens": train_tokens, "base_score": np.frombuffer(about["d"]), "score": score})

    return gather


def score(docs: DataFrame, held: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Rows where ``held`` is not true train the model; all rows are scored. A null text counts as
    empty: its one token is the end. Texts are scored whole, and a text's first word follows an end
    token. Repeated rows count each time; a null id stays null; other columns are not read. Without
    training rows nothing is known and every token has the probability of unknown words, which is 1.
    """
    chunks = stage(_chunks(docs, held, id_column, text_column), "chunks")
    size = chunks.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words")).first()
    if not size["tokens"]:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    words = stage(_word_parts(chunks, max(1, math.ceil(size["words"] / WORDS))), "words")
    shares = Shares.of(words)
    unigrams = Unigrams.of(shares)
    parts = max(1, math.ceil(size["tokens"] / PAIRS))
    frequent = int(shares.n[shares.kinds > FREQUENT].sum())
    shared = docs.sparkSession.sparkContext.broadcast(unigrams)
    dealt = _deal_pairs(chunks, _numbers(words, shares), unigrams, parts, frequent)
    pairs = stage(dealt.groupBy("part").applyInPandas(_merge_pairs(shared, frequent), _PAIR_ROW), "pairs")
    model = _model(pairs.where("part >= 0"), unigrams, frequent)
    return _sums_by_text(pairs, model).groupBy("chunk").applyInPandas(
        _by_text(shares.tokens), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _model(pairs: DataFrame, unigrams: Unigrams, frequent: int) -> _Model:
    """Discounts from all parts' counts; sums of frequent histories, which are few by definition."""
    totals = {r["at"]: r["n"] for r in pairs.select(F.posexplode("kinds").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()}
    factor = discounts([totals.get(r, 0) for r in range(TRUSTED + 1)])
    names = ["history", *[f"n{r}" for r in range(1, TRUSTED + 1)], "large", "covered"]
    sums = {n: np.zeros(0) for n in names}
    if frequent:
        def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw in batch.column("d").to_pylist():
                    table = np.frombuffer(_three(raw)[1]).reshape(-1, len(names))
                    yield pa.RecordBatch.from_arrays([pa.array(table[:, i]) for i in range(len(names))], names)

        each = pairs.select("d").mapInArrow(rows, ", ".join(f"{n} double" for n in names))
        found = each.groupBy("history").agg(*[F.sum(n).alias(n) for n in names[1:]]).orderBy("history").toPandas()
        sums = {n: found[n].to_numpy() for n in names}
    return _Model(unigrams, factor, sums["history"].astype(np.int64), Backoff.of(sums, factor))
