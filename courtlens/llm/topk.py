"""Exact top-k inner products by columnar branch-and-bound.

Candidates lie in blocks in vertical layout, one row of numbers per dimension. For a query, the
dimensions are taken in blocks from its heaviest to its lightest; after each, what a candidate can
still gain is at most the product of the masses remaining on both sides (Cauchy-Schwarz). Those
whose best case is below the k-th best worst case are out, and the survivors are compacted.

Query blocks meet candidate blocks through an equality join on the block number, so a task holds
one pair of blocks of fixed size, and each pair hands on k rows a query. Every query block travels to
every candidate block: numbers that fit take two bytes, and the join sorts, since Spark would take the
copies for one query block and send them all through the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from courtlens.llm.common import merged, pack, stage
from courtlens.llm.vectors import usable

SCALE = 1024
CANDIDATES = 4096
QUERIES = 1024
STEP = 8
#: Sums below this are exact in doubles.
_EXACT = 2.0**53
_LONG = (1 << 63) - 1
_PEAK = np.finfo(np.float64).max


def _blocks(rows: DataFrame, size: int, total: int) -> DataFrame:
    """(block, dim, n, ids, data): ``data`` is dim x n numbers, floors of the scaled components.

    Rows of one id land in one block, where the first by (id, vector) stays. A block holds ``size``
    vectors on average; vectors of different lengths are kept in rows of their own.
    """
    count = max(1, math.ceil(total / size))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        frame = frame.assign(vector=[tuple(v) for v in frame["vector"]]).sort_values(["id", "vector"]).drop_duplicates("id")
        for dim, part in frame.groupby(frame["vector"].map(len)):
            values = np.array(part["vector"].tolist(), dtype=np.float64).reshape(len(part), dim)
            with np.errstate(over="ignore"):
                data = np.clip(np.floor(values.T * SCALE), -_PEAK, _PEAK)
            out.append((key[0], dim, len(part), pack(part["id"].to_numpy(np.int64)), _narrow(data)))
        return pd.DataFrame(out, columns=["block", "dim", "n", "ids", "data"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    return dealt.groupBy("block").applyInPandas(build, "block int, dim int, n int, ids binary, data binary")


def _narrow(data: np.ndarray) -> bytes:
    """Whole numbers in two bytes each if all of them fit, else as doubles."""
    return pack(data.astype(np.int16) if np.abs(data).max(initial=0) < 1 << 15 else data)


def _wide(raw: bytes, dim: int, n: int) -> np.ndarray:
    kind = np.int16 if len(raw) == 2 * dim * n else np.float64
    return np.frombuffer(raw, dtype=kind).reshape(dim, n).astype(np.float64)


def best_of_block(query: np.ndarray, data: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k highest inner products of one query with the columns of ``data``,
    ties to the smaller id; all columns if there are no more than k."""
    alive = np.arange(data.shape[1])
    partial = np.zeros(len(alive))
    order = np.argsort(-np.abs(query), kind="stable")
    rest = np.einsum("ij,ij->j", data, data)
    left = float(query @ query)
    for at in range(0, len(order), STEP):
        dims = order[at:at + STEP]
        part = data[dims[:, None], alive[None, :]] if len(alive) < data.shape[1] else data[dims]
        partial += query[dims] @ part
        rest = np.maximum(rest - np.einsum("ij,ij->j", part, part), 0.0)
        left = max(0.0, left - float(query[dims] @ query[dims]))
        if len(alive) > k:
            reach = np.sqrt(left * rest) * (1 + 1e-9)
            floor = np.partition(partial - reach, len(alive) - k)[len(alive) - k]
            stay = partial + reach >= floor
            if stay.sum() < 0.8 * len(alive):
                alive, partial, rest = alive[stay], partial[stay], rest[stay]
    best = np.lexsort((ids[alive], -partial))[:k]
    return ids[alive[best]], partial[best]


def _large(query: np.ndarray, data: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same in whole numbers of any size, for components too large for exact doubles; scores
    outside the range of long become its ends, and tie there."""
    whole = [int(x) for x in query]
    scores = [max(-_LONG - 1, min(_LONG, sum(a * int(b) for a, b in zip(whole, column)))) for column in data.T]
    best = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    return ids[best], np.array([scores[i] for i in best], dtype=object)


def _meet(k: int):
    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in frame.itertuples(index=False):
            ids = np.frombuffer(row.ids, dtype=np.int64)
            data = _wide(row.data, row.dim, row.n)
            asked = np.frombuffer(row.q_ids, dtype=np.int64)
            queries = _wide(row.q_data, row.dim, row.q_n)
            place = {i: p for p, i in enumerate(ids.tolist())}
            peak = float(np.abs(data).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, row.dim)
            square = max(float(np.abs(data).max(initial=0)), float(np.abs(queries).max(initial=0))) ** 2 * max(1, row.dim)
            search = best_of_block if max(peak, square) < _EXACT else _large
            for q, number in enumerate(asked.tolist()):
                own = place.get(number)
                found, scores = search(queries[:, q], data, k + (own is not None), ids)
                pairs = [(number, i, int(s)) for i, s in zip(found.tolist(), scores.tolist()) if i != number]
                out += pairs[:k]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return meet


def search(table: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``is_query`` chooses, the k other rows of
    highest score, all if there are fewer; rank starts at 1 and ties go to the smaller id.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no
    part; vectors of different lengths are not compared; rows that repeat an id count once. Other
    columns are not read. An empty table gives no rows.
    """
    vector = F.col(vector_column)
    rows = table.where(F.col(id_column).isNotNull() & usable(vector)).select(
        F.col(id_column).cast("long").alias("id"), vector.cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("asked")).first()
    groups = max(1, math.ceil(sizes["n"] / CANDIDATES))
    candidates = stage(_blocks(rows.select("id", "vector"), CANDIDATES, sizes["n"]), "candidates")
    queries = _blocks(rows.where("asks").select("id", "vector"), QUERIES, sizes["asked"]).select(
        F.col("block").alias("q_block"), "dim", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("block"))
    met = candidates.join(merged(queries), ["block", "dim"]).groupBy("block", "dim", "q_block").applyInPandas(
        _meet(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
