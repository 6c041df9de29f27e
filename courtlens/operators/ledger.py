"""Bet ledger: bankroll paths, equity curves, drawdown and summaries.

A bankroll path is sequential, but a bet is a simple map of the bankroll: below a threshold it
multiplies it, above it adds a fixed sum, and it never falls. Such maps compose: a run of bets is a
broken line with one more piece than bets at most, and one piece for pure share rules. So paths are
an associative scan: bets to blocks and blocks to groups of blocks in parallel, then the groups of a
path one after another as a stream, then starts of blocks and bets in parallel again. The number of
jobs does not depend on the bets.
"""

from __future__ import annotations

from typing import Iterable, Iterator, NamedTuple, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from courtlens.functions import calibrate, staking
from courtlens.operators.windows import career_position
from courtlens.session import cut_lineage

START = 100.0
BLOCK = 500
INF = float("inf")
BET = ("bet_number", "tourney_date", "match_num", "share", "amount", "odds", "won", "edge")
#: Bets whose lines are composed at once; bounds the arrays of a task.
AT_ONCE = 1 << 15


# ---- choosing bets -----------------------------------------------------------------------------


def oriented_odds(predictions: DataFrame, odds: DataFrame) -> DataFrame:
    """Predictions with the odds of both players (inner join on the match)."""
    won = F.col("actual") == 1
    return predictions.join(odds, "match_num").withColumns({
        "odds_one": F.when(won, F.col("odds_winner")).otherwise(F.col("odds_loser")),
        "odds_two": F.when(won, F.col("odds_loser")).otherwise(F.col("odds_winner")),
    }).drop("odds_winner", "odds_loser")


def with_temperatures(df: DataFrame, temperatures: Sequence[float]) -> DataFrame:
    """One row per match and candidate temperature, probabilities scaled accordingly."""
    grid = F.array(*[F.lit(float(t)) for t in temperatures])
    out = df.withColumn("temperature", F.explode(grid))
    scaled = calibrate.with_temperature(F.col("raw_probability"), F.col("temperature"))
    return out.withColumn("prob_one", scaled).withColumn("prob_two", 1 - F.col("prob_one"))


def chosen_bets(df: DataFrame, **rules) -> DataFrame:
    """The side worth a bet, if any: its probability, odds, edge and whether it won."""
    def side(name: str, won: Column) -> Column:
        prob, price = F.col(f"prob_{name}"), F.col(f"odds_{name}")
        return F.when(staking.is_bet(prob, price, **rules), F.struct(
            prob.alias("prob"), price.alias("odds"), staking.edge(prob, price).alias("edge"), won.alias("won")))

    pick = F.coalesce(side("one", F.col("actual") == 1), side("two", F.col("actual") == 0))
    return df.withColumn("_bet", pick).filter(F.col("_bet").isNotNull()).select("*", "_bet.*").drop("_bet")


def with_strategies(bets: DataFrame, names: Sequence[str], **options) -> DataFrame:
    """One row per bet and strategy with the stake rule as ``share`` and ``amount``."""
    prob, odds = F.col("prob"), F.col("odds")
    cells = []
    for name in names:
        rule = staking.get_strategy(name)(prob, odds, **options)
        share = F.lit(None).cast("double") if rule.share is None else rule.share
        amount = F.lit(None).cast("double") if rule.amount is None else rule.amount
        cells.append(F.struct(F.lit(name).alias("strategy"), share.cast("double").alias("share"), amount.cast("double").alias("amount")))
    return bets.select("*", F.inline(F.array(*cells)))


# ---- the path ----------------------------------------------------------------------------------


def numbered_bets(bets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bets with their date order per path; number before adding strategies, they share it."""
    return career_position(bets, keys, "bet_number")


def _positioned(bets: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """Number the bets of each path and cut them into blocks and groups of blocks."""
    numbered = bets if "bet_number" in bets.columns else numbered_bets(bets, keys)
    slim = numbered.dropna(subset=list(keys)).select(*keys, *BET)
    return slim.withColumn("_block", F.floor((F.col("bet_number") - 1) / block)).withColumn("_group", F.floor(F.col("_block") / block))


class BrokenLine(NamedTuple):
    """``x -> slope[k] * x + offset[k]`` on the k-th piece, which ends at ``until[k]``; never falling."""

    until: np.ndarray
    slope: np.ndarray
    offset: np.ndarray

    @staticmethod
    def same() -> "BrokenLine":
        return BrokenLine(np.array([INF]), np.array([1.0]), np.array([0.0]))

    def __call__(self, x: float) -> float:
        k = int(np.searchsorted(self.until, x))
        return float(self.slope[k] * x + self.offset[k])

    def then(self, other: "BrokenLine") -> "BrokenLine":
        """This line followed by ``other``: pieces are split where their value crosses its breaks."""
        return _tight(*(x[0] for x in _followed([x[None] for x in self], [x[None] for x in other])))

    def pack(self) -> bytes:
        return np.stack(self).tobytes()

    @staticmethod
    def unpack(raw: bytes) -> "BrokenLine":
        return BrokenLine(*np.frombuffer(raw, np.float64).reshape(3, -1))


Rows = Sequence[np.ndarray]


def _followed(first: Rows, then: Rows) -> Rows:
    """Row by row the lines of ``first`` followed by those of ``then``. Each is (until, slope, offset) of
    one shape; pieces that end where the one before them ends are empty, as those that fill up a row."""
    (until, slope, offset), (turn, steep, shift) = first, then
    p, q = until.shape[1], turn.shape[1]
    with np.errstate(invalid="ignore", over="ignore"):
        ends = np.where(slope > 0, slope * until, 0.0) + offset
    ends = np.maximum.accumulate(np.where(until == -INF, -INF, ends), axis=1)
    # the piece whose value reaches a break of ``then``, and where it does
    rank = np.argsort(np.argsort(np.concatenate([turn, ends], axis=1), axis=1, kind="stable"), axis=1, kind="stable")
    reached = rank[:, :q] - np.arange(q)
    k = np.minimum(reached, p - 1)
    lows = np.concatenate([np.full((len(until), 1), -INF), until[:, :-1]], axis=1)
    low, high, a, c = (np.take_along_axis(x, k, 1) for x in (lows, until, slope, offset))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        at = np.where(a > 0, np.clip((turn - c) / a, low, high), low)
    at = np.maximum.accumulate(np.where(reached >= p, INF, at), axis=1)
    every = np.concatenate([until, at], axis=1)
    order = np.argsort(every, axis=1, kind="stable")[:, :-1]  # both end at infinity; one end is enough
    own = order < p
    i = np.minimum(np.cumsum(own, axis=1) - own, p - 1)
    j = np.minimum(np.cumsum(~own, axis=1) - ~own, q - 1)
    a, c = np.take_along_axis(slope, i, 1), np.take_along_axis(offset, i, 1)
    b, d = np.take_along_axis(steep, j, 1), np.take_along_axis(shift, j, 1)
    return np.take_along_axis(every, order, 1), a * b, c * b + d


def _tight(until: np.ndarray, slope: np.ndarray, offset: np.ndarray) -> BrokenLine:
    """The line without its empty pieces."""
    kept = until > np.concatenate([[-INF], until[:-1]])
    return BrokenLine(until[kept], slope[kept], offset[kept])


def _lines_of(blocks: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[BrokenLine]:
    """The line of each block of (share, amount, gain): neighbours are composed in pairs, all blocks at once."""
    width = 1 << max(0, int(max(len(b[0]) for b in blocks) - 1).bit_length())
    share, amount, gain = np.zeros((3, len(blocks), width))
    for n, block in enumerate(blocks):
        for to, values in zip((share, amount, gain), block):
            to[n, :len(values)] = values
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = np.where(share > 0, amount / share, INF)
        added = np.where(turn < INF, gain * amount, 0.0)
    scaled = 1 + gain * share
    both = lambda a, b: np.stack([a, b], axis=-1).reshape(-1, 2)
    rows = both(turn, np.full_like(turn, INF)), both(scaled, np.where(turn < INF, 1.0, scaled)), both(np.zeros_like(turn), added)
    while len(rows[0]) > len(blocks):
        rows = _followed([x[::2] for x in rows], [x[1::2] for x in rows])
    return [_tight(*row) for row in zip(*rows)]


def lines_of_bets(blocks: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[BrokenLine]:
    """The broken line of each block of bets in order. A bet multiplies up to ``amount / share`` and adds beyond."""
    lines: list[BrokenLine | None] = [None] * len(blocks)
    open_blocks, held = [], 0
    for n, (share, amount, gain) in enumerate(blocks):
        if not ((share > 0) & (amount < INF)).any():
            lines[n] = BrokenLine(np.array([INF]), np.array([np.prod(1 + gain * share)]), np.array([0.0]))
            continue
        open_blocks.append(n)
        held += len(share)
        if held >= AT_ONCE:
            for k, line in zip(open_blocks, _lines_of([blocks[k] for k in open_blocks])):
                lines[k] = line
            open_blocks, held = [], 0
    if open_blocks:
        for k, line in zip(open_blocks, _lines_of([blocks[k] for k in open_blocks])):
            lines[k] = line
    return lines


def line_of_bets(share: np.ndarray, amount: np.ndarray, gain: np.ndarray) -> BrokenLine:
    return lines_of_bets([(share, amount, gain)])[0]


def _composed(lines: Sequence[BrokenLine]) -> BrokenLine:
    """Lines one after another, neighbours first, so that long lines are touched a few times only."""
    while len(lines) > 1:
        odd = lines[len(lines) // 2 * 2:]
        lines = [a.then(b) for a, b in zip(lines[::2], lines[1::2])] + list(odd)
    return lines[0] if lines else BrokenLine.same()


def _block_lists(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys, "_group", "_block").agg(F.collect_list(F.struct(*BET)).alias("_bets"))


def _bets_of(bets: pa.StructArray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The order of a block's bets, and in it their share, amount and gain."""
    order = np.argsort(bets.field("bet_number").to_numpy(zero_copy_only=False), kind="stable")
    share, amount, odds = (bets.field(c).to_numpy(zero_copy_only=False)[order] for c in ("share", "amount", "odds"))
    won = bets.field("won").fill_null(False).to_numpy(zero_copy_only=False)[order]
    share = np.where(bets.field("share").is_null().to_numpy(zero_copy_only=False)[order], 1.0, np.fmin(share, 1.0))
    amount = np.where(bets.field("amount").is_null().to_numpy(zero_copy_only=False)[order], INF, amount)
    return order, (share, amount, np.where(won, odds - 1, -1.0))


def _block_lines(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _group, _block, line) with the packed line of every block of bets."""
    kept = [*keys, "_group", "_block"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = lines_of_bets([_bets_of(x.values)[1] for x in batch.column("_bets")])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([x.pack() for x in lines], pa.binary())], [*kept, "line"])

    kinds = ", ".join(f"`{n}` {k}" for n, k in blocks.dtypes if n in kept)
    return blocks.mapInArrow(work, f"{kinds}, line binary")


def _settled(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bets of every block one after another from its ``_start``, with ``stake`` and ``bankroll``."""
    columns = [*keys, *BET, "_block", "stake", "bankroll"]
    kinds = dict(blocks.select(*keys, "_block", F.inline("_bets")).dtypes) | {"stake": "double", "bankroll": "double"}

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, bets in enumerate(batch.column("_bets")):
                order, rules = _bets_of(bets.values)
                now, stakes, after = batch.column("_start")[n].as_py(), [], []
                for share, amount, gain in zip(*(x.tolist() for x in rules)):
                    stake = min(share * now, amount)
                    now += gain * stake
                    stakes.append(stake)
                    after.append(now)
                same = {c: batch.column(c).take(pa.array(np.full(len(order), n))) for c in (*keys, "_block")}
                listed = bets.values.take(pa.array(order))
                made = same | {c: listed.field(c) for c in BET} | {"stake": pa.array(stakes, pa.float64()), "bankroll": pa.array(after, pa.float64())}
                yield pa.RecordBatch.from_arrays([made[c] for c in columns], columns)

    return blocks.select(*keys, "_block", "_start", "_bets").mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in columns))


def _group_starts(lines: DataFrame, keys: Sequence[str], start: float) -> DataFrame:
    """(keys, _group, _begin): the bankroll at the start of every group of blocks.

    A group's line is composed in a task of its own; a path's groups then pass one after another
    through a task that holds one line at a time.
    """
    kinds = ", ".join(f"`{n}` {k}" for n, k in lines.dtypes if n in (*keys, "_group"))

    def composed(frame: pd.DataFrame) -> pd.DataFrame:
        line = _composed([BrokenLine.unpack(raw) for raw in frame.sort_values("_block")["line"]])
        return frame.iloc[:1][[*keys, "_group"]].assign(line=line.pack())

    def chained(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, now = None, start
        for frame in frames:
            begins = []
            for own, raw in zip(frame[list(keys)].itertuples(index=False, name=None), frame["line"]):
                if own != path:
                    path, now = own, start
                begins.append(now)
                now = BrokenLine.unpack(raw)(now)
            yield frame[[*keys, "_group"]].assign(_begin=np.array(begins, np.float64))

    groups = lines.groupBy(*keys, "_group").applyInPandas(composed, f"{kinds}, line binary")
    ordered = groups.repartition(*keys).sortWithinPartitions(*keys, "_group")
    return ordered.mapInPandas(chained, f"{kinds}, _begin double")


def _block_starts(lines: DataFrame, keys: Sequence[str], begins: DataFrame | None, start: float) -> DataFrame:
    """(keys, _block, _start) from the starts of the groups, or ``start`` where a path is one group."""
    known = lines.withColumn("_begin", F.lit(float(start))) if begins is None else lines.join(begins, [*keys, "_group"])
    kinds = ", ".join(f"`{n}` {k}" for n, k in lines.dtypes if n in (*keys, "_block"))

    def walked(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_block")
        now, out = float(frame["_begin"].iloc[0]), []
        for raw in frame["line"]:
            out.append(now)
            now = BrokenLine.unpack(raw)(now)
        return frame[[*keys, "_block"]].assign(_start=np.array(out, np.float64))

    return known.groupBy(*keys, "_group").applyInPandas(walked, f"{kinds}, _start double")


def bankroll_path(bets: DataFrame, keys: Sequence[str], start: float = START, block: int = BLOCK) -> DataFrame:
    """Bets with ``bet_number``, ``stake`` and ``bankroll`` (after the bet) in date order per path."""
    keys = list(keys)
    blocks = cut_lineage(_block_lists(_positioned(bets, keys, block), keys))
    longest = blocks.agg(F.max("_block").alias("block"), F.max("_group").alias("group")).first()
    if not longest["block"]:
        return _settled(blocks.withColumn("_start", F.lit(float(start))), keys)
    lines = cut_lineage(_block_lines(blocks, keys))
    begins = _group_starts(lines, keys, start) if longest["group"] else None
    return _settled(blocks.join(_block_starts(lines, keys, begins, start), [*keys, "_block"]), keys)


def equity_curve(path: DataFrame, keys: Sequence[str], start: float = START) -> DataFrame:
    """(bet number, bankroll) per path, beginning with the start at bet 0."""
    first = path.select(*keys).distinct().select(*keys, F.lit(0).cast("bigint").alias("bet_number"), F.lit(float(start)).alias("bankroll"))
    return first.unionByName(path.select(*keys, "bet_number", "bankroll"))


def drawdown(path: DataFrame, keys: Sequence[str], start: float = START) -> DataFrame:
    """Largest peak minus trough in currency per path; peaks travel block by block."""
    inside = Window.partitionBy(*keys, "_block").orderBy("bet_number").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    peaks = path.groupBy(*keys, "_block").agg(F.max("bankroll").alias("_p")).select(
        *keys, "_block", F.greatest(F.max("_p").over(earlier), F.lit(float(start))).alias("_before"))
    at = path.select(*keys, "_block", "bankroll", F.max("bankroll").over(inside).alias("_peak")).join(peaks, [*keys, "_block"])
    return at.groupBy(*keys).agg(F.max(F.greatest("_peak", "_before") - F.col("bankroll")).alias("max_drawdown"))


def summary(path: DataFrame, keys: Sequence[str], totals: DataFrame, total_keys: Sequence[str], start: float = START,
            stage=cut_lineage) -> DataFrame:
    """Backtest summary per path; ``totals`` has the number of matches per ``total_keys``. ``stage`` stores
    the path; one that is stored already needs none."""
    path = stage(path)  # read for the totals and twice for the drawdown
    base = path.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_bets_placed"), F.count_if("won").alias("bets_won"),
        F.count_if(~F.col("won")).alias("bets_lost"), F.avg(F.col("won").cast("double")).alias("win_rate"),
        F.avg("edge").alias("avg_edge"), F.max_by("bankroll", "bet_number").alias("final_bankroll"))
    out = base.join(drawdown(path, keys, start), list(keys)).join(totals, list(total_keys))
    profit = F.col("final_bankroll") - start
    return out.withColumns({
        "total_profit": profit, "roi_pct": profit / start * 100,
        "pct_bet_on": F.col("num_bets_placed") / F.col("num_total_matches") * 100,
    }).withColumn("risk_adjusted_roi", F.when(F.col("max_drawdown") > 0, F.col("roi_pct") / F.col("max_drawdown")).otherwise(F.lit(0.0)))


def temperature_table(candidates: DataFrame, path: DataFrame, keys: Sequence[str], start: float = START) -> DataFrame:
    """Bets, profit, ROI, hit rate, mean edge and drawdown per temperature; zeros without bets."""
    path = cut_lineage(path)
    base = path.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bets"), (F.max_by("bankroll", "bet_number") - start).alias("profit"),
        F.avg(F.col("won").cast("double")).alias("hit_rate"), F.avg("edge").alias("avg_edge"))
    out = candidates.select(*keys).distinct().join(base.join(drawdown(path, keys, start), list(keys)), list(keys), "left")
    numbers = ["bets", "profit", "hit_rate", "avg_edge", "max_drawdown"]
    return out.fillna(0, numbers).withColumn("roi", F.col("profit") / start * 100)


def best_temperature(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    best = F.max_by(F.struct("temperature", "roi", "bets", "profit", "hit_rate", "max_drawdown"), F.struct("roi", -F.col("temperature")))
    return table.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def shown_strategies(summaries: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Rows of the allowed strategies, or all rows when none of them is there."""
    listed = summaries.withColumn("_ok", F.col("strategy").isin(*allowed))
    any_listed = listed.agg(F.coalesce(F.max("_ok"), F.lit(False))).scalar()
    return listed.filter(F.col("_ok") | ~any_listed).drop("_ok")
