"""From one row per match to one row per player and match, and the cleaning around it."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from courtlens.functions import dates, names

STATS = ("ace", "df", "svpt", "1stIn", "1stWon", "2ndWon", "SvGms", "bpSaved", "bpFaced")
USED_STATS = tuple(s for s in STATS if s != "SvGms")
UNFINISHED = "W/O|RET|DEF"


def require_columns(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def column_contract(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(column, expected, found, present, fits, filled) per expected column: the type it has, null
    if it is absent, whether that is the expected one, and how many rows have a value; one pass."""
    found = {f.name: f.dataType.simpleString() for f in df.schema}
    there = [c for c in expected if c in found]
    counts = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(there)], F.count(F.lit(1)).alias("rows"))
    cells = [F.struct(
        F.lit(c).alias("column"), F.lit(kind).alias("expected"), F.lit(found.get(c)).cast("string").alias("found"),
        F.lit(c in found).alias("present"), F.lit(found.get(c) == kind).alias("fits"),
        (F.col(f"n{there.index(c)}") if c in found else F.lit(0).cast("bigint")).alias("filled")) for c, kind in expected.items()]
    return counts.select(F.inline(F.array(*cells)))


def finished_only(df: DataFrame) -> DataFrame:
    """Drop walkovers, retirements and defaults; a missing score is kept."""
    return df.filter(~F.coalesce(F.col("score").rlike(UNFINISHED), F.lit(False)))


def both_ranked(df: DataFrame) -> DataFrame:
    return df.filter(F.col("winner_rank").isNotNull() & F.col("loser_rank").isNotNull())


def any_service_stat(df: DataFrame) -> DataFrame:
    present = [F.col(f"{side}_{s}") for side in ("w", "l") for s in STATS if f"{side}_{s}" in df.columns]
    return df.filter(F.coalesce(*present).isNotNull()) if present else df


def clean_matches(df: DataFrame) -> DataFrame:
    """The three cleaning filters, each skipped when its columns are absent."""
    if "score" in df.columns:
        df = finished_only(df)
    if {"winner_rank", "loser_rank"} <= set(df.columns):
        df = both_ranked(df)
    return any_service_stat(df)


def _side(df: DataFrame, own: str, other: str, label: int, long_own: str, long_other: str) -> Column:
    fields = [
        F.col(f"{long_own}_name").alias("player"), F.col(f"{long_other}_name").alias("opponent"),
        F.lit(label).alias("label"),
    ]
    for stat in STATS:
        if f"{own}_{stat}" in df.columns:
            fields += [F.col(f"{own}_{stat}").alias(stat), F.col(f"{other}_{stat}").alias(f"opponent_{stat}")]
    for extra in ("rank",):
        if f"{long_own}_{extra}" in df.columns:
            fields += [F.col(f"{long_own}_{extra}").alias(f"player_{extra}"),
                       F.col(f"{long_other}_{extra}").alias(f"opponent_{extra}")]
    return F.struct(*fields)


def two_sided(df: DataFrame, keep: Iterable[str] | None = None) -> DataFrame:
    """Two rows per match: the winner's view (label 1) and the loser's (label 0), one scan.

    ``keep`` limits the match columns carried along; all of them by default.
    """
    require_columns(df, ["winner_name", "loser_name", "tourney_date"])
    winner = _side(df, "w", "l", 1, "winner", "loser")
    loser = _side(df, "l", "w", 0, "loser", "winner")
    carried = list(df.columns if keep is None else keep)
    sides = df.select(*carried, F.explode(F.array(winner, loser)).alias("_side"))
    out = sides.select(*carried, "_side.*")
    if "tourney_level" in carried:
        out = out.withColumn("tourney_level", collapsed_level(F.col("tourney_level")))
    # the key uses the date as delivered; only then is the date brought to YYYYMMDD
    if "match_id" not in carried:
        out = out.withColumn("match_id", names.match_key(F.col("player"), F.col("opponent"), F.col("tourney_date")))
    kind = df.schema["tourney_date"].dataType
    return out.withColumn("tourney_date", dates.as_int_day(F.col("tourney_date"), kind))


def collapsed_level(level: Column) -> Column:
    """Levels ``B`` and ``500`` count as ``A``."""
    return F.when(level.isin("B", "500"), F.lit("A")).otherwise(level)


def picked_by_name(df: DataFrame) -> DataFrame:
    """Player and opponent columns from winner/loser columns by comparing names."""
    won = F.coalesce(F.col("player") == F.col("winner_name"), F.lit(False))

    def pick(w: str, l: str) -> Column:
        return F.when(won, F.col(w)).otherwise(F.col(l))

    new = {}
    for extra in ("ioc", "hand", "ht", "rank"):
        if f"winner_{extra}" in df.columns:
            new[f"player_{extra}"] = pick(f"winner_{extra}", f"loser_{extra}")
    if "winner_rank" in df.columns:
        new["opponent_rank"] = pick("loser_rank", "winner_rank")
    for stat in ("svpt", "1stIn", "1stWon", "2ndWon", "bpSaved", "bpFaced"):
        new[f"player_{stat}"] = pick(f"w_{stat}", f"l_{stat}")
        new[f"opponent_{stat}"] = pick(f"l_{stat}", f"w_{stat}")
    return df.withColumns(new)


def to_player_columns(df: DataFrame) -> DataFrame:
    """``ace`` to ``player_ace``, ``opponent_ace`` to ``opp_ace`` where the target is absent."""
    new = {}
    for stat in USED_STATS:
        for source, target in ((stat, f"player_{stat}"), (f"opponent_{stat}", f"opp_{stat}")):
            if source in df.columns and target not in df.columns:
                new[source] = target
    return df.withColumnsRenamed(new)


def with_base_columns(df: DataFrame) -> DataFrame:
    """Absent stats default to 0.0 and an absent surface to ``Hard``."""
    new = {}
    for side in ("player", "opp"):
        for stat in USED_STATS:
            if f"{side}_{stat}" not in df.columns:
                new[f"{side}_{stat}"] = F.lit(0.0)
    if "surface" not in df.columns:
        new["surface"] = F.lit("Hard")
    return df.withColumns(new) if new else df


def temporal_split(day: Column, train_until: int, validate_until: int) -> Column:
    return F.when(day <= train_until, "train").when(day <= validate_until, "validation").otherwise("test")


def displayable(df: DataFrame) -> DataFrame:
    """Rows fit for display: finished and with service points on both sides."""
    unfinished = F.coalesce(F.col("score").rlike("W/O|RET"), F.lit(False))
    return df.filter(~unfinished & (F.col("player_svpt") > 0) & (F.col("opp_svpt") > 0))


def before_date(df: DataFrame, cutoff: int | Column) -> DataFrame:
    return df.filter(F.col("tourney_date") < cutoff)


def coerced_history(df: DataFrame) -> DataFrame:
    """History rows for serving: label from the winner's name, gaps filled with defaults."""
    new = {"label": F.coalesce((F.col("player") == F.col("winner_name")).cast("double"), F.lit(0.0))}
    for side in ("player", "opp"):
        for stat in USED_STATS:
            default = 100.0 if stat == "svpt" else 0.0
            new[f"{side}_{stat}"] = F.coalesce(F.col(f"{side}_{stat}").cast("double"), F.lit(default))
    new["surface"] = F.coalesce("surface", F.lit("Hard"))
    return df.withColumns(new)


def with_request_rows(history: DataFrame, requests: DataFrame) -> DataFrame:
    """Append hypothetical matches (zero stats, label 0.5) so windows give their features."""
    zeros = {f"{side}_{stat}": F.lit(0.0) for side in ("player", "opp") for stat in USED_STATS}
    rows = requests.withColumns({**zeros, "label": F.lit(0.5), "is_request": F.lit(True)})
    return history.withColumn("is_request", F.lit(False)).unionByName(rows, allowMissingColumns=True)


def stable_swap(df: DataFrame, seed: int) -> DataFrame:
    """Seeded order of the two rows of a match: ``slot`` 0/1, swapped for about half of them."""
    digest = F.md5(F.concat_ws("/", F.col("match_id"), F.col("match_num"), F.lit(seed)))
    swap = F.substring(digest, -1, 1).isin(*"13579bdf").cast("int")
    first = (F.col("player") < F.col("opponent")).cast("int")
    return df.withColumn("slot", F.pmod(F.lit(1) - first + swap, F.lit(2)).cast("int"))
