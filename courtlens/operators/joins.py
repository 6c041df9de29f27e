"""Equi joins of feature tables and of predictions with match details."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from courtlens.operators.timeline import one_per_key

ROW_KEYS = ("player", "opponent", "match_id", "tourney_date", "match_num")
INFO = ("tourney_name", "tourney_id", "tourney_level", "surface", "round")


def feature_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = ROW_KEYS) -> DataFrame:
    return left.join(right, list(keys), "left")


def first_match_join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[Column],
                     values: Sequence[str]) -> DataFrame:
    """Left join against the first right row per key, so the left side keeps its rows one to one."""
    single = one_per_key(right, keys, order).select(*keys, *values)
    return left.join(single, list(keys), "left")


def with_match_info(predictions: DataFrame, matches: DataFrame, key: Sequence[str] = ("match_id",)) -> DataFrame:
    """Match details by id (first row wins); unknown ids get blanks."""
    order = [F.col("match_num")] if "match_num" not in key else [F.col(key[0])]
    info = one_per_key(matches.select(*{*key, "match_num"}, *INFO), list(key), order).select(*key, *INFO)
    return predictions.join(info, list(key), "left").withColumns({c: F.coalesce(c, F.lit("")) for c in INFO})
