"""URL filter: rules for hosts and paths first, a logistic regression for all other addresses.

The regression reads hashed character n-grams of host and path. It is trained on a small labelled
table of addresses; how many rows it may take is ``LABELLED``, so the fit fits the driver whatever
the size of the table. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from typing import Iterable, Iterator, NamedTuple, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from courtlens.llm.common import lower_ascii

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
#: Labelled addresses used by the fit at most, those of the smallest hashes.
LABELLED = 20_000


class Rule(NamedTuple):
    """``name`` is host and path prefix as one string, such as ``example.com/en/``."""

    verdict: str
    name: str

    @property
    def host(self) -> str:
        return self.name.partition("/")[0]

    @property
    def path(self) -> str:
        return self.name[len(self.host):]


# Fixed values.
RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"),
         Rule("block", "net/es/"), Rule("block", "net/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest rule whose host equals or contains the host as a subdomain and whose
    path begins the path; null if none fits. The rule list is an argument of the program, not data."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.lit(rule.name)).otherwise(chosen)
    return chosen


def verdict_of(rule: Column, rules: Sequence[Rule]) -> Column:
    out = F.lit(None).cast("string")
    for one in rules:
        out = F.when(rule == one.name, F.lit(one.verdict)).otherwise(out)
    return out


# ---- the regression ------------------------------------------------------------------------------


def features(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct n-gram of each address; host and path hash apart."""
    rows, buckets = [], []
    for side, texts in enumerate((hosts, paths)):
        codes = [np.frombuffer(f"^{t}$".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) for t in texts]
        starts = np.cumsum([0] + [len(c) for c in codes])
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(codes)), np.diff(starts))
        value = np.full(len(flat), 7 + side, dtype=np.uint64)
        for n in range(1, max(SIZES) + 1):
            if len(flat) < n:
                break
            value = value[:len(flat) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + flat[n - 1:]
            if n in SIZES:
                inside = owner[:len(value)] == owner[n - 1:]
                mixed = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                rows.append(owner[:len(value)][inside])
                buckets.append((mixed >> np.uint64(48)).astype(np.int64)[inside])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(buckets))
    return pairs // BUCKETS, pairs % BUCKETS


class Regression(NamedTuple):
    weights: np.ndarray
    bias: float

    def scores(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """Probability of block."""
        rows, buckets = features(hosts, paths)
        n = np.maximum(np.bincount(rows, minlength=len(hosts)), 1)
        total = np.bincount(rows, self.weights[buckets], minlength=len(hosts)) / np.sqrt(n) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(hosts: Sequence[str], paths: Sequence[str], block: Sequence[bool], rounds: int = 300,
        rate: float = 2.0, decay: float = 1e-4) -> Regression:
    """Full-batch gradient descent with momentum and balanced classes. With no row, or one class
    only, the bias alone decides: allow without a row, else that class."""
    y = np.asarray(block, dtype=np.float64)
    weights, bias = np.zeros(BUCKETS), 0.0
    if not len(y) or y.min() == y.max():
        return Regression(weights, -1.0 if not len(y) or y[0] == 0 else 1.0)
    rows, buckets = features(hosts, paths)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))[rows]
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    pull, pull_bias = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        total = np.bincount(rows, weights[buckets] * scale, minlength=len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - y) * share
        pull = 0.9 * pull - rate * (np.bincount(buckets, error[rows] * scale, minlength=BUCKETS) + decay * weights)
        pull_bias = 0.9 * pull_bias - rate * error.sum()
        weights, bias = weights + pull, bias + pull_bias
    return Regression(weights, bias)


def labelled_by_rules(pages: DataFrame, rules: Sequence[Rule] = RULES, url_column: str = "url") -> DataFrame:
    """The labelled table the rules give: distinct (host, path, block) of addresses that a rule judges."""
    url = F.col(url_column)
    parts = pages.select(host_of(url).alias("host"), path_of(url).alias("path"))
    return parts.withColumn("verdict", verdict_of(matched_rule(F.col("host"), F.col("path"), rules), rules)).where(
        "verdict IS NOT NULL").select("host", "path", (F.col("verdict") == "block").alias("block")).distinct()


def train(labelled: DataFrame) -> Regression:
    """Fit on (host, path, block), at most ``LABELLED`` rows, chosen by hash so that a rerun agrees."""
    rows = labelled.orderBy(F.xxhash64("host", "path"), "host", "path", "block").limit(LABELLED).collect()
    return fit([r.host for r in rows], [r.path for r in rows], [r.block for r in rows])



def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule] = RULES,
          id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    A null address or one without ``://`` has empty host and path and is judged by the regression
    like any other. Ties between rules cannot occur, as equally long rules of one host differ in
    their path. Repeated rows are judged alike; other columns are not read.
    """
    model = pages.sparkSession.sparkContext.broadcast(train(labelled))
    url = F.col(url_column)
    parts = pages.select(F.col(id_column).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    parts = parts.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))

    def add_scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.scores(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    kind = dict(parts.dtypes)["page_id"]
    scored = parts.mapInArrow(add_scores, f"page_id {kind}, host string, path string, rule string, score double")
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce(verdict_of(F.col("rule"), rules), by_model).alias("verdict"), "score")
