"""Mixing documents to target weights with soft domain membership.

A softmax regression, fitted on a labelled table, gives every document a posterior over domains.
A document's rate says how often it enters the mixture; the rates are the nonnegative ones, near 1,
for which the expected tokens of each domain meet the targets in the least-squares sense. They are
found by projected gradient steps. A document's rate follows from its posterior and the steps taken
so far, which are a few numbers each, so an iteration is one aggregate over a narrow table.
"""

from __future__ import annotations

import warnings
import zlib
from typing import Iterable, Iterator, NamedTuple, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from courtlens.llm.common import by_bytes, stage

BUCKETS = 1 << 14
#: Labelled documents that the classifier is fitted on at most, those of the smallest hashes.
LABELLED = 5000
#: Steps of the descent, far more than it takes; a fit that needs more says so in a warning.
STEPS = 200
CLOSE = 1e-6
DOMAINS = ("high", "low", "toxic")
#: Share of the mixture's tokens that each domain shall have.
TARGETS = {"high": 0.70, "low": 0.22, "toxic": 0.08}


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain a label row stands for; null if it says nothing."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "high").when(quality == 0, "low")


# ---- features and classifier ---------------------------------------------------------------------


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, buckets, values) of each text: dampened counts of hashed words, of length 1."""
    for at, n in by_bytes(texts):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, n).fill_null("").cast(pa.string())))
        coded = lists.flatten().dictionary_encode()
        known = np.array([zlib.crc32(w.strip(".,;:!?").encode("utf-8")) % BUCKETS if w else -1 for w in coded.dictionary.to_pylist()], dtype=np.int64)
        bucket = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            own = bucket[a:b]
            counts = np.bincount(own[own >= 0], minlength=BUCKETS)
            held = np.flatnonzero(counts)
            values = np.log1p(counts[held])
            yield int(counts.sum()), held, values / max(1e-12, float(np.sqrt(values @ values)))


class Classifier(NamedTuple):
    weights: np.ndarray  # (BUCKETS + 1) x domains, the last row is the bias

    def posterior(self, held: np.ndarray, values: np.ndarray) -> np.ndarray:
        total = values @ self.weights[held] + self.weights[BUCKETS]
        odds = np.exp(total - total.max())
        return odds / odds.sum()


def fit(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], domains: int, rounds: int = 200, rate: float = 20.0, decay: float = 1e-4) -> Classifier:
    """Softmax regression by full-batch gradient descent with momentum; without rows all posteriors
    are equal."""
    weights = np.zeros((BUCKETS + 1, domains))
    if not rows:
        return Classifier(weights)
    owner = np.repeat(np.arange(len(rows)), [len(h) + 1 for h, _, _ in rows])
    bucket = np.concatenate([np.append(h, BUCKETS) for h, _, _ in rows])
    value = np.concatenate([np.append(v, 1.0) for _, v, _ in rows])
    wanted = np.eye(domains)[[k for _, _, k in rows]]
    pull = np.zeros_like(weights)
    for _ in range(rounds):
        total = np.column_stack([np.bincount(owner, weights[bucket, k] * value, minlength=len(rows)) for k in range(domains)])
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        error = (odds / odds.sum(axis=1, keepdims=True) - wanted) / len(rows)
        slope = np.column_stack([np.bincount(bucket, error[owner, k] * value, minlength=BUCKETS + 1) for k in range(domains)])
        pull = 0.9 * pull - rate * 0.1 * (slope + decay * weights)
        weights = weights + pull
    return Classifier(weights)


def train(docs: DataFrame, labelled: DataFrame, domains: Sequence[str] = DOMAINS,
          id_column: str = "doc_id", text_column: str = "text") -> Classifier:
    """Classifier from ``labelled`` (doc_id, domain): labels of other domains or without a document
    are left out; an id with several labels takes the first in order. ``LABELLED`` bounds the sample."""
    labels = labelled.where(F.col("domain").isin(list(domains)) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).join(F.broadcast(chosen), "doc_id").select("domain", "text")

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(features(batch.column("text")))
            yield pa.RecordBatch.from_pydict({
                "domain": batch.column("domain"), "held": pa.array([h.tolist() for _, h, _ in made], pa.list_(pa.int64())),
                "values": pa.array([v.tolist() for _, _, v in made], pa.list_(pa.float64()))})

    rows = texts.mapInArrow(reduce, "domain string, held array<bigint>, values array<double>").toPandas()
    rows = sorted(zip(rows["domain"], rows["held"], rows["values"]), key=lambda r: (r[0], tuple(r[1]), tuple(r[2])))
    return fit([(np.asarray(h, dtype=np.int64), np.asarray(v, dtype=np.float64), list(domains).index(d)) for d, h, v in rows], len(domains))


def memberships(docs: DataFrame, model: Classifier, domains: Sequence[str] = DOMAINS,
                id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, p_<domain> ...) per row; a text without a word has the bias' posterior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = dict(inner.dtypes)["doc_id"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(n, shared.value.posterior(h, v)) for n, h, v in features(batch.column("text"))]
            p = np.array([x for _, x in made]).reshape(len(made), len(domains))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), *[pa.array(p[:, k]) for k in range(len(domains))]],
                ["doc_id", "n_tokens", *[f"p_{d}" for d in domains]])

    return inner.mapInArrow(work, f"doc_id {kind}, n_tokens long, " + ", ".join(f"p_{d} double" for d in domains))


# ---- rates ---------------------------------------------------------------------------------------


def rate_after(steps: Sequence[np.ndarray], domains: Sequence[str] = DOMAINS) -> Column:
    """A document's rate: 1, less each step's gradient for its posterior, cut off at 0 each time."""
    rate = F.lit(1.0)
    for step in steps:
        slope = sum((F.col(f"p_{d}") * float(u) for d, u in zip(domains, step)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - slope)
    return rate


def _totals(members: DataFrame, trials: Sequence[Sequence[np.ndarray]], domains: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each trial, expected tokens of each domain and the domains' Gram matrix over documents
    whose rate is above 0; one aggregate for all."""
    frame = members.select("n_tokens", *[f"p_{d}" for d in domains], *[rate_after(t, domains).alias(f"r{i}") for i, t in enumerate(trials)])
    sums = []
    for i in range(len(trials)):
        for d in domains:
            sums.append(F.sum(F.col("n_tokens") * F.col(f"r{i}") * F.col(f"p_{d}")))
        for d in domains:
            for e in domains:
                sums.append(F.sum(F.when(F.col(f"r{i}") > 0, F.col("n_tokens") * F.col(f"p_{d}") * F.col(f"p_{e}"))))
    values = np.array([x or 0.0 for x in frame.agg(*sums).first()])
    k = len(domains)
    return [(part[:k], part[k:].reshape(k, k)) for part in values.reshape(len(trials), k + k * k)]


def fit_rates(members: DataFrame, targets: dict[str, float], domains: Sequence[str] = DOMAINS) -> list[np.ndarray]:
    """Steps of the projected gradient descent on the squared miss of the targets.

    Targets are shares of the tokens there are. A step is the gradient, for documents weighted by
    their tokens, scaled by the inverse Gram matrix of the domains; shorter ones and the plain
    gradient step are tried in the same pass and the best is taken. It ends when the miss is below
    ``CLOSE`` of the tokens or no step helps, which is the least-squares point if targets cannot be met.
    """
    wanted = np.array([targets[d] for d in domains], dtype=float)
    wanted = wanted / wanted.sum()
    steps: list[np.ndarray] = []
    (now, gram), = _totals(members, [steps], domains)
    tokens = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    if tokens == 0:
        return steps
    goal = wanted * tokens
    while True:
        miss = now - goal
        if np.abs(miss).max() <= CLOSE * tokens:
            break
        if len(steps) >= STEPS:
            warnings.warn(f"mixing rates after {STEPS} steps miss the targets by {np.abs(miss).max() / tokens:.2g} of the tokens", stacklevel=2)
            break
        newton = np.linalg.pinv(gram / tokens, rcond=1e-9) @ miss / tokens
        plain = miss / tokens / max(1e-12, float(np.linalg.eigvalsh(gram / tokens).max()))
        trials = [newton, newton / 2, newton / 8, plain, plain / 4]
        results = _totals(members, [[*steps, t] for t in trials], domains)
        best = min(range(len(trials)), key=lambda i: float(((results[i][0] - goal) ** 2).sum()))
        if ((results[best][0] - goal) ** 2).sum() >= (miss ** 2).sum() * (1 - 1e-9):
            break
        steps.append(trials[best])
        now, gram = results[best]
    return steps


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, domains: Sequence[str] = DOMAINS,
          id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, p_<domain> ..., rate) per row.

    Null and empty texts have no tokens and still a rate; repeated rows have equal rates; without
    labels all posteriors are equal. An empty table gives an empty result. Other columns are not read.
    """
    model = train(docs, labelled, domains, id_column, text_column)
    members = stage(memberships(docs, model, domains, id_column, text_column), "memberships")
    return members.withColumn("rate", rate_after(fit_rates(members, targets, domains), domains))


def sampled(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, seed: int = 7,
            id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The mixture: every row of ``docs`` as often as its rate says, all columns.

    The fraction of a rate is drawn by a hash of id and text, and for a null id of the row's place
    in its task too, so that a rerun gives the same rows and the expected tokens are those of the
    rates.
    """
    model = train(docs, labelled, DOMAINS, id_column, text_column)
    members = stage(memberships(docs, model, DOMAINS, id_column, text_column), "memberships")
    steps = fit_rates(members, targets, DOMAINS)
    shared = docs.sparkSession.sparkContext.broadcast((model, steps))
    id_at, text_at = docs.columns.index(id_column), docs.columns.index(text_column)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier, taken = shared.value
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, n in by_bytes(batch.column(text_at)):
                part = batch.slice(at, n)
                texts, copies = part.column(text_at), []
                for doc, text, (_, held, values) in zip(part.column(id_at).to_pylist(), texts, features(texts)):
                    p, rate = classifier.posterior(held, values), 1.0
                    for step in taken:
                        rate = max(0.0, rate - float(p @ step))
                    row += 1
                    own = zlib.crc32(text.as_buffer() if text.is_valid else b"", zlib.crc32(f"{seed}:{f'{task}-{row}' if doc is None else doc}:".encode()))
                    copies.append(int(rate) + (own / 2**32 < rate - int(rate)))
                yield part.take(pa.array(np.repeat(np.arange(n), copies)))

    return docs.mapInArrow(work, docs.schema)
