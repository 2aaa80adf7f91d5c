"""Hidden Markov chains over several features, fitted to many series at once.

Each round, tasks run the forward-backward pass over their series and return its sufficient statistics, Spark adds them up, and the driver
turns the sums, whose number depends on states and features alone, into the next parameters. A series is as long as there are dates.
Series are packed into one row each, written once for all rounds, and a task takes a block of them through each step together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.sources import scratch

#: Steps of the series that are taken together.
BLOCK_STEPS = 200_000


@dataclass
class Chain:
    """Start and transition probabilities, and each state's mean and covariance; ``history``: what each round's parameters made of the data."""

    start: np.ndarray
    move: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    ridge: float
    history: tuple[float, ...] = ()

    def log_density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.start)))
        for k, (m, c) in enumerate(zip(self.means, self.covariances, strict=True)):
            root = np.linalg.cholesky(c)
            z = np.linalg.solve(root, (x - m).T)
            out[:, k] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out

    def passes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Chances of the states at each step, expected transitions, and the log-likelihood of one series."""
        n, k = len(x), len(self.start)
        log = self.log_density(x)
        top = log.max(axis=1)
        like = np.exp(log - top[:, None])
        alpha, beta, scale = np.empty((n, k)), np.ones((n, k)), np.empty(n)
        for t in range(n):
            a = (self.start if t == 0 else alpha[t - 1] @ self.move) * like[t]
            scale[t] = a.sum()
            alpha[t] = a / scale[t]
        for t in range(n - 2, -1, -1):
            beta[t] = self.move @ (like[t + 1] * beta[t + 1]) / scale[t + 1]
        pairs = self.move * (alpha[:-1].T @ (like[1:] * beta[1:] / scale[1:, None]))
        return alpha * beta, pairs, float(np.log(scale).sum() + top.sum())

    def passes_together(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """:meth:`passes` over series that follow one another in ``x``, the longest first: all of them at one step after another. The transitions and likelihoods are summed."""
        k = len(self.start)
        log = self.log_density(x)
        top = log.max(axis=1)
        like = np.exp(log - top[:, None])
        first = np.cumsum(lengths) - lengths
        # Series that have a step t are a prefix, as the longest come first.
        alive = [first[: np.searchsorted(-lengths, -t, side="left")] + t for t in range(int(lengths[0]))]
        alpha, beta, scale = np.empty((len(x), k)), np.ones((len(x), k)), np.empty(len(x))
        for t, at in enumerate(alive):
            a = (self.start if t == 0 else alpha[at - 1] @ self.move) * like[at]
            scale[at] = a.sum(axis=1)
            alpha[at] = a / scale[at, None]
        pairs = np.zeros((k, k))
        for at in alive[:0:-1]:
            ahead = like[at] * beta[at] / scale[at, None]
            beta[at - 1] = ahead @ self.move.T
            pairs += alpha[at - 1].T @ ahead
        return alpha * beta, self.move * pairs, float(np.log(scale).sum() + top.sum())

    def statistics(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        g, pairs, log = self.passes_together(x, lengths)
        outer = np.stack([(x * g[:, k, None]).T @ x for k in range(g.shape[1])])
        return np.concatenate([[log], g[np.cumsum(lengths) - lengths].sum(axis=0), pairs.ravel(), g.sum(axis=0), (g.T @ x).ravel(), outer.ravel()])

    def penalty(self) -> float:
        """What the ridge takes off: it keeps a state from closing in on a few points, and a round never lowers the likelihood less this."""
        return 0.5 * self.ridge * float(sum(np.trace(np.linalg.inv(c)) for c in self.covariances))

    def after(self, sums: np.ndarray) -> Chain:
        k, f = self.means.shape
        parts = np.split(sums, np.cumsum([1, k, k * k, k, k * f]))
        log, start, pairs, mass, first, second = parts[0][0], parts[1], parts[2].reshape(k, k), parts[3], parts[4].reshape(k, f), parts[5].reshape(k, f, f)
        held = np.maximum(mass, 1e-12)
        means = np.where(mass[:, None] > 1e-9, first / held[:, None], self.means)
        cov = second / held[:, None, None] - np.einsum("ki,kj->kij", means, means) + self.ridge * np.eye(f) / held[:, None, None]
        cov = np.where(mass[:, None, None] > 1e-9, (cov + cov.transpose(0, 2, 1)) / 2, self.covariances)
        out = pairs.sum(axis=1, keepdims=True)
        move = np.where(out > 1e-12, pairs / np.maximum(out, 1e-300), self.move)
        return Chain(start / start.sum(), move, means, cov, self.ridge, (*self.history, float(log) - self.penalty()))


def first_guess(rows: DataFrame, names: tuple[str, ...], states: int, ridge: float) -> Chain:
    """States at the quantiles of the first feature: each slice's means, and the covariance of all rows."""
    cuts = rows.agg(F.percentile(names[0], [k / states for k in range(1, states)]).alias("p")).first()["p"] or [0.0] * (states - 1)
    slice_of = sum((F.when(F.col(names[0]) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    found = {r["k"]: r for r in rows.groupBy(slice_of.alias("k")).agg(*[F.avg(c).alias(c) for c in names]).collect()}
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    cov = rows.agg(*[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs], *[F.avg(c).alias(c) for c in names]).first()
    full = np.array([[cov[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))]) + 1e-6 * np.eye(len(names))
    means = np.array([[(found[k][c] if k in found else cov[c]) or 0.0 for c in names] for k in range(states)])
    stay = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(stay, 0.9 if states > 1 else 1.0)
    return Chain(np.full(states, 1 / states), stay, means, np.repeat(full[None], states, axis=0), ridge)


def packed(rows: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """(key, t, features): one row for each series, its steps as arrays in the order of t."""
    steps = F.sort_array(F.collect_list(F.struct("t", *names)))
    return rows.groupBy(key).agg(steps.alias("s")).select(key, *[F.col(f"s.{c}").alias(c) for c in ("t", *names)])


def _blocks(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of packed series, the longest first, of about ``BLOCK_STEPS`` steps, with their lengths and all their steps' features."""
    lengths = np.diff(batch.column("t").offsets.to_numpy())
    order = np.argsort(-lengths, kind="stable")
    cuts = np.cumsum(lengths[order]) // BLOCK_STEPS
    for own in np.split(order, np.flatnonzero(np.diff(cuts)) + 1):
        if len(own):
            part = batch.take(pa.array(own))
            yield part, lengths[own], np.stack([part.column(c).flatten().to_numpy(zero_copy_only=False) for c in names], axis=1)


def _sums(chain: Chain, names: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sum(chain.statistics(x, lengths) for batch in batches for _, lengths, x in _blocks(batch, names))
        if isinstance(found, np.ndarray):
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(found), dtype=np.int32), "v": found})

    return run


def fit_chain(rows: DataFrame, key: str, names: tuple[str, ...], states: int = 3, rounds: int = 20, tolerance: float = 1e-6, ridge: float = 1e-3) -> Chain:
    """Baum-Welch over the series (key, t, features) without nulls; states are numbered by the rising mean of the first feature.

    Stops where a round gains less than ``tolerance`` of the likelihood's size. ``rows`` are read for the first guess and packed once: pass a written table."""
    chain = first_guess(rows, names, states, ridge)
    series = scratch.written(packed(rows, key, names), "series")
    for _ in range(rounds):
        total = series.mapInArrow(_sums(chain, names), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        if not total:
            break
        chain = chain.after(np.array([r["v"] for r in sorted(total, key=lambda r: r["i"])]))
        if len(chain.history) > 1 and chain.history[-1] - chain.history[-2] < tolerance * abs(chain.history[-1]):
            break
    order = np.argsort(chain.means[:, 0], kind="stable")
    return Chain(chain.start[order], chain.move[np.ix_(order, order)], chain.means[order], chain.covariances[order], chain.ridge, chain.history)


def decoded(rows: DataFrame, key: str, names: tuple[str, ...], chain: Chain) -> DataFrame:
    """(key, t, state, p): the likeliest state at each step, and its chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, lengths, x in _blocks(batch, names):
                g = chain.passes_together(x, lengths)[0]
                keys = part.column(key).take(pa.array(np.repeat(np.arange(len(lengths)), lengths)))
                yield pa.RecordBatch.from_pydict({key: keys, "t": part.column("t").flatten(), "state": g.argmax(axis=1), "p": g.max(axis=1)})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return packed(rows, key, names).mapInArrow(run, f"{key} {kinds[key]}, t {kinds['t']}, state long, p double")


def current_regimes(states: DataFrame, key: str, last: int = 5) -> DataFrame:
    """(key, state, p, n): the state most of a series' last ``last`` steps were in, ties to the lesser, and its mean chance."""
    recent = states.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("t")))).where(F.col("k") <= last)
    by = recent.groupBy(key, "state").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"))
    best = F.min_by(F.struct("state", "p", "n"), F.struct(-F.col("n"), F.col("state")))
    return by.groupBy(key).agg(best.alias("b")).select(key, "b.*")

