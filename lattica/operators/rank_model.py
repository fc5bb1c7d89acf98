"""Piecewise-linear models of a point's rank within its partition, fitted one partition to a task.

Everything that a fit needs of the points are sums over the values from a break on: of 1, x, x * x, rank and
rank * x. They are made once, so a trial of other breaks costs the same whatever the number of points.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.geometry import piecewise

RATES = (0.1, 0.05, 0.01, 0.001)


def first_breaks(x: np.ndarray, breaks: int) -> np.ndarray:
    """The values at equal steps of the rank."""
    return x[np.floor(np.arange(breaks) * len(x) / breaks).astype(int)].astype(float)


@dataclass
class Ranks:
    """Ascending values and their ranks, as sums from any place to the end. Values are taken as shares of their range."""

    x: np.ndarray
    low: float = field(init=False)
    span: float = field(init=False)

    def __post_init__(self):
        self.low = float(self.x[0])
        self.span = float(self.x[-1] - self.x[0]) or 1.0
        self.t = (self.x - self.low) / self.span
        t, y = self.t.astype(np.longdouble), np.arange(len(self.x), dtype=np.longdouble)
        from_here = lambda v: np.append(np.cumsum(v[::-1])[::-1], 0)
        self.n, self.st, self.stt, self.sy, self.syt = map(from_here, (np.ones_like(t), t, t * t, y, y * t))
        self.yy = float((y * y).sum())

    def share(self, beta: np.ndarray) -> np.ndarray:
        return (beta - self.low) / self.span

    def normal(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A'A and A'y for a constant and a hinge max(0, t - b) for each break."""
        p = np.searchsorted(self.t, b, side="left")
        q = np.maximum(p[:, None], p[None, :])
        m = len(b)
        gram, right = np.empty((m + 1, m + 1)), np.empty(m + 1)
        gram[0, 0], right[0] = self.n[0], self.sy[0]
        gram[0, 1:] = gram[1:, 0] = self.st[p] - b * self.n[p]
        gram[1:, 1:] = self.stt[q] - (b[:, None] + b[None, :]) * self.st[q] + b[:, None] * b[None, :] * self.n[q]
        right[1:] = self.syt[p] - b * self.sy[p]
        return gram, right

    def error(self, gram: np.ndarray, right: np.ndarray, alpha: np.ndarray) -> float:
        return max(0.0, self.yy - 2 * float(right @ alpha) + float(alpha @ gram @ alpha))

    def solve(self, b: np.ndarray) -> tuple[np.ndarray, float]:
        """Least squares for the given breaks, and the squared error; breaks that coincide do no harm."""
        gram, right = self.normal(b)
        alpha = np.linalg.lstsq(gram, right, rcond=1e-14)[0]
        return alpha, self.error(gram, right, alpha)

    def solve_rising(self, b: np.ndarray) -> tuple[np.ndarray, float]:
        """The same among models that never fall: the slopes between breaks are held to 0 or more."""
        gram, right = self.normal(b)
        m = len(b)
        sums = np.eye(m + 1)  # alpha from the constant and the slopes
        sums[np.arange(2, m + 1), np.arange(1, m)] = -1.0
        slopes = not_negative(sums.T @ gram @ sums, sums.T @ right)
        alpha = sums @ slopes
        return alpha, self.error(gram, right, alpha)

    def step(self, b: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        """Newton's step for the breaks: -Y^-1 g, or -g where Y is singular."""
        p = np.searchsorted(self.t, b, side="left")
        q = np.maximum(p[:, None], p[None, :])
        error = alpha[0] * self.n[p] + ((self.st[q] - b[None, :] * self.n[q]) * alpha[None, 1:]).sum(1) - self.sy[p]
        g = (-2 * alpha[1:] * error).astype(float)
        curvature = (2 * alpha[1:, None] * alpha[None, 1:] * self.n[q]).astype(float)
        try:
            step = -np.linalg.solve(curvature, g)
        except np.linalg.LinAlgError:
            return -g
        return step if np.isfinite(step).all() else -g

    def slopes(self, alpha: np.ndarray) -> np.ndarray:
        """alpha for values instead of shares."""
        return np.append(alpha[:1], alpha[1:] / self.span)


def not_negative(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least squares in which all but the first unknown are 0 or more, by an active set."""
    size = len(right)
    free, x = np.zeros(size, bool), np.zeros(size)
    free[0] = True
    scale = np.abs(right).max(initial=1.0)
    for _ in range(10 * size):
        while True:
            z = np.zeros(size)
            z[free] = np.linalg.lstsq(gram[np.ix_(free, free)], right[free], rcond=1e-14)[0]
            under = free & (z < 0)
            under[0] = False
            if not under.any():
                break
            # As far towards z as none falls below 0; what reaches 0 is held there.
            share = np.min(x[under] / (x[under] - z[under]))
            x = x + share * (z - x)
            held = under & (x <= 1e-15)
            x[held], free[held] = 0.0, False
        x = z
        pull = np.where(free, -np.inf, right - gram @ x)
        best = int(np.argmax(pull))
        if pull[best] <= 1e-12 * scale:
            break
        free[best] = True
    return x


def rises(alpha: np.ndarray) -> bool:
    """Whether no piece falls: the slopes' running sums are not negative."""
    return bool((np.cumsum(alpha[1:]) >= -1e-9 * np.abs(alpha[1:]).max(initial=1.0)).all())


def fit(x: np.ndarray, breaks: int, least_gain: float = 1e-3, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray, float, float]:
    """alpha, beta, loss and first loss of a rank model of ascending values.

    A step is taken at the largest rate that lowers the loss and keeps the model rising; the search ends when none
    does, or gains too little. Should the first model fall somewhere, its slopes are fitted to rise; so no model
    falls. rounds=0 gives the first model.
    """
    ranks = Ranks(x)
    beta = first_breaks(x, breaks)
    b = ranks.share(beta)
    alpha, loss = ranks.solve(b)
    if not rises(alpha):
        alpha, loss = ranks.solve_rising(b)
    first = loss
    for _ in range(rounds):
        step, better = ranks.step(b, alpha), None
        for rate in RATES:
            moved = np.sort(b + rate * step)
            found, cost = ranks.solve(moved)
            if rises(found) and cost < loss:
                better = moved, found, cost
                break
        if better is None:
            break
        gain = loss - better[2]
        b, alpha, loss = better
        beta = ranks.low + b * ranks.span
        if gain < least_gain:
            break
    return ranks.slopes(alpha), beta, loss, first


def train(ranked: DataFrame, breaks: int = 10, part: str = "part", value: str = "mapping", rounds: int = 1000) -> DataFrame:
    """part, alpha, beta, loss, first_loss, monotone, n: a model for each partition, each in its own task.

    A partition has N / K rows; K grows with N, so that one fits a task.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(rows[value].to_numpy(float))
        alpha, beta, loss, first = fit(x, breaks, rounds=rounds)
        return pd.DataFrame({"part": [int(rows[part].iloc[0])], "alpha": [alpha.tolist()], "beta": [beta.tolist()], "loss": [loss], "first_loss": [first], "monotone": [rises(alpha)], "n": [len(x)]})

    schema = "part int, alpha array<double>, beta array<double>, loss double, first_loss double, monotone boolean, n bigint"
    return ranked.select(F.col(part).cast("int").alias(part), value).groupBy(part).applyInPandas(one, schema)


def predicted(x: Column, alpha: Column, beta: Column) -> Column:
    return piecewise(x, alpha, beta)


def shard_of(x: Column, alpha: Column, beta: Column, psi: int) -> Column:
    """The shard of psi expected rows that the model puts a mapped value into."""
    return F.floor(predicted(x, alpha, beta) / F.lit(float(psi)))


def shards_between(low: Column, high: Column, alpha: Column, beta: Column, psi: int) -> tuple[Column, Column]:
    """The first and last shard that a value from low to high can be put into, whether or not the model rises.

    A piecewise-linear function is least and greatest at the ends or at breaks between them. A share of 1e-9 is left
    for rounding: a shard too many is looked into rather than one too few.
    """
    inner = F.filter(beta, lambda b: (b > low) & (b < high))
    values = F.transform(F.concat(F.array(low, high), inner), lambda x: predicted(x, alpha, beta))
    least, most = F.array_min(values), F.array_max(values)
    slack = (F.abs(least) + F.abs(most) + 1) * 1e-9
    return F.floor((least - slack) / psi).cast("long"), F.floor((most + slack) / psi).cast("long")


def squared_error(f: Column, rank: Column) -> Column:
    """Aggregate: the sum of squared residuals."""
    return F.sum((f - rank) * (f - rank))
