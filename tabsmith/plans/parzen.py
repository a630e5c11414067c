"""Model-based search over parameters: a tree-structured Parzen estimator, and successive halving over folds.

Trials are split by value into a good and a bad part.  For each parameter both parts give a density, a mixture of one
kernel for each trial and a flat one; new values are drawn from the good density, and the draw where it exceeds the bad
one most is tried.  A trial first gets some folds, and goes on to the others only while it is among the best that came
that far.

Everything follows from the seed, the number of a trial and the trials before it.  So a search that is taken up again
from its table of trials goes on as if it had not stopped.
"""

from __future__ import annotations

import json
import math
import time
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from tabsmith.functions.space import Choice, Real, Space, draw, normal

TRIALS = "trial int, state string, value double, folds array<double>, params string, seconds double"


def _kernels(d: Real, values: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Centres and widths of a mixture: a kernel for each value as wide as the gap beside it, and one over the whole range."""
    low, high = d.bounds()
    at = np.append(d.inner(values), (low + high) / 2)
    order = np.argsort(at, kind="stable")
    edge = np.concatenate(([low], at[order], [high]))
    wide = np.empty(len(at))
    wide[order] = np.maximum(edge[1:-1] - edge[:-2], edge[2:] - edge[1:-1])
    wide = np.clip(wide, (high - low) / min(100.0, 1.0 + len(at)), high - low)
    wide[-1] = high - low
    return at, wide


def suggest(space: Space, tried: Sequence[tuple[dict, float]], rng: np.random.Generator, first: int = 10, draws: int = 24) -> dict:
    """Parameters for the next trial; ``tried`` has parameters and values, larger ones being better."""
    if len(tried) < first:
        return draw(space, rng)
    order = sorted(range(len(tried)), key=lambda i: (-tried[i][1], i))
    n = min(25, math.ceil(0.1 * len(tried)))
    good, bad = [tried[i][0] for i in order[:n]], [tried[i][0] for i in order[n:]]
    out = {}
    for name, d in space.items():
        a, b = [p[name] for p in good], [p[name] for p in bad]
        if isinstance(d, Choice):
            x, y = d.shares(a), d.shares(b)
            some = rng.choice(len(d.options), size=draws, p=x)
            out[name] = d.options[int(some[np.argmax(x[some] / y[some])])]
            continue
        (at, wide), (low, high) = _kernels(d, a), d.bounds()
        kernel = rng.integers(len(at), size=draws)
        # Draws outside the range are drawn again from the same kernel, by its distribution function.
        p, q = normal((low - at[kernel]) / wide[kernel]), normal((high - at[kernel]) / wide[kernel])
        some = np.clip(at[kernel] + wide[kernel] * _quantile(p + rng.random(draws) * (q - p)), low, high)
        gain = d.log_density(some, at, wide) - d.log_density(some, *_kernels(d, b))
        out[name] = d.value(float(some[np.argmax(gain)]))
    return out


def _quantile(p: np.ndarray) -> np.ndarray:
    """Quantiles of the normal distribution, by halving."""
    low, high = np.full(len(p), -40.0), np.full(len(p), 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = normal(middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


@dataclass
class Trial:
    trial: int
    params: dict
    folds: list[float] = field(default_factory=list)
    state: str = "complete"  # complete, stopped (by halving) or failed
    seconds: float = 0.0

    @property
    def value(self) -> float | None:
        return float(np.mean(self.folds)) if self.folds and self.state != "failed" else None


class TrialTable:
    """Trials of a search, in a Parquet table at ``path`` if one is given; each trial is appended when it ends."""

    def __init__(self, spark: SparkSession | None = None, path: str | None = None):
        self.spark, self.path, self.trials = spark, path, []
        if path:
            try:
                rows = spark.read.schema(TRIALS).parquet(path).orderBy("trial").collect()
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e.getCondition()):
                    raise
                rows = []
            self.trials = [Trial(r["trial"], json.loads(r["params"]), list(r["folds"]), r["state"], r["seconds"]) for r in rows]

    def add(self, t: Trial) -> None:
        self.trials.append(t)
        if self.path:
            self.rows([t]).coalesce(1).write.mode("append").parquet(self.path)

    def rows(self, trials: Sequence[Trial] | None = None, spark: SparkSession | None = None):
        found = self.trials if trials is None else trials
        return (spark or self.spark).createDataFrame(
            [(t.trial, t.state, t.value, [float(x) for x in t.folds], json.dumps(t.params), float(t.seconds)) for t in found], TRIALS)


def rungs(k: int) -> list[int]:
    """Folds after which a trial is compared: one, half of them, all."""
    return sorted({1, -(-k // 2), k})


def goes_on(folds: Sequence[float], others: Sequence[Sequence[float]], keep: float = 1 / 3) -> bool:
    """Whether a trial's mean is among the best ``keep`` of the trials that had as many folds (it always is among the first three)."""
    n = len(folds)
    means = sorted((float(np.mean(o[:n])) for o in others if len(o) >= n), reverse=True)
    if len(means) < 3:
        return True
    return float(np.mean(folds)) >= means[max(0, math.ceil(keep * (len(means) + 1)) - 1)]


def search(objective: Callable[[dict, Sequence[int]], list[float]], space: Space, trials: int, k: int = 1, table: TrialTable | None = None,
           seconds: float | None = None, seed: int = 42, defaults: dict | None = None, halving: bool = True) -> TrialTable:
    """Try parameters until the table holds ``trials`` trials; ``objective(params, folds)`` gives a value for each fold asked for.

    Larger values are better.  A trial whose objective raises is kept as failed, with a warning, and counts as worse than
    all others.  ``seconds`` limits this call, checked between trials.
    """
    table, start = table or TrialTable(), time.time()
    while len(table.trials) < trials:
        number = len(table.trials)
        rng = np.random.default_rng([seed, number])
        worst = min((t.value for t in table.trials if t.value is not None), default=0.0)
        tried = [({n: _listed(t.params[n]) for n in space}, worst - 1.0 if t.value is None else t.value) for t in table.trials]
        t = Trial(number, {**(defaults or {}), **suggest(space, tried, rng)})
        begun = time.time()
        try:
            for rung in rungs(k):
                t.folds += objective(t.params, range(len(t.folds), rung))
                if halving and rung < k and not goes_on(t.folds, [o.folds for o in table.trials if o.state != "failed"]):
                    t.state = "stopped"
                    break
        except Exception as e:  # one bad draw does not end the search
            t.state = "failed"
            warnings.warn(f"trial {number} with {t.params}: {type(e).__name__}: {str(e)[:300]}", RuntimeWarning, stacklevel=2)
        t.seconds = round(time.time() - begun, 3)
        table.add(t)
        if seconds is not None and time.time() - start > seconds:
            break
    return table


def _listed(value):
    """A value as the options of a space have it: JSON turns tuples into lists."""
    return tuple(value) if isinstance(value, list) else value


def best(table: TrialTable) -> Trial | None:
    """The best complete trial, the earliest of equal ones."""
    done = [t for t in table.trials if t.state == "complete" and t.value is not None]
    return max(done, key=lambda t: (t.value, -t.trial), default=None)
