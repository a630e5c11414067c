"""Ranges of parameters for a search, with draws and densities on their own scales."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Real:
    """A number from low to high, even on a log scale with ``log``."""

    low: float
    high: float
    log: bool = False

    def _inner(self, value):
        return np.log(value) if self.log else np.asarray(value, float)

    def bounds(self) -> tuple[float, float]:
        return float(self._inner(self.low)), float(self._inner(self.high))

    def draw(self, rng: np.random.Generator):
        return self.value(rng.uniform(*self.bounds()))

    def value(self, inner: float):
        x = math.exp(inner) if self.log else inner
        return float(min(max(x, self.low), self.high))

    def inner(self, values: Sequence) -> np.ndarray:
        return np.asarray(self._inner(np.asarray(values, float)), float)

    def log_density(self, x: np.ndarray, at: np.ndarray, wide: np.ndarray) -> np.ndarray:
        low, high = self.bounds()
        whole = np.log(np.maximum(normal((high - at) / wide) - normal((low - at) / wide), 1e-300))
        z = (x[:, None] - at) / wide
        return _log_mean(-0.5 * z * z - np.log(wide * math.sqrt(2 * math.pi)) - whole)


@dataclass(frozen=True)
class Whole(Real):
    """A whole number from low to high in steps."""

    step: int = 1

    def bounds(self) -> tuple[float, float]:
        half = self.step / 2
        low = max(self.low - half, self.low / 2) if self.log else self.low - half
        return float(self._inner(low)), float(self._inner(self.high + half))

    def value(self, inner: float):
        x = math.exp(inner) if self.log else inner
        return int(min(max(self.low + self.step * round((x - self.low) / self.step), self.low), self.low + (self.high - self.low) // self.step * self.step))

    def log_density(self, x: np.ndarray, at: np.ndarray, wide: np.ndarray) -> np.ndarray:
        low, high = self.bounds()
        whole = np.maximum(normal((high - at) / wide) - normal((low - at) / wide), 1e-300)
        values = np.array([self.value(v) for v in x], float)
        edge = [self._inner(np.maximum(values + s * self.step / 2, math.exp(low) if self.log else low)) for s in (-1, 1)]
        mass = normal((edge[1][:, None] - at) / wide) - normal((edge[0][:, None] - at) / wide)
        return _log_mean(np.log(np.maximum(mass / whole, 1e-300)))


@dataclass(frozen=True)
class Choice:
    """One of some values."""

    options: tuple

    def draw(self, rng: np.random.Generator):
        return self.options[int(rng.integers(len(self.options)))]

    def shares(self, values: Sequence) -> np.ndarray:
        """Share of each option among the values, one more of each kind of value being counted."""
        counts = np.array([1.0 + sum(1 for v in values if v == o) for o in self.options])
        return counts / counts.sum()


Space = dict[str, Real | Whole | Choice]
_erf = np.vectorize(math.erf)


def normal(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + _erf(z / math.sqrt(2.0)))


def _log_mean(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).mean(axis=1))


def draw(space: Space, rng: np.random.Generator) -> dict:
    return {n: d.draw(rng) for n, d in space.items()}
