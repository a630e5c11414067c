"""Decision trees as plain arrays, for models grown here and for Spark's own."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa


@dataclass
class Tree:
    """Nodes by number, the root being 0.  A row goes left where its feature is at most the threshold (or, for a
    categorical feature, among ``categories`` of the node).  Leaves have feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # (nodes, outputs)
    cover: np.ndarray  # weight of the training rows in each node
    gain: np.ndarray | None = None
    categories: dict[int, list[float]] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.feature)

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        """Whether rows with the values ``x`` of the node's feature go left; NaN is above every threshold."""
        return np.isin(x, self.categories[node]) if node in self.categories else x <= self.threshold[node]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x`` (rows, features)."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0 or not len(rows):
                out[rows] = node
                continue
            left = self.goes_left(node, x[rows, self.feature[node]])
            todo += [(int(self.left[node]), rows[left]), (int(self.right[node]), rows[~left])]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of doubles, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


@dataclass
class LevelTree(Tree):
    """A tree whose nodes of one depth share their split: a leaf is looked up by one bit for each level."""

    levels: list[tuple[int, float]] = field(default_factory=list)

    @classmethod
    def of(cls, levels: list[tuple[int, float]], value: np.ndarray, cover: np.ndarray, gain: np.ndarray) -> "LevelTree":
        """``value`` and ``cover`` by leaf number, whose highest bit is the first level (1: right); ``gain`` by level."""
        depth, inner = len(levels), (1 << len(levels)) - 1
        at = np.arange(inner)
        level = np.floor(np.log2(at + 1)).astype(np.int64)
        whole = [cover]
        for _ in range(depth):
            whole.append(whole[-1].reshape(-1, 2).sum(axis=1))
        none = np.full(inner + 1, -1, np.int64)
        pick = lambda values, kind: np.concatenate([np.array([values[d] for d in level], kind), np.zeros(inner + 1, kind)])
        return cls(np.concatenate([np.array([levels[d][0] for d in level], np.int64), none]), pick([t for _, t in levels], float),
                   np.concatenate([2 * at + 1, none]), np.concatenate([2 * at + 2, none]), np.vstack([np.zeros((inner, value.shape[1])), value]),
                   np.concatenate(whole[::-1]), pick(gain / 2.0 ** np.arange(depth), float), levels=levels)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        number = np.zeros(len(x), np.int64)
        for feature, threshold in self.levels:
            number = number * 2 + ~(x[:, feature] <= threshold)
        return number + (1 << len(self.levels)) - 1
