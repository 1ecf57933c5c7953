"""Binary trees as arrays: prediction in whole columns, and the search for the best histogram split."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Node arrays, node 0 is the root; a row goes left if its value is at most the threshold, a missing one as ``missing_left`` says."""
    feature: np.ndarray        # -1 for a leaf
    threshold: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray          # (nodes, outputs)
    cover: np.ndarray          # training weight of the node
    gain: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        if self.feature[0] < 0:
            return node
        rows = np.arange(len(x))
        while len(rows):
            at = node[rows]
            v = x[rows, self.feature[at]]
            with np.errstate(invalid="ignore"):
                left = np.where(np.isnan(v), self.missing_left[at], v <= self.threshold[at])
            node[rows] = np.where(left, self.left[at], self.right[at])
            rows = rows[self.feature[node[rows]] >= 0]
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaf_of(x)]

    def rows(self) -> list[tuple]:
        """(node, feature, threshold, missing_left, left, right, cover, value) of every node, NULL where it does not apply."""
        out = []
        for i in range(len(self.feature)):
            leaf = self.feature[i] < 0
            out.append((i, None if leaf else int(self.feature[i]), None if leaf else float(self.threshold[i]),
                        None if leaf else bool(self.missing_left[i]), None if leaf else int(self.left[i]), None if leaf else int(self.right[i]),
                        float(self.cover[i]), [float(v) for v in self.value[i]]))
        return out

    def importance(self, width: int) -> np.ndarray:
        inner = self.feature >= 0
        return np.bincount(self.feature[inner], weights=self.gain[inner], minlength=width)


TREE_ROWS = "node int, feature int, threshold double, missing_left boolean, left int, right int, cover double, value array<double>"


@dataclass(frozen=True)
class SplitRule:
    """How a split is valued: ``newton`` from gradients and Hessians with an L2 penalty, ``friedman`` from counts and gradient means."""
    kind: str = "newton"
    l2: float = 1.0
    scale: float = 0.5
    min_gain: float = 1e-6
    min_hessian: float = 1.0
    min_rows: int = 1

    def leaf(self, sums: np.ndarray) -> np.ndarray:
        """Newton step for every gradient of a node."""
        return -sums[..., :-2] / np.maximum(sums[..., -2:-1] + self.l2, 1e-16)

    def _score(self, g, h):
        return (g * g).sum(axis=-1) / np.maximum(h + self.l2, 1e-16)

    def gain(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Gain of children with sums (gradients, Hessian, rows) in the last axis; -inf where a child is too small."""
        (gl, hl, nl), (gr, hr, nr) = ((v[..., :-2], v[..., -2], v[..., -1]) for v in (left, right))
        if self.kind == "friedman":
            with np.errstate(divide="ignore", invalid="ignore"):
                d = gl[..., 0] / nl - gr[..., 0] / nr
                out = nl * nr / (nl + nr) * d * d
        else:
            out = self.scale * (self._score(gl, hl) + self._score(gr, hr) - self._score(gl + gr, hl + hr))
        ok = (nl >= self.min_rows) & (nr >= self.min_rows) & (hl >= self.min_hessian) & (hr >= self.min_hessian)
        return np.where(ok, out, -np.inf)


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    left: np.ndarray
    right: np.ndarray


def best_splits(hist: np.ndarray, offsets: np.ndarray, rule: SplitRule, allowed: np.ndarray | None = None) -> list[Split | None]:
    """Best split of every node from its histogram (nodes, bins, sums), over its ``allowed`` (nodes, features) when given.

    The bins of feature f are offsets[f] to offsets[f + 1], the last one for
    missing values, which are tried on either side.  Of equal gains the first
    feature wins, then the lowest bin, then missing values on the right.
    """
    out: list[Split | None] = [None] * len(hist)
    best = np.full(len(hist), rule.min_gain)
    for f in range(len(offsets) - 1):
        seg = hist[:, offsets[f]:offsets[f + 1]]
        total, missing = seg.sum(axis=1)[:, None], seg[:, -1:]
        below = np.cumsum(seg[:, :-1], axis=1)
        for side, left in enumerate((below, below + missing)):
            if side and not missing[..., -1].any():
                continue
            gain = rule.gain(left, total - left)
            if not gain.shape[1]:
                continue
            at = gain.argmax(axis=1)
            top = gain[np.arange(len(hist)), at]
            if allowed is not None:
                top = np.where(allowed[:, f], top, -np.inf)
            for i in np.flatnonzero(top > best * (1 + 1e-12)):
                best[i] = top[i]
                lo = left[i, at[i]].copy()
                out[i] = Split(float(top[i]), f, int(at[i]), bool(side), lo, total[i, 0] - lo)
    return out
