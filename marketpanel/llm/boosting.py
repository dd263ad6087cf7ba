"""Small boosted trees for binary labels, fitted on arrays or on all rows of a table, and applied to arrays in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
UNIT = 1 << 24  # sums over a table are integers of this unit, so that they don't depend on the order of the rows
FREQUENCY = 1_000_000  # of a row of weight one in a quantile


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BoostedTrees:
    """Trees of a fixed depth over binned features: a node is (feature, last bin that goes left)."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.2
    damping: float = 2.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)]).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS)[1:-1])) for k in range(x.shape[1])]
        bins = self._binned(x)
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = sigmoid(score)
            tree = self._grow(bins, p - y, p * (1 - p))
            self.trees.append(tree)
            score += self._leaf(tree, bins)
        return self

    def _grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray):
        size = 1 << self.depth
        feature, cut = np.zeros(size, np.int64), np.full(size, BINS, np.int64)  # BINS: all go left
        node = np.ones(len(g), np.int64)
        for level in range(self.depth):
            for k in range(1 << level, 2 << level):
                rows = np.flatnonzero(node == k)
                if len(rows) < 2:
                    continue
                best, total_g, total_h = 1e-6, g[rows].sum(), h[rows].sum()
                for f in range(bins.shape[1]):
                    left_g = np.cumsum(np.bincount(bins[rows, f], g[rows], BINS))
                    left_h = np.cumsum(np.bincount(bins[rows, f], h[rows], BINS))
                    d = self.damping
                    gain = left_g**2 / (left_h + d) + (total_g - left_g) ** 2 / (total_h - left_h + d) - total_g**2 / (total_h + d)
                    at = int(np.argmax(gain))
                    if gain[at] > best:
                        best, feature[k], cut[k] = gain[at], f, at
            node = 2 * node + (bins[np.arange(len(node)), feature[node]] > cut[node])
        sums_g, sums_h = np.bincount(node - size, g, size), np.bincount(node - size, h, size)
        return feature, cut, -self.rate * sums_g / (sums_h + self.damping)

    def fit_rows(self, rows: DataFrame, width: int) -> DataFrame:
        """Fit on all rows (x, y, w, held, ...) that are not held: `width` features, a label of 0 or 1, a weight.

        The edges of bins are exact quantiles. A level of a tree is one pass over the binned rows, of which each task
        sends a sum of gradients and curvatures a node, feature and bin: as much at any size. Returns all rows as
        (bins, ..., n), equal ones counted together; without two labels outside the held ones there are no trees.
        """
        from marketpanel.sources.sinks import materialize

        learned = rows.filter(~F.col("held"))
        shares = [float(p) for p in np.linspace(0, 1, BINS)[1:-1]]
        often = F.greatest(F.lit(1).cast("bigint"), F.round(F.col("w") * FREQUENCY).cast("bigint"))
        found = learned.agg(*[F.percentile(F.col("x")[k], F.array(*map(F.lit, shares)), often).alias(f"q{k}") for k in range(width)]).first()
        self.edges = [np.unique(np.array(q if q is not None else [], float)) for q in found]
        kept = [c for c in rows.columns if c != "x"]

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                codes = [r.tobytes() for r in self._binned(x).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), *(batch.column(c) for c in kept)], names=["bins", *kept])

        kinds = dict(rows.dtypes)
        coded = rows.mapInArrow(binned, "bins binary, " + ", ".join(f"{c} {kinds[c]}" for c in kept))
        coded = materialize(coded.groupBy("bins", *kept).agg(F.count(F.lit(1)).alias("n")), "binned-rows")
        learned = coded.filter(~F.col("held")).select("bins", F.col("y").cast("double").alias("y"), (F.col("w") * F.col("n")).alias("w"))
        sums = learned.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("y"), F.min("y").alias("low"), F.max("y").alias("high")).first()
        if sums.w is None or sums.low == sums.high:
            return coded
        share = min(max(float(sums.y / sums.w), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        for _ in range(self.rounds):
            size = 1 << self.depth
            feature, cut, value = np.zeros(size, np.int64), np.full(size, BINS, np.int64), np.zeros(size)  # BINS: all go left
            for level in range(self.depth):
                first, d = 1 << level, self.damping
                left = np.cumsum(self._sums(learned, width, feature, cut, level), axis=3)
                for k in range(first, 2 * first):
                    g, h = left[:, k - first]
                    total_g, total_h = g[0, -1], h[0, -1]
                    gain = g**2 / (h + d) + (total_g - g) ** 2 / (total_h - h + d) - total_g**2 / (total_h + d)
                    f, at = divmod(int(np.argmax(gain)), BINS)
                    if gain[f, at] > 1e-6:
                        feature[k], cut[k] = f, at
                    low = g[feature[k], min(cut[k], BINS - 1)], h[feature[k], min(cut[k], BINS - 1)]
                    if level == self.depth - 1:
                        value[2 * k - size] = -self.rate * low[0] / (low[1] + d)
                        value[2 * k + 1 - size] = -self.rate * (total_g - low[0]) / (total_h - low[1] + d)
            self.trees.append((feature, cut, value))
        return coded

    def _sums(self, rows: DataFrame, width: int, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        """Sums of gradients and curvatures by node of a level, feature and bin, over all rows (bins, y, w)."""
        shape = (2, 1 << level, width, BINS)
        cells = shape[1] * width * BINS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, cells), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width).astype(np.int64)
                y, w = (batch.column(c).to_numpy() for c in ("y", "w"))
                node, places = np.ones(len(bins), np.int64), np.arange(len(bins))
                for _ in range(level):
                    node = 2 * node + (bins[places, feature[node]] > cut[node])
                cell = (((node - (1 << level)) * width)[:, None] + np.arange(width)) * BINS + bins
                p = sigmoid(self.margin(bins))
                for k, x in enumerate((w * (p - y), w * p * (1 - p))):
                    total[k] += np.bincount(cell.ravel(), np.repeat(np.rint(x * UNIT), width), cells).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        out = np.zeros(2 * cells, np.int64)
        for r in rows.mapInArrow(run, "sums binary").collect():
            out += np.frombuffer(r.sums, np.int64)
        return out.reshape(shape) / UNIT

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.start + sum((self._leaf(t, bins) for t in self.trees), np.zeros(len(bins)))

    def _leaf(self, tree, bins: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            node = 2 * node + (bins[rows, feature[node]] > cut[node])
        return value[node - len(value)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(self._binned(x)))


def isotonic(scores: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Calibration by pooling adjacent violators: (upper ends of score ranges, share of ones in each). A row counts
    as one, or by its weight."""
    w = np.ones(len(y)) if weights is None else weights
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # end, ones, rows
    for s, v, n in zip(scores[order].tolist(), (y * w)[order].tolist(), w[order].tolist()):
        if blocks and blocks[-1][0] == s:
            blocks[-1][1] += v
            blocks[-1][2] += n
        else:
            blocks.append([s, v, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            end, ones, rows = blocks.pop()
            blocks[-1] = [end, blocks[-1][1] + ones, blocks[-1][2] + rows]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])
