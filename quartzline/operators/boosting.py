"""Boosted trees for absolute error, many models side by side: histograms of binned features, leaves that hold the median of their residuals.

All models of one call grow their trees in step, so a level of a tree is one job whatever the number of series, horizons and folds. Tasks sum
gradients by (model, node, feature, bin) over the rows they hold, a shuffle by node adds these up and finds each node's best split, and only that comes
to the driver. Gradients are signs, so all sums are whole numbers and don't depend on how rows are dealt. Rows are stored as one byte a feature.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzline.operators.quantiles import GATHERED, quantiles
from quartzline.session import discard, written

#: Trees that are applied to every row in each job before the rows' predictions are written anew.
HELD_TREES = 16
#: Bytes of histograms that a task of one job makes.
HISTOGRAM_BYTES = 64 << 20
#: A task holds so many rows at most, and no fewer where there are more tasks than cores.
MOST_ROWS, LEAST_ROWS = 1_000_000, 20_000
#: Accuracy of the sketch that gives the bins' edges.
SKETCH = 10_000


@dataclass(frozen=True)
class Settings:
    # The production settings of the trees; the least rows of a leaf and the bins of a feature.
    iterations: int = 350
    step: float = 0.05
    leaves: int = 31
    l2: float = 1.0
    least_rows: int = 20
    bins: int = 255
    depth: int | None = None


@dataclass
class Tree:
    """Nodes in parallel lists; feature is -1 in a leaf. Values count for leaves; rows with at most the edge of bin cut go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    level: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int) -> None:
        for side in (self.left, self.right):
            side[node] = len(self.feature)
            for name, v in (("feature", -1), ("cut", 0), ("left", 0), ("right", 0), ("value", 0.0), ("level", self.level[node] + 1)):
                getattr(self, name).append(v)
        self.feature[node], self.cut[node] = feature, cut

    def leaf_of(self, coded: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        at, rows = np.zeros(len(coded), np.int64), np.arange(len(coded))
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            at = np.where(inner, np.where(coded[rows, np.maximum(f, 0)] <= cut[at], left[at], right[at]), at)


@dataclass
class Trees:
    """A fitted ensemble: predicts in rows what transform() is given."""

    features: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree]

    def coded(self, x: np.ndarray) -> np.ndarray:
        return coded(x, [np.array(e) for e in self.edges])

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.coded(x), np.full(len(x), self.base)
        for t in self.trees:
            out += np.array(t.value)[t.leaf_of(bins)]
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with prediction; rows in which a feature is missing are left out."""
        kept = rows.dropna(subset=self.features)
        schema, names = kept.withColumn("prediction", F.lit(0.0)).schema, self.features

        def run(batches):
            for batch in batches:
                x = np.column_stack([batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]) if batch.num_rows else np.empty((0, len(names)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(self.predict(x))], names=[*batch.schema.names, "prediction"])

        return kept.mapInArrow(run, schema)

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "edges": self.edges, "base": self.base, "trees": [vars(t) for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Trees:
        d = json.loads(text)
        return Trees(d["features"], d["edges"], d["base"], [Tree(**t) for t in d["trees"]])

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        SparkSession.active().createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.text(path)


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: how many edges lie below it; NaN goes last."""
    return np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)]).astype(np.uint8) if len(edges) else np.empty((len(x), 0), np.uint8)


def best_splits(total: np.ndarray, settings: Settings) -> tuple[int, int, float] | None:
    """(feature, cut, gain) of a node from total[feature, bin, (gradient, rows)], the first of equals; None where no split gains."""
    left = np.cumsum(total, axis=1)[:, :-1]
    whole = total[0].sum(axis=0)
    rest = whole - left
    worth = lambda h: h[..., 0] ** 2 / (h[..., 1] + settings.l2)
    gain = worth(left) + worth(rest) - worth(whole)
    gain = np.where((left[..., 1] >= settings.least_rows) & (rest[..., 1] >= settings.least_rows), gain, -1.0)
    feature, cut = np.unravel_index(np.argmax(gain), gain.shape)
    return (int(feature), int(cut), float(gain[feature, cut])) if gain[feature, cut] > 0 else None


class Growth:
    """One tree of one model while it grows: splits are taken in the order of their gain until there are enough leaves.

    Nodes are opened ahead where they may be taken, so a round of histograms serves many; pruned() keeps those that were taken.
    """

    def __init__(self, settings: Settings):
        self.tree, self.known, self.settings = Tree(), {}, settings

    def order(self) -> tuple[list[int], list[int]]:
        """(nodes that are split, in order; nodes whose best split must be found first)."""
        if 0 not in self.known:
            return [], [0]
        taken, wanted, heap = [], [], []

        def push(node):
            if node in self.known:
                if self.known[node] and (self.settings.depth is None or self.tree.level[node] < self.settings.depth):
                    heapq.heappush(heap, (-self.known[node][2], node))
            else:
                wanted.append(node)

        push(0)
        while heap and len(taken) + 1 < self.settings.leaves:
            _, node = heapq.heappop(heap)
            taken.append(node)
            if self.tree.feature[node] < 0:
                self.tree.split(node, *self.known[node][:2])
            push(self.tree.left[node])
            push(self.tree.right[node])
        return taken, wanted

    def pruned(self) -> Tree:
        taken, _ = self.order()
        out, names = Tree(), {0: 0}
        for node in sorted(taken):  # parents have lesser numbers
            out.split(names[node], self.tree.feature[node], self.tree.cut[node])
            names[self.tree.left[node]], names[self.tree.right[node]] = out.left[names[node]], out.right[names[node]]
        return out


def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(model, y, raw, bins) of a batch, sorted by model."""
    model, y, raw = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("model", "y", "raw"))
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    order = np.argsort(model, kind="stable")
    return model[order], y[order], raw[order], bins[order]


def stretches(model: np.ndarray):
    """(model, from, to) of each run of one model."""
    if len(model):
        at = np.flatnonzero(np.diff(model)) + 1
        for lo, hi in zip([0, *at], [*at, len(model)], strict=True):
            yield int(model[lo]), int(lo), int(hi)


def moved_on(raw: np.ndarray, model: np.ndarray, bins: np.ndarray, held: list[list[Tree]]) -> np.ndarray:
    """Predictions with the trees that are not in raw yet."""
    out = raw.copy()
    for m, lo, hi in stretches(model):
        for t in held[m]:
            out[lo:hi] += np.array(t.value)[t.leaf_of(bins[lo:hi])]
    return out


def histograms(table: DataFrame, tasks: int, slots: list[tuple[int, int]], growing: list[Tree], held: list[list[Tree]], width: int, settings: Settings) -> dict:
    """(model, node) -> best split or None, and the node's rows, for all slots. A table of one task needs no shuffle."""
    place = {s: k for k, s in enumerate(slots)}
    size = width * 256

    def summed(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            model, y, raw, bins = rows_of(batch)
            sign = np.sign(moved_on(raw, model, bins, held) - y)
            slot = np.full(len(y), -1)
            for m, lo, hi in stretches(model):
                node = growing[m].leaf_of(bins[lo:hi])
                slot[lo:hi] = np.array([place.get((m, k), -1) for k in range(len(growing[m].feature))])[node]
            here = slot >= 0
            flat = ((slot[here, None] * width + np.arange(width)) * 256 + bins[here]).ravel()
            if total is None:
                total = np.zeros((len(slots) * size, 2), np.int64)
            total[:, 0] += np.bincount(flat, np.repeat(sign[here], width), len(total)).astype(np.int64)
            total[:, 1] += np.bincount(flat, minlength=len(total))
        if total is not None:
            parts = total.reshape(len(slots), -1)
            some = [k for k in range(len(slots)) if parts[k].any()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], names=["slot", "part"])

    def best(batches):
        slot, total, out = None, None, []

        def end():
            found = best_splits(total.reshape(width, 256, 2), settings)
            out.append((slot, *(found or (-1, 0, 0.0)), int(total.reshape(width, 256, 2)[0, :, 1].sum())))

        for batch in batches:
            for s, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != slot:
                    if slot is not None:
                        end()
                    slot, total = s, np.zeros(size * 2, np.int64)
                total += np.frombuffer(part, np.int64)
        if slot is not None:
            end()
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True)], names=["slot", "feature", "cut", "gain", "rows"])

    parts = table.coalesce(1) if tasks == 1 else table
    parts = parts.mapInArrow(summed, "slot int, part binary")
    parts = parts if tasks == 1 else parts.repartition("slot").sortWithinPartitions("slot")
    found = {slots[r.slot]: (None if r.feature < 0 else (r.feature, r.cut, r.gain), r.rows) for r in parts.mapInArrow(best, "slot int, feature int, cut int, gain double, rows long").collect()}
    return {s: found.get(s, (None, 0)) for s in slots}


def leaf_medians(table: DataFrame, trees: list[Tree], held: list[list[Tree]], largest: int) -> dict:
    """(model, leaf) -> median residual."""

    def residuals(batches):
        for batch in batches:
            if batch.num_rows:
                model, y, raw, bins = rows_of(batch)
                leaf = np.concatenate([trees[m].leaf_of(bins[lo:hi]) for m, lo, hi in stretches(model)])
                yield pa.RecordBatch.from_arrays([pa.array(model), pa.array(leaf.astype(np.int32)), pa.array(y - moved_on(raw, model, bins, held))], names=["model", "leaf", "residual"])

    d = table.mapInArrow(residuals, "model int, leaf int, residual double")
    if largest <= GATHERED:
        found = d.groupBy("model", "leaf").agg(F.percentile("residual", F.lit(0.5)).alias("m"))
    else:
        d = written(d, "residuals")
        found = quantiles(d, ["model", "leaf"], "residual", [0.5]).select("model", "leaf", F.col("quantiles")[0].alias("m"))
    return {(r.model, r.leaf): r.m for r in found.collect()}


def fit_many(rows: DataFrame, features: list[str], target: str, model: str, settings: Settings = Settings()) -> dict:
    """One ensemble for each value of the column model, all fitted together. Rows in which a feature or the target is missing teach nothing.

    Bins end at quantiles of a feature by a sketch, exact for small data; they, the trees and one split a node are all that the driver holds.
    """
    d = rows.select(F.col(model).alias("__m"), F.col(target).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"__f{k}") for k, f in enumerate(features)]).dropna()
    shares = F.array(*[F.lit(k / settings.bins) for k in range(1, settings.bins)])
    cuts = d.groupBy("__m").agg(*[F.percentile_approx(f"__f{k}", shares, F.lit(SKETCH)).alias(f"e{k}") for k in range(len(features))], F.count("*").alias("n")).collect()
    cuts = sorted(cuts, key=lambda r: str(r["__m"]))
    names = [r["__m"] for r in cuts]
    if not names:
        return {}
    edges = [[sorted(set(r[f"e{k}"])) for k in range(len(features))] for r in cuts]
    medians = {r["__m"]: r["quantiles"][0] for r in quantiles(d, ["__m"], "y", [0.5]).collect()}
    base, number = [medians[n] for n in names], {n: k for k, n in enumerate(names)}
    arrays = [[np.array(e) for e in of] for of in edges]

    def encode(batches):
        for batch in batches:
            m = np.array([number[v] for v in batch.column(0).to_pylist()], np.int32)
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]) if features else np.empty((len(m), 0))
            bins = np.empty(x.shape, np.uint8)
            for k in np.unique(m):
                bins[m == k] = coded(x[m == k], arrays[k])
            yield pa.RecordBatch.from_arrays([pa.array(m), batch.column(1), pa.array(np.array(base)[m]), pa.array([b.tobytes() for b in bins], pa.binary())], names=["model", "y", "raw", "bins"])

    n = sum(r["n"] for r in cuts)
    tasks = max(-(-n // MOST_ROWS), min(-(-n // LEAST_ROWS), d.sparkSession.sparkContext.defaultParallelism))
    table = written(d.repartition(tasks).mapInArrow(encode, "model int, y double, raw double, bins binary"), "binned")
    done, held = [[] for _ in names], [[] for _ in names]
    nodes = max(HISTOGRAM_BYTES // (max(len(features), 1) * 256 * 16), 1)
    for _ in range(settings.iterations):
        growths = [Growth(settings) for _ in names]
        rows_in: dict = {}
        while wanted := [(m, node) for m, g in enumerate(growths) for node in g.order()[1]]:
            for at in range(0, len(wanted), nodes):
                part = wanted[at : at + nodes]
                for (m, node), (split, n) in histograms(table, tasks, part, [g.tree for g in growths], held, len(features), settings).items():
                    growths[m].known[node], rows_in[m, node] = split, n
        trees = [g.pruned() for g in growths]
        values = leaf_medians(table, trees, held, max(rows_in.values()))
        for m, t in enumerate(trees):
            t.value = [settings.step * values.get((m, k), 0.0) for k in range(len(t.feature))]
            done[m].append(t)
            held[m].append(t)
        if len(held[0]) >= HELD_TREES:
            applied = held

            def rewrite(batches, applied=applied):
                for batch in batches:
                    if batch.num_rows:
                        model, y, raw, bins = rows_of(batch)
                        yield pa.RecordBatch.from_arrays([pa.array(model), pa.array(y), pa.array(moved_on(raw, model, bins, applied)), pa.array([b.tobytes() for b in bins], pa.binary())], names=["model", "y", "raw", "bins"])

            before, table = table, written(table.mapInArrow(rewrite, "model int, y double, raw double, bins binary"), "binned")
            discard(before)
            held = [[] for _ in names]
    discard(table)
    return {n: Trees(features, edges[k], base[k], done[k]) for k, n in enumerate(names)}
