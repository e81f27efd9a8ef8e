"""M6, second variant: leaf-wise gradient boosting on binned features.

Trees grow best leaf first up to ``leaves`` leaves, instead of level by level.
Every feature is cut once into at most ``bins`` bins, so a split needs only the
sums of the residuals per (node, feature, bin). The rows stay in the tasks of one
barrier stage, as a byte a feature and a residual: each task adds up its part,
the tasks exchange these sums, whose size does not depend on the rows, and all
take the same split. A tree of few rows and one of many cost the same number of
exchanges, and no job or shuffle. The better-known child is never counted twice:
a node's second child has the node's sums without those of the first.

One exchange serves all leaves that can still be split: their best splits are
tried ahead, and the tree then takes them in order of gain, which gives the tree
that one split after the other would give, in about as many exchanges as the
tree is deep. If an executor is lost, the stage starts again from the
checkpointed rows and finds the same trees. A cluster that allocates executors
dynamically has to switch that off for the fit (barrier stages need all tasks at
once; there are as many as the rows ask for, at most one a core).

Squared loss; a leaf adds ``rate`` times the mean residual of its rows. Ties go
to the first feature, then the first bin (gains are compared to 10 digits, so
the order of the sums does not decide). Importance is the share of splits.
"""

from __future__ import annotations

import base64
import heapq
import pickle
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.operators.mlforecast import FEATURES, SparkMLForecaster, _Fitted, series_state, training_frame
from bizlens.session import cut_lineage


#: Blocks (Arrow batches) of training rows that one task holds: about 5 million rows.
PART_BLOCKS = 500


@dataclass
class Tree:
    """Nodes by number: ``split[k]`` = (feature, bin), rows below the bin go to
    ``kids[k][0]``, the others to ``kids[k][1]``; ``value[k]`` is a leaf's step."""
    split: dict[int, tuple[int, int]] = field(default_factory=dict)
    kids: dict[int, tuple[int, int]] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of ``bins`` (rows x features) reaches."""
        at = np.zeros(len(bins), np.int32)
        for k in sorted(self.split):  # children have higher numbers than their parent
            here = np.flatnonzero(at == k)
            f, b = self.split[k]
            left, right = self.kids[k]
            at[here] = np.where(bins[here, f] < b, left, right)
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        steps = np.zeros(max([0, *self.value]) + 1)
        for k, v in self.value.items():
            steps[k] = v
        return steps[self.route(bins)]


@dataclass
class BoostedTrees:
    """The model: bin edges of every feature, the start value and the trees."""
    features: Sequence[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]

    def bin(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x, "right") for e, x in zip(self.edges, columns)], 1).astype(np.int16)

    def predict(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        bins = self.bin(columns)
        return self.base + sum((t.predict(bins) for t in self.trees), np.zeros(len(bins)))

    def importance(self) -> list[tuple[str, float]]:
        """Share of the splits, most important first."""
        used = np.bincount([f for t in self.trees for f, _ in t.split.values()], minlength=len(self.features)).astype(float)
        share = used / max(1.0, used.sum())
        return sorted(zip(self.features, share.tolist()), key=lambda r: -r[1])

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``; the model (a few thousand nodes) travels with the task."""
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for columns in batches:
                yield pa.array(model.value.predict([c.to_numpy(zero_copy_only=False) for c in columns]))

        return df.withColumn("prediction", score(*[F.col(c).cast("double") for c in self.features]))


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` edges a feature: its quantiles (exact up to 10,000 values)."""
    shares = [k / bins for k in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10000).alias(c) for c in features]).first()
    return [np.unique(np.array(row[c] or [], np.float64)) for c in features]


def _cells(bins: np.ndarray, left: np.ndarray, growing: Tree, wanted: dict[int, int]) -> np.ndarray:
    """Sums of the residuals ``left`` and row counts of this task per (wanted node, feature, bin)."""
    features = bins.shape[1]
    size = len(wanted) * features << 8
    lookup = np.full(max([0, *wanted, *(k for p in growing.kids.values() for k in p)]) + 1, -1, np.int64)
    for k, i in wanted.items():
        lookup[k] = i
    slot = lookup[growing.route(bins)]
    ok = slot >= 0
    at = (((slot[ok, None] * features + np.arange(features)) << 8) + bins[ok]).ravel()
    return np.stack([np.bincount(at, np.repeat(left[ok], features), size), np.bincount(at, minlength=size)]) \
        .reshape(2, len(wanted), features, 256)


def _add_up(context: BarrierTaskContext, mine: np.ndarray) -> np.ndarray:
    """The sum of all tasks' arrays, added in the order of the tasks (about a second an exchange)."""
    if len(context.getTaskInfos()) == 1:
        return mine
    text = base64.b64encode(zlib.compress(mine.tobytes(), 1)).decode()
    total = np.zeros(mine.shape)
    for other in context.allGather(text):
        total += np.frombuffer(zlib.decompress(base64.b64decode(other))).reshape(mine.shape)
    return total


def best_split(cells: np.ndarray, min_rows: int) -> tuple[float, int, int, float, float] | None:
    """(gain, feature, bin, residual sum, rows) of the best split of a node with ``cells``
    (2, features, bins); None where no split leaves ``min_rows`` rows on both sides and gains."""
    g, n = cells[0].cumsum(1), cells[1].cumsum(1)
    all_g, all_n = g[0, -1], n[0, -1]
    left_g, left_n = g[:, :-1], n[:, :-1]
    right_g, right_n = all_g - left_g, all_n - left_n
    ok = (left_n >= min_rows) & (right_n >= min_rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, left_g ** 2 / left_n + right_g ** 2 / right_n - all_g ** 2 / all_n, -np.inf)
    scale = max(1e-300, float(np.abs(cells[0]).sum()) ** 2 / max(all_n, 1.0))
    top = np.round(gain / scale, 10)
    at = int(top.argmax())
    if not top.flat[at] > 0:
        return None
    f, b = divmod(at, gain.shape[1])
    return float(gain[f, b]), f, b + 1, float(all_g), float(all_n)


def grow(cells_of: Callable[[Tree, dict[int, int]], np.ndarray], *, leaves: int, min_rows: int, rate: float) -> Tree:
    """One tree; ``cells_of`` gives the sums over all rows of the nodes it is asked for."""
    ahead = Tree()  # splits tried; those taken become the tree
    cells = {0: cells_of(ahead, {0: 0})[:, 0]}
    found = {0: best_split(cells[0], min_rows)}
    tree, number = Tree(), 1
    open_: list[tuple[float, int]] = []

    def offer(k: int) -> None:
        if found[k]:
            heapq.heappush(open_, (-found[k][0], k))

    offer(0)
    now = [0]
    while open_ and len(now) < leaves:
        if open_[0][1] not in ahead.split:
            some = [k for _, k in heapq.nsmallest(leaves - len(now), open_) if k not in ahead.split]
            for k in some:
                ahead.split[k] = found[k][1:3]
                ahead.kids[k] = (number, number + 1)
                number += 2
            counted = cells_of(ahead, {ahead.kids[k][0]: i for i, k in enumerate(some)})
            for i, k in enumerate(some):
                left, right = ahead.kids[k]
                cells[left], cells[right] = counted[:, i], cells[k] - counted[:, i]
                found[left], found[right] = best_split(cells[left], min_rows), best_split(cells[right], min_rows)
        _, k = heapq.heappop(open_)
        tree.split[k], tree.kids[k] = ahead.split[k], ahead.kids[k]
        now.remove(k)
        for kid in tree.kids[k]:
            now.append(kid)
            offer(kid)
    for k in now:
        n = cells[k][1][0].sum()
        tree.value[k] = rate * float(cells[k][0][0].sum() / n) if n else 0.0
    return tree


def boost(df: DataFrame, features: Sequence[str], label: str, *, trees: int = 200, leaves: int = 31, rate: float = 0.03,
          bins: int = 255, min_rows: int = 20) -> BoostedTrees:
    """Fit ``trees`` trees on ``df``; rows without a label or feature are left out."""
    clean = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias(label)).dropna()
    model = BoostedTrees(list(features), bin_edges(clean, features, min(bins, 255)), clean.agg(F.avg(label)).first()[0] or 0.0, [])
    shared = df.sparkSession.sparkContext.broadcast(model.edges)
    base, k = model.base, len(features)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = np.stack([np.searchsorted(e, b.column(i).to_numpy(), "right") for i, e in enumerate(shared.value)], 1)
            yield _block(cut.astype(np.uint8).tobytes(), b.column(k).to_numpy() - base)

    rows = cut_lineage(clean.mapInArrow(to_bins, "bins binary, residual binary"))
    blocks = rows.count()
    if not blocks:
        return model
    tasks = min(-(-blocks // PART_BLOCKS), df.sparkSession.sparkContext.defaultParallelism)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.frombuffer(x, np.uint8).reshape(-1, k), np.frombuffer(r)) for b in batches
                for x, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        cut = np.concatenate([x for x, _ in held] or [np.zeros((0, k), np.uint8)])
        left = np.concatenate([r for _, r in held] or [np.zeros(0)])
        context, made = BarrierTaskContext.get(), []
        for _ in range(trees):
            tree = grow(lambda growing, wanted: _add_up(context, _cells(cut, left, growing, wanted)),
                        leaves=leaves, min_rows=min_rows, rate=rate)
            if not tree.split:
                break  # no split gains any more
            left = left - tree.predict(cut)
            made.append(tree)
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["trees"])

    model.trees += pickle.loads(rows.repartition(tasks).mapInArrow(train, "trees binary", barrier=True).collect()[0].trees)
    return model


def _block(bins: bytes, residual: np.ndarray) -> pa.RecordBatch:
    """A batch of training rows as one row of two byte strings."""
    return pa.RecordBatch.from_arrays([pa.array([bins], pa.binary()), pa.array([residual.astype(np.float64).tobytes()], pa.binary())],
                                      ["bins", "residual"])


class LeafwiseBoosting(SparkMLForecaster):
    """M6 with 200 leaf-wise trees of 31 leaves at learning rate 0.03, one model for all series."""

    def __init__(self, *, trees: int = 200, leaves: int = 31, rate: float = 0.03):
        super().__init__("leafwise_boosting", None)
        self.options = {"trees": trees, "leaves": leaves, "rate": rate}

    def fit(self, train: DataFrame, by: Sequence[str]) -> _Fitted:
        frame = cut_lineage(training_frame(train, by=by))
        index = StringIndexer(inputCol="series_key", outputCol="series_idx", handleInvalid="keep").fit(frame)
        return _Fitted(_Indexed(index, boost(index.transform(frame), FEATURES, "y", **self.options)), series_state(train, by))


@dataclass
class _Indexed:
    index: object
    model: BoostedTrees

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.index.transform(df))
