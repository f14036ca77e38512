"""Many small networks in one job: one hidden layer of sigmoid units and a softmax
over two classes, a network per label, all over the same sparse inputs.

The training rows stay sparse where they lie.  In each pass a task makes a bounded
number of rows dense at a time, takes them through the networks of all labels with one
matrix product in single precision (a search's step needs no more), and adds up loss and
gradient of every network in double; the sums of a label meet in one task.  The driver keeps what a model is made of (weights, and the last
``MEMORY`` steps of L-BFGS) and decides on the next step, so memory follows the size of
the networks, not the rows, and the number of passes is that of the slowest label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_ROWS = 512
MEMORY = 10


def first_weights(spark, n_inputs: int, hidden: int, seed: int) -> np.ndarray:
    """The weights at which Spark ML's perceptron of this size and seed starts: it is
    asked for no step over two rows."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(Vectors.sparse(n_inputs, {}), 0.0), (Vectors.sparse(n_inputs, {0: 1.0}), 1.0)],
                                 ["features", "label"])
    start = MultilayerPerceptronClassifier(layers=[n_inputs, hidden, 2], maxIter=0, seed=seed)
    return start.fit(rows).weights.toArray()


def _layers(w: np.ndarray, n_inputs: int, hidden: int):
    """Input weights (inputs, labels, hidden), their shift, output weights (labels,
    hidden, 2) and theirs, of the rows of ``w``; laid out as Spark ML lays them out."""
    k, a = len(w), n_inputs * hidden
    return (w[:, :a].reshape(k, n_inputs, hidden).transpose(1, 0, 2), w[:, a:a + hidden],
            w[:, a + hidden:a + 3 * hidden].reshape(k, hidden, 2), w[:, a + 3 * hidden:])


def _dense(batch: pa.RecordBatch, n_inputs: int, step: int = BATCH_ROWS,
           kind: type = np.float64) -> Iterator[tuple[slice, np.ndarray]]:
    """Some rows at a time as a matrix of their counts."""
    slots, counts = batch.column("slots"), batch.column("counts")
    for at in range(0, batch.num_rows, step):
        s, c = slots.slice(at, step), counts.slice(at, step)
        x = np.zeros((len(s), n_inputs), kind)
        rows = np.repeat(np.arange(len(s)), s.value_lengths().to_numpy())
        x[rows, s.flatten().to_numpy()] = c.flatten().to_numpy()
        yield slice(at, at + len(s)), x


def _logistic(z: np.ndarray) -> np.ndarray:
    """The logistic function, written over ``z``; what is cut off is 0 or 1 in its precision."""
    most = 80 if z.dtype == np.float32 else 700
    np.clip(z, -most, most, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def _forward(x: np.ndarray, w: np.ndarray, n_inputs: int, hidden: int, w1: np.ndarray | None = None):
    """Hidden values (rows, labels, hidden) and class margins (rows, labels): the
    probability of class 1 is the logistic function of the margin.  ``w1``: the input
    weights (inputs, labels x hidden), if they are at hand."""
    first, b1, w2, b2 = _layers(w, n_inputs, hidden)
    z = (x @ (first.reshape(n_inputs, -1) if w1 is None else w1)).reshape(len(x), len(w), hidden)
    z += b1
    h = _logistic(z)
    return h, np.einsum("rkh,kh->rk", h, w2[:, :, 1] - w2[:, :, 0]) + b2[:, 1] - b2[:, 0]


def _losses(rows: DataFrame, w: np.ndarray, live: np.ndarray, n_inputs: int, hidden: int, tasks: int,
            scale: np.ndarray | None = None) -> dict[int, tuple[float, np.ndarray]]:
    """Sum of the loss and of its gradient over the rows of every live label, in one
    pass; ``scale[label, class]`` is the weight of a row of that class (default 1)."""
    at = w[live].astype(np.float32)
    by_class = (np.ones((len(w), 2)) if scale is None else scale)[live].astype(np.float32)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, g1, gb1 = np.zeros(len(at)), np.zeros((n_inputs, len(at) * hidden)), np.zeros((len(at), hidden))
        g2, gb2 = np.zeros((len(at), hidden)), np.zeros(len(at))
        w1, _, w2, _ = _layers(at, n_inputs, hidden)
        w1 = w1.reshape(n_inputs, -1)                                  # copied once, not for each part
        out = w2[:, :, 1] - w2[:, :, 0]
        for batch in batches:
            flat = batch.column("ys").flatten().to_numpy(zero_copy_only=False)
            ys = flat.reshape(batch.num_rows, -1)[:, live]             # -1: the row has no class for that label
            for part, x in _dense(batch, n_inputs, kind=np.float32):
                h, margin = _forward(x, at, n_inputs, hidden, w1)
                y = ys[part]
                weight = np.where(y >= 0, np.where(y > 0, by_class[:, 1], by_class[:, 0]), np.float32(0))
                y = y.astype(np.float32)
                loss += (weight * (np.logaddexp(np.float32(0), margin) - y * margin)).sum(0, dtype=float)
                d = weight * (_logistic(margin) - y)
                g2 += np.einsum("rk,rkh->kh", d, h)
                gb2 += d.sum(0)
                dz = d[:, :, None] * out
                dz *= h
                np.subtract(1, h, out=h)
                dz *= h
                g1 += x.T @ dz.reshape(len(x), -1)
                gb1 += dz.sum(0)
        grads = np.concatenate([
            g1.reshape(n_inputs, len(at), hidden).transpose(1, 0, 2).reshape(len(at), -1), gb1,
            np.stack([-g2, g2], 2).reshape(len(at), -1), np.stack([-gb2, gb2], 1)], 1)
        yield pa.RecordBatch.from_pydict({
            "k": pa.array(live, pa.int32()), "part": pa.array([np.append(a, g).tobytes() for a, g in zip(loss, grads)])})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("k").to_pylist(), batch.column("part")):
                total[k] = total.get(k, 0.0) + np.frombuffer(part.as_py())
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(total), pa.int32()),
                                          "part": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    parts = rows.select("slots", "counts", "ys").coalesce(tasks).mapInArrow(sums, "k int, part binary")
    found = parts.repartition("k").mapInArrow(add, "k int, part binary").collect()       # a row a label
    return {r["k"]: (float(v[0]), v[1:]) for r in found for v in [np.frombuffer(r["part"])]}


class _Search:
    """L-BFGS of one network: ``at`` is where the next pass looks, ``w`` the best so far.

    A step is taken if it lowers the loss enough (Armijo) and is halved otherwise; a
    pair of (step, change of gradient) that shows no curvature is not remembered."""

    def __init__(self, w: np.ndarray, max_iter: int, tolerance: float):
        self.w, self.at, self.max_iter, self.tolerance = w, w, max_iter, tolerance
        self.loss = self.gradient = self.direction = None
        self.share, self.steps, self.done = 1.0, 0, max_iter < 1
        self.past: list[tuple[np.ndarray, np.ndarray]] = []

    def _direction(self) -> np.ndarray:
        q, alphas = self.gradient.copy(), []
        for s, y in reversed(self.past):
            alphas.append((s @ q) / (s @ y))
            q -= alphas[-1] * y
        if self.past:
            s, y = self.past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.past, reversed(alphas)):
            q += (a - (y @ q) / (s @ y)) * s
        return -q

    def move(self, loss: float, gradient: np.ndarray) -> None:
        if self.loss is not None:
            slope = self.gradient @ self.direction
            if not loss <= self.loss + 1e-4 * self.share * slope:
                self.share /= 2
                self.done = self.share < 1e-10
                self.at = self.w + self.share * self.direction
                return
            s, y = self.at - self.w, gradient - self.gradient
            if s @ y > 1e-12 * (y @ y):
                self.past = [*self.past, (s, y)][-MEMORY:]
            self.steps += 1
            gain = self.loss - loss
            self.done = self.steps >= self.max_iter or gain <= self.tolerance * max(abs(self.loss), abs(loss), 1e-6)
        self.w, self.loss, self.gradient = self.at, loss, gradient
        self.direction = self._direction()
        if self.gradient @ self.direction >= 0:     # no descent: start over with the gradient
            self.past, self.direction = [], -self.gradient
        norm = np.sqrt(self.gradient @ self.gradient)
        self.done = self.done or norm <= self.tolerance * max(abs(loss), 1e-6)
        self.share = 1.0 if self.past else min(1.0, 1 / max(norm, 1e-300))
        self.at = self.w + self.share * self.direction


def fit_networks(rows: DataFrame, n_rows: list[int], n_inputs: int, hidden: int, max_iter: int,
                 seed: int = 42, tolerance: float = 1e-6, scale: np.ndarray | None = None) -> np.ndarray:
    """Weights of a network per label.  ``rows(slots, counts, ys)``: a document's
    sparse inputs and its class (0, 1, or -1 for none) for every label; ``n_rows`` counts
    a label's rows (labels with none keep the first weights).  ``scale[label, class]``
    weighs the rows of a class; a label's weights add up to its rows."""
    spark = rows.sparkSession
    start = first_weights(spark, n_inputs, hidden, seed)
    searches = [_Search(start, max_iter if n else 0, tolerance) for n in n_rows]
    tasks = spark.sparkContext.defaultParallelism
    while not all(s.done for s in searches):
        live = np.array([k for k, s in enumerate(searches) if not s.done])
        w = np.stack([s.at for s in searches])
        for k, (loss, gradient) in _losses(rows, w, live, n_inputs, hidden, tasks, scale).items():
            searches[k].move(loss / n_rows[k], gradient / n_rows[k])
    return np.stack([s.w for s in searches])


def predict_networks(rows: DataFrame, w: np.ndarray, n_inputs: int, hidden: int, id_col: str) -> DataFrame:
    """(id, ys, guess): the more likely class of every label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            guess = [row for _, x in _dense(batch, n_inputs) for row in (_forward(x, w, n_inputs, hidden)[1] > 0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("ys"),
                 pa.array([g.astype(np.int32).tolist() for g in guess], pa.list_(pa.int32()))], names=[id_col, "ys", "guess"])

    id_type = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "slots", "counts", "ys").mapInArrow(run, f"{id_col} {id_type}, ys array<int>, guess array<int>")
