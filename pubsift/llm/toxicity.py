"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes
log-count ratios, trained on labelled text.

1. Every labelled training text gives the set of hashed n-grams it contains;
   Spark counts, per class, the texts that contain each n-gram (all labelled
   rows).  The smoothed log ratio of the two class frequencies scales a feature.
2. The ``N_FEATURES`` n-grams with the strongest evidence (log ratio times the
   root of the texts that have it) are kept.
3. A logistic regression is fitted on a bounded sample: the ``MAX_PER_CLASS``
   texts of each class with the smallest hash of their id, weighted to the class
   sizes of all labelled rows.  A feature is its log ratio if present, else 0.
4. Every whole text is scored in one pass.

Inputs of a score are the text only.  Cases: null and empty texts have no
n-grams and get the intercept's score; without labelled texts, or with one
class only, the score is the share of toxic labels (0 without any); repeated
labels of an id count as toxic if one of them does; null labels are ignored;
other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pubsift.llm.common import Workspace

ORDERS = (3, 4, 5)
BITS = 18
N_FEATURES = 2048
MAX_PER_CLASS = 2000
SMOOTHING = 1.0
L2 = 1e-3
STEPS = 300
HOLDOUT = 5

_MUL = np.uint32(0x01000193)
_MIX = np.uint32(0x9E3779B1)


def gram_slots(text: str | None) -> np.ndarray:
    """Hashed slots of all character n-grams of a text, with repeats."""
    if not text:
        return np.empty(0, dtype=np.uint32)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out, gram = [], c
    for n in range(2, max(ORDERS) + 1):
        if len(c) < n:
            break
        gram = gram[:-1] * _MUL + c[n - 1:]
        if n in ORDERS:
            mixed = (gram + np.uint32(n)) * _MIX
            mixed ^= mixed >> np.uint32(15)
            out.append((mixed * _MIX) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


@dataclass
class Model:
    """``slot_of[s]`` is the feature of slot s (-1: none)."""

    slot_of: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        f = self.slot_of[gram_slots(text)]
        z = self.bias + float(self.weight[np.unique(f[f >= 0])].sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, toxic)`` of the labels that may be learnt from."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HOLDOUT == 0
    return (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held)
            .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))


def slot_counts(texts: DataFrame) -> DataFrame:
    """``(slot, neg, pos)``: texts of each class that contain a slot, from ``(text, toxic)``.
    Slot -1 counts the texts.  Each task adds up its own texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, 1 << BITS), dtype=np.int64)
        texts = [0, 0]
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                y = int(toxic > 0)
                texts[y] += 1
                seen = np.zeros(1 << BITS, dtype=bool)
                seen[gram_slots(text)] = True
                count[y] += seen
        slots = np.flatnonzero(count.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(slots, -1)), pa.array(np.append(count[0, slots], texts[0])),
             pa.array(np.append(count[1, slots], texts[1]))], ["slot", "neg", "pos"])

    parts = texts.select("text", "toxic").mapInArrow(run, "slot long, neg long, pos long")
    return parts.groupBy("slot").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))


def fit(docs: DataFrame, labels: DataFrame, n_features: int = N_FEATURES,
        max_per_class: int = MAX_PER_CLASS) -> Model:
    rows = training_rows(docs, labels)
    text = F.col("text").cast("string").alias("text")
    # Texts meet their labels in a shuffle join at every size: the labels grow
    # with the corpus, so a plan that broadcasts a small table would not last.
    counts = slot_counts(docs.select("doc_id", text).join(rows.hint("merge"), "doc_id"))
    counts = counts.where((F.col("neg") > 0) | (F.col("pos") > 0))
    ws = Workspace(docs.sparkSession, "toxicity")
    counts = ws.put(counts, "counts")
    total = counts.where("slot = -1").collect()
    neg, pos = (int(total[0]["neg"]), int(total[0]["pos"])) if total else (0, 0)
    none = np.full(1 << BITS, -1, dtype=np.int32)
    if not neg or not pos:
        share = pos / (neg + pos) if neg + pos else 0.0
        return Model(none, np.empty(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    ratio = (F.log((F.col("pos") + SMOOTHING) / F.lit(pos + 2 * SMOOTHING))
             - F.log((F.col("neg") + SMOOTHING) / F.lit(neg + 2 * SMOOTHING)))
    best = (counts.where("slot >= 0").withColumn("r", ratio)
            .orderBy(F.desc(F.abs("r") * F.sqrt(F.col("neg") + F.col("pos"))), "slot")
            .limit(n_features).select("slot", "r").collect())
    slots, r = np.array([x[0] for x in best]), np.array([x[1] for x in best])
    none[slots] = np.arange(len(slots))
    slot_of = none

    ids = [x["doc_id"] for y in (0, 1)
           for x in rows.where((F.col("toxic") > 0) == F.lit(bool(y)))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class).collect()]
    if not ids:
        return Model(slot_of, np.zeros(len(slots)), 0.0)

    @F.pandas_udf("array<int>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(f[f >= 0]) for f in (slot_of[gram_slots(t)] for t in texts)])

    # At most 2 x max_per_class ids: a bounded table.
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long"))
    sample = (docs.select("doc_id", text).join(chosen, "doc_id", "left_semi")
              .select("doc_id", features("text").alias("f")).join(rows, "doc_id")
              .orderBy(F.xxhash64("doc_id"), "f").limit(2 * max_per_class).collect())
    x = np.zeros((len(sample), len(slots)), dtype=np.float32)
    y = np.array([float(s["toxic"] > 0) for s in sample], dtype=np.float32)
    for i, s in enumerate(sample):
        x[i, s["f"]] = r[s["f"]]
    size = np.array([neg, pos]) / np.maximum(1, [(y == 0).sum(), (y == 1).sum()])
    weight = np.where(y > 0, size[1], size[0]).astype(np.float32)
    w, b = _logistic(x, y, weight / weight.sum())
    ws.drop("counts")
    return Model(slot_of, (w * r).astype(np.float64), b)


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Adam on the full, bounded sample."""
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(np.float32) + w[-1], -40, 40)))
        g = share * (p - y)
        grad = np.append(x.T @ g.astype(np.float32) + L2 * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def scorer(spark: SparkSession, model: Model):
    """A function of a text column to the score column."""
    sent = spark.sparkContext.broadcast(model)      # 2^BITS slots: a fixed size

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = sent.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    return lambda text: score((F.col(text) if isinstance(text, str) else text).cast("string"))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % HOLDOUT == 0
