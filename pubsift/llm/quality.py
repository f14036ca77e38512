"""Line sequence labelling for quality: a linear-chain conditional random field.

Every line of a text that has a word becomes a vector of binary features; a
two-state chain (boilerplate, content) is decoded with Viterbi, and the share of
word characters in content lines decides retention.

Training is weakly supervised by ``labels.quality``.  A bounded sample (the
``MAX_DOCS_PER_CLASS`` labelled texts of each class with the smallest hash of
their id, of each ``MAX_LINES`` lines at most, a run that starts at a place
given by the same hash) is collected.  Lines of good texts are content.  Lines
of poor texts are boilerplate at first; a first fit without transitions frees
those that look like content, and the chain is fitted on the result by maximum
likelihood.

Cases: null and empty texts have no words; they fail the base rules.  Without
labels, or with one class only, every line is content, so the base rules decide.
Null labels are ignored; of repeated labels the lowest counts.  Other columns
pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubsift.llm.common import as_bytes, frame

MAX_DOCS_PER_CLASS = 1500
MAX_LINES = 24
MIN_CONTENT_SHARE = 0.5
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
L2 = 2e-3
STEPS = 120

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
FEATURES = ("bias", "words<=2", "words<=5", "words<=15", "words>15", "symbols>5%", "symbols>25%",
            "symbols>75%", "bars", "ends sentence", "upper>30%", "upper>60%", "exclaims>20%",
            "digits>15%", "digits>40%", "distinct<75%", "distinct<40%", "same as before",
            "long words", "short words", "alphabetic>85%", "alphabetic<60%", "link or mail")


def line_features(line: bytes, words: list[bytes], seen: set) -> list[int]:
    """Numbers of the features that a line has."""
    n, chars = len(words), sum(map(len, words))
    sym = sum(line.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS)))
    upper = len(line) - len(line.translate(None, _UPPER))
    digit = len(line) - len(line.translate(None, _DIGITS))
    alpha = chars - len(line.translate(None, _LETTERS + SPACES))
    distinct = len(set(words)) / n
    tests = (True, n <= 2, n <= 5, 5 < n <= 15, n > 15, sym > 0.05 * n, sym > 0.25 * n, sym > 0.75 * n,
             line.count(b"|") > 0.2 * n, words[-1][-1:] in b".!?", upper > 0.3 * chars, upper > 0.6 * chars,
             line.count(b"!") > 0.2 * n, digit > 0.15 * chars, digit > 0.4 * chars,
             n > 4 and distinct < 0.75, n > 4 and distinct < 0.4, line in seen, chars > 15 * n, chars < 2 * n,
             alpha > 0.85 * chars, alpha < 0.6 * chars, b"://" in line or b"@" in line)
    return [i for i, t in enumerate(tests) if t]


_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))


def text_lines(data: bytes) -> Iterator[tuple[bytes, list[bytes]]]:
    for line in data.split(b"\n"):
        if words := line.split():
            yield line, words


@dataclass
class Chain:
    """Scores of state 1 (content) over state 0, and of transitions."""

    emit: np.ndarray        # (features, 2)
    start: np.ndarray       # (2,)
    step: np.ndarray        # (2, 2)

    def decode(self, feats: list[list[int]]) -> list[int]:
        """Viterbi."""
        emit, back = self.emit.tolist(), []
        (t00, t01), (t10, t11) = self.step.tolist()
        a, b = self.start.tolist()
        first = True
        for f in feats:
            e0 = e1 = 0.0
            for i in f:
                e0 += emit[i][0]
                e1 += emit[i][1]
            if first:
                a, b, first = a + e0, b + e1, False
                continue
            p0, p1 = int(b + t10 > a + t00), int(b + t11 >= a + t01)
            back.append((p0, p1))
            a, b = (b + t10 if p0 else a + t00) + e0, (b + t11 if p1 else a + t01) + e1
        states = [int(b >= a)]
        for p in reversed(back):
            states.append(p[states[-1]])
        return states[::-1]


def content_share(chain: Chain, data: bytes) -> float:
    """Share of word bytes in lines that the chain labels content; 1 without lines."""
    feats, sizes, seen = [], [], set()
    for line, words in text_lines(data):
        feats.append(line_features(line, words, seen))
        sizes.append(sum(map(len, words)))
        seen.add(line)
    if not feats:
        return 1.0
    states = chain.decode(feats)
    return sum(s for s, y in zip(sizes, states) if y) / sum(sizes)


def repeat_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    key, size = w[:n - window + 1], len(ids)
    for k in range(1, window):
        key = key * size + w[k:n - window + 1 + k]
        if size ** window > 2 ** 62:      # renumber before it overflows
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    start = np.flatnonzero(count[inverse] > 1)
    hit = np.zeros(n, dtype=bool)
    for k in range(window):
        hit[start + k] = True
    return int(hit.sum())


def dup_lines(data: bytes) -> int:
    seen, n = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(SPACES):
            seen.add(line)
    return n


def code_points(data: bytes) -> int:
    a = np.frombuffer(data, dtype=np.uint8)
    return int(np.count_nonzero((a & 0xC0) != 0x80))


RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, content_share double, kept boolean")
_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
           "content_share", "kept"]


def judge(chain: Chain, data: bytes) -> tuple:
    words = data.split()
    n = len(words)
    rep = repeat_words(words)
    failed = n < MIN_WORDS or 100 * rep > MAX_REPEAT_PCT * n
    share = content_share(chain, data)
    return (n, code_points(data.translate(None, SPACES)),
            sum(data.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS))), dup_lines(data), rep, failed,
            share, not failed and share >= MIN_CONTENT_SHARE)


def judger(spark: SparkSession, chain: Chain):
    """A function of a text column to the struct ``RESULT``."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return frame([judge(chain, bytes(t)) for t in texts], _FIELDS)

    return lambda text="text": run(as_bytes(text))


# --- training ---------------------------------------------------------------

def training_lines(docs: DataFrame, labels: DataFrame, per_class: int = MAX_DOCS_PER_CLASS,
                   max_lines: int = MAX_LINES) -> list[tuple[int, list[list[int]]]]:
    """``(quality, features of consecutive lines)`` of the bounded sample."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
             .groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality")))
    ids = [(x["doc_id"], y) for y in (0, 1)
           for x in known.where((F.col("quality") > 0) == F.lit(bool(y)))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    if len({y for _, y in ids}) < 2:
        return []

    @F.pandas_udf("array<array<int>>")
    def features(texts: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for data, h in zip(texts, at):
            seen, feats = set(), []
            for line, words in text_lines(bytes(data)):
                feats.append(line_features(line, words, seen))
                seen.add(line)
            first = int(h) % max(1, len(feats) - max_lines + 1)
            out.append(feats[first:first + max_lines])
        return pd.Series(out, dtype=object)

    # At most 2 x per_class ids: a bounded table.
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, _quality int"))
    rows = (docs.select("doc_id", as_bytes("text").alias("_data")).join(chosen, "doc_id")
            .select("doc_id", "_quality", features("_data", F.abs(F.xxhash64("doc_id") % 1_000_003)).alias("_f"))
            .orderBy(F.xxhash64("doc_id"), "_f").limit(2 * per_class).collect())
    return [(r["_quality"], [list(f) for f in r["_f"]]) for r in rows if r["_f"]]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = MAX_DOCS_PER_CLASS,
        max_lines: int = MAX_LINES) -> Chain:
    k = len(FEATURES)
    seqs = training_lines(docs, labels, per_class, max_lines)
    if len({y for y, _ in seqs}) < 2:
        content = np.zeros((k, 2))
        content[0, 1] = 1.0
        return Chain(content, np.zeros(2), np.zeros((2, 2)))
    n, length = len(seqs), max(len(f) for _, f in seqs)
    x = np.zeros((n, length, k), dtype=np.float32)
    there = np.zeros((n, length), dtype=bool)
    y = np.zeros((n, length), dtype=np.int64)
    for i, (good, feats) in enumerate(seqs):
        y[i, :len(feats)] = good
        there[i, :len(feats)] = True
        for t, f in enumerate(feats):
            x[i, t, f] = 1.0
    lines = _fit_chain(x, y, there, chained=False)
    margin = x @ (lines.emit[:, 1] - lines.emit[:, 0]).astype(np.float32)
    y = np.where(margin > 0, 1, y)
    return _fit_chain(x, y, there, chained=True)


def _fit_chain(x: np.ndarray, y: np.ndarray, there: np.ndarray, chained: bool) -> Chain:
    """Maximum likelihood with L2 by Adam; expectations by forward-backward."""
    n, length, k = x.shape
    emit, start, step = np.zeros((k, 2)), np.zeros(2), np.zeros((2, 2))
    both = there[:, 1:] & there[:, :-1]
    gold = np.zeros((n, length, 2))
    gold[np.arange(n)[:, None], np.arange(length)[None], y] = there
    gold_step = np.einsum("nti,ntj->ij", gold[:, :-1] * both[..., None], gold[:, 1:])
    moment, square = np.zeros(2 * k + 6), np.zeros(2 * k + 6)
    scale = max(1, there.sum())
    flat = x.reshape(-1, k)
    for it in range(1, STEPS + 1):
        if not chained:
            z = flat @ emit.astype(np.float32)
            p = np.exp(z - np.logaddexp(z[:, :1], z[:, 1:])).reshape(n, length, 2) * there[..., None]
            grad = np.zeros(2 * k + 6)
            grad[:2 * k] = (flat.T @ (p - gold).reshape(-1, 2).astype(np.float32) / scale + L2 * emit).ravel()
        else:
            grad = _chain_gradient(x, flat, gold, gold_step, there, both, emit, start, step, scale)
        moment, square = 0.9 * moment + 0.1 * grad, 0.999 * square + 0.001 * grad ** 2
        delta = 0.1 * (moment / (1 - 0.9 ** it)) / (np.sqrt(square / (1 - 0.999 ** it)) + 1e-9)
        emit -= delta[:2 * k].reshape(k, 2)
        start -= delta[2 * k:2 * k + 2]
        step -= delta[2 * k + 2:].reshape(2, 2)
    return Chain(emit, start, step)


def _chain_gradient(x, flat, gold, gold_step, there, both, emit, start, step, scale) -> np.ndarray:
    """Expected minus observed feature counts, by forward-backward over the batch."""
    n, length, _ = x.shape
    e = (flat @ emit.astype(np.float32)).reshape(n, length, 2).astype(float)
    fwd, bwd = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    fwd[:, 0] = start + e[:, 0]
    for t in range(1, length):
        s = fwd[:, t - 1][:, :, None] + step + e[:, t][:, None, :]
        fwd[:, t] = np.where(both[:, t - 1][:, None], np.logaddexp(s[:, 0], s[:, 1]), fwd[:, t - 1])
    for t in range(length - 2, -1, -1):
        s = step + (e[:, t + 1] + bwd[:, t + 1])[:, None, :]
        bwd[:, t] = np.where(both[:, t][:, None], np.logaddexp(s[..., 0], s[..., 1]), 0.0)
    z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    node = np.exp(fwd + bwd - z[:, None, None]) * there[..., None]
    pair = np.exp(fwd[:, :-1, :, None] + step + (e[:, 1:] + bwd[:, 1:])[:, :, None, :]
                  - z[:, None, None, None]) * both[..., None, None]
    return np.concatenate([
        ((flat.T @ (node - gold).reshape(-1, 2).astype(np.float32)) / scale + L2 * emit).ravel(),
        (node[:, 0] - gold[:, 0]).sum(axis=0) / scale + L2 * start,
        ((pair.sum(axis=(0, 1)) - gold_step) / scale + L2 * step).ravel()])
