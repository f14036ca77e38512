"""Periodic runs of words, found through string synchronising sets.

The words of many texts are one array of integers; a number of its own ends each
text.  Windows of 4, 8, 16 ... words get names, equal for equal windows, from the
names of their halves.

* Periods 1 to 3 come from a direct comparison of the array with itself.
* For periods from ``t`` to ``2t - 1`` the synchronising set of scale ``t`` holds
  the positions i where the least hash of the windows of ``t`` words that start
  at i to i + t belongs to the first or the last of them.  Windows of a highly
  periodic region (inside a run of period t/4 or less, found at a smaller scale)
  have no hash.  Whether i is in the set depends on the words i to i + 2t - 1
  alone, so a run repeats its positions period by period.
* A position and the next one with the same 2t words propose their distance as a
  period.  Neighbouring proposals of one distance are one candidate, which is
  compared word by word to both sides.

Every run of length 4q or more is found: a highly periodic region of t words has
its own shorter period, and by Fine and Wilf a run of period q >= t cannot hold
3t - 1 words of such a region, so its first t positions hold one of the set; the
next position with an equal context then lies one period on, as 2t words are
longer than the period.  A text leaves the search at the first scale where fewer
than 2t + 1 of its windows occur again in it: no run of that scale or above is
left.

Texts are worked on where they are read, ``BATCH_WORDS`` words at a time or one
text if that is longer; no shuffle.

Cases: null, empty and blank texts have no words, no runs and null run columns;
texts of any length are searched whole; repeated rows are searched each; an empty
table gives no rows; a null doc_id stays null and its words are not folded;
further columns are not read, whatever their names.  Among longest runs the one
with the smallest start, then period, is reported.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_WORDS = 400_000
MIN_LENGTH = 6
POWER = 4
DIRECT = 4                     # smaller periods are compared directly
NO_HASH = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A random-looking 63-bit number for each name."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def _shift(x: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full_like(x, fill)
    if by < len(x):
        out[:len(x) - by] = x[by:]
    return out


def _double(name: np.ndarray, width: int) -> np.ndarray:
    """Names of windows of twice the width."""
    other = _shift(name, width, -1) + 1
    return np.unique(name * (len(name) + 2) + other, return_inverse=True)[1].astype(np.int64)


def _repeats(name: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions with a later equal name in their text, and the next such position."""
    order = np.argsort(name, kind="stable")
    same = (name[order[1:]] == name[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    return order[:-1][same], order[1:][same]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of h[i .. i + width], width a power of two."""
    least, have = h, 1
    while have < width:
        least, have = np.minimum(least, _shift(least, have, NO_HASH)), 2 * have
    return np.minimum(least, _shift(h, width, NO_HASH))


def _stretch(words: np.ndarray, start: int, end: int, q: int) -> tuple[int, int]:
    """The longest stretch of period q around words[start:end], which has it."""
    x, step = end - q, 64                       # words[y] = words[y + q] for start <= y < x
    while x + q < len(words):
        stop = min(x + step, len(words) - q)
        off = np.flatnonzero(words[x:stop] != words[x + q:stop + q])
        if len(off):
            x += int(off[0])
            break
        x, step = stop, 2 * step
    y, step = start, 64
    while y > 0:
        stop = max(y - step, 0)
        off = np.flatnonzero(words[stop:y] != words[stop + q:y + q])
        if len(off):
            y = stop + int(off[-1]) + 1
            break
        y, step = stop, 2 * step
    return y, x + q


def find_runs(words: np.ndarray, sizes: np.ndarray, power: int = POWER) -> np.ndarray:
    """Rows ``(start, end, period)`` of all runs of ``power`` (4 or more) periods.

    ``words`` holds the texts one after the other, each followed by a number that
    occurs nowhere else; ``sizes`` counts the words of each text.
    """
    if power < 4:
        raise ValueError("synchronising sets are laid out for runs of four periods or more")
    n = len(words)
    found: dict[tuple[int, int], int] = {}
    for q in range(1, DIRECT):
        same = np.zeros(n + 1, np.int8)
        if n > q:
            same[1:n - q + 1] = words[:-q] == words[q:]
        edge = np.diff(same)
        for a, b in zip(np.flatnonzero(edge == 1).tolist(),
                        (np.flatnonzero(edge == -1) if same[-1] == 0 else
                         np.append(np.flatnonzero(edge == -1), n)).tolist()):
            if b - a + q >= 4 * q:
                found.setdefault((a, b + q), q)
    # Names of single words, then of windows of 4; positions of the texts still searched.
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    at = np.arange(n)
    name = np.unique(words, return_inverse=True)[1].astype(np.int64)
    t = 1
    while n:
        if t >= DIRECT:
            first, _ = _repeats(name, text[at])
            often = np.bincount(text[at[first]], minlength=len(sizes)) >= 2 * t + 1
            stay = (often & (sizes >= 4 * t))[text[at]]
        else:
            stay = (sizes >= 4 * DIRECT)[text[at]]
        at, name = at[stay], name[stay]
        n = len(at)
        if not n:
            break
        wide = _double(name, t)
        if t >= DIRECT:
            for start, end, q in list(_candidates(name, wide, at, text, t, found)):
                start, end = _stretch(words, start, end, q)
                if end - start >= 4 * q:
                    found.setdefault((start, end), q)
        name, t = wide, 2 * t
    rows = np.array([(s, e, q) for (s, e), q in found.items() if e - s >= power * q], np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _candidates(name, wide, at, text, t, found):
    """``(start, end, period)`` stretches, in the whole array, proposed at scale t."""
    # Highly periodic windows, at positions of the texts still searched.
    edge = np.zeros(len(at) + 1, np.int64)
    for (s, e), q in found.items():
        if POWER * q <= t <= e - s:
            i = int(np.searchsorted(at, s))
            if i < len(at) and at[i] == s:
                edge[i] += 1
                edge[i + e - s - t + 1] -= 1
    h = np.where(np.cumsum(edge[:-1]) > 0, NO_HASH, _mix(name))
    least = _least(h, t)
    chosen = np.flatnonzero((least != NO_HASH) & ((least == h) | (least == _shift(h, t, NO_HASH))))
    a, b = _repeats(wide[chosen], text[at[chosen]])
    a, b = at[chosen[a]], at[chosen[b]]
    near = (b - a >= t) & (b - a < 2 * t)
    a, q = a[near], (b - a)[near]
    order = np.lexsort((a, q))
    a, q = a[order], q[order]
    if not len(a):
        return
    new = np.ones(len(a), bool)
    new[1:] = (q[1:] != q[:-1]) | (a[1:] - a[:-1] > 2 * t)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(a)) - 1
    for i, j in zip(starts.tolist(), ends.tolist()):
        yield int(a[i]), int(a[j] + q[j] + 2 * t), int(q[i])


def fold(codes: np.ndarray, h: int | None) -> np.ndarray:
    """The words of a text whose number ends in 0 repeat from one place on."""
    n = len(codes)
    if h is None or h % 10 or not n:
        return codes
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return codes[np.where(i >= a, a + (i - a) % p, i)]


_RESULT = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
           "collapsed_sha256 string")


def describe(texts: list[str], numbers: list[int | None]) -> list[tuple]:
    """One row of ``_RESULT`` for each text."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    flat = [w for s in split for w in s]
    codes, distinct = pd.factorize(np.array(flat + [b""], dtype=object))
    distinct, codes = np.array(distinct, dtype=object), codes[:-1].astype(np.int64)
    sizes = np.array([len(s) for s in split], np.int64)
    ends = np.cumsum(sizes)
    del flat, split
    chunks = [fold(codes[e - n:e], h) for e, n, h in zip(ends.tolist(), sizes.tolist(), numbers)]
    words = np.concatenate([x for i, c in enumerate(chunks) for x in (c, [len(distinct) + i])] or [codes]).astype(np.int64)
    runs = find_runs(words, sizes)
    runs = runs[runs[:, 1] - runs[:, 0] >= MIN_LENGTH]
    offsets = np.cumsum(sizes + 1) - sizes - 1
    owner = np.searchsorted(offsets, runs[:, 0], side="right") - 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    dropped = np.cumsum(edge[:-1]) > 0
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    rows = []
    for i, chunk in enumerate(chunks):
        mine = runs[cut[i]:cut[i + 1]]
        start, length, period = mine[:, 0] - offsets[i], mine[:, 1] - mine[:, 0], mine[:, 2]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()))
        kept = chunk[~dropped[offsets[i]:offsets[i] + len(chunk)]]
        best = (None,) * 4
        if len(mine):
            b = int(np.lexsort((period, start, -length))[0])
            best = (int(start[b]), int(length[b]), int(period[b]), 1000 * int(length[b]) // int(period[b]))
        rows.append((len(mine), *best, hashlib.sha256(listed.encode()).hexdigest(),
                     hashlib.sha256(b" ".join(distinct[kept].tolist())).hexdigest()))
    return rows


def describer(batch_words: int = BATCH_WORDS):
    """A column function of a text and its number: the runs, as a struct."""
    names = [c.split(" ")[0] for c in _RESULT.split(", ")]

    @F.pandas_udf(_RESULT)
    def runs(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        rows, held, group = [], 0, ([], [])
        for text, h in zip(texts, numbers):
            group[0].append(text)
            group[1].append(None if pd.isna(h) else int(h))
            held += 1 + len(text or "") // 6
            if held >= batch_words:
                rows += describe(*group)
                held, group = 0, ([], [])
        rows += describe(*group)
        cols = list(zip(*rows)) if rows else [[] for _ in names]
        return pd.DataFrame({n: pd.Series(list(c), dtype="Int64" if i < 5 else object)
                             for i, (n, c) in enumerate(zip(names, cols))})

    return runs


def text_number(doc_id: str | Column) -> Column:
    """crc32 of the decimal id; decides which texts are folded."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, number of runs, the longest run, digests of all runs and of the
    text without its repeats, of every document."""
    return docs.select("doc_id", describer()(F.col("text").cast("string"), text_number("doc_id")).alias("r")).select(
        "doc_id", "r.*")
