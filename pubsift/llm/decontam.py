"""Benchmark decontamination with one Aho-Corasick automaton.

Items are normalised to words (A-Z lower-cased, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``).  A window is ``WINDOW`` consecutive
words of an item; an item with fewer words is one window.  Every window holds one
of the item's anchors, the runs of 7 words that start at multiples of 7, so the
automaton holds the anchors: about the text of the benchmark, a thirteenth of its
windows.  Every text is normalised byte for byte and scanned once.  Each anchor
found is extended in both directions as long as text and item agree; a run of at
least ``WINDOW`` words is a chain of windows.  Runs are kept as word numbers and
mapped to character offsets of the original text.

The benchmark is read to the driver one block at a time, and its size is
checked: a block holds at most ``MAX_BLOCK_CHARS`` of item text (long items are
cut into pieces that share ``WINDOW - 1`` words) and becomes one automaton.  A
benchmark within that bound is one block.  A larger one is scanned block by block
with the same result: texts are then held up to ``HELD_CHARS``, so that an
automaton is built once for many Arrow batches.

Cases: null or empty texts and items have no words and no hits; repeated items
count by distinct ``item_id``; a null ``item_id`` is ignored; repeated
documents each get their row; very long texts are scanned whole, one at a time;
other columns, whatever their names, pass through unread.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pubsift.llm.common import as_bytes, frame, letter_words

WINDOW = 13
MAX_BLOCK_CHARS = 4_000_000
PIECE_WORDS = 10_000
HELD_CHARS = 32_000_000
RESULT = ("n_words long, n_hit long, n_items long, items array<long>, "
          "spans array<struct<start:long,end:long>>")
_FIELDS = ["n_words", "n_hit", "n_items", "items", "spans"]


def item_pieces(data: bytes, window: int = WINDOW) -> list[bytes]:
    """The item's words in lines of bounded size that together hold every window."""
    words = letter_words(data)
    size = max(PIECE_WORDS, 2 * window)
    return [b" ".join(words[i:i + size]) for i in range(0, max(1, len(words) - window + 1), size - window + 1)
            if words]


def anchors(words: list[bytes], window: int = WINDOW) -> Iterator[tuple[int, list[bytes]]]:
    """``(start, words)`` of runs of which every window of ``words`` holds one."""
    if len(words) < window:
        yield 0, words
        return
    step = (window + 1) // 2
    for i in range(0, len(words) - step + 1, step):
        yield i, words[i:i + step]


def item_blocks(benchmark: DataFrame, window: int, max_chars: int) -> Iterator[list]:
    """Blocks ``[(piece, item ids)]`` of bounded size; equal pieces are one."""
    rows = (benchmark.where(F.col("item_id").isNotNull())
            .select(F.col("item_id").cast("long"), as_bytes("text")))
    block: dict[bytes, set] = {}
    held = 0
    for item, data in rows.toLocalIterator():
        for piece in item_pieces(bytes(data), window):
            if piece not in block:
                if held and held + len(piece) > max_chars:
                    yield list(block.items())
                    block, held = {}, 0
                block[piece] = set()
                held += len(piece)
            block[piece].add(item)
    if block:
        yield list(block.items())


_BUILT: dict[str, object] = {}      # per Python worker: the automaton last used


def _automaton(key: str, block: list, window: int):
    """``(automaton, pieces)``: anchors to ``(words, [(piece, start)])``, and
    ``(words, least run, item ids)`` of each piece."""
    if key not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        same: dict[bytes, bytes] = {}       # one object for equal words
        pieces, places = [], defaultdict(list)
        for n, (line, ids) in enumerate(block):
            words = [same.setdefault(w, w) for w in line.split()]
            pieces.append((words, min(window, len(words)), ids))
            for start, run in anchors(words, window):
                places[" " + b" ".join(run).decode("latin-1") + " "].append((n, start))
        auto = ahocorasick.Automaton()
        for text, where in places.items():
            auto.add_word(text, (text.count(" ") - 1, where))
        auto.make_automaton()
        _BUILT[key] = (auto, pieces)
    return _BUILT[key]


def _matches(auto, pieces: list, words: list[bytes]) -> list[tuple[int, int, set]]:
    """``(first word, words, items)`` of every longest run with an item that holds a window."""
    line = b" " + b" ".join(words) + b" "
    found = list(auto.iter(line.decode("latin-1")))
    if not found:
        return []
    spaces = np.cumsum(np.frombuffer(line, dtype=np.uint8) == 32)
    out, done = [], {}
    for end, (k, places) in found:
        p = int(spaces[end]) - 1 - k
        for n, j in places:
            if p < done.get((n, p - j), 0):         # inside a run already extended
                continue
            item, least, ids = pieces[n]
            before, after = 0, k
            while before < min(p, j) and words[p - before - 1] == item[j - before - 1]:
                before += 1
            while after < min(len(words) - p, len(item) - j) and words[p + after] == item[j + after]:
                after += 1
            done[n, p - j] = p + after
            if before + after >= least:
                out.append((p - before, before + after, ids))
    return out


def _spans(data: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets in the original text of each run of hit words."""
    mask = np.frombuffer(data.translate(_IS_WORD), dtype=np.uint8) == 1
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)))
    return [(int(lead[first[a]]), int(lead[last[b - 1]]))
            for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1))]


_IS_WORD = bytes(1 if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 0
                 for b in range(256))


def scanner(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW,
            max_chars: int = MAX_BLOCK_CHARS, spans: bool = True):
    """A function of a text column to the struct ``RESULT``; one per benchmark."""
    sent = [spark.sparkContext.broadcast(b) for b in item_blocks(benchmark, window, max_chars)]
    key = uuid.uuid4().hex

    def judged(texts: pd.Series) -> pd.DataFrame:
        # The words of one text are held at a time.
        sizes, hits = np.zeros(len(texts), dtype=np.int64), defaultdict(list)
        for i, block in enumerate(sent):
            auto, pieces = _automaton(f"{key}-{i}", block.value, window)
            for row, t in enumerate(texts):
                w = letter_words(bytes(t))
                sizes[row] = len(w)
                if w and (found := _matches(auto, pieces, w)):
                    hits[row] += found
        if not sent:
            sizes = np.array([len(letter_words(bytes(t))) for t in texts], dtype=np.int64)
        out = []
        for row, size in enumerate(sizes.tolist()):
            if row not in hits:
                out.append((size, 0, 0, [], []))
                continue
            hit, items = np.zeros(size, dtype=bool), set()
            for first, k, ids in hits[row]:
                hit[first:first + k] = True
                items.update(ids)
            where = _spans(bytes(texts.iloc[row]), hit) if spans else []
            out.append((size, int(hit.sum()), len(items), sorted(items),
                        [{"start": a, "end": b} for a, b in where]))
        return frame(out, _FIELDS)

    @F.pandas_udf(RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held, chars = [], 0
        for texts in batches:
            held.append(texts)
            chars += int(texts.map(len).sum())
            if len(sent) < 2 or chars >= HELD_CHARS:
                yield judged(pd.concat(held, ignore_index=True))
                held, chars = [], 0
        if held:
            yield judged(pd.concat(held, ignore_index=True))

    return lambda text: scan(as_bytes(text))


def is_contaminated(result: Column) -> Column:
    """At least a twentieth of the words, and at least one, lie in windows."""
    return (result["n_hit"] > 0) & (F.lit(20) * result["n_hit"] >= result["n_words"])
