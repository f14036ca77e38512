"""Bound-certified best-fit packing of token sequences.

1. ``tokenize`` turns every text into token ids plus a separator and cuts texts
   longer than ``max_len`` into pieces of ``max_len`` (the first takes the
   remainder).
2. Full pieces are sequences of their own.  The others are dealt evenly over
   partitions of about ``PIECES_PER_PART`` rows and packed there by best-fit
   decreasing.
3. Dual-feasible functions give each partition a lower bound on its bins.  A
   partition that meets its bound is certified and keeps its bins, but for its
   emptiest one; a partition with a gap also gives up the emptiest bins that
   the gap covers.  The pieces given up are exchanged: dealt over a sixteenth
   of the partitions and packed again, until one partition is left.

The pool of a round is a few bins per partition, so rounds shrink by an order of
magnitude; every round is written, so a lost executor repeats its tasks only.

Ids are those of ``tokenizers`` for the given file.  ``tiktoken`` computes the
same ids three times as fast from the same vocabulary, so it encodes texts whose
characters all lie below U+0250 and hold no special token (there the two agree;
tested); ``tokenizers`` itself encodes the rest.

Cases: null text is empty and becomes the separator alone; repeated rows are
packed once each; an empty table gives no rows; ids of null documents stay null.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubsift.llm.common import Workspace

MAX_LEN = 2048
SEPARATOR = 0
PIECES_PER_PART = 50_000
EXCHANGE = 16               # partitions of a round that share one partition of the next
SAFE_BELOW = "ɐ"

_LOADED: dict[str, tuple] = {}


def _encoders(path: str, ranks_path: str | None):
    """Per worker process: the tokenizer, the fast encoder, the special strings."""
    key = f"{path}|{ranks_path}"
    if key not in _LOADED:
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(path)
        special = [t.content for t in exact.get_added_tokens_decoder().values()]
        fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens={})
        _LOADED[key] = (exact, fast, special)
    return _LOADED[key]


def encode(text: str | None, path: str, ranks_path: str | None = None) -> np.ndarray:
    exact, fast, special = _encoders(path, ranks_path)
    text = text or ""
    if fast is not None and (text.isascii() or max(text) < SAFE_BELOW) \
            and not any(s in text for s in special):
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
    return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut(n: int, max_len: int = MAX_LEN) -> list[tuple[int, int, int]]:
    """``(piece, start, length)`` of a document of n ids; the first may be shorter."""
    first = n % max_len or max_len
    return [(i, 0 if i == 0 else first + (i - 1) * max_len, first if i == 0 else max_len)
            for i in range(1 + (n - first) // max_len)]


def tokenize(docs: DataFrame, path: str, ranks_path: str | None = None, max_len: int = MAX_LEN,
             separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of every document."""
    kind = "array<struct<piece:int,start:long,length:long,ids_crc32:long" + (
        ",ids:array<int>" if with_ids else "") + ">>"

    @F.pandas_udf(kind)
    def pieces(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            ids = np.append(encode(t, path, ranks_path), np.array([separator], dtype="<u4"))
            rows = []
            for piece, start, length in cut(len(ids), max_len):
                part = ids[start:start + length]
                row = {"piece": piece, "start": start, "length": length, "ids_crc32": zlib.crc32(part.tobytes())}
                rows.append(row | {"ids": part.astype(np.int32)} if with_ids else row)
            out.append(rows)
        return pd.Series(out, dtype=object)

    return (docs.select("doc_id", F.explode(pieces(F.col("text").cast("string"))).alias("_p"))
            .select("doc_id", "_p.*"))


def lower_bound(lengths: np.ndarray, size: int = MAX_LEN) -> int:
    """Bins that any packing needs at least: the best of two families of
    dual-feasible functions over the histogram of lengths."""
    if not len(lengths):
        return 0
    x, count = np.unique(np.asarray(lengths, dtype=np.int64), return_counts=True)
    best = -(-int((x * count).sum()) // size)
    for cutoff in np.unique(np.minimum(x, size - x)):
        # Items over size - cutoff fill a bin, items under cutoff weigh nothing.
        if 0 < cutoff <= size // 2:
            f = np.where(x > size - cutoff, size, np.where(x < cutoff, 0, x))
            best = max(best, -(-int((f * count).sum()) // size))
    for k in range(1, 32):
        # Items round down to multiples of 1/k of a bin, but exact (k+1)-ths stay.
        whole = (k + 1) * x % size == 0
        f = np.where(whole, x * k, (k + 1) * x // size * size)      # in units of 1/k
        best = max(best, -(-int((f * count).sum()) // (size * k)))
    return best


def best_fit(lengths: np.ndarray, size: int = MAX_LEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: ``(bin, offset)`` of each item, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0               # bit r is set if some bin has room r left
    fill: list[int] = []
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = size, len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return where, offset, np.array(fill, dtype=np.int64)


_PACKED = ("doc_id long, piece int, start long, length long, ids_crc32 long, rid long, "
           "sequence_id long, offset long, placed boolean, certified boolean")


def _pack_round(rows: DataFrame, level: int, last: bool, size: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        pdf = pdf.sort_values("rid", kind="stable").drop(columns="part")
        lengths = pdf["length"].to_numpy()
        where, offset, fill = best_fit(lengths, size)
        gap = len(fill) - lower_bound(lengths, size)
        give = np.argsort(fill, kind="stable")[:0 if last else 2 * gap + 1]
        return pdf.assign(sequence_id=(level << 56) + (part << 32) + where, offset=offset,
                          placed=~np.isin(where, give), certified=gap == 0)

    return rows.groupBy("part").applyInPandas(run, _PACKED)


def pack(pieces: DataFrame, max_len: int = MAX_LEN, per_part: int = PIECES_PER_PART) -> DataFrame:
    """Add ``sequence_id``, ``offset`` and ``certified`` (the bins of the partition
    that placed the piece meet its lower bound) to ``tokenize`` rows."""
    ws = Workspace(pieces.sparkSession, "packing")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # Written once: the row numbers below must not change between two reads.
    rows = ws.put(pieces.select(*cols).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    result = cols + ["sequence_id", "offset", "certified"]
    done = rows.where(F.col("length") >= max_len).select(
        *cols, ((F.lit(127) * (1 << 55)) + F.col("rid")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    todo = rows.where(F.col("length") < max_len)
    n = todo.count()
    level, parts = 0, max(1, -(-n // per_part))
    while n:
        deal = F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(parts)).cast("int")
        packed = ws.put(_pack_round(todo.select(*cols, "rid", deal.alias("part")), level, parts == 1, max_len),
                        f"round{level}")
        done = done.unionByName(packed.where("placed").select(*result))
        if parts == 1:
            break
        todo = packed.where(~F.col("placed"))
        # A pool that did not shrink (no partition could be improved) is packed
        # over as many partitions as its rows need, so groups stay bounded.
        n = todo.count()
        fewer = max(1, -(-n // per_part))
        parts, level = (1 if fewer == 1 else min(parts - 1, max(fewer, -(-parts // EXCHANGE)))), level + 1
    return done


def default_paths() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


