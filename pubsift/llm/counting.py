"""Token counts of whole texts by rank-synchronous merging of ragged arrays.

1. Texts are cut at the tokenizer's special strings, normalised and split at
   white space; the distinct words of a batch are split into pre-tokens.
2. All distinct pre-tokens of a batch become one ragged array of symbol ids, one
   segment each.  A segment is cut further wherever no token of the vocabulary
   spans the boundary, so very long pre-tokens fall apart.
3. In each round every segment looks up the ranks of its neighbouring pairs and
   merges all places of its lowest-ranked pair at once (in a chain of equal
   symbols every second one).  Segments without a pair to merge leave the
   arrays, their symbols counted.

Merging all places of a pair at once equals merging them one by one if no token
has two rules and every rule comes after those that make its parts: a merge then
never brings up a pair of lower rank.  A vocabulary is checked for that; where it
does not hold, only a segment's leftmost lowest pair is merged in a round.

Texts are counted where they are read: no shuffle.  A worker holds the words of
``BATCH_CHARS`` characters at a time, or of one text if that is longer.

Cases: null text is empty and has 0 bytes and 0 tokens; so has white space alone
0 tokens; texts of any length are counted whole; repeated rows are counted each;
an empty table gives no rows; a null doc_id stays null; further columns are not
read, whatever their names.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_CHARS = 4_000_000
LIMIT = 2048
NEVER = np.int64(1) << 40

_LOADED: dict[str, "MergeTable"] = {}


def byte_symbols() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as its own character and the
    others, in order, as the characters from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeTable:
    """Merge rules of a byte-level tokenizer file as sorted arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in (
                "dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: only plain byte-level merge rules are supported")
        added = spec["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: special tokens must match their plain text")
        names = sorted((re.escape(t["content"]) for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(names)) if names else None
        # ASCII words are split by the same pattern, compiled here; a lower-cased
        # ASCII word has no other letters and digits than these.
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.ascii_pattern = re.compile(split.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r" \t-\r").encode())
        self.to_byte = {ord(c): chr(b) for c, b in byte_symbols().items()}

        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner, self.final = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c, b in byte_symbols().items():
            self.inner[b], self.final[b] = vocab[c], vocab[c + suffix]
        self.n_ids = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left * self.n_ids + right)
        self.keys, self.ranks, self.made = (left * self.n_ids + right)[order], order, made

        born = np.full(self.n_ids, -1)
        born[made] = np.arange(len(made))
        self.together = (len(np.unique(made)) == len(made)
                         and bool((np.maximum(born[left], born[right]) < np.arange(len(made))).all()))
        # crossed[x, y]: some token holds the symbols x and y of single bytes side by side.
        first, last = np.arange(self.n_ids), np.arange(self.n_ids)
        base = np.full(self.n_ids, -1)
        base[np.concatenate([self.inner, self.final])] = np.arange(512)
        self.crossed = np.zeros((512, 512), bool)
        for a, b, c in zip(left.tolist(), right.tolist(), made.tolist()):
            self.crossed[base[last[a]], base[first[b]]] = True
            first[c], last[c] = first[a], last[b]
        self.base = base

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n_ids + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def words(self, text: str) -> tuple[list[bytes], int]:
        """Normalised words between white space, in UTF-8, and the number of special strings."""
        parts = self.special.split(text) if self.special else [text]
        found: list[bytes] = []
        for part in parts:
            part = part.lower() if part.isascii() else self.library.normalizer.normalize_str(part)
            # Bytes split at the ASCII white space alone; the normaliser made all
            # other white space plain spaces.
            found += part.encode().split()
        return found, len(parts) - 1

    def pieces(self, word: bytes) -> list[bytes]:
        """Pre-tokens of one word."""
        if word.isascii():
            return self.ascii_pattern.findall(word)
        return [p.translate(self.to_byte).encode("latin-1")
                for p, _ in self.library.pre_tokenizer.pre_tokenize_str(word.decode())]

    def symbol_counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token when no rule applies any more."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        counts = np.zeros(len(pieces), np.int64)
        if not lengths.sum():
            return counts
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(lengths)
        sym = self.inner[data]
        sym[ends[lengths > 0] - 1] = self.final[data[ends[lengths > 0] - 1]]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        opens = np.ones(len(sym), bool)
        opens[1:] = (owner[1:] != owner[:-1]) | ~self.crossed[self.base[sym[:-1]], self.base[sym[1:]]]
        while len(sym):
            starts = np.flatnonzero(opens)
            segment = np.cumsum(opens) - 1
            rank = np.full(len(sym), NEVER)
            inside = np.flatnonzero(~opens[1:])
            rank[inside] = self.pair_ranks(sym[inside], sym[inside + 1])
            low = np.minimum.reduceat(rank, starts)
            live = low < NEVER
            np.add.at(counts, owner[starts[~live]], np.diff(starts, append=len(sym))[~live])
            hits = np.flatnonzero((rank == low[segment]) & live[segment])
            if not len(hits):
                break
            if self.together:
                # Places side by side share a symbol: take every second one.
                fresh = np.diff(hits, prepend=-2) != 1
                nth = np.arange(len(hits))
                hits = hits[(nth - np.maximum.accumulate(np.where(fresh, nth, 0))) % 2 == 0]
            else:
                hits = hits[np.diff(segment[hits], prepend=-1) != 0]
            sym[hits] = self.made[rank[hits]]
            keep = live[segment]
            keep[hits + 1] = False
            sym, owner, opens = sym[keep], owner[keep], opens[keep]
        return counts

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        words: list[bytes] = []
        sizes, total = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found, total[i] = self.words(text)
            words += found
            sizes.append(len(found))
        if not words:
            return total
        code, distinct = pd.factorize(np.array(words, dtype=object))
        split = [self.pieces(w) for w in distinct]
        flat = [p for s in split for p in s]
        piece_code, piece_distinct = pd.factorize(np.array(flat + [b""], dtype=object))
        per_piece = self.symbol_counts(list(piece_distinct))[piece_code[:-1]]
        of_word = np.repeat(np.arange(len(split)), [len(s) for s in split])
        per_word = np.bincount(of_word, weights=per_piece, minlength=len(split)).astype(np.int64)
        of_text = np.repeat(np.arange(len(texts)), sizes)
        return total + np.bincount(of_text, weights=per_word[code], minlength=len(texts)).astype(np.int64)


def merge_table(path: str) -> MergeTable:
    """One table a worker process."""
    if path not in _LOADED:
        _LOADED[path] = MergeTable(path)
    return _LOADED[path]


def counter(path: str, batch_chars: int = BATCH_CHARS):
    """A column function: tokens of a text under the tokenizer file at ``path``."""

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        rules, out, group, held = merge_table(path), [], [], 0
        for text in texts:
            group.append(text or "")
            held += len(group[-1])
            if held >= batch_chars:
                out.append(rules.count(group))
                group, held = [], 0
        out.append(rules.count(group))
        return pd.Series(np.concatenate(out))

    return n_tokens


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
                        counter(path)(text).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
