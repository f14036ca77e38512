"""Token counts against the library, and periodic runs against a direct search."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pubsift.llm import counting, periodic, queries
from pubsift.llm.common import table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " \t\n", "\x1c", "\x85 x", "a" * 30_000, "ab" * 5_000 + "!" * 777, "don't we'll I'M", "日本語" * 4_000,
       "<|endoftext|>", "x<|endoftext|>́y <|startoftext|> <|ENDOFTEXT|>", "ΑΣ Σς İıßſ", "½²ⅨǅЖ﻿​",
       "é é ﬁ", "🎉👍🏽‍🎉", "1234 12a34", "a b　c"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(library):
    rules = counting.merge_table(PATH)
    assert rules.together
    rng = random.Random(3)
    alphabet = "abcdefgh ABC'sdtvemr0123 \n\t\x1c\x85éÉßΣσςİıÀ́日本한국مرحبا🎉👍🏽 !?.,<|_-…½²ⅨǅЖ​"
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(80))) for _ in range(3000)]
    texts += [f"a{chr(i)}b {chr(i) * 3}" for i in range(1, 0x30000, 11) if not 0xD800 <= i < 0xE000]
    assert rules.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_counts_of_any_text(text):
    rules = counting.merge_table(PATH)
    assert rules.count([text])[0] == len(rules.library.encode(text, add_special_tokens=False).ids)


def test_rules_out_of_order_are_merged_one_by_one(tmp_path):
    """A token with two rules: merging all places at once would differ."""
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    letters = [c for c in spec["model"]["vocab"] if len(c.replace("</w>", "")) == 1]
    merges = [["b", "c"], ["a", "b"], ["ab", "c"], ["abc", "a"], ["a", "bc"]]
    names = letters + ["bc", "ab", "abc", "abca"]
    spec["model"] |= {"vocab": {n: i for i, n in enumerate(names)}, "merges": merges}
    spec["added_tokens"] = []
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    rules = counting.MergeTable(str(path))
    assert not rules.together
    texts = ["".join(w) for w in ["abcabca", "abcabcabcd", "aabcbca", "abcab"]]
    assert rules.count(texts).tolist() == [len(rules.library.encode(t).ids) for t in texts]


def test_token_counts_rows(spark, rows, library):
    data = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, None, "y"), (None, "two words", "z"), (3, ODD[5], None)]
    out = counting.token_counts(rows(data, "doc_id long, text string, n_tokens string"), PATH, limit=100).collect()
    expect = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
                    for i, t, _ in data)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out) == expect
    assert all(r.over_limit == (r.n_tokens > 100) for r in out)
    assert counting.token_counts(rows([], "doc_id long, text string"), PATH).collect() == []


def test_op11_whole_table(spark, library):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    out = queries.op11_tokens(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


# --- periodic runs ------------------------------------------------------------

def brute_runs(words):
    """Every maximal stretch of each period, the smallest period of a stretch kept."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= 4 * q:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def some_words(rng):
    words = []
    for _ in range(rng.randrange(6)):
        top = rng.choice([1, 1, 2, 40])
        part = [rng.randint(0, top) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 32, 33]))]
        if rng.random() < 0.3:                  # a period that holds a highly periodic region
            q = rng.randint(1, 3)
            part = (part[:q] * 20)[:rng.randint(4, 30)] + [rng.randint(0, top) for _ in range(rng.randrange(3))]
        words += (part * 9)[:rng.randint(len(part), 6 * len(part) + 3)]
    return words


@pytest.mark.parametrize("seed", range(60))
def test_runs_against_direct_search(seed):
    rng = random.Random(seed)
    texts = [some_words(rng) for _ in range(8)]
    flat, expect = [], []
    for i, words in enumerate(texts):
        expect += [(s + len(flat), e + len(flat), q) for s, e, q in brute_runs(words)]
        flat += [*words, 1000 + i]
    got = periodic.find_runs(np.array(flat, np.int64), np.array([len(w) for w in texts]))
    assert [tuple(r) for r in got.tolist()] == sorted(expect, key=lambda r: (r[0], r[2]))


def test_runs_of_thue_morse_and_fibonacci_words():
    thue = [bin(i).count("1") % 2 for i in range(4096)]         # no run of four periods
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    flat = np.array([*thue, 9, *(thue[:100] * 5), 10, *b, 11], np.int64)
    sizes = np.array([len(thue), 500, len(b)])
    assert [tuple(r) for r in periodic.find_runs(flat, sizes).tolist()] == [
        (s + 4097, e + 4097, q) for s, e, q in brute_runs(thue[:100] * 5)] + [
        (s + 4598, e + 4598, q) for s, e, q in brute_runs(b)]


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(((s, e - s, q) for s, e, q in brute_runs(words) if e - s >= 6), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_periodic_runs_rows(spark, rows):
    rng = random.Random(9)
    data = [(i, " ".join(f"w{x}" for x in some_words(rng)), "e") for i in range(300)]
    data += [(7, None, "a"), (8, "", None), (9, " \n\t", "b"), (None, "a " * 40, "c"), (11, "a b " * 300, "d"),
             (11, "a b " * 300, "d"), (12, "x\x1cy " * 8, "d"), (13, "one", "d")]
    out = periodic.periodic_runs(rows(data, "doc_id long, text string, period string")).collect()
    assert sorted(map(tuple, out), key=repr) == sorted((brute_row(i, t) for i, t, _ in data), key=repr)
    assert periodic.periodic_runs(rows([], "doc_id long, text string")).collect() == []


def test_batches_do_not_matter(rows):
    rng = random.Random(2)
    texts = [" ".join(map(str, some_words(rng))) for _ in range(40)]
    whole = periodic.describe(texts, [20] * 40)
    assert whole == [r for t in texts for r in periodic.describe([t], [20])]


def test_op12_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    out = {r.doc_id: tuple(r) for r in queries.op12_runs(spark, SF).collect()}
    assert len(out) == len(docs)
    for doc_id, text in docs:
        if len((text or "").split()) < 1500:
            assert out[doc_id] == brute_row(doc_id, text)
