"""Operators over whole tables against brute force: near-dedup, quotes, packing, sharding, WARC, the pipeline."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from pubsift.llm import neardup, packing, quoting, sharding, warc
from pubsift.llm.common import Workspace, table
from test_llm_text import CASES, DOCS

SF = "/root/testdata/sf0.001"


# --- near duplicates --------------------------------------------------------

def brute_components(docs):
    sets = {}
    for i, (_, text) in enumerate(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(docs):
        r = find(i)
        least[r] = min(least.get(r, doc), doc)
    return {doc: (len(sets[i]), least[find(i)] if sets[i] else doc) for i, (doc, _) in enumerate(docs)}


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words]


@pytest.mark.parametrize("block", [neardup.BLOCK_SHINGLES, 400])
def test_neardup_against_brute_force(spark, rows, block):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    texts = [" ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04, 0.08]))) for _ in range(150)]
    chain = base
    for _ in range(25):         # a chain whose ends are far apart
        chain = edited(rng, chain, 0.02)
        texts.append(" ".join(chain))
    texts += [" ".join(f"x{rng.randrange(900)}" for _ in range(40)) for _ in range(60)]
    texts += ["", "one", "ONE ", "one two three four five", "One two\tthree four five", "a b c d e f"] + texts[:20]
    docs = [(rng.randrange(10) * 1000 + i, t) for i, t in enumerate(texts)]
    got = neardup.near_duplicates(spark, rows(docs, "doc_id long, text string"), block).collect()
    assert len(got) == len(docs)
    assert {g["doc_id"]: (g["n_shingles"], g["component_id"]) for g in got} == brute_components(docs)
    assert all(g["kept"] == (g["doc_id"] == g["component_id"]) for g in got)


def test_neardup_cases(spark, rows):
    got = neardup.near_duplicates(spark, rows(CASES, DOCS)).collect()
    assert len(got) == len(CASES) and sum(g["doc_id"] == 4 and g["kept"] for g in got) == 2
    assert {g["doc_id"]: g["n_shingles"] for g in got if g["doc_id"] in (1, 2, 3, 5)} == {1: 0, 2: 0, 3: 0, 5: 1}
    assert neardup.near_duplicates(spark, rows([], DOCS)).collect() == []


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
@settings(max_examples=8, deadline=None)
def test_components(spark, pairs):
    ws = Workspace(spark, "test")
    data = [(a.to_bytes(2), b.to_bytes(2)) for a, b in pairs]
    got = neardup.components(spark.createDataFrame(data, "u binary, v binary"), ws, "t").collect()
    near = collections.defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for a in near:
        seen, todo = {a}, [a]
        while todo:
            todo += [y for y in near[todo.pop()] if not (y in seen or seen.add(y))]
        want[a] = min(seen)
    assert {int.from_bytes(g["node"]): int.from_bytes(g["root"]) for g in got} == want


# --- quotes -----------------------------------------------------------------

TALK = [("c1", 0, "user", "How do I sort a list?\n\nIt has many numbers."),
        ("c1", 1, "assistant", "On Monday, user wrote:\n> How do I sort  a LIST?\nUse the sorted function."),
        ("c1", 2, "user", "Unrelated: what is a heap?"),
        ("c1", 3, "user", "> > how do I sort a list?\n> Use the sorted function.\n\nThanks, works."),
        ("c1", 4, "assistant", ">what is a heap?\nnot matched as a whole line\n> Unrelated: what is a heap?\nA tree."),
        ("c2", 0, "user", "> Use the sorted function.\nQuoted from elsewhere"), ("c2", 1, "user", None),
        ("c2", 1, "user", ""), (None, 3, "user", "> x y z"), ("c3", None, "user", "hello there")]


def test_quotes(spark, rows):
    got = quoting.link_conversations(spark, rows(TALK, "conv_id string, turn int, role string, text string")).collect()
    assert len(got) == len(TALK)
    by = {(g["conv_id"], g["turn"]): g for g in got}
    assert {t: by["c1", t]["parent_turn"] for t in range(5)} == {0: None, 1: 0, 2: None, 3: 1, 4: 2}
    assert {t: by["c1", t]["thread_turn"] for t in range(5)} == {0: 0, 1: 0, 2: 2, 3: 0, 4: 2}
    assert [g["turn"] for g in sorted((g for g in got if g["conv_id"] == "c1"), key=lambda g: g["position"])] == [0, 1, 3, 2, 4]
    assert by["c1", 1]["text"] == "Use the sorted function." and by["c1", 3]["text"] == "Thanks, works."
    assert by["c1", 4]["text"] == "not matched as a whole line\nA tree."
    assert by["c2", 0]["parent_turn"] is None and by["c2", 0]["n_quoted_lines"] == 1
    assert sorted(g["position"] for g in got if g["conv_id"] == "c2") == [0, 1, 2]
    assert quoting.link_conversations(spark, rows([], "conv_id long, turn int, role string, text string, h int")).collect() == []


def test_trimmed_and_wrapped_quotes(spark, rows):
    said = ("The first thing to know is the order of the rows. It matters a lot. Then sort them by the key "
            "of the group, and number them in that order. Good luck!")
    quotes = ["> It matters a lot.", "> Then sort them by the key of the group, and number\n> them in that order.",
              "> The first thing to know is\n> the order of the rows. It\n> matters a lot. Then sort",
              "> sort them by the key\n> [...]\n> in that order. Good luck!", "> Good luck!",
              "> the order of the\n> rows, which nobody said like this"]
    data = [("c", 0, "user", "How do I number rows?"), ("c", 1, "assistant", said), ("c", 2, "user", "Some other matter.")]
    data += [("c", 3 + i, "user", f"{q}\nAnswer number {i}") for i, q in enumerate(quotes)]
    data += [("c", 20, "user", "> nothing of this was said before\nAnswer"), ("d", 0, "user", "> It matters a lot.\nNo.")]
    got = quoting.link_conversations(spark, rows(data, "conv_id string, turn int, role string, text string")).collect()
    by = {(g["conv_id"], g["turn"]): g for g in got}
    assert len(got) == len(data) and [by["c", 3 + i]["parent_turn"] for i in range(len(quotes))] == [1] * len(quotes)
    assert all(by["c", 3 + i]["thread_turn"] == 1 and by["c", 3 + i]["n_linked"] >= 1 for i in range(len(quotes)))
    assert by["c", 20]["parent_turn"] is by["d", 0]["parent_turn"] is None and by["c", 20]["n_linked"] == 0


def test_quotes_random_threads_against_brute_force(spark, rows):
    rng, data, parent = random.Random(2), [], {}
    for conv in range(6):
        for turn in range(25):
            own = f"message {conv} {turn} says {rng.random()}"
            p = rng.randrange(turn) if turn and rng.random() < 0.7 else None
            parent[conv, turn] = p
            quote = "" if p is None else f"> {next(d[4] for d in data if d[:2] == (conv, p))}\n"
            data.append((conv, turn, "user", quote + own, own))
    got = quoting.link_conversations(spark, rows([d[:4] for d in data], "conv_id long, turn int, role string, text string"))
    want = {}
    for (conv, turn), p in parent.items():
        want[conv, turn] = (p, turn if p is None else want[conv, p][1])
    got = got.collect()
    assert {(g["conv_id"], g["turn"]): (g["parent_turn"], g["thread_turn"]) for g in got} == want
    assert {(g["conv_id"], g["turn"]): g["text"] for g in got} == {d[:2]: d[4] for d in data}
    for conv in range(6):
        order = sorted((want[conv, t][1], t) for t in range(25))
        assert [g["position"] for g in sorted((g for g in got if g["conv_id"] == conv), key=lambda g: order.index((g["thread_turn"], g["turn"])))] == list(range(25))


# --- packing ----------------------------------------------------------------

@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=200, deadline=None)
def test_best_fit_and_bound(lengths):
    lengths = np.array(lengths, dtype=np.int64)
    where, offset, fill = packing.best_fit(lengths, 64)
    for b in range(len(fill)):
        inside = sorted((offset[i], lengths[i]) for i in np.flatnonzero(where == b))
        at = 0
        for o, n in inside:
            assert o == at
            at += n
        assert at == fill[b] <= 64
    assert packing.lower_bound(lengths, 64) <= len(fill)


@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
@settings(max_examples=150, deadline=None)
def test_bound_never_exceeds_the_optimum(lengths):
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= 12:
                go(i + 1, bins[:b] + [bins[b] + lengths[i]] + bins[b + 1:])
        go(i + 1, bins + [lengths[i]])

    go(0, [])
    assert packing.lower_bound(np.array(lengths), 12) <= best


@given(st.text(alphabet=st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=40)
       | st.text(max_size=20).map(lambda s: s + "<|endoftext|>"))
@settings(max_examples=400, deadline=None)
def test_ids_are_those_of_the_tokenizer(text):
    from tokenizers import Tokenizer

    path, ranks = packing.default_paths()
    exact = test_ids_are_those_of_the_tokenizer.__dict__.setdefault("t", Tokenizer.from_file(path))
    assert packing.encode(text, path, ranks).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_ids_of_every_low_character():
    path, ranks = packing.default_paths()
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}", f" {c}a", f"{c}{c} {c}", f"1{c}2 \n{c} "):
            assert packing.encode(text, path, ranks).tolist() == packing.encode(text, path).tolist()


@pytest.mark.parametrize("per_part", [packing.PIECES_PER_PART, 60])
def test_packing_is_a_packing(spark, rows, per_part):
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(
        rows([(9001, None), (9002, ""), (9003, "word " * 9000), (9004, "<|endoftext|>")], "doc_id long, text string"))
    path, ranks = packing.default_paths()
    got = packing.pack(packing.tokenize(docs, path, ranks), per_part=per_part).collect()
    ids = {d["doc_id"]: packing.encode(d["text"], path).tolist() + [0] for d in docs.collect()}
    pieces = collections.defaultdict(list)
    for g in got:
        pieces[g["doc_id"]].append(g)
        part = ids[g["doc_id"]][g["start"]:g["start"] + g["length"]]
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == g["ids_crc32"]
    assert pieces.keys() == ids.keys()
    for doc, ps in pieces.items():
        ps.sort(key=lambda g: g["piece"])
        assert [p["piece"] for p in ps] == list(range(len(ps))) and sum(p["length"] for p in ps) == len(ids[doc])
        assert all(p["length"] == 2048 for p in ps[1:]) and (len(ps) == 1 or len(ids[doc]) > 2048)
    sequences = collections.defaultdict(list)
    for g in got:
        sequences[g["sequence_id"]].append((g["offset"], g["length"]))
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    bound = -(-sum(map(len, ids.values())) // 2048)
    assert len(sequences) <= bound * 1.03 + 2


def test_packing_cases(spark, rows):
    path, ranks = packing.default_paths()
    got = packing.pack(packing.tokenize(rows(CASES, DOCS), path, ranks, with_ids=True)).collect()
    assert sum(g["piece"] == 0 for g in got) == len(CASES)
    assert packing.pack(packing.tokenize(rows([], DOCS), path, ranks)).collect() == []


# --- sharding ---------------------------------------------------------------

@pytest.mark.parametrize("kind", ["mixed", "one group", "no group", "few"])
def test_sharding(spark, rows, kind):
    rng = random.Random(1)
    texts = {"mixed": ["hot text"] * 700 + [f"group {i % 200}" for i in range(600)] + [f"single {i}" for i in range(501)] + [None, None, ""],
             "one group": ["same"] * 1003, "no group": [f"t{i}" for i in range(1001)], "few": ["a", "a", "b"]}[kind]
    data = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(data)
    got = sharding.assign_shards(spark, rows(data, "doc_id long, text string"), rows_per_bucket=50).collect()
    text = dict(data)
    assert sorted(g["doc_id"] for g in got) == sorted(text)
    by = collections.defaultdict(list)
    for g in got:
        by[g["shard"]].append(g["slot"])
        raw = (text[g["doc_id"]] or "").encode()
        assert (g["size"], g["text_crc32"], g["law"], g["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    sizes = [len(by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    where = collections.defaultdict(set)
    for g in got:
        where[(text[g["doc_id"]] or "")].add(g["shard"])
    if kind == "mixed":         # 700 rows in shards of 226, the others of at most 3
        assert len(where["hot text"]) == 4
        assert all(len(v) == 1 for k, v in where.items() if k != "hot text")


def cut_groups(got, text):
    where = collections.defaultdict(set)
    for g in got:
        where[text[g["doc_id"]]].add(g["shard"])
    return sum(len(v) - 1 for v in where.values())


@pytest.mark.parametrize("kind", ["eight of sixty", "pairs", "large and small"])
def test_groups_that_fit_stay_whole(spark, rows, kind):
    texts = {"eight of sixty": [f"g{i % 8}" for i in range(480)] + [f"s{i}" for i in range(320)],
             "pairs": [f"p{i // 2}" for i in range(40_000)],
             "large and small": [f"l{i % 7}" for i in range(630)] + [f"m{i // 9}" for i in range(270)] + [
                 f"q{i // 3}" for i in range(300)]}[kind]
    text = dict(enumerate(texts))
    got = sharding.assign_shards(spark, rows(list(text.items()), "doc_id long, text string")).collect()
    sizes = collections.Counter(g["shard"] for g in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert cut_groups(got, text) == 0


def fewest_cuts(groups, room):
    """Over all ways to place the groups; a cut group fills the shards it spans but one."""
    if not groups:
        return 0
    n, best = groups[0], len(room) * 9
    for s, r in enumerate(room):
        if r:
            rest = room[:s] + [r - min(n, r)] + room[s + 1:]
            more = groups[1:] if n <= r else [n - r, *groups[1:]]
            best = min(best, (n > r) + fewest_cuts(more, rest))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_cuts_against_all_placements(spark, rows, seed):
    rng = random.Random(seed)
    groups = sorted((rng.randint(2, 30) for _ in range(6)), reverse=True)
    texts = [f"g{i}" for i, n in enumerate(groups) for _ in range(n)] + [f"s{i}" for i in range(rng.randint(0, 12))]
    rng.shuffle(texts)
    text = dict(enumerate(texts))
    got = sharding.assign_shards(spark, rows(list(text.items()), "doc_id long, text string"), n_shards=3).collect()
    sizes = collections.Counter(g["shard"] for g in got)
    room = [len(texts) // 3 + (s < len(texts) % 3) for s in range(3)]
    assert sorted(sizes.values()) == sorted(r for r in room if r)
    # Placing groups is bin packing: large first costs at most one cut more than the best.
    assert cut_groups(got, text) <= fewest_cuts(groups, room) + 1


def test_sharding_cases(spark, rows):
    assert sharding.assign_shards(spark, rows(CASES, DOCS)).count() == len(CASES)
    assert sharding.assign_shards(spark, rows([], DOCS)).collect() == []


# --- WARC -------------------------------------------------------------------

def test_warc_round_trip(spark, rows):
    long = "".join(f"<p>paragraph {i} é</p>\r\n\r\n" for i in range(3000))
    data = [(5, "http://a/5", long, 1), (3, "http://a/3", long, 1), (9, None, None, 1), (8, "u", "", 1),
            (7, "u\r\nX: y", "é" * 49, 1), (6, "u", "é" * 49, 1), (4, "u", "é" * 50, 1), (2, "u", "é" * 50, 1),
            (2, "u", "é" * 50, 1), (None, "u", "WARC/1.1\r\n\r\n" * 20, 1), (None, "u", "WARC/1.1\r\n\r\n" * 20, 1)]
    pages = rows(data, "page_id long, url string, html string, rec int")
    manifest, folder = warc.archive_pages(spark, pages, chunk_bytes=1000)
    got = warc.read_records(manifest, folder).collect()
    assert len(got) == len(data)
    key = lambda p: hashlib.sha256((p or "").encode()).hexdigest()
    by = {g["page_id"]: g for g in got}
    for page, _, html, _ in data:
        assert (by[page]["payload_bytes"], by[page]["payload_digest"]) == (len((html or "").encode()), key(html))
    assert by[3]["record_type"] == "response" and (by[5]["record_type"], by[5]["refers_to"]) == ("revisit", 3)
    assert by[7]["record_type"] == by[6]["record_type"] == "response"       # 98 bytes
    assert (by[4]["record_type"], by[4]["refers_to"]) == ("revisit", 2)
    assert sorted(g["record_type"] for g in got if g["page_id"] == 2) == ["response", "revisit"]
    assert len({g["record_id"] for g in got}) == len(data)
    chunks = collections.defaultdict(dict)
    for c in warc.read_chunks(manifest, folder, 1000).collect():
        assert len(c["data"]) <= 1000
        chunks[c["page_id"], c["record_type"]][c["chunk_no"]] = c
    whole = b"".join(bytes(chunks[3, "response"][i]["data"]) for i in range(len(chunks[3, "response"])))
    assert whole == long.encode()
    part = b""
    for i in range(len(chunks[3, "response"])):
        part += bytes(chunks[3, "response"][i]["data"])
        assert chunks[3, "response"][i]["sha256_so_far"] == hashlib.sha256(part).hexdigest()
    import gzip

    from pyarrow import fs
    paths = [m["path"] for m in manifest.collect()]
    local, _ = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), None)
    raw = b"".join(gzip.decompress(local.open_input_stream(p, compression=None).read()) for p in paths)
    assert raw.count(b"WARC-Record-ID:") == len(data)


def test_warc_empty(spark, rows):
    manifest, folder = warc.archive_pages(spark, rows([], "page_id long, url string, html string"))
    assert warc.read_records(manifest, folder).collect() == []


# --- pipeline ---------------------------------------------------------------

def test_pipeline_stages(spark, rows):
    docs = table(spark, SF, "documents")
    ws = Workspace(spark, "test-pipeline")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = ws.put(stage(spark, docs, SF), name)
        assert docs.columns == before.columns and docs.join(before, "doc_id", "left_anti").isEmpty()
        if name == "neardup":
            want = brute_components([(r["doc_id"], r["text"]) for r in before.collect()])
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(d for d, (_, c) in want.items() if d == c)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("data", [CASES, []])
def test_pipeline_cases(spark, rows, data):
    docs = rows(data, DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() <= len(data)
    kept = corpus_pipeline.drop_copies(spark, docs, SF).collect()
    assert len(kept) == (7 if data else 0)         # one of the two rows of id 4
    assert len(corpus_pipeline.drop_contaminated(spark, docs, SF).collect()) == len(data)
