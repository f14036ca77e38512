"""Row-wise operators against brute force: toxicity, quality, decontamination, licenses, HTML."""

import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pubsift.llm import decontam, licenses, quality, toxicity, wrapper
from pubsift.llm.common import letter_words, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score double, kept string, n_words string"
CASES = [(1, None, "en", 0.1, "x", "y"), (2, "", "en", 0.2, "x", "y"), (3, " \n\t ", None, None, None, None),
         (4, "one two", "en", 1.0, "a", "b"), (4, "one two", "en", 1.0, "a", "b"),
         (5, "word " * 30_000, "en", 1.0, "a", "b"), (None, "no id here", "en", 1.0, "a", "b"),
         (7, "ünïcödé Ünïcödé x \U0001f600", "de", 1.0, "a", "b")]

LETTER = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def letters(text):
    return LETTER.findall((text or "").translate(LOWER))


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_letter_words(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [w.decode() for w in letter_words(text.encode())] == letters(text)


# --- decontamination --------------------------------------------------------

def brute_hits(text, items):
    words, hit, found = letters(text), set(), set()
    for item, body in items:
        w = letters(body)
        k = min(13, len(w))
        if not k or item is None:
            continue
        for a in range(len(w) - k + 1):
            for i in range(len(words) - k + 1):
                if words[i:i + k] == w[a:a + k]:
                    hit |= set(range(i, i + k))
                    found.add(item)
    return len(words), len(hit), sorted(found)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and then runs far away home again now"), (2, "Short item!"),
         (3, None), (4, " .. "), (None, "no id here"), (5, "short ITEM"),
         (6, "a a a a a a a a a a a a a a a a")]
ITEMS += [(7, "one two three four five six seven eight nine ten eleven twelve thirteen"), (8, ITEMS[0][1]),
          (9, " ".join(f"w{i % 23}x{i % 7}" for i in range(120)))]
TEXTS = ["Well: The Quick, brown fox jumps over the lazy dog -- and then runs far away! Short item. short itemize",
         "a " * 40, "xshort item", "short", "é shorté short item", None, "",
         "the quick brown fox jumps over the lazy dog and then runs far away home again now " * 3,
         "zero one two three four five six seven eight nine ten eleven twelve thirteen one two three four five six "
         "seven eight nine ten eleven twelve", ITEMS[8][1][200:500] + " gap " + ITEMS[8][1][:60]]


@pytest.mark.parametrize(("max_chars", "piece"), [(decontam.MAX_BLOCK_CHARS, decontam.PIECE_WORDS), (90, 26)])
def test_decontam_against_brute_force(spark, rows, max_chars, piece, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE_WORDS", piece)
    docs = rows(list(enumerate(TEXTS)) + [(0, TEXTS[0])], "doc_id long, text string")
    scan = decontam.scanner(spark, rows(ITEMS, "item_id long, text string"), max_chars=max_chars)
    got = docs.select("doc_id", "text", scan("text").alias("r")).collect()
    assert len(got) == len(TEXTS) + 1
    for g in got:
        n, hit, items = brute_hits(g["text"], ITEMS)
        assert (g["r"]["n_words"], g["r"]["n_hit"], g["r"]["items"]) == (n, hit, items)
        covered = [letters(g["text"][s["start"]:s["end"]]) for s in g["r"]["spans"]]
        assert sum(map(len, covered)) == hit        # offsets are those of the original text


def test_decontam_cases(spark, rows):
    scan = decontam.scanner(spark, rows([], "item_id long, text string"))
    got = rows(CASES, DOCS).select("*", scan("text").alias("r")).collect()
    assert len(got) == len(CASES) and all(g["r"]["n_hit"] == 0 for g in got)
    assert rows([], DOCS).select(scan("text")).collect() == []


@given(st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_decontam_runs_hold_every_window(seed):
    """Few different words, so that items repeat themselves and each other; windows of every small size."""
    rng = random.Random(seed)
    window, words = rng.randint(1, 14), [b"a", b"b", b"c"][:rng.randint(1, 3)]
    items = [[rng.choice(words) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 4))]
    text = [rng.choice([*words, b"z"]) for _ in range(rng.randint(0, 60))] + rng.choice(items)[2:]
    expected, found = set(), set()
    for n, item in enumerate(items):
        k = min(window, len(item))
        for a in range(len(item) - k + 1):
            for i in range(len(text) - k + 1):
                if text[i:i + k] == item[a:a + k]:
                    expected |= set(range(i, i + k))
                    found.add(n)
    block = [(line, {n}) for n, item in enumerate(items) for line in decontam.item_pieces(b" ".join(item), window)]
    got = decontam._matches(*decontam._automaton(f"test-{seed}", block, window), text) if text else []
    assert {i for first, size, _ in got for i in range(first, first + size)} == expected
    assert {n for _, _, ids in got for n in ids} == found


def test_decontam_long_items_in_pieces():
    words = [f"w{i}".encode() for i in range(35_000)]
    pieces = [p.split() for p in decontam.item_pieces(b" ".join(words))]
    held = {tuple(p[i:i + 13]) for p in pieces for i in range(len(p) - 12)}
    assert len(pieces) == 4 and held == {tuple(words[i:i + 13]) for i in range(len(words) - 12)}


def test_decontam_many_blocks_same_result(spark, rows):
    """A benchmark of 18 million characters: five automata at the default bound, all passages found."""
    rng = random.Random(5)
    items = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(400))) for i in range(4200)]
    texts = [(i, "x " * 30 + " ".join(items[i][1].split()[100:100 + 10 + i % 7])) for i in range(0, 4200, 50)]
    scan = decontam.scanner(spark, rows(items, "item_id long, text string"), spans=False)
    got = rows(texts, "doc_id long, text string").select("doc_id", scan("text").alias("r")).collect()
    assert all(g["r"]["items"] == ([g["doc_id"]] if g["doc_id"] % 7 >= 3 else []) for g in got)


# --- licenses ---------------------------------------------------------------

def test_licenses_against_brute_force(spark, rows):
    phrases = [(tuple(p.split()), label) for p, label in licenses.PHRASES.items()]
    texts = ["MIT License, mit-license; the MIT  LICENSE", "general public license general public", None, "",
             "GNU General\nPublic. License apache license version", "mit licenses", "mit", "license mit license mit"]
    texts += [licenses.PASSAGES["mit"].replace("modify, ", "").upper(), licenses.PASSAGES["bsd"] + " mit license",
              "Licensed under CC BY-NC 4.0. " + "filler " * 50, "of the software without restriction"]
    docs = rows([*enumerate(texts), (0, texts[0]), (None, texts[1])], "doc_id long, text string")
    got = licenses.scan(spark, docs).collect()
    assert len(got) == len(texts) + 2
    for g in got:
        text = texts[1] if g["doc_id"] is None else texts[g["doc_id"]]
        words = letters(text)
        at = [(i, label) for p, label in phrases for i in range(len(words)) if tuple(words[i:i + len(p)]) == p]
        assert g["n_words"] == len(words) and g["n_base"] == len(at)
        assert g["first_word"] == min((i for i, _ in at), default=None)
        assert g["last_word"] == max((i for i, _ in at), default=None)
        assert g["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert set(g["base_labels"].split(",")) - {""} <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1
    by = {g["doc_id"]: g["labels"] for g in got}
    assert by[8] == "mit" and by[9] == "bsd,mit" and by[10] == "cc-by-nc" and by[11] == ""


def test_licenses_lower_case_of_ascii_only(spark, rows):
    """The Kelvin sign and a dotted capital I lower to ASCII letters elsewhere; here they stay other words."""
    texts = ["m\u0130t license", "apache l\u0130cense MIT LICENSE", "\u00c9T\u00c9 mit license",
             "General Public License of \u212aelvin", "mit licen\u017fe"]
    got = {g["doc_id"]: g for g in licenses.scan(spark, rows([*enumerate(texts)], "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_words"] == len(letters(t))
    assert [got[i]["n_base"] for i in range(5)] == [0, 1, 1, 1, 0]


def test_licenses_no_other_letter_becomes_ascii(spark):
    """The only letter beyond ASCII that ``lower`` turns into ASCII letters is the one that is replaced."""
    def signs(frames):
        for f in frames:
            yield f.assign(sign=[chr(i) for i in f["id"]])

    every = (spark.range(128, 0x110000).where("id < 55296 or id > 57343")
             .mapInPandas(signs, "id long, sign string").selectExpr("id", "lower(sign) as low"))
    assert [r["id"] for r in every.where("low rlike '^[ -~]+$'").collect()] == [0x212A]
    split = every.where("low rlike '[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]'")
    assert split.count() == 0 and every.where("length(low) = 0").count() == 0


def test_licenses_notices(spark, rows):
    """Every passage is found alone, whole and with a word left out, under its own label."""
    known = [*licenses.PASSAGES.items(), *licenses.NOTICES]
    texts = [f"before {t} after" for _, t in known]
    texts += [f"before {' '.join(t.split()[:9] + t.split()[10:])}" for _, t in known if len(t.split()) > 30]
    labels = [n for n, _ in known] + [n for n, t in known if len(t.split()) > 30]
    got = {g["doc_id"]: g["labels"].split(",")
           for g in licenses.scan(spark, rows([*enumerate(texts)], "doc_id long, text string")).collect()}
    for i, label in enumerate(labels):
        assert label in got[i] and set(got[i]) <= {label, "gpl", "apache"}, (label, got[i])


def test_licenses_cases(spark, rows):
    assert licenses.scan(spark, rows(CASES, DOCS)).count() == len(CASES)
    assert licenses.scan(spark, rows([], DOCS)).collect() == []


# --- quality ----------------------------------------------------------------

def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


@given(st.text(alphabet="ab \n\té  |#\x0b\x1c", max_size=80))
@settings(max_examples=300, deadline=None)
def test_base_rules(text):
    chain = quality.Chain(np.zeros((len(quality.FEATURES), 2)), np.zeros(2), np.zeros((2, 2)))
    assert quality.judge(chain, text.encode())[:6] == brute_base(text)


@given(st.lists(st.lists(st.integers(0, 4), max_size=3), min_size=1, max_size=7), st.integers(0, 2**31))
@settings(max_examples=100, deadline=None)
def test_viterbi_finds_the_best_path(feats, seed):
    r = np.random.default_rng(seed)
    chain = quality.Chain(r.normal(size=(5, 2)), r.normal(size=2), r.normal(size=(2, 2)))

    def score(path):
        s = chain.start[path[0]]
        for t, f in enumerate(feats):
            s += sum(chain.emit[i][path[t]] for i in f) + (chain.step[path[t - 1]][path[t]] if t else 0)
        return s

    paths = [[p >> t & 1 for t in range(len(feats))] for p in range(1 << len(feats))]
    assert score(chain.decode(feats)) == pytest.approx(max(map(score, paths)))


def test_chain_gradient_is_that_of_the_likelihood():
    r = np.random.default_rng(3)
    x = (r.random((4, 5, 3)) < 0.5).astype(np.float32)
    there = np.ones((4, 5), dtype=bool)
    there[1, 3:] = False
    x[~there] = 0
    y = r.integers(0, 2, (4, 5))
    y[~there] = 0
    gold = np.zeros((4, 5, 2))
    gold[np.arange(4)[:, None], np.arange(5)[None], y] = there
    both = there[:, 1:] & there[:, :-1]
    gold_step = np.einsum("nti,ntj->ij", gold[:, :-1] * both[..., None], gold[:, 1:])

    def loss(v):
        emit, start, step = v[:6].reshape(3, 2), v[6:8], v[8:].reshape(2, 2)
        total = 0.0
        for i in range(4):
            n = int(there[i].sum())
            e = x[i, :n] @ emit

            def path(p):
                return start[p[0]] + sum(e[t, p[t]] for t in range(n)) + sum(step[p[t - 1], p[t]] for t in range(1, n))

            scores = [path([q >> t & 1 for t in range(n)]) for q in range(1 << n)]
            total += np.logaddexp.reduce(scores) - path(y[i, :n])
        return total

    v = r.normal(size=12)
    l2, quality.L2 = quality.L2, 0.0
    try:
        g = quality._chain_gradient(x, x.reshape(-1, 3), gold, gold_step, there, both, v[:6].reshape(3, 2), v[6:8],
                                    v[8:].reshape(2, 2), 1.0)
    finally:
        quality.L2 = l2
    for i in range(12):
        d = np.zeros(12)
        d[i] = 1e-5
        assert g[i] == pytest.approx((loss(v + d) - loss(v - d)) / 2e-5, abs=1e-3)


def test_quality_separates_the_labels(spark):
    docs, labels = table(spark, SF.replace("0.001", "0.01"), "documents"), table(spark, SF.replace("0.001", "0.01"), "labels")
    judged = quality.judger(spark, quality.fit(docs, labels))
    got = docs.join(labels, "doc_id").select("quality", judged("text").alias("r")).select("quality", "r.*").collect()
    good = [g["kept"] for g in got if g["quality"] == 1 and not g["base_failed"]]
    poor = [g["kept"] for g in got if g["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(poor) < 0.1


def test_quality_cases(spark, rows):
    docs = rows(CASES, DOCS)
    for labels in ([], [(4, None), (None, 1)], [(4, 1)], [(4, 1), (5, 0), (5, 1), (2, 0)]):
        chain = quality.fit(docs, rows(labels, "doc_id long, quality int"))
        got = docs.select("n_words", quality.judger(spark, chain)("text").alias("r")).collect()
        assert len(got) == len(CASES) and all(g["r"]["base_failed"] for g in got)


# --- toxicity ---------------------------------------------------------------

def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    score = toxicity.scorer(spark, toxicity.fit(docs, labels))
    got = docs.join(labels, "doc_id").where(toxicity.held_out()).select(score("text").alias("s"), "toxic").collect()
    right = np.mean([(g["s"] >= 0.5) == (g["toxic"] == 1) for g in got])
    assert right > 0.97 and all(0 <= g["s"] <= 1 for g in got)


def test_toxicity_ignores_held_out_labels(spark, rows):
    docs = rows([(i, f"text number {i} {'awful' if i % 2 else 'fine'}") for i in range(60)], "doc_id long, text string")
    labels = rows([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert np.allclose(a.weight, b.weight) and a.bias == pytest.approx(b.bias)
    assert a.score("awful") > a.score("fine")


def test_toxicity_cases(spark, rows):
    docs = rows(CASES, DOCS)
    for labels in ([], [(4, None), (None, 1)], [(4, 1)], [(1, 1), (2, 0), (3, 1), (4, 0), (5, 1), (4, 1)]):
        model = toxicity.fit(docs, rows(labels, "doc_id long, toxic int"))
        got = docs.select("score", toxicity.scorer(spark, model)("text").alias("s")).collect()
        assert len(got) == len(CASES) and all(0 <= g["s"] <= 1 for g in got)


# --- HTML -------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var x="</p><p>no";</script></head>
<body><header><a href="/">Site name</a></header><nav><ul><li>Home<li>News</ul></nav>
<div class="cookie-banner">We use cookies {n}</div><div id="sidebar"><p>Side {n}</p></div>
{open}<h1>Title {n} &amp; more</h1><p>First   paragraph {n} of
text with <b>bold</b><i>italic</i> &eacute;&#233;&nbsp;x, long enough to count here.<p>Second {n}<br>line
<ul><li>one {n}<li>two</ul><form><input name=q>Ask {n}<button>Go</button></form>
<div class="ad">Buy {n}</div><!-- <p>hidden {n}</p> --></p>{close}
<section class="comments"><p>Reader {n} says this is a long comment about it, longer than the article itself perhaps,
and going on and on and on and on and on and on and on and on and on and on and on</p></section>
<footer>&copy; {n}</footer></body></html>"""
TEXT = ("Title {n} & more First paragraph {n} of text with bolditalic éé x, long enough to count here. "
        "Second {n} line one {n} two")


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<main>", ""), ('<div class="post-content">', "</div>")])
@pytest.mark.parametrize("pages", [1, 7])
def test_article_text(tags, pages):
    got = wrapper.extract([PAGE.format(n=n, open=tags[0], close=tags[1]) for n in range(pages)])
    assert got == [TEXT.format(n=n) for n in range(pages)]


def test_unmarked_content_and_template():
    page = ("<html><body><div class=top><span>Welcome to the site of sites, the best of all</span></div><div class=x>"
            "<div class=y><p>Story {n} tells {n} things about {n} people in {n} places.</p><p>And {n} more of it.</p></div>"
            "</div><div class=low><span>All rights reserved by the owners of this site, always</span></div></body></html>")
    got = wrapper.extract([page.format(n=f"w{n}" * 3) for n in range(6)])
    assert got == [f"Story {w} tells {w} things about {w} people in {w} places. And {w} more of it."
                   for w in (f"w{n}" * 3 for n in range(6))]


def story(n, words=60):
    return " ".join(f"s{n}w{i}" for i in range(words))


@pytest.mark.parametrize("tags", [("<article><div>", "</div></article>"), ("<div>", "</div>")])
@pytest.mark.parametrize("near", [False, True])
def test_copies_are_no_template(tags, near):
    page = f"<html><body><span>Site of sites</span>{tags[0]}<h1>Head</h1><p>{{}}</p><p>{{}}</p>{tags[1]}</body></html>"
    # All pages copies; and copies as nine tenths of a block that has other pages.
    for others in (0, 4):
        texts = [(story(0), f"copy {i if near else 0}") for i in range(44)] + [(story(i), f"x{i}") for i in range(1, 1 + others)]
        got = wrapper.extract([page.format(*t) for t in texts])
        assert all(g.endswith(f"{a} {b}") for g, (a, b) in zip(got, texts))


def test_template_never_takes_a_whole_text():
    page = "<html><body><div>One notice of the host for all of its pages</div><div class=x><p>{}</p></div></body></html>"
    got = wrapper.extract([page.format(story(i)) for i in range(6)] + [page.format("")])
    assert got[:6] == [story(i) for i in range(6)] and got[6] == "One notice of the host for all of its pages"


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<main>", "</main>")])
def test_template_inside_marked_content(tags):
    page = (f"<html><body>{tags[0]}<h1>Abstract</h1><p>Read us every day</p><p>{{0}}</p><ul><li>{{1}}</li><li>two</li></ul>"
            "<table><tr><th>Size</th><td>{1}</td></tr></table><section><h2>Our offer</h2><p>Buy now</p></section>"
            f"<p>{{2}}</p><h3>Owner</h3><p>All rights are reserved</p>{tags[1]}</body></html>")
    got = wrapper.extract([page.format(story(i), f"one {i}", f"end {i}") for i in range(6)])
    assert got == [f"Abstract {story(i)} one {i} two Size one {i} end {i}" for i in range(6)]
    # Without other pages, or with copies only, the marks alone decide.
    for n in (1, 6):
        got = wrapper.extract([page.format(story(0), "one", "end")] * n)
        assert all(g.startswith(f"Abstract Read us every day {story(0)} one two") for g in got)


@pytest.mark.parametrize("sections", [10, 60, 400])
def test_template_of_long_flat_pages(sections):
    def page(i):
        n = sections + 3 * i
        body = [f"<h2>Head {i} {k}</h2><p>{story(1000 * i + k, 8)}</p>" for k in range(n)]
        body.insert(n // 2, "<h2>Offer of the day</h2><pre>Buy one get one</pre>")
        return "<html><body>" + "".join(body) + "<div>All rights are reserved by the owner</div></body></html>", n

    pages = [page(i) for i in range(6)]
    for i, (text, (_, n)) in enumerate(zip(wrapper.extract([p for p, _ in pages]), pages)):
        assert text == " ".join(f"Head {i} {k} {story(1000 * i + k, 8)}" for k in range(n))


NAMES = ["entry-content has-sidebar", "post-content no-footer", "post comment-open", "article-body legal-text",
         "main-col search-page", "story alert-level-2", "content", "no-ads", "social-science note", "sidebar", "x cookie-wall"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("pages", [1, 6])
def test_class_names_never_take_the_only_text(name, pages):
    page = ('<html><body><div class="site-nav">Home News</div><div class="wrap"><div class="{0}"><p>{1}</p><p>{2}</p></div></div>'
            '<div class="share-buttons">Share it</div><div class="page-footer">All rights reserved</div></body></html>')
    got = wrapper.extract([page.format(name, story(i), f"end {i}") for i in range(pages)])
    assert got == [f"{story(i)} end {i}" for i in range(pages)]


def test_names_of_boilerplate_are_left_out():
    page = ("<html><body><article><p>{0}</p>" + "".join(
        f'<div class="{c}">{c} {{1}}</div>' for c in (
            "ad", "ad-slot", "cookie-banner", "site-footer", "comment-list", "related-posts", "share-buttons", "social",
            "post-comments", "newsletter-signup", "notice", "left sidebar", "entry-footer"))
        + '<div id="comments">Reader {1}</div><div role="search">Find {1}</div></article></body></html>')
    got = wrapper.extract([page.format(story(i), f"varies {i}") for i in range(5)])
    assert got == [story(i) for i in range(5)]


def test_parts_of_an_article_stay():
    page = ('<html><body><header><p>Site of sites {2}</p></header><article><header><h1>Head {2}</h1><p>Standfirst {2}</p></header>'
            '<p>{0}</p><figure><img src=x><figcaption>Caption {2}</figcaption></figure>'
            '<section id="legal"><h2>Law {2}</h2><p>{1}</p></section><p class="note social-science">Note {2}</p></article></body></html>')
    got = wrapper.extract([page.format(story(i), story(50 + i, 9), i) for i in range(5)])
    assert got == [f"Head {i} Standfirst {i} {story(i)} Caption {i} Law {i} {story(50 + i, 9)} Note {i}" for i in range(5)]


def matched(a, b):
    """The size of a largest order-preserving match of two trees, tried out."""
    if a.sign != b.sign:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), matched(x[0], y[0]) + best(x[1:], y[1:]))

    return 1 + best(a.kids, b.kids)


@pytest.mark.parametrize("seed", range(40))
def test_alignment_against_all_matches(seed):
    rng = random.Random(seed)

    def tree(depth):
        kids = "".join(tree(depth - 1) for _ in range(rng.randrange(4))) if depth else ""
        return f'<{rng.choice(["div", "section"])} class="{rng.choice("ab")}">{kids}</{"div"}>' if depth < 2 else \
            f"<div>{kids}</div>"

    a, b = (wrapper.Fold(("#root", ""), [wrapper.parse(tree(2))]) for _ in range(2))
    size, pairs = wrapper.align(a, b)
    assert size == len(pairs) == matched(a, b)
    assert all(p.sign == q.sign for p, q in pairs)


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_blocks_depend_on_the_table_alone(spark, rows, partitions):
    page = "<html><body><div>{2}</div><div><p>{0}</p><p>{1}</p></div></body></html>"
    data = [(i, f"http://{'hot' if i % 4 else 'cold'}.example/{i}", page.format(story(i % 90), f"end {i % 7}", f"Notice {i % 5}"))
            for i in range(260)]
    frame = rows(data, "page_id long, url string, html string").repartition(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(2 * partitions))
    try:
        got = sorted(map(tuple, wrapper.main_texts(frame).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(map(tuple, wrapper.main_texts(rows(data, "page_id long, url string, html string")).collect()))


def test_broken_pages():
    odd = [None, "", "plain text & more", "<p>a<p>b", "<article><p>cut of", "<<>>< x", "<!-- never closed <p>a</p>",
           "<script>no end", "<div>" * 3000 + "deep", "</p></div>stray", "<p a='>'>quoted", "<br/><p>x<br/>y"]
    got = wrapper.extract(odd)
    assert got[0] == got[1] == "" and got[2] == "plain text & more" and got[3] == "a b" and got[4] == "cut of"
    assert got[6] == got[7] == "" and got[8] == "deep" and got[9] == "stray" and got[11] == "x y"


def test_alignment_is_a_largest_match():
    a = wrapper.parse("<div><p>1</p><ul><li>2</ul><table></table></div>")
    b = wrapper.parse("<div><ul><li>x<li>y</ul><h2></h2><table></table></div>")
    n, pairs = wrapper.align(wrapper.Fold(("#root", ""), [a]), wrapper.Fold(("#root", ""), [b]))
    assert n == len(pairs) == 5 and [p[0].sign[0] for p in pairs].count("li") == 1


def test_pages_query_cases(spark, rows):
    data = [(1, "http://a.example/x", "<p>one", 1.5), (1, "http://a.example/x", "<p>one", 1.5), (2, None, None, 0.0),
            (None, "not a url", "", 0.0), (3, "http://a.example/y", "<article><p>" + "long " * 40_000, 0.0)]
    got = wrapper.main_texts(rows(data, "page_id long, url string, html string, text double")).collect()
    assert sorted((g["page_id"] or 0, g["text"][:4], len(g["text"])) for g in got) == [
        (0, "", 0), (1, "one", 3), (1, "one", 3), (2, "", 0), (3, "long", 5 * 40_000 - 1)]
    assert wrapper.main_texts(rows([], "page_id long, url string, html string")).collect() == []


def test_many_hosts_share_and_split_blocks(spark, rows):
    data = [(i, f"http://{'hot' if i % 3 else 'h%d' % i}.example/{i}", PAGE.format(n=i, open="<article>", close="</article>"))
            for i in range(300)]
    got = {g["page_id"]: g["text"] for g in wrapper.main_texts(rows(data, "page_id long, url string, html string")).collect()}
    assert got == {i: TEXT.format(n=i) for i in range(300)}


