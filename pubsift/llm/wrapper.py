"""HTML extraction by wrapper induction.

A host of n pages has ceil(n / ``BLOCK``) blocks, and a hash of the page id deals
its pages to them, so a host that holds a third of all pages spans many tasks and
the blocks depend on the table alone.  The block numbers of larger hosts are
broadcast if there are at most ``MAX_HOSTS`` of them, else joined.  A block that
repeated ids make longer than ``LONGEST`` pages is cut in the order of its rows.

In a block the pages become DOM trees whose runs of equal siblings (tag and
class) fold into one node.  The richest tree is the seed; every other tree is
aligned with it by simple tree matching.  An aligned node whose text is the same
in most pages is template; a varying node is a slot.  Pages whose main text by
the marks alone is equal or nearly equal are copies and vote once, so that a
text many pages share is no template; a page that its template would leave
without any text keeps its text by the marks alone.  The content slot is the
marked article or main element with most varying text, else the deepest node
that holds most of the varying text outside boilerplate.  Of the content,
template blocks and boilerplate (navigation, page headers and footers, sidebars,
notices, adverts, forms, comments of readers, by tag, role or class name) are
left out.  A class name counts as a whole or as a compound of a noise word, but
not as a state ("has-sidebar", "comment-open"), not beside a name of content
("entry-content") on the same element, and ambiguous words ("legal", "social")
only as a whole name.  Where such names would leave out nearly all varying text
of a page, the element that holds it is kept.  In a run of siblings each one is template or not by itself, but the
members of a list or table are so together; in marked content a constant heading
stays where varying text follows it, and a constant cell where its row varies.

Block elements are the text blocks: character references are decoded, white
space becomes one space, blocks are joined by one space in page order.

Cases: null or empty pages give an empty text; a page whose host has no other
page in its block has no template, marks alone decide; unclosed and stray tags,
comments and text without any tag are handled; repeated pages are pages of their
own; a page without a host shares blocks with the others of that kind.  Extra
columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 48
LONGEST = 192               # pages aligned at once; a block of different ids is hardly ever so long
MAX_HOSTS = 1_000_000       # rows of the broadcast block counts
MIN_PAGES = 3               # pages, copies counted once, that must hold a node before it can be template
COPY_SHARE = 0.8            # common share of the word triples of two texts that are copies
CONSTANT_SHARE = 0.8
MASS_SHARE = 0.6
NAMED_SHARE = 0.1           # of the varying text, must lie outside elements that are noise by name
MAX_DEPTH = 200             # as in browsers, elements nested deeper become siblings; no text is lost

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp".split())
SKIP = RAW | frozenset("head nav footer aside form button select option menu dialog object applet audio video canvas "
                       "map label input fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MEMBERS = frozenset("li td th dt dd tr".split())
CELLS = frozenset("td th dt dd".split())
BLOCKS = HEADINGS | frozenset("address article blockquote body center dd details div dl dt figcaption figure header hr html "
                              "li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS | frozenset("aside fieldset footer form nav menu".split())
RUNNING = HEADINGS | frozenset("p li blockquote pre td th dd dt figcaption body article main section".split())
# Class, id and role words of boilerplate; the second list only as whole class names.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar "
    "navigation breadcrumb breadcrumbs footer sidebar rail widget cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup login sharing comments disqus respond pagination pager toolbar masthead "
    "topbar contentinfo complementary teaser".split())
AMBIGUOUS = frozenset("notice share social comment reply replies related recommended recommendations alert search "
                      "copyright legal disclaimer skip".split())
# Compounds that name such a block whole.
COMPOUND = frozenset("comment related recommended share social notice search skip reply copyright".split())
PARTS = frozenset("area bar block box buttons button content form icons items link links list media module panel posts "
                  "post articles stories section thread wrap wrapper container widget line to text".split())
STATES = frozenset("has no with without is not".split()), frozenset("open closed on off enabled disabled active".split())
CONTENT = frozenset("article articles content post entry story body main prose text".split())
MAIN_WORDS = frozenset("articlebody main-content article-body post-content entry-content article-content".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")


def _kind(name: str) -> str:
    """What one class name says of its element: noise, content or nothing."""
    words = _WORDS.findall(name)
    if not words or words[0] in STATES[0] or words[-1] in STATES[1]:
        return ""
    if any(w in NOISE for w in words) or name in AMBIGUOUS or any(
            w in COMPOUND and set(words) - {w} <= PARTS | CONTENT | COMPOUND and len(words) > 1 for w in words):
        return "noise"
    return "content" if any(w in CONTENT for w in words) else ""


def noisy(classes: str, ident: str, role: str) -> bool:
    """Whether class, id and role name boilerplate.  An id is also a link target, so
    an ambiguous word alone is none there."""
    kinds = [_kind(c) for c in classes.split()]
    if ident and ident not in AMBIGUOUS:
        kinds.append(_kind(ident))
    return role in NOISE or role in AMBIGUOUS or "noise" in kinds and "content" not in kinds


class Node:
    """An element; ``kids`` holds elements and text in order."""

    __slots__ = ("tag", "mark", "noise", "named", "main", "kids", "template", "_text")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.kids, self.template, self._text = tag, [], False, None
        self.mark, self.noise, self.main = "", tag in SKIP, tag in ("article", "main")
        self.named = False          # noise by its class, id or role only
        if attrs and "=" in attrs or "hidden" in attrs:
            self._read(attrs)

    def _read(self, attrs: str) -> None:
        found = {}
        for name, a, b, c in _ATTR.findall(attrs):
            found.setdefault(name.lower(), (a or b or c).lower())
        self.mark = found.get("class", "")
        words = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}"
        self.noise = self.noise or "hidden" in found or found.get("aria-hidden") == "true" or \
            "display:none" in found.get("style", "").replace(" ", "")
        if words.strip() and not self.noise and self.tag not in ("body", "html", "article", "main"):
            self.noise = self.named = noisy(found.get("class", ""), found.get("id", ""), found.get("role", ""))
        self.main = self.main or found.get("role") == "main" or found.get("itemprop") == "articlebody" or \
            any(w in MAIN_WORDS for w in words.split())

    def text(self) -> tuple[int, bool]:
        """A hash of all text below, and whether there is any."""
        if self._text is None:
            own = " ".join("".join(k for k in self.kids if type(k) is str).split())
            kids = [k.text() for k in self.kids if type(k) is Node and k.tag not in RAW]
            self._text = hash((own, *kids)), bool(own) or any(k[1] for k in kids)
        return self._text


def parse(page: str) -> Node:
    """The DOM tree of a page, by a small subset of the HTML rules."""
    root = Node("#root", "")
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i].tag
                if t == "p" or t == tag and tag in ("li", "tr", "td", "th", "dt", "dd"):
                    del stack[i:]
                    break
                if t in CLOSES_P:
                    break
        node = Node(tag, m.group(3))
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]|</{re.escape(tag)}\Z", re.I).search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else n
        elif tag not in VOID and len(stack) < MAX_DEPTH:
            stack.append(node)      # "/>" does not close an HTML element
    return root


class Fold:
    """A run of equal siblings, folded: the nodes, and the folds of their children."""

    __slots__ = ("sign", "nodes", "kids", "votes", "seen")

    def __init__(self, sign, nodes: list[Node]):
        self.sign, self.nodes, self.votes, self.seen = sign, nodes, Counter(), 0
        runs: list[tuple] = []
        for node in nodes:
            for k in node.kids:
                if type(k) is Node and k.tag not in RAW:
                    s = (k.tag, k.mark)
                    if runs and runs[-1][0] == s:
                        runs[-1][1].append(k)
                    else:
                        runs.append((s, [k]))
        self.kids = [Fold(s, r) for s, r in runs]

    def units(self) -> dict:
        """The nodes that are template or not together, by their text (empty ones left out)."""
        if self.sign[0] in MEMBERS:
            texts = [n.text() for n in self.nodes]
            return {tuple(texts): self.nodes} if any(t[1] for t in texts) else {}
        out: dict = {}
        for n in self.nodes:
            if n.text()[1]:
                out.setdefault(n.text(), []).append(n)
        return out

    def size(self) -> int:
        return 1 + sum(k.size() for k in self.kids)


def _fixed(x: list[Fold], y: list[Fold]) -> list[tuple[int, int]]:
    """Pairs of children with equal mark and text, each the only one of its list, in the order of both."""
    def single(folds: list[Fold]) -> dict:
        out: dict = {}
        for i, f in enumerate(folds):
            texts = tuple(n.text() for n in f.nodes)
            if any(t[1] for t in texts):
                key = f.sign, texts
                out[key] = None if key in out else i
        return out

    at = single(y)
    pairs = [(i, at[k]) for k, i in single(x).items() if i is not None and at.get(k) is not None]
    # The longest run of pairs that rises on both sides.
    ends: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        ends[k:k + 1], last[k:k + 1] = [j], [n]
        back.append(last[k - 1] if k else -1)
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _between(x: list[Fold], y: list[Fold]) -> tuple[int, list]:
    """The largest order-preserving match of two lists, whatever their lengths.

    Row by row; a place holds its size and a chain of the matched pairs, so memory
    follows one list and the chains, which share their ends."""
    if not x or not y:
        return 0, []
    above, ends = [0] * (len(y) + 1), [None] * (len(y) + 1)
    for p in x:
        sizes, chains = [0], [None]
        for j, q in enumerate(y):
            value, chain = above[j + 1], ends[j + 1]
            if sizes[j] > value:
                value, chain = sizes[j], chains[j]
            if p.sign == q.sign:
                n, found = align(p, q) if p.kids and q.kids else (1, [(p, q)])
                if above[j] + n >= value:
                    value, chain = above[j] + n, (found, ends[j])
            sizes.append(value)
            chains.append(chain)
        above, ends = sizes, chains
    pairs, chain = [], ends[-1]
    while chain:
        found, chain = chain
        pairs += found
    return above[-1], pairs


def align(a: Fold, b: Fold) -> tuple[int, list]:
    """Simple tree matching: the size of an order-preserving match of two trees,
    and its pairs of nodes.  Children that only one place of the other list
    equals are matched first; between them the match is the largest."""
    if a.sign != b.sign:
        return 0, []
    size, pairs, i, j = 1, [(a, b)], 0, 0
    for s, t in [*_fixed(a.kids, b.kids), (len(a.kids), len(b.kids))]:
        n, found = _between(a.kids[i:s], b.kids[j:t])
        size, pairs = size + n, pairs + found
        if s < len(a.kids):
            n, found = align(a.kids[s], b.kids[t])
            size, pairs = size + n, pairs + found
        i, j = s + 1, t + 1
    return size, pairs


def originals(texts: list[str]) -> list[int]:
    """The first text of every group of equal or nearly equal texts."""
    kept: list[tuple[int, set]] = []
    seen: set[str] = set()
    for i, t in enumerate(texts):
        if t in seen:
            continue
        seen.add(t)
        words = t.split()
        grams = set(zip(words, words[1:], words[2:])) or {tuple(words)}
        for _, g in kept:
            if min(len(g), len(grams)) >= COPY_SHARE * max(len(g), len(grams)):
                both = len(g & grams)
                if both >= COPY_SHARE * (len(g) + len(grams) - both):
                    break
        else:
            kept.append((i, grams))
    return [i for i, _ in kept]


def induce(trees: list[Node], texts: list[str]) -> None:
    """Mark the template nodes of a block's pages; ``texts`` are their texts by the marks alone."""
    voters = originals(texts)
    if len(voters) < MIN_PAGES:
        return
    folds = [Fold(("#root", ""), [t]) for t in trees]
    seed = max((folds[i] for i in voters), key=Fold.size)
    matched = [align(seed, f)[1] if f is not seed else [(n, n) for n in _all(seed)] for f in folds]
    for i in voters:
        for s, o in matched[i]:
            s.seen += 1
            s.votes.update(o.units().keys())
    for pairs in matched:
        for s, o in pairs:
            if s.seen >= MIN_PAGES and max(s.votes.values(), default=0) >= CONSTANT_SHARE * s.seen:
                for text, nodes in o.units().items():
                    if s.votes[text] >= CONSTANT_SHARE * s.seen:
                        for n in nodes:
                            n.template = True


def _all(f: Fold) -> Iterator[Fold]:
    yield f
    for k in f.kids:
        yield from _all(k)


def _mass(node: Node, constant: bool = False) -> int:
    """Characters of varying (or also of constant) text outside boilerplate and links."""
    if node.noise or node.tag == "a":
        return 0
    own = 0 if node.template and not constant else sum(len(k.strip()) for k in node.kids if type(k) is str)
    return own + sum(_mass(k, constant) for k in node.kids if type(k) is Node)


def _varying(node: Node, through_names: bool) -> int:
    """Characters of varying text outside links and outside boilerplate (or only outside that by tag)."""
    if node.tag == "a" or node.noise and not (node.named and through_names):
        return 0
    own = 0 if node.template else sum(len(k.strip()) for k in node.kids if type(k) is str)
    return own + sum(_varying(k, through_names) for k in node.kids if type(k) is Node)


def clear_names(root: Node) -> None:
    """Where the names of elements would leave out nearly all varying text of a
    page, the elements on the way to most of it are no boilerplate."""
    total = _varying(root, True)
    if not total or _varying(root, False) >= NAMED_SHARE * total:
        return
    node = root
    while node is not None:
        if node.named:
            node.noise = node.named = False
        kids = [(k, _varying(k, True)) for k in node.kids if type(k) is Node]
        best = max(kids, key=lambda x: x[1], default=(None, 0))
        node = best[0] if best[1] >= MASS_SHARE * total else None


def _marked(node: Node) -> Iterator[Node]:
    if node.noise:
        return
    if node.main:
        yield node
    for k in node.kids:
        if type(k) is Node:
            yield from _marked(k)


def content_slot(root: Node) -> tuple[Node, bool]:
    """The content node, and whether it is marked as such."""
    found = list(_marked(root))
    # Constant text decides only between marks that hold no varying text.
    for constant in (False, True):
        marked = [(m, n) for n in found if (m := _mass(n, constant))]
        if marked:
            most = max(m for m, _ in marked)
            # The innermost of the marked nodes that hold nearly all of it.
            return [n for m, n in marked if m >= 0.9 * most][-1], True
    node, total = root, _mass(root)
    while True:
        kids = [(k, _mass(k)) for k in node.kids if type(k) is Node and k.tag in BLOCKS]
        best = max(kids, key=lambda x: x[1], default=(None, 0))
        if not total or best[1] < MASS_SHARE * total or best[0].tag in RUNNING - {"body", "article", "main", "section"}:
            return node, False
        node = best[0]


def _labels(parent: Node) -> set[int]:
    """Constant children that belong to varying text: headings of a section that has some, cells beside it."""
    kids = [k for k in parent.kids if type(k) is Node and not k.noise and k.tag in BLOCKS and k.text()[1]]
    row = any(not k.template for k in kids if k.tag in CELLS)
    out, follows, below = set(), False, ""
    for k in reversed(kids):
        if k.tag in HEADINGS:
            kept = not k.template or follows or below > k.tag       # h3 belongs to the h2 before it
            follows, below = False, k.tag if kept else below
        else:
            kept = not k.template or row and k.tag in CELLS
            follows |= not k.template
        if k.template and kept:
            out.add(id(k))
    return out


def blocks(node: Node, marked: bool) -> list[str]:
    """Text blocks of the content in page order."""
    out: list[list[str]] = [[]]

    def walk(n: Node, inside_header: bool, label: bool, kept: bool = False) -> None:
        if n is not node and n.noise:
            return
        # Of a header, its headings and, in a marked article, its paragraphs.
        kept = kept or n.tag in HEADINGS or marked and n.tag == "p"
        if n.template and n is not node and n.tag in BLOCKS and not label:
            return
        labels = _labels(n) if marked and not label else ()
        header = inside_header or n.tag == "header"
        block = n.tag in BLOCKS
        if block:
            out.append([])
        for k in n.kids:
            if type(k) is str:
                if not header or kept:
                    out[-1].append(k)
            elif k.tag == "br":
                out[-1].append(" ")
            elif k.tag not in VOID or k.tag == "hr":
                walk(k, header, label or id(k) in labels, kept)
        if block:
            out.append([])

    walk(node, False, False)
    texts = (" ".join(entities.unescape("".join(b)).split()) for b in out)
    return [t for t in texts if t]


def extract(pages: list[str | None]) -> list[str]:
    """The main text of each page of a block (pages of one host)."""
    trees = [parse(p) if p else None for p in pages]
    held = [t for t in trees if t is not None]
    marked = [" ".join(blocks(*content_slot(t))) for t in held]
    induce(held, marked)
    for t in held:
        clear_names(t)
    texts = iter([" ".join(blocks(*content_slot(t))) or m for t, m in zip(held, marked)])
    return [next(texts) if t is not None else "" for t in trees]


def main_texts(pages: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(page_id, url, text)`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            texts = extract([h[4] for h in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([h[2] for h in held], pa.int64()), pa.array([h[3] for h in held], pa.string()),
                 pa.array(texts, pa.string())], ["page_id", "url", "text"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if held and (row[:2] != held[0][:2] or len(held) >= LONGEST):
                    yield done()
                    held.clear()
                held.append(row)
        if held:
            yield done()

    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)),
                      F.lit(""))
    # Blocks of hosts with more than one; only the url column is read for it.
    sizes = pages.groupBy(host.alias("host")).count().where(F.col("count") > block).select(
        "host", F.ceil(F.col("count") / block).alias("_blocks"))
    small = sizes.limit(MAX_HOSTS + 1).count() <= MAX_HOSTS
    rows = pages.select(host.alias("host"), F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.join(F.broadcast(sizes) if small else sizes, "host", "left").withColumn(
        "block", F.pmod(F.xxhash64("page_id"), F.coalesce("_blocks", F.lit(1))))
    dealt = rows.repartition("host", "block").sortWithinPartitions("host", "block", "page_id", "url", "html")
    return dealt.select("host", "block", "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
