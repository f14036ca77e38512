"""Quotation linking: conversations ordered by reply, without quotes.

1. Every message is parsed line by line: leading ``>`` marks (blanks between them
   allowed) are the quote level; lines of level 0 are the message's own.
2. Passages are paragraphs (runs of lines of one level) and their single lines,
   lower-cased with white space folded, hashed.  For trimmed and re-wrapped
   quotes, runs of ``RUN`` words of a paragraph are hashed as well, and the
   sentences of fewer words; in own text only where the conversation has quotes.
3. The first message of a conversation that says a passage as its own is its
   original (an aggregate, combined map-side).  Quoted passages join it by
   conversation and hash; the original must be an earlier turn.  So do runs; those
   of a paragraph have its characters together, so a whole passage outweighs them.
4. The parent of a message is the original with most quoted characters (ties:
   the later turn), shallowest quote level first.  Thread roots come from
   pointer jumping: as many joins as the logarithm of the longest chain.
5. Messages are ordered by (turn of the thread root, turn) with a distributed
   ordinal, so a hot conversation is never gathered.

Attribution lines ("On ... wrote:") right before a quote go with the quote.

Cases: null text is empty; a null conversation or turn links with nothing and
keeps its row; rows that repeat a turn are ordered by role and text, and a
passage said in a turn belongs to that turn; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubsift.llm.common import Workspace, frame
from pubsift.operators.ordinals import global_ordinal

_MARKS = re.compile(r"[ \t]*(?:>[ \t]?)+")
_ATTRIBUTION = re.compile(r"^\s*(?:on\b.{0,200}\bwrote|.{1,80}\b(?:wrote|said|writes))\s*:\s*$", re.I)
MIN_CHARS = 3               # normalised passages below this say nothing
RUN = 4                     # words of a run
_SENTENCE = re.compile(r"(?<=[.!?]) ")
_BLANK = re.compile(r"\n[^\S\n]*\n")


def split_levels(text: str | None) -> list[tuple[int, str]]:
    """``(level, line without marks)`` of every line."""
    out = []
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        out.append((line[:m.end()].count(">"), line[m.end():]) if m else (0, line))
    for i, (level, line) in enumerate(out[:-1]):
        if level == 0 and _ATTRIBUTION.match(line) and out[i + 1][0] > 0:
            out[i] = (out[i + 1][0], "")
    return out


def normalise(passage: str) -> str:
    return " ".join(passage.lower().split())


def paragraphs(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """``(level, normalised paragraph)``."""
    out, run, at = [], [], None
    for level, line in [*lines, (None, "")]:
        if run and (level != at or not line.strip()):
            out.append((at, normalise(" ".join(run))))
            run = []
        if level is not None and line.strip():
            run.append(line)
        at = level
    return out


def passages(lines: list[tuple[int, str]]) -> set[tuple[int, str]]:
    """``(level, normalised passage)``: paragraphs and their lines."""
    out = {*paragraphs(lines), *((level, normalise(line)) for level, line in lines if line.strip())}
    return {(level, p) for level, p in out if len(p) >= MIN_CHARS}


def runs(paragraph: str) -> list[tuple[str, int]]:
    """``(run, characters)`` of every ``RUN`` words of a normalised paragraph; the characters add up to its own."""
    words = paragraph.split(" ")
    out = [(" ".join(words[i:i + RUN]), len(words[i]) + 1) for i in range(len(words) - RUN + 1)]
    return [*out[:-1], (out[-1][0], len(out[-1][0]))] if out else []


def short_sentences(paragraph: str) -> list[tuple[str, int]]:
    """``(sentence, characters)`` of the sentences of fewer words than a run."""
    return [(x, len(x)) for x in _SENTENCE.split(paragraph) if len(x) >= MIN_CHARS and x.count(" ") < RUN - 1]


PARSED = ("text string, n_quoted_lines int, said array<long>, "
          "quoted array<struct<level:int,passage:long,h:long,chars:int>>")


def _signed(p: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass"), seed) - (1 << 63)


def _parsed(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        lines = split_levels(t)
        units = passages(lines)
        quoted = sum(level > 0 for level, _ in lines)
        own = "\n".join(line for level, line in lines if not level)
        asked = {(level, p, _signed(p), len(p)) for level, p in units if level}
        for level, p in paragraphs(lines) if quoted else ():
            if level:
                asked |= {(level, p, _signed(r, 1), n) for r, n in runs(p) or short_sentences(p)}
        out.append((re.sub(r"\n{3,}", "\n\n", own).strip() if quoted else t or "", quoted,
                    sorted({_signed(p) for level, p in units if not level}),
                    [{"level": level, "passage": _signed(p), "h": h, "chars": n} for level, p, h, n in sorted(asked)]))
    return frame(out, ["text", "n_quoted_lines", "said", "quoted"])


def _runs_said(texts: pd.Series) -> pd.Series:
    """Hashes of the runs and short sentences of a message's own text."""
    out = []
    for t in texts:
        own = [normalise(p) for p in _BLANK.split(t)]
        out.append(sorted({_signed(r, 1) for p in own if p for r, _ in [*runs(p), *short_sentences(p)]}))
    return pd.Series(out)


def link_conversations(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, n_quoted_lines, n_linked, parent_turn, thread_turn, position)``."""
    ws = Workspace(spark, "quoting")
    parsed = F.pandas_udf(_parsed, PARSED)
    rows = ws.put(messages.select("conv_id", "turn", "role", parsed(F.col("text").cast("string")).alias("p"))
                  .select("conv_id", "turn", "role", "p.*"), "parsed")
    known = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quotes = known.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*").distinct()
    # Only passages that somebody quotes can be originals: the quotes decide early.
    asked = quotes.select("conv_id", "h").distinct()
    runs_said = F.pandas_udf(_runs_said, "array<long>")
    quoting = known.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi")
    said = (known.select("conv_id", "turn", F.explode("said").alias("h"))
            .unionByName(quoting.select("conv_id", "turn", F.explode(runs_said("text")).alias("h"))))
    first = (said.join(asked, ["conv_id", "h"], "left_semi")
             .groupBy("conv_id", "h").agg(F.min("turn").alias("source")))
    # Written before the join, so that adaptive execution may split a hot passage.
    first = ws.put(first, "first")
    links = ws.put(quotes.join(first, ["conv_id", "h"]).where(F.col("source") < F.col("turn")), "links")
    votes = links.groupBy("conv_id", "turn", "level", "source").agg(F.sum("chars").alias("chars"))
    # Passages of which any run is linked.
    linked = (links.select("conv_id", "turn", "level", "passage").distinct()
              .groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked")))
    parents = ws.put(votes.groupBy("conv_id", "turn").agg(
        F.max_by("source", F.struct(-F.col("level"), F.col("chars"), F.col("source"))).alias("parent_turn"))
        .join(linked, ["conv_id", "turn"]), "parents")
    roots = ws.put(_roots(parents, ws), "roots")
    linked = parents.join(roots, ["conv_id", "turn"])
    full = rows.join(linked, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "n_quoted_lines", F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "parent_turn", F.coalesce("root", "turn").alias("thread_turn"))
    # The ordinal needs non-null keys in a total order; the text travels once.
    ordered = global_ordinal(full, ["conv_id", "thread_turn", "turn", "role", "text"], "_at", start=0)
    start = ordered.groupBy("conv_id").agg(F.min("_at").alias("_first")).withColumnRenamed("conv_id", "_conv")
    start = ws.put(start, "starts")
    return (ordered.join(start, F.col("conv_id").eqNullSafe(F.col("_conv")))
            .withColumn("position", (F.col("_at") - F.col("_first")).cast("long")).drop("_at", "_first", "_conv"))


def _roots(parents: DataFrame, ws: Workspace) -> DataFrame:
    """The first turn of each linked message's chain; parents are earlier turns."""
    up, step = parents.select("conv_id", "turn", F.col("parent_turn").alias("root")), 0
    while True:
        over = up.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"))
        jumped = ws.put(up.join(over, ["conv_id", "root"], "left").select(
            "conv_id", "turn", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")),
            f"jump{step}")
        up = jumped.select("conv_id", "turn", "root")
        if jumped.where("moved").isEmpty():
            return up
        step += 1
