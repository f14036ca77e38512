"""Annotation events and their current state; spans inside sentences.

Annotations arrive as an append-only event log ``(event_id, ts, gid, docid,
annot_id, type, tag, value)``; the current state is "last write wins" per
(gid, docid, annot_id), with 'delete' events removing an entry.  The state
is a partial aggregate (``max(struct(ts, event_id, ...))``), so a document or
group with a third of all events is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubsift.functions.text import annotation_span_start, count_preceding_matches, col_of

KEY = ["gid", "docid", "annot_id"]

# Annotation symbols and their weights.
WEIGHTS = {"+": 2, "+-": 1, "-": -2, "-+": -1, "x": 0}


def annotation_state(events: DataFrame, key=KEY) -> DataFrame:
    """Current annotation per key: the latest event by (ts, event_id), unless
    it is a 'delete'."""
    payload = [c for c in events.columns if c not in key and c not in ("ts", "event_id")]
    last = events.groupBy(*key).agg(F.max(F.struct("ts", "event_id", *payload)).alias("_l"))
    out = last.select(*key, *[F.col(f"_l.{c}").alias(c) for c in ["ts", "event_id"] + payload])
    return out.where(F.col("type") != "delete")


def annotation_weight(symbol) -> F.Column:
    m = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, col_of(symbol))


def valid_annotation(symbol) -> F.Column:
    """Keep = annotation not NULL and not 'invalid'."""
    return col_of(symbol).isNotNull() & (col_of(symbol) != "invalid")


def strongest_label(annotations: DataFrame, unit: str = "docid", symbol: str = "label") -> DataFrame:
    """One label per unit (sentence / document): the annotation with the
    largest absolute weight (ties: larger weight, then smaller annot_id)."""
    w = annotations.where(valid_annotation(symbol)).withColumn("weight", annotation_weight(symbol))
    best = w.groupBy(unit).agg(F.max(F.struct(F.abs("weight").alias("_a"), F.col("weight"),
                                              (-F.col("annot_id")).alias("_n"),
                                              F.col(symbol))).alias("_b"))
    return best.select(unit, F.col(f"_b.{symbol}").alias(symbol), F.col("_b.weight").alias("weight"))


def distinct_tags(annotations: DataFrame, tag: str = "tag") -> DataFrame:
    return annotations.select(tag).where(F.col(tag).isNotNull()).distinct().orderBy(tag)


def attach_annotations(assoc: DataFrame, state: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Left join associations to the current annotation state on key pairs
    (association column, state column)."""
    cond = None
    for a, s in keys:
        c = assoc[a] == state[s]
        cond = c if cond is None else cond & c
    return assoc.join(state, cond, "left")


def spans(df: DataFrame, text: str, label: str, n: str) -> DataFrame:
    """Add ``span_start`` (0-based start of the (n+1)-th occurrence of label)
    and ``span_end``."""
    return (df.withColumn("span_start", annotation_span_start(text, label, n))
            .withColumn("span_end", F.col("span_start") + F.length(label)))


def preceding_matches(df: DataFrame, text: str, label: str, position: str) -> DataFrame:
    return df.withColumn("preceding", count_preceding_matches(text, label, position))


def render_annotations(df: DataFrame, text: str, spans_col: str, name: str = "marked") -> DataFrame:
    """Insert markup around spans: ``spans_col`` is array<struct<start, end,
    tag>>, offsets into the bare text.  Nested and touching spans keep their
    nesting: at one place inner spans close first, closing comes before opening
    and outer spans open first.  Of spans with equal ends the tag decides; an
    empty span is an empty mark.  A null list or element marks nothing."""
    spans_of = F.filter(F.coalesce(col_of(spans_col), F.array()), lambda s: s["start"].isNotNull() & s["end"].isNotNull())

    def mark(at, kind, rank, tag, markup):
        return F.struct(at.cast("long").alias("at"), F.lit(kind).alias("kind"), rank.cast("long").alias("rank"),
                        tag.alias("tag"), markup.alias("markup"))

    def opening(s):
        return F.concat(F.lit('<mark class="'), F.coalesce(s["tag"], F.lit("")), F.lit('">'))

    filled = F.filter(spans_of, lambda s: s["start"] < s["end"])
    empty = F.filter(spans_of, lambda s: s["start"] >= s["end"])
    numbered = F.array_sort(filled)  # the place in (start, end, tag) order settles spans with equal ends
    n = F.size(filled)
    closes = F.transform(numbered, lambda s, i: mark(s["end"], 0, -s["start"] * (n + 1) - i,
                                                     F.lit(""), F.lit("</mark>")))
    opens = F.transform(numbered, lambda s, i: mark(s["start"], 1, -s["end"] * (n + 1) + i,
                                                    F.lit(""), opening(s)))
    hollow = F.transform(empty, lambda s: mark(s["start"], 2, F.lit(0), F.coalesce(s["tag"], F.lit("")),
                                               F.concat(opening(s), F.lit("</mark>"))))
    marks = F.array_sort(F.concat(closes, opens, hollow))
    # Pieces of text between the marks, each followed by its mark.
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(marks, lambda m: m["at"]))
    pieces = F.zip_with(starts, marks, lambda a, m: F.concat(
        F.when(m.isNull(), F.substr(col_of(text), (a + 1).cast("int")))
        .otherwise(F.substr(col_of(text), (a + 1).cast("int"), (m["at"] - a).cast("int"))),
        F.coalesce(m["markup"], F.lit(""))))
    return df.withColumn(name, F.when(col_of(text).isNotNull(), F.array_join(pieces, "")))
