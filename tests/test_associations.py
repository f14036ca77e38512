"""Association features on hand-written sentences."""

import datetime

from pubsift.operators import annotations as AN
from pubsift.operators import associations as A
from pyspark.sql import functions as F


def _run(spark, sentence, dictionary, lexicon=None):
    s = spark.createDataFrame([(1, datetime.date(2000, 1, 1), 0, sentence)],
                              "pmid long, date date, sent_pos int, sentence string")
    d = spark.createDataFrame(dictionary, "symbol string, alias string")
    lex = spark.createDataFrame(lexicon or [("binds", "VERB"), ("with", "ADP"), ("cells", "NOUN")],
                                "word string, class string")
    out = A.association_features(s, d, r"(?i)\bassociated\b", lex)
    return sorted((r.symbol, r.tok_pos, r.before, r.VERB, r.NOUN, r.ADP, r.PUNCT, r.GENE)
                  for r in out.collect())


def test_two_genes_before_and_one_after(spark):
    # tokens: The(0) MYCN(1) and(2) ALK2(3) binds(4) ,(5) associated(6) with(7) TP53(8) cells(9)
    rows = _run(spark, "The MYCN and ALK2 binds, associated with TP53 cells",
                [("MYCN", "mycn"), ("ALK", "alk2"), ("TP53", "tp53")])
    # flip = 7 (first token after the match start); MYCN at 1: tokens (1,7): VERB 1, PUNCT 1, GENE 1
    assert ("MYCN", 1, True, 1, 0, 0, 1, 1) in rows
    assert ("ALK", 3, True, 1, 0, 0, 1, 0) in rows
    # TP53 at 8 >= flip: tokens [7, 8): ADP 1
    assert ("TP53", 8, False, 0, 0, 1, 0, 0) in rows


def test_repeated_gene_before_keeps_nearest_and_alias_with_two_symbols(spark):
    rows = _run(spark, "First MYCN then MYCN binds associated here",
                [("MYCN", "mycn"), ("MYCNOS", "mycn")])
    syms = [(r[0], r[1]) for r in rows]
    assert ("MYCN", 3) in syms and ("MYCN", 1) not in syms
    assert ("MYCNOS", 3) in syms


def test_match_at_last_token_drops_genes_before(spark):
    rows = _run(spark, "The MYCN binds associated", [("MYCN", "mycn")])
    assert rows == []


def test_guard_rejects_sentence_start_and_lower_case(spark):
    rows = _run(spark, "Mycn binds mycn associated MYCN", [("MYCN", "mycn")])
    assert [(r[0], r[1]) for r in rows] == [("MYCN", 4)]


def test_spans_and_preceding_matches(spark):
    df = spark.createDataFrame([("aaa ab aaa", "aa", 0), ("aaa ab aaa", "aa", 2), ("xyz", "q", 0)],
                               "s string, l string, n int")
    out = AN.spans(df, "s", "l", "n").collect()
    assert [r.span_start for r in out] == [0, 7, None]
    pre = AN.preceding_matches(df.withColumn("p", F.lit(5)), "s", "l", "p").collect()
    assert [r.preceding for r in pre] == [2, 2, 0]


def test_render_annotations_later_spans_first(spark):
    df = spark.createDataFrame([("one two three", [(0, 3, "x"), (8, 13, "y")])],
                               "s string, spans array<struct<start:int,end:int,tag:string>>")
    out = AN.render_annotations(df, "s", "spans").first().marked
    assert out == '<mark class="x">one</mark> two <mark class="y">three</mark>'


def test_annotation_state_last_write_wins_with_delete(spark):
    ev = spark.createDataFrame([
        (1, datetime.datetime(2024, 1, 1), 0, 5, 1, "segment_annotation", "+", 1.0),
        (2, datetime.datetime(2024, 1, 2), 0, 5, 1, "delete", None, 0.0),
        (3, datetime.datetime(2024, 1, 3), 0, 5, 2, "segment_annotation", "-", 1.0),
        (4, datetime.datetime(2024, 1, 4), 0, 5, 2, "segment_annotation", "x", 1.0),
    ], "event_id long, ts timestamp, gid int, docid int, annot_id int, type string, tag string, value double")
    st = {r.annot_id: r.tag for r in AN.annotation_state(ev).collect()}
    assert st == {2: "x"}


def test_accented_words_and_terms(spark):
    # The(0) größe(1) GRÖSSE(2) wächst(3) ,(4) associated(5) ÉTÉ-2(6) naïve(7)
    rows = _run(spark, "The größe GRÖSSE wächst, associated ÉTÉ-2 naïve",
                [("SIZE", "grösse"), ("SUMMER", "été-2"), ("LOW", "größe"), ("N", "naïve")],
                [("wächst", "VERB"), ("naïve", "NOUN")])
    # flip = 6; lower-case words are no terms, accented letters no punctuation
    assert rows == [("SIZE", 2, True, 1, 0, 0, 1, 0), ("SUMMER", 6, False, 0, 0, 0, 0, 0)]


def test_verb_filter_and_flush_at_the_end(spark):
    s = spark.createDataFrame([(1, datetime.date(2000, 1, 1), 0, "The MYCN binds ALK associated"),
                               (2, datetime.date(2000, 1, 1), 0, "An ALK binds associated MYCN then")],
                              "pmid long, date date, sent_pos int, sentence string")
    d = spark.createDataFrame([("MYCN", "mycn"), ("ALK", "alk")], "symbol string, alias string")
    lex = spark.createDataFrame([("binds", "VERB"), ("binds", "X")], "word string, class string")

    def found(**options):
        return sorted((r.pmid, r.symbol, r.before, r.VERB, r.GENE)
                      for r in A.association_features(s, d, "associated", lex, **options).collect())

    assert found() == [(2, "ALK", True, 1, 0), (2, "MYCN", False, 0, 0)]
    assert found(flush_at_end=True) == [(1, "ALK", True, 0, 0), (1, "MYCN", True, 1, 1),
                                        (2, "ALK", True, 1, 0), (2, "MYCN", False, 0, 0)]
    assert found(flush_at_end=True, verbed=True) == [(1, "MYCN", True, 1, 1), (2, "ALK", True, 1, 0)]
