"""Occurrences of a label: overlapping ones count, and long texts take no time squared."""

import time

import pytest
from pyspark.sql import functions as F

from pubsift.functions.text import annotation_span_start, count_preceding_matches

SCHEMA = "t string, l string, n int, p int"


@pytest.mark.parametrize("row, start, before", [
    (("aaaa", "aa", 2, 3), 2, 3), (("aaaa", "aa", 3, 4), None, 3), (("a.b axb", "a.b", 1, 7), None, 1),
    (("é𝒳é𝒳é", "é𝒳é", 1, 3), 2, 2), (("x\\Ey\\E", "\\E", 1, 5), 4, 2), (("ab", "ab", 0, 0), 0, 0),
    ((None, "a", 0, 1), None, 0), (("abc", "", 1, 2), 1, 2), (("", "a", 0, 1), None, 0), (("aba", "a", 0, -1), 0, 0)])
def test_occurrences(spark, row, start, before):
    got = spark.createDataFrame([row], SCHEMA).select(
        annotation_span_start("t", "l", "n").alias("s"), count_preceding_matches("t", "l", "p").alias("b")).first()
    assert (got.s, got.b) == (start, before)


def test_long_texts(spark):
    rows = spark.range(4).select(F.repeat(F.lit("é b "), 75_000).alias("t"), F.lit("b").alias("l"),
                                 F.lit(74_999).alias("n"), F.lit(150_000).alias("p"))
    began = time.monotonic()
    got = rows.select(annotation_span_start("t", "l", "n").alias("s"), count_preceding_matches("t", "l", "p").alias("b"))
    assert {tuple(r) for r in got.collect()} == {(299_998, 37_500)}
    assert time.monotonic() - began < 15
