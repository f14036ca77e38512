"""Shared pieces of the registered queries (Spark side and SQL side)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubsift.functions.text import TOKEN_RUN

# Fixed query parameters used by the registered queries.
TOPIC_ALL = ["the"]
TOPIC_ANY = ["with", "rewh", "of the"]
TOPIC_NONE = ["th"]
ASSOC_PATTERN = r"(?i)\bthe\b"
REGEX_PATTERN = r"\bthe of\b"


def normalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """Output convention: integers as bigint, floating values rounded doubles."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# DuckDB fragments reused by several oracles.
SQL_SENTS = r"""
sents as (
  select pmid, date, unnest(ss) as sentence, unnest(range(len(ss))) as sent_pos
  from (select pmid, date, string_split_regex(content, '[.!?]+\s+') as ss from articles) a
)"""

SQL_TOKS = rf"""
toks as (
  select pmid, date, sent_pos, sentence, unnest(t) as token, unnest(range(len(t))) as tok_pos
  from (select *, regexp_extract_all(lower(sentence), '{TOKEN_RUN}') as t from sents) s
)"""

SQL_POSTINGS = rf"""
postings as (
  select pmid, unnest(t) as token, unnest(range(len(t))) as pos
  from (select pmid, regexp_extract_all(lower(content), '{TOKEN_RUN}') as t from articles) a
)"""


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
