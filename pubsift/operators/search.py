"""Topical selection: boolean / phrase / regex filters over text or stored postings.

One question is a filter: a document's tokens are joined by spaces once, and its
words and phrases are looked up in that string, without a shuffle.  Many
questions over time go to a :class:`~pubsift.operators.postings.PostingsStore`,
which reads only the buckets of their tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubsift.functions.text import TOKEN_RUN, raw_tokens

ID = "pmid"


def entry_words(item: str) -> list[str]:
    """The words of a query entry (a word or a phrase)."""
    import regex

    return regex.findall(TOKEN_RUN, item.lower())


def joined_tokens(text: str = "content") -> Column:
    """Tokens between single spaces, with one at each end; null text has none."""
    return F.concat(F.lit(" "), F.array_join(F.coalesce(raw_tokens(text), F.array().cast("array<string>")), " "),
                    F.lit(" "))


def matches(joined: Column, all_of=(), any_of=(), none_of=()) -> Column:
    """True if every ``all_of`` entry, at least one ``any_of`` entry (when given)
    and no ``none_of`` entry occurs.  An entry without a word occurs nowhere."""
    def has(item):
        words = entry_words(item)
        return F.contains(joined, F.lit(f" {' '.join(words)} ")) if words else F.lit(False)

    cond = F.lit(True)
    for item in all_of:
        cond = cond & has(item)
    if any_of:
        some = F.lit(False)
        for item in any_of:
            some = some | has(item)
        cond = cond & some
    for item in none_of:
        cond = cond & ~has(item)
    return cond


def text_match(docs: DataFrame, all_of=(), any_of=(), none_of=(),
               text: str = "content", id_col: str = ID) -> DataFrame:
    """Documents with every ``all_of`` entry, at least one ``any_of`` entry
    (when given) and no ``none_of`` entry.  Entries are words or phrases;
    matching is case-insensitive on whole tokens.  All hits, unscored.

    A filter on each row: the tokens are computed once (the lambda binds them)
    and nothing is shuffled."""
    return docs.where(F.exists(F.array(joined_tokens(text)), lambda j: matches(j, all_of, any_of, none_of)))


def search_sorted_by_date(docs: DataFrame, date: str = "date", id_col: str = ID,
                          **query) -> DataFrame:
    """``text_match`` ordered globally by (date, id)."""
    return text_match(docs, id_col=id_col, **query).orderBy(date, id_col)


def tag_documents_by_query(docs: DataFrame, queries: dict[str, dict],
                           text: str = "content", id_col: str = ID) -> DataFrame:
    """(query, id) for many topic queries in one scan of the text.

    ``queries`` maps a query name to ``text_match`` keyword arguments.
    """
    def tags(joined):
        return F.filter(F.array(*[F.when(matches(joined, **spec), F.lit(name)) for name, spec in queries.items()]),
                        lambda t: t.isNotNull())

    found = F.flatten(F.transform(F.array(joined_tokens(text)), tags))
    return docs.select(F.explode(found).alias("query"), id_col)


def filter_regex(docs: DataFrame, pattern: str, cols=("title", "content")) -> DataFrame:
    """Case-insensitive regex on any of ``cols``; NULL counts as no match."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.col(c).rlike(f"(?i){pattern}"), F.lit(False))
    return docs.where(cond)


def filter_association(docs: DataFrame, pattern: str, col: str = "content") -> DataFrame:
    """Keep rows whose ``col`` matches the association regex."""
    return docs.where(F.coalesce(F.col(col).rlike(pattern), F.lit(False)))
