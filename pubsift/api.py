"""A document collection object: one DataFrame and the verbs a user calls
on a corpus (retrieve, process, filter).  Every verb returns
a new collection; nothing is collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubsift.operators import search as S


class Collection:
    """Articles ``(pmid, title, content, date, ...)`` as one DataFrame."""

    def __init__(self, df: DataFrame, id_col: str = "pmid"):
        self.df = df
        self.id_col = id_col

    def retrieve(self, ids: DataFrame) -> "Collection":
        """Full records for an id table (left semi join)."""
        return Collection(self.df.join(ids.select(self.id_col), self.id_col, "left_semi"),
                          self.id_col)

    def filter(self, all_of=(), any_of=(), none_of=(), regex: str | None = None) -> "Collection":
        """Topical selection: boolean / phrase terms and an optional regex."""
        df = self.df
        if all_of or any_of or none_of:
            df = S.text_match(df, all_of, any_of, none_of, id_col=self.id_col)
        if regex:
            df = S.filter_regex(df, regex)
        return Collection(df, self.id_col)

    def process(self, fn: Callable[[DataFrame], DataFrame]) -> "Collection":
        """Apply a DataFrame -> DataFrame function (``df.transform``)."""
        return Collection(self.df.transform(fn), self.id_col)

    def map_articles(self, fn, schema: str) -> DataFrame:
        """Python logic per batch of articles (``mapInPandas``): ``fn`` takes
        and returns pandas DataFrames."""

        def run(batches):
            for pdf in batches:
                yield fn(pdf)

        return self.df.mapInPandas(run, schema)

    def count_by(self, col: str) -> DataFrame:
        return self.df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
