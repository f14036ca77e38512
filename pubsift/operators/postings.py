"""Stored token positions: topical questions that read only their tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubsift.functions.text import raw_tokens
from pubsift.operators.search import ID, entry_words
from pubsift.streaming.state import KeyedState

KINDS = ("all_of", "any_of", "none_of")


class PostingsStore:
    """``(token, pos, id)`` in Parquet folders by epoch and token bucket.

    Every added batch of documents is an epoch.  A question reads the folders of
    its tokens' buckets, and of their files only the row groups whose token range
    holds one (rows are sorted by token).  The last epoch of each id, a
    :class:`KeyedState`, decides which postings count: a document added again
    replaces its earlier text, a removed one is gone, and what an unfinished batch
    left counts nowhere.  A bucket with a frequent token is split over files (the
    ``rebalance`` hint), so a common word does not make one large task.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, id_col: str = ID):
        self.spark, self.path, self.buckets, self.id_col = spark, path, buckets, id_col

        def newest(rows: DataFrame) -> DataFrame:
            return rows.groupBy(id_col).agg(F.max(F.struct("epoch", "gone")).alias("_l")).select(id_col, "_l.*")

        self.ids = KeyedState(spark, f"{path}/ids", newest)

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def _next_epoch(self) -> int:
        return max((last for _, last in self.ids.runs()), default=-1) + 1

    def add(self, docs: DataFrame, text: str = "content") -> int:
        """Add or replace documents (ids unique in ``docs``); returns the epoch.  It
        counts once its ids are written, after its postings."""
        epoch = self._next_epoch()
        rows = (docs.select(self.id_col, F.posexplode(raw_tokens(text)).alias("pos", "token"))
                .withColumn("bucket", self._bucket(F.col("token"))).hint("rebalance", "bucket"))
        (rows.sortWithinPartitions("bucket", "token", self.id_col, "pos").write.mode("overwrite")
         .partitionBy("bucket").parquet(f"{self.path}/postings/epoch={epoch}"))
        self.ids.apply(docs.select(self.id_col, F.lit(epoch).alias("epoch"), F.lit(False).alias("gone")), epoch)
        return epoch

    def remove(self, ids: DataFrame) -> int:
        """Remove documents; returns the epoch."""
        epoch = self._next_epoch()
        self.ids.apply(ids.select(self.id_col, F.lit(epoch).alias("epoch"), F.lit(True).alias("gone")), epoch)
        return epoch

    def documents(self) -> DataFrame:
        """``(id, epoch)`` of the documents that count."""
        rows = self.ids.read()
        if rows is None:
            raise ValueError(f"{self.path}: nothing was added")
        return rows.where(~F.col("gone")).select(self.id_col, "epoch")

    def postings(self, tokens: list[str]) -> DataFrame:
        """``(id, epoch, pos, token)`` of the given tokens, of all epochs."""
        schema = T.StructType([T.StructField(self.id_col, self.documents().schema[self.id_col].dataType),
                               T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType()),
                               T.StructField("epoch", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        wanted = sorted(set(tokens))
        if not wanted:
            return self.spark.createDataFrame([], schema).drop("bucket")
        numbers = self.spark.createDataFrame([(t,) for t in wanted], "t string").select(self._bucket(F.col("t")))
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/postings")
        return rows.where(F.col("bucket").isin([r[0] for r in numbers.collect()])       # one number a query token
                          & F.col("token").isin(wanted)).drop("bucket")

    def tag(self, queries: dict[str, dict]) -> DataFrame:
        """(query, id) for many topic queries; ``queries`` maps a name to the keyword
        arguments of :func:`pubsift.operators.search.text_match`."""
        words, entry = [], 0
        for name, spec in queries.items():
            for kind in KINDS:
                for item in spec.get(kind, ()):
                    split = entry_words(item)
                    words += [(name, entry, kind, len(split), i, w) for i, w in enumerate(split)]
                    entry += 1
        asked = self.spark.createDataFrame(
            words, "query string, entry int, kind string, n_words int, idx int, word string")
        need = self.spark.createDataFrame(
            [(q, len(s.get("all_of", ())), bool(s.get("any_of"))) for q, s in queries.items()],
            "query string, n_all_needed int, any_needed boolean")
        live = self.documents()
        # Both broadcast tables are the caller's arguments.
        hits = (self.postings([w[5] for w in words]).join(F.broadcast(asked), F.col("token") == F.col("word"))
                .join(live, [self.id_col, "epoch"], "left_semi"))
        # A phrase occurs where all its words share one start.
        found = (hits.groupBy(self.id_col, "query", "entry", "kind", "n_words", (F.col("pos") - F.col("idx")).alias("at"))
                 .agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == F.col("n_words"))
                 .select(self.id_col, "query", "entry", "kind").distinct())
        per = found.groupBy(self.id_col, "query").agg(
            F.count_if(F.col("kind") == "all_of").alias("n_all"),
            F.max(F.col("kind") == "any_of").alias("has_any"), F.max(F.col("kind") == "none_of").alias("has_none"))
        tagged = per.join(F.broadcast(need), "query").where(
            (F.col("n_all") == F.col("n_all_needed")) & (~F.col("any_needed") | F.col("has_any")) & ~F.col("has_none"))
        # A query without positive entries takes every document but those it excludes.
        rest = [q for q, s in queries.items() if not s.get("all_of") and not s.get("any_of")]
        every = live.select(F.explode(F.array(*map(F.lit, rest)).cast("array<string>")).alias("query"), self.id_col)
        others = every.join(per.where("has_none"), ["query", self.id_col], "left_anti")
        return tagged.where(~F.col("query").isin(rest)).select("query", self.id_col).unionByName(others)

    def text_match(self, all_of=(), any_of=(), none_of=()) -> DataFrame:
        """Ids of the documents that :func:`pubsift.operators.search.text_match` keeps."""
        spec = {"all_of": list(all_of), "any_of": list(any_of), "none_of": list(none_of)}
        return self.tag({"q": spec}).select(self.id_col)
