"""Corpus hygiene, versions, ids, splits and set operations.

"Keep one row per key" operators are written as aggregates of a struct
(``max(struct(order..., payload...))``) rather than ``row_number()`` windows:
the aggregate is combined map-side, so a key holding a third of all rows
never lands whole in one task, and the full struct order makes the winner
deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubsift.operators.ordinals import global_ordinal, with_scalars

ID = "pmid"


def _winner(df: DataFrame, key: str, order: list[str], agg=F.max) -> DataFrame:
    payload = [c for c in df.columns if c != key and c not in order]
    best = agg(F.struct(*order, *payload)).alias("_w")
    return (df.groupBy(key).agg(best, F.count(F.lit(1)).alias("n_copies"))
            .select(key, *[F.col(f"_w.{c}").alias(c) for c in order + payload], "n_copies"))


def latest_version(versions: DataFrame, id_col: str = ID) -> DataFrame:
    """Newest copy of each article: greater (file_pos, article_pos) wins.

    ``version`` is NULL when the article was never updated (one copy), else
    the version of the winning copy; ``warn`` marks two copies of one version
    inside one file.
    """
    w = _winner(versions, id_col, ["file_pos", "article_pos"])
    dup_version = (versions.groupBy(id_col, "file_pos", "version").count()
                   .groupBy(id_col).agg(F.max(F.col("count") > 1).alias("warn")))
    return (w.withColumn("version", F.when(F.col("n_copies") > 1, F.col("version")))
            .join(dup_version, id_col))


def first_per_id(df: DataFrame, order: list[str], id_col: str = ID) -> DataFrame:
    """Drop duplicate ids, keep the first row in ``order``."""
    return _winner(df, id_col, order, agg=F.min).drop("n_copies")


def missing_text(*cols) -> Column:
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.col(c).isNull() | (F.trim(F.col(c)) == "")
    return cond


def drop_missing_text(df: DataFrame, cols=("title", "content")) -> DataFrame:
    """Rows whose text columns are all present (NULL or blank = missing)."""
    return df.where(~missing_text(*cols))


def quality_counts(df: DataFrame, id_col: str = ID, cols=("title", "content")) -> DataFrame:
    """Rows, distinct ids, duplicate rows and rows with missing text."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct(id_col).alias("n_ids"),
                  (F.count(F.lit(1)) - F.count_distinct(id_col)).alias("n_duplicates"),
                  F.count_if(missing_text(*cols)).alias("n_missing"))


def duplicate_ids(df: DataFrame, id_col: str = ID) -> DataFrame:
    """Ids seen more than once, with a flag for more than twice."""
    return (df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
            .where("n > 1").withColumn("more_than_twice", F.col("n") > 2))


def title_into_content(df: DataFrame) -> DataFrame:
    """content = title + ' ' + content (a missing part contributes nothing)."""
    return df.withColumn("content", F.concat_ws(" ", "title", "content"))


def filter_date_range(df: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """Rows dated in [start, end] inclusive; bounds are 'yyyy/MM/dd' strings."""
    lo = F.try_to_date(F.lit(start), "yyyy/MM/dd")
    hi = F.try_to_date(F.lit(end), "yyyy/MM/dd")
    return df.where(F.col(date).between(lo, hi))


def filter_year_range(df: DataFrame, first: int, last: int, date: str = "date") -> DataFrame:
    return filter_date_range(df, f"{first}/01/01", f"{last}/12/31", date)


def count_by_period(df: DataFrame, date: str = "date") -> DataFrame:
    return df.groupBy(F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def id_ranges(df: DataFrame, first: int, last: int, id_col: str = ID,
              date: str = "date") -> DataFrame:
    """Ids published between two years (inclusive), duplicates kept."""
    return df.where(F.year(date).between(first, last)).select(id_col)


def max_id(df: DataFrame, id_col: str = ID) -> DataFrame:
    return df.agg(F.max(id_col).alias("max_id"))


def assign_ids(new: DataFrame, existing: DataFrame, order, id_col: str = ID) -> DataFrame:
    """Consecutive ids after the current maximum, in ``order``."""
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_max"))
    out = global_ordinal(new, order, "_ord")
    return (with_scalars(out, top)
            .withColumn(id_col, F.col("_max") + F.col("_ord")).drop("_max", "_ord"))


def batch_ids(ids: DataFrame, id_col: str = ID, batch: int = 100, group: int = 10) -> DataFrame:
    """(id, batch, group): consecutive batches of ``batch`` ids in id order."""
    out = global_ordinal(ids.select(id_col), [id_col], "_ord", start=0)
    return out.select(id_col, F.floor(F.col("_ord") / batch).alias("batch"),
                      F.floor(F.col("_ord") / (batch * group)).alias("group"))


def hash_key(seed: str, *cols) -> Column:
    """Deterministic pseudo-random order: md5(seed || key)."""
    return F.md5(F.concat(F.lit(seed), *[F.col(c).cast("string") for c in cols]))


def group_ordinal(df: DataFrame, group: str, order, name: str = "ord") -> DataFrame:
    """1-based position inside ``group`` by ``order`` without a per-group window.

    A global ordinal over (group, order) minus each group's first ordinal: a
    group holding a third of the rows is still spread over many tasks.
    """
    g = global_ordinal(df, [group] + list(order), "_g")
    first = g.groupBy(group).agg(F.min("_g").alias("_g0"))
    return g.join(first, group).withColumn(name, F.col("_g") - F.col("_g0") + 1) \
        .drop("_g", "_g0")


def train_test_split(df: DataFrame, fraction: float = 0.25, seed: str = "42",
                     id_col: str = ID, group: str | None = None) -> DataFrame:
    """Exact split: the first ceil(fraction * n) rows by md5(seed || id) are
    'test', the rest 'train' (per ``group`` when given)."""
    keyed = df.withColumn("_h", hash_key(seed, id_col))
    if group is None:
        ordered = global_ordinal(keyed, ["_h", id_col], "_o")
        counted = with_scalars(ordered, ordered.agg(F.count(F.lit(1)).alias("_n")))
    else:
        ordered = group_ordinal(keyed, group, ["_h", id_col], "_o")
        counted = ordered.join(keyed.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), group)
    out = counted.withColumn(
        "split", F.when(F.col("_o") <= F.ceil(F.col("_n") * fraction), "test").otherwise("train"))
    return out.drop("_h", "_o", "_n")


def hash_split(df: DataFrame, fraction: float = 0.25, seed: str = "42",
               id_col: str = ID) -> DataFrame:
    """Approximate split for very large inputs: no ordinal, one pass."""
    bucket = F.conv(F.substr(hash_key(seed, id_col), F.lit(1), F.lit(8)), 16, 10).cast("double")
    return df.withColumn("split", F.when(bucket / 4294967296.0 < fraction, "test")
                         .otherwise("train"))


def pool_corpora(splits: DataFrame, id_col: str = ID) -> DataFrame:
    """Union of all training sets (one row per id) and test = union minus training."""
    train = splits.where("split = 'train'").select(id_col).distinct()
    test = splits.where("split = 'test'").select(id_col).distinct().join(train, id_col, "left_anti")
    return (train.withColumn("role", F.lit("train"))
            .unionByName(test.withColumn("role", F.lit("test"))))


def corpus_overlap(members: DataFrame, corpus: str = "corpus", id_col: str = ID) -> DataFrame:
    """overlap(i, j) = |i and j| / |i| for i != j, plus each corpus's largest.

    Documents are first grouped by the set of corpora they belong to (a
    partial aggregate); pairs are expanded per distinct set only, so no
    per-document pair list is ever built.
    """
    sets = members.groupBy(id_col).agg(F.array_sort(F.collect_set(corpus)).alias("cs"))
    sig = sets.groupBy("cs").agg(F.count(F.lit(1)).alias("n"))
    pairs = (sig.select("n", F.explode("cs").alias("i"), "cs")
             .select("n", "i", F.explode("cs").alias("j")))
    inter = pairs.groupBy("i", "j").agg(F.sum("n").alias("n_ij"))
    size = inter.where("i = j").select("i", F.col("n_ij").alias("n_i"))
    return (inter.where("i <> j").join(size, "i")
            .select(F.col("i").alias("corpus_i"), F.col("j").alias("corpus_j"),
                    (F.col("n_ij") / F.col("n_i")).alias("overlap")))


def largest_overlap(overlap: DataFrame) -> DataFrame:
    return overlap.groupBy("corpus_i").agg(F.max("overlap").alias("max_overlap"))


def downsample_corpora(members: DataFrame, corpus: str = "corpus", id_col: str = ID,
                       seed: str = "42") -> DataFrame:
    """For each corpus, a hash-ordered sample at every smaller corpus size."""
    keyed = members.withColumn("_h", hash_key(seed, id_col))
    ordered = group_ordinal(keyed, corpus, ["_h", id_col], "_o")
    sizes = members.groupBy(corpus).agg(F.count(F.lit(1)).alias("size"))
    # corpora x sizes: bounded by (number of corpora)^2, not by the data.
    targets = (sizes.alias("c").join(sizes.select(F.col("size").alias("target")).distinct(),
                                     F.col("target") < F.col("size"))
               .select(corpus, "target"))
    return (ordered.join(F.broadcast(targets), corpus)
            .where(F.col("_o") <= F.col("target"))
            .select(corpus, F.col("target").alias("sample_size"), id_col))


def scale_range(df: DataFrame, col: str, lo: float = 20.0, hi: float = 100.0,
                name: str = "scaled") -> DataFrame:
    """Linear map of [min, max] of ``col`` onto [lo, hi]."""
    stats = df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    return (with_scalars(df, stats)
            .withColumn(name, F.lit(lo) + (F.col(col) - F.col("_mn")) * (hi - lo)
                        / F.nullif(F.col("_mx") - F.col("_mn"), F.lit(0)))
            .drop("_mn", "_mx"))


def union_distinct_ids(*frames: DataFrame, id_col: str = ID) -> DataFrame:
    out = frames[0].select(id_col)
    for f in frames[1:]:
        out = out.union(f.select(id_col))
    return out.distinct()


def intersect_ids(a: DataFrame, b: DataFrame, id_col: str = ID) -> DataFrame:
    return a.select(id_col).intersect(b.select(id_col))


def exclude_ids(df: DataFrame, excluded: DataFrame, id_col: str = ID) -> DataFrame:
    return df.join(excluded.select(id_col), id_col, "left_anti")


def fetch_articles(df: DataFrame, ids: DataFrame, id_col: str = ID) -> DataFrame:
    """Full records for an id list; ids with no record come back with found=false."""
    wanted = ids.select(id_col).distinct()
    return (wanted.join(df.withColumn("_found", F.lit(True)), id_col, "left")
            .withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found"))


def sample_files(files: DataFrame, n: int, seed: str = "42", file_col: str = "file") -> DataFrame:
    """A reproducible random sample of ``n`` distinct input files."""
    distinct = files.select(file_col).distinct()
    return distinct.orderBy(hash_key(seed, file_col), file_col).limit(n)
