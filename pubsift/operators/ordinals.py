"""Global ordinals and running sums without a single-task window.

An ``ORDER BY`` window with no ``PARTITION BY`` moves every row into one task.
For lists that grow with the data (article ids, vocabularies, ranked lists)
we use the classic zip-with-index pattern instead:

1. range-partition on the order key and sort inside each partition;
2. ``monotonically_increasing_id`` then encodes (partition index, local row);
3. per-partition row counts / sums are a table with one row per partition,
   so its size is bounded by the partition count (safe to broadcast);
4. a prefix over that small table gives each partition its offset.

The order key must be total (add a unique tie-breaker) for the result to be
deterministic across task retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOCAL_BITS = 33


def _cols(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _blocked(df: DataFrame, order, n: int | None) -> DataFrame:
    from pubsift.session import ensure_checkpoint_dir, materialize

    order = _cols(order)
    # Without an explicit count AQE may merge small range partitions; it
    # only merges neighbours, so partition order stays key order, and the
    # ids below are computed once (in the write) either way.
    ranged = (df.repartitionByRange(n, *order) if n else df.repartitionByRange(*order)) \
        .sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    blocked = (ranged.withColumn("_mid", mid)
               .withColumn("_blk", F.shiftright(F.col("_mid"), _LOCAL_BITS))
               .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
               .drop("_mid"))
    # The blocked rows are read twice (block sizes, block rows).  Range bounds
    # are sampled and partition ids depend on the physical plan, so the two
    # reads must see one materialisation: written once under the cluster's
    # checkpoint folder, which also cuts the lineage so a lost executor does
    # not recompute the whole upstream plan.
    ensure_checkpoint_dir(df.sparkSession)
    return materialize(blocked)


def global_ordinal(df: DataFrame, order, name: str = "ordinal", start: int = 1,
                   num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = position of each row in ``order`` (start, start+1, ...)."""
    b = _blocked(df, order, num_partitions)
    sizes = b.groupBy("_blk").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a bounded table, prefix over it in one task is fine.
    offsets = sizes.select(
        "_blk",
        (F.sum("_n").over(Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    out = b.join(F.broadcast(offsets), "_blk", "left")
    return (out.withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_loc") + F.lit(start))
            .drop("_blk", "_loc", "_off"))


def running_sums(df: DataFrame, order, values: dict[str, Column],
                 num_partitions: int | None = None, how: str = "sum") -> DataFrame:
    """Add inclusive running aggregates ``values`` (name -> column) down
    ``order``; ``how`` is 'sum', 'min' or 'max'."""
    agg = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    b = _blocked(df, order, num_partitions)
    for k, v in values.items():
        b = b.withColumn(f"_v_{k}", v)
    totals = b.groupBy("_blk").agg(*[agg(f"_v_{k}").alias(f"_t_{k}") for k in values])
    # One row per partition: a bounded table, so a single-task window is fine.
    prev = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_blk", *[agg(f"_t_{k}").over(prev).alias(f"_o_{k}")
                                      for k in values])
    local = Window.partitionBy("_blk").orderBy("_loc").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    for k in values:
        b = b.withColumn(f"_r_{k}", agg(f"_v_{k}").over(local))
    out = b.join(F.broadcast(offsets), "_blk", "left")
    for k in values:
        o, r = F.col(f"_o_{k}"), F.col(f"_r_{k}")
        if how == "sum":
            comb = F.coalesce(o, F.lit(0)) + r
        elif how == "min":
            comb = F.least(F.coalesce(o, r), r)
        else:
            comb = F.greatest(F.coalesce(o, r), r)
        out = out.withColumn(k, comb)
    drop = ["_blk", "_loc"] + [f"_{p}_{k}" for k in values for p in ("v", "o", "r")]
    return out.drop(*drop)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table (global stats) to every row.

    A broadcast hash join on a constant key: the right side is one row by
    construction, so nothing grows with the data and no pairs are formed.
    """
    right = one_row.withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(right), "_one").drop("_one")


def replicate(df: DataFrame, n: int, name: str) -> DataFrame:
    """Copy each row ``n`` times with ``name`` = 0..n-1 (a generator, no join)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def expand_small(df: DataFrame, small: DataFrame) -> DataFrame:
    """Pair each row of ``df`` with every row of ``small``, a table whose size
    is bounded by a parameter (a top-k list, the classes of a model).

    ``small`` is folded into one array row, attached with :func:`with_scalars`
    and exploded: a broadcast of k rows and a generator, never a join of two
    data-sized tables.
    """
    folded = small.agg(F.collect_list(F.struct(*small.columns)).alias("_small"))
    return with_scalars(df, folded).select(*df.columns, F.inline("_small"))
