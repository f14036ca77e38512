"""Term dictionaries: alias lists, concept ids, lookups.

A dictionary row is ``(tid, cid, symbol, alias, ...)``: one row per alias,
``tid`` a 0-based global ordinal of the exploded rows, ``cid`` the tid of the
concept's first row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubsift.functions.text import alias_list
from pubsift.operators.ordinals import global_ordinal


def gene_alias_lists(names: DataFrame, sep: str = r"\|") -> DataFrame:
    """(hgnc_id, symbol, aliases): [symbol, name] + the split alias field."""
    return names.select("hgnc_id", "symbol",
                        alias_list("symbol", "name", "alias_symbol", sep).alias("aliases"))


def concept_ids(lists: DataFrame, key: str = "hgnc_id") -> DataFrame:
    """Explode alias lists: tid = 0-based position over (key, alias position);
    cid = the smallest tid of the concept (symbol)."""
    ex = lists.select(key, "symbol", F.posexplode("aliases").alias("_p", "alias"))
    t = global_ordinal(ex, [key, "_p"], "tid", start=0)
    first = t.groupBy("symbol").agg(F.min("tid").alias("cid"))
    return t.join(first, "symbol").select("tid", "cid", "symbol", "alias", key)


def aliases_of(dictionary: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """(symbol, aliases): sorted distinct aliases of each requested symbol
    (of every symbol when ``symbols`` is None)."""
    d = dictionary if symbols is None else dictionary.where(F.col("symbol").isin(symbols))
    return (d.groupBy("symbol")
            .agg(F.array_sort(F.collect_set("alias")).alias("aliases")))


def attach_aliases_by_symbol(ids: DataFrame, lists: DataFrame) -> DataFrame:
    """Id table left-joined to the exploded aliases of its symbol."""
    ex = lists.select("symbol", F.explode("aliases").alias("alias"))
    return ids.join(ex, "symbol", "left")


def filter_in_set(df: DataFrame, values: DataFrame, col: str = "symbol",
                  value_col: str = "value", casefold: bool = True) -> DataFrame:
    """Rows whose ``col`` is in the ``values`` table (left semi join)."""
    key = F.lower(F.col(col)) if casefold else F.col(col)
    v = values.select((F.lower(value_col) if casefold else F.col(value_col)).alias("_v")).distinct()
    return df.join(v, key == F.col("_v"), "left_semi")


def rename_select(df: DataFrame, mapping: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """Rename columns (old -> new) and keep a subset (new names)."""
    out = df.withColumnsRenamed(mapping)
    return out.select(*keep) if keep else out
