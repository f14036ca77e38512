"""Statistics over tables: rank correlation, FDR, ANOVA, spreads, best rows.

Test statistics are DataFrame aggregates; only their p-values (an
incomplete beta function) run in a vectorised pandas UDF, on the few result
rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pubsift.operators.ordinals import global_ordinal, running_sums, with_scalars


def average_rank(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Average rank (ties share the mean of their positions) of ``value``
    inside ``group``: first position of the tie + (ties - 1) / 2.

    Positions come from a distributed ordinal over (group, value) — not a
    window over the group, which would put a whole vocabulary in one task —
    and ties are an aggregate over (group, value) joined back."""
    from pubsift.operators.corpus import group_ordinal

    keyed = df.withColumn("_rid", F.monotonically_increasing_id())
    pos = group_ordinal(keyed.select(group, value, "_rid"), group, [value, "_rid"], "_pos")
    ties = pos.groupBy(group, value).agg(F.min("_pos").alias("_first"),
                                         F.count(F.lit(1)).alias("_ties"))
    ranked = ties.select(group, value, (F.col("_first") + (F.col("_ties") - 1) / 2.0).alias(name))
    return df.join(ranked, [group, value])


def rank_correlation(sims_a: DataFrame, sims_b: DataFrame) -> DataFrame:
    """(target, n, rho): Spearman correlation per target between its
    similarities in two models over their common words."""
    j = (sims_a.select("target", "word", F.col("similarity").alias("sa"))
         .join(sims_b.select("target", "word", F.col("similarity").alias("sb")),
               ["target", "word"]))
    j = average_rank(average_rank(j, "target", "sa", "ra"), "target", "sb", "rb")
    return j.groupBy("target").agg(F.count(F.lit(1)).alias("n"),
                                   F.corr("ra", "rb").alias("rho"))


# ---- p-values: regularised incomplete beta (continued fraction, vectorised)
def _betacf(a, b, x, iters: int = 200):
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        h = h * d * c
    return h


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b) for arrays."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    a, b, x = np.broadcast_arrays(a, b, x)
    lbeta = np.vectorize(lambda p, q: math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q))(a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(np.clip(x, 1e-300, 1)) + b * np.log(np.clip(1 - x, 1e-300, 1))
                       - lbeta)
        direct = front * _betacf(a, b, x) / a
        flipped = 1 - front * _betacf(b, a, 1 - x) / b
    out = np.where(x < (a + 1) / (a + b + 2), direct, flipped)
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))
    return out


def t_test_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    t, df = t.astype(float).to_numpy(), df.astype(float).to_numpy()
    x = df / (df + t * t)
    return pd.Series(betainc(df / 2, 0.5, x))


def f_test_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail p of Fisher's F."""
    f, d1, d2 = (s.astype(float).to_numpy() for s in (f, d1, d2))
    x = d2 / (d2 + d1 * f)
    return pd.Series(betainc(d2 / 2, d1 / 2, x))


def _t_p_udf():
    @F.pandas_udf(DoubleType())
    def t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
        return t_test_p(t, dof)

    return t_p


def _f_p_udf():
    @F.pandas_udf(DoubleType())
    def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return f_test_p(f, d1, d2)

    return f_p


def correlation_p(corr: DataFrame, r: str = "rho", n: str = "n") -> DataFrame:
    """Add p of H0: no correlation, via t = r sqrt((n-2)/(1-r^2))."""
    t = F.col(r) * F.sqrt((F.col(n) - 2) / F.greatest(1 - F.col(r) * F.col(r), F.lit(1e-300)))
    return corr.withColumn("p", F.when(F.col(n) > 2, _t_p_udf()(t, F.col(n) - 2)))


def fdr_adjust(df: DataFrame, p: str = "p", key: str = "target", name: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg: fdr_i = min(1, min over j >= i of p_j n / j), with
    j the position in ascending (p, key) order.  Ordinals and the running
    minimum are distributed (no single-task window)."""
    ranked = global_ordinal(df, [p, key], "_j")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    ranked = with_scalars(ranked, n).withColumn("_v", F.col(p) * F.col("_n") / F.col("_j"))
    tail_min = running_sums(ranked, [F.desc("_j")], {"_m": F.col("_v")}, how="min")
    return tail_min.withColumn(name, F.least(F.lit(1.0), F.col("_m"))).drop("_j", "_n", "_v", "_m")


def significance_filter(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Rows with p < alpha, ordered by p."""
    return df.where(F.col(p) < alpha).orderBy(p)


def similarity_filter(df: DataFrame, col: str = "similarity", cut: float = 0.5) -> DataFrame:
    """Rows with |similarity| >= cut."""
    return df.where(F.abs(F.col(col)) >= cut)


def group_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: n, mean and population variance."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
                                 F.var_pop(value).alias("var_pop"))


def anova_oneway(df: DataFrame, group: str, value: str, with_p: bool = False) -> DataFrame:
    """One row: k groups, N rows, F = (SSB / (k-1)) / (SSW / (N-k)) [and p]."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"),
                              F.sum(F.col(value) * F.col(value)).alias("_q"))
    tot = g.agg(F.count(F.lit(1)).alias("k"), F.sum("_n").alias("N"),
                F.sum("_s").alias("_S"), F.sum("_q").alias("_Q"),
                F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("_B"))
    ssb = F.col("_B") - F.col("_S") * F.col("_S") / F.col("N")
    ssw = F.col("_Q") - F.col("_B")
    out = tot.select("k", "N", ((ssb / (F.col("k") - 1)) / (ssw / (F.col("N") - F.col("k"))))
                     .alias("F"))
    if with_p:
        out = out.withColumn("p", _f_p_udf()(F.col("F"), F.col("k") - 1, F.col("N") - F.col("k")))
    return out


def best_params(results: DataFrame, group: str, score: str, params: list[str]) -> DataFrame:
    """Per group, the parameter row with the highest score (ties: the
    largest parameters); a partial aggregate, so no group lands in one task."""
    best = results.groupBy(group).agg(
        F.max(F.struct(F.col(score).alias("_sc"), *[F.col(p) for p in params])).alias("_b"))
    return best.select(group, F.col("_b._sc").alias(score),
                       *[F.col(f"_b.{p}").alias(p) for p in params])


def score_spread(results: DataFrame, group: str, score: str, vary: str,
                 fixed: list[str]) -> DataFrame:
    """Std (population) of scores across ``vary`` with all ``fixed``
    parameters at the values of each group's best row."""
    best = best_params(results, group, score, [vary] + fixed).select(
        group, *[F.col(p).alias(f"_best_{p}") for p in fixed])
    cond = [F.col(p) == F.col(f"_best_{p}") for p in fixed]
    j = results.join(best, group)
    for c in cond:
        j = j.where(c)
    return j.groupBy(group).agg(F.stddev_pop(score).alias("spread"),
                                F.count(F.lit(1)).alias("n"))
