"""Enrichment of associated terms at the top of a ranked list.

* ``null_rank_sums``: sums of n ranks drawn without replacement, for every
  n at once: each permutation orders the list by md5(seed, perm, symbol) and
  takes running sums.
* ``stratum_prefix_test``: for each date, the terms first seen by then,
  ordered by rank; the longest prefix whose rank sum stays significant.
* ``enrichment_score``: running in-set minus out-of-set fraction.
* ``enrichment_frontier``: the next terms of the ranked list whose added
  rank keeps the prefix significant (classic mode).
* ``discovery_curve``: generalised logistic growth fitted on a parameter
  grid; for fixed (B, M, v) the curve is linear in (A, K), so each grid point
  is solved exactly from a handful of sums.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pubsift.operators.ordinals import global_ordinal, replicate, running_sums, with_scalars
from pubsift.session import materialize


def clean_ranked(ranked: DataFrame, gene: str = "symbol", rank: str = "rank",
                 pos: str = "pos") -> DataFrame:
    """Ranked list without NULL genes and with only the first row of a gene."""
    best = (ranked.where(F.col(gene).isNotNull()).groupBy(gene)
            .agg(F.min(F.struct(pos, rank)).alias("_f")))
    return best.select(F.col(gene).alias("symbol"), F.col(f"_f.{rank}").alias("rank"),
                       F.col(f"_f.{pos}").alias("pos"))


def attach_rank(assoc: DataFrame, ranked: DataFrame, aggregate=None,
                gene: str = "symbol", rank: str = "rank", pos: str = "pos") -> DataFrame:
    """Left join each association to its gene's first rank in list order, or to
    ``aggregate`` over its ranks (the ranked table first loses NULL genes)."""
    aggregate = aggregate or (lambda r: F.min_by(r, pos))
    r = (ranked.where(F.col(gene).isNotNull()).groupBy(F.col(gene).alias("symbol"))
         .agg(aggregate(rank).alias("rank")))
    return assoc.join(r, "symbol", "left")


def first_mentions(assoc: DataFrame, id_col: str = "pmid") -> DataFrame:
    """(symbol, date, pmid): the earliest association of each symbol."""
    f = assoc.groupBy("symbol").agg(F.min(F.struct("date", id_col, "sent_pos")).alias("_f"))
    return f.select("symbol", F.col("_f.date").alias("date"), F.col(f"_f.{id_col}").alias(id_col))


def cumulative_discoveries(firsts: DataFrame) -> DataFrame:
    """(date, n_known): number of symbols first seen on or before each date."""
    per_day = firsts.groupBy("date").agg(F.count(F.lit(1)).alias("_new"))
    return running_sums(per_day, ["date"], {"n_known": F.col("_new")}).drop("_new")


def null_rank_sums(ranked: DataFrame, n_perms: int = 1000, seed: str = "42",
                   max_n: int | None = None) -> DataFrame:
    """(perm, n, null_sum): sum of the first n ranks of random permutation perm.

    Each row is replicated ``n_perms`` times by a generator (a parameter, not
    data); each permutation's running sum is a window over one permutation
    (one gene list), spread over tasks by perm.
    """
    keyed = replicate(ranked.select("symbol", "rank"), n_perms, "perm").withColumn(
        "_h", F.md5(F.concat_ws(":", F.lit(seed), F.col("perm").cast("string"), "symbol")))
    w = Window.partitionBy("perm").orderBy("_h", "symbol")
    out = (keyed.withColumn("n", F.row_number().over(w))
           .withColumn("null_sum", F.sum("rank").over(w.rowsBetween(Window.unboundedPreceding,
                                                                    Window.currentRow))))
    if max_n is not None:
        out = out.where(F.col("n") <= max_n)
    return out.select("perm", "n", "null_sum")


def null_table(nulls: DataFrame) -> DataFrame:
    """(n, sums): the sorted null sums per size; array length = number of perms."""
    return nulls.groupBy("n").agg(F.array_sort(F.collect_list("null_sum")).alias("sums"))


def _p_value(sums, observed, ascending: bool):
    hits = F.filter(sums, (lambda x: x <= observed) if ascending else (lambda x: x >= observed))
    return F.size(hits) / F.size(sums)


def is_ascending(ranked: DataFrame) -> DataFrame:
    """One row: true when rank never decreases in list (pos) order; positions may
    have gaps."""
    n = global_ordinal(ranked.select("pos", "rank"), ["pos", "rank"], "_n")
    nxt = n.select((F.col("_n") - 1).alias("_n"), F.col("rank").alias("_next"))
    d = n.join(nxt, "_n").select((F.col("_next") - F.col("rank")).alias("_d"))
    return d.agg(F.coalesce(F.min(F.col("_d") >= 0), F.lit(True)).alias("ascending"))


def stratum_ranks(firsts_ranked: DataFrame) -> DataFrame:
    """Range join: for each distinct first-mention date d, every symbol first
    seen on or before d.  The dates side is the distinct first dates (bounded
    by the calendar, broadcast)."""
    dates = firsts_ranked.select(F.col("date").alias("stratum_date")).distinct()
    return (firsts_ranked.join(F.broadcast(dates), F.col("date") <= F.col("stratum_date"))
            .select("stratum_date", "symbol", "date", "rank"))


def prefix_tests(firsts_ranked: DataFrame, nulls: DataFrame, ascending: bool = True) -> DataFrame:
    """Every prefix of every stratum (by rank, ties together) with its size,
    rank sum and p = share of null sums at least as extreme:
    (stratum_date, rank, size, ranksum, p)."""
    s = stratum_ranks(firsts_ranked.where(F.col("rank").isNotNull()))
    order = F.col("rank").asc() if ascending else F.col("rank").desc()
    tie = Window.partitionBy("stratum_date").orderBy(order).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    s = (s.withColumn("size", F.count(F.lit(1)).over(tie))
         .withColumn("ranksum", F.sum("rank").over(tie)))
    prefixes = s.select("stratum_date", "rank", "size", "ranksum").distinct()
    return null_p_values(prefixes, nulls, ascending)


def null_p_values(observed: DataFrame, nulls: DataFrame, ascending: bool = True) -> DataFrame:
    """Add p = share of null sums of the same size at least as extreme as
    ``ranksum`` (<= when ascending, >= otherwise).

    Observations and null sums of one size are sorted together (nulls before
    observations on ties) and a running count of null rows gives, for each
    observation, the number of null sums not beyond it — a window per size
    over N null rows plus that size's observations, with no per-row array
    scan."""
    key = [c for c in observed.columns]
    obs = observed.select(F.struct(*key).alias("_o"), F.col("size").alias("n"),
                          F.col("ranksum").cast("double").alias("_v"), F.lit(1).alias("_kind"))
    nul = nulls.select(F.lit(None).cast(obs.schema["_o"].dataType).alias("_o"), "n",
                       F.col("null_sum").cast("double").alias("_v"), F.lit(0).alias("_kind"))
    both = obs.unionByName(nul)
    order = [F.col("_v").asc(), F.col("_kind").asc()] if ascending else \
        [F.col("_v").desc(), F.col("_kind").asc()]
    w = Window.partitionBy("n").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("n")
    counted = (both.withColumn("_c", F.sum(1 - F.col("_kind")).over(w))
               .withColumn("_N", F.sum(1 - F.col("_kind")).over(total)))
    return (counted.where(F.col("_kind") == 1)
            .select(*[F.col(f"_o.{c}").alias(c) for c in key],
                    F.when(F.col("_N") > 0, F.col("_c") / F.col("_N")).alias("p")))


def stratum_prefix_test(firsts_ranked: DataFrame, nulls: DataFrame, alpha: float = 0.05,
                        ascending: bool = True) -> DataFrame:
    """Per stratum date: the largest prefix (by rank, ties together) whose rank
    sum is significant, before the first prefix that is not.

    Returns (stratum_date, size, ranksum, p, known_gene) for dates with a
    significant prefix; known_gene = the symbol at position ``size``.
    """
    order = F.col("rank").asc() if ascending else F.col("rank").desc()
    firsts_ranked = materialize(firsts_ranked)  # prefixes and the known gene read it
    tested = prefix_tests(firsts_ranked, nulls, ascending).withColumn(
        "fail", (F.col("p") > alpha).cast("int"))
    run = Window.partitionBy("stratum_date").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    passed = tested.withColumn("_failed", F.max("fail").over(run)).where("_failed = 0")
    best = (passed.groupBy("stratum_date")
            .agg(F.max(F.struct("size", "ranksum", "p")).alias("_b"))
            .select("stratum_date", F.col("_b.size").alias("size"),
                    F.col("_b.ranksum").alias("ranksum"), F.col("_b.p").alias("p")))
    # The known gene: position ``size`` in (rank, symbol) order inside the stratum.
    s = stratum_ranks(firsts_ranked.where(F.col("rank").isNotNull()))
    pos = Window.partitionBy("stratum_date").orderBy(order, F.col("symbol"))
    at = s.withColumn("_i", F.row_number().over(pos)).select(
        "stratum_date", "_i", F.col("symbol").alias("known_gene"))
    return best.join(at, (best.stratum_date == at.stratum_date) & (F.col("_i") == F.col("size"))) \
        .select(best.stratum_date, "size", "ranksum", "p", "known_gene")


def enrichment_frontier(prefix: DataFrame, ranked: DataFrame, nulls: DataFrame,
                        alpha: float = 0.05, ascending: bool = True) -> DataFrame:
    """Classic mode: after the stratum's known gene, walk down the ranked list;
    candidate j passes if ranksum + rank_j is still significant at size + 1.
    The frontier is the last candidate before the first failure (the known
    gene itself when the very next one fails, the list end if none fails).

    p <= alpha  <=>  at most m = floor(alpha * N) null sums are as extreme,
    i.e. ranksum + rank_j is beyond the (m+1)-th most extreme null sum.  So
    each stratum gets a rank threshold, and the first failure is the first
    list position after the known gene whose rank crosses it.
    """
    r = ranked.select("symbol", "rank", "pos")
    prefix = materialize(prefix)  # thresholds and the output read it
    nt = null_table(nulls)
    m = F.floor(F.lit(alpha) * F.size("sums")).cast("int")
    cut = (F.element_at("sums", m + 1) if ascending
           else F.element_at("sums", F.size("sums") - m))
    known = (prefix.join(r.select(F.col("symbol").alias("known_gene"), F.col("pos").alias("kpos")),
                         "known_gene")
             .join(nt.select((F.col("n") - 1).alias("size"), cut.alias("_cut")), "size", "left")
             .withColumn("_thr", F.col("_cut") - F.col("ranksum")))
    strata = known.select("stratum_date", "kpos", "_thr")
    fails = (r.join(F.broadcast(strata), (F.col("pos") > F.col("kpos"))
                    & ((F.col("rank") >= F.col("_thr")) if ascending
                       else (F.col("rank") <= F.col("_thr"))))
             .groupBy("stratum_date").agg(F.min("pos").alias("_ff")))
    last = r.agg(F.max("pos").alias("_last"))
    out = with_scalars(known.join(fails, "stratum_date", "left"), last)
    out = out.withColumn("_fpos", F.coalesce(F.col("_ff") - 1, F.col("_last")))
    return (out.join(r.select(F.col("pos").alias("_fpos"), F.col("symbol").alias("frontier_gene")),
                     "_fpos", "left")
            .select("stratum_date", "known_gene", "frontier_gene"))


def stratum_leading_edges(firsts_ranked: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per stratum date, the gene at the (first) highest enrichment score of the
    symbols seen by then: (stratum_date, edge_gene).

    The score rises only at members of the set, so only they are looked at: the
    c-th member, at place p of N, has c / n - (p - c) / (N - n), compared as the
    integer c * (N - n) - (p - c) * n.  With every gene in the set it is the last.
    """
    places = global_ordinal(ranked.select("symbol", "pos"), ["pos", "symbol"], "_p")
    members = stratum_ranks(firsts_ranked).select("stratum_date", "symbol").join(
        places.select("symbol", "_p"), "symbol")
    down = Window.partitionBy("stratum_date").orderBy("_p")
    scored = with_scalars(
        members.withColumn("_c", F.row_number().over(down))
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("stratum_date"))),
        places.agg(F.max("_p").alias("_all")))
    others = F.col("_all") - F.col("_n")
    score = F.when(others == 0, F.col("_c")).otherwise(
        F.col("_c") * others - (F.col("_p") - F.col("_c")) * F.col("_n"))
    return scored.groupBy("stratum_date").agg(
        F.max(F.struct(score.alias("_s"), (-F.col("_p")).alias("_m"), "symbol")).alias("_b")).select(
        "stratum_date", F.col("_b.symbol").alias("edge_gene"))


def enrichment_by_date(firsts_ranked: DataFrame, ranked: DataFrame, nulls: DataFrame, alpha: float = 0.05,
                       ascending: bool | None = None, use_leading_edge: bool = True) -> DataFrame:
    """(stratum_date, known_gene, frontier_gene) for every date of a first
    mention; both genes are null where no prefix is significant.

    The frontier is the leading edge of the genes known by then or, without
    ``use_leading_edge``, the last unknown gene that keeps the prefix
    significant (:func:`enrichment_frontier`).  ``ranked`` loses NULL and
    repeated genes first; unless given, the direction is the list's own."""
    ranked = materialize(clean_ranked(ranked))
    firsts_ranked = materialize(firsts_ranked)
    if ascending is None:
        ascending = is_ascending(ranked).first()[0]  # one row
    prefix = stratum_prefix_test(firsts_ranked, nulls, alpha, ascending)
    dates = firsts_ranked.select(F.col("date").alias("stratum_date")).distinct()
    if use_leading_edge:
        found = prefix.select("stratum_date", "known_gene").join(
            stratum_leading_edges(firsts_ranked, ranked), "stratum_date").withColumnRenamed(
            "edge_gene", "frontier_gene")
    else:
        found = enrichment_frontier(prefix, ranked, nulls, alpha, ascending)
    return dates.join(found, "stratum_date", "left")


def enrichment_score(ranked: DataFrame, geneset: DataFrame) -> DataFrame:
    """(symbol, pos, in_set, es): running in-set fraction minus running
    out-of-set fraction down the list (by pos).  Ends at 0."""
    gs = geneset.select("symbol").distinct().withColumn("in_set", F.lit(True))
    r = (ranked.select("symbol", "pos").join(gs, "symbol", "left")
         .withColumn("in_set", F.coalesce("in_set", F.lit(False))))
    totals = r.agg(F.count_if("in_set").alias("_ns"), F.count_if(~F.col("in_set")).alias("_no"))
    run = running_sums(r, ["pos"], {"_cs": F.col("in_set").cast("long"),
                                   "_co": (~F.col("in_set")).cast("long")})
    return (with_scalars(run, totals)
            .withColumn("es", F.col("_cs") / F.col("_ns") - F.col("_co") / F.col("_no"))
            .select("symbol", "pos", "in_set", "es"))


def leading_edge(scores: DataFrame) -> DataFrame:
    """The first position of the maximal enrichment score."""
    best = scores.agg(F.max("es").alias("_m"))
    top = scores.join(F.broadcast(best), F.col("es") == F.col("_m"))
    return top.agg(F.min(F.struct("pos", "symbol", "es")).alias("_b")).select(
        F.col("_b.symbol").alias("symbol"), F.col("_b.pos").alias("pos"), F.col("_b.es").alias("es"))


def year_fraction(df: DataFrame, date: str = "date", name: str = "t") -> DataFrame:
    """Epoch seconds normalised as (x - min) / max (this exact scaling is kept:
    the fitted curve parameters depend on it)."""
    x = F.unix_timestamp(F.col(date).cast("timestamp")).cast("double")
    stats = df.agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    return (with_scalars(df, stats)
            .withColumn(name, (x - F.col("_mn")) / F.col("_mx")).drop("_mn", "_mx"))


def logistic_grid(b_values, m_values, v_values) -> list[tuple[float, float, float]]:
    return [(float(b), float(m), float(v)) for b in b_values for m in m_values for v in v_values]


def logistic_fits(points: DataFrame, grid: list | None = None, t: str = "t",
                  y: str = "y") -> DataFrame:
    """Fit y = A + (K - A) / (1 + exp(-B (t - M)))^(1/v) (C = Q = 1) at
    every grid point: (B, M, v, A, K, sse).

    For each grid point (B, M, v), g(t) is fixed and y = A (1 - g) + K g is
    linear, so (A, K) and the squared error follow from sums over the points.
    The grid is a parameter list, generated onto every point; the points grow
    with the data and are only aggregated.
    """
    grid = grid if grid is not None else logistic_grid(**DEFAULT_GRID)
    grid_col = F.array(*[F.struct(F.lit(b).alias("B"), F.lit(m).alias("M"), F.lit(v).alias("v"))
                         for b, m, v in grid])
    g = F.pow(1 + F.exp(-F.col("B") * (F.col(t) - F.col("M"))), -1 / F.col("v"))
    u = 1 - g
    pts = points.select(F.col(t).alias(t), F.col(y).cast("double").alias("_y"))
    s = (pts.select("*", F.inline(grid_col))
         .withColumn("_g", g).withColumn("_u", u)
         .groupBy("B", "M", "v").agg(
             F.sum(F.col("_u") * F.col("_u")).alias("suu"),
             F.sum(F.col("_u") * F.col("_g")).alias("sug"),
             F.sum(F.col("_g") * F.col("_g")).alias("sgg"),
             F.sum(F.col("_u") * F.col("_y")).alias("suy"),
             F.sum(F.col("_g") * F.col("_y")).alias("sgy"),
             F.sum(F.col("_y") * F.col("_y")).alias("syy")))
    det = F.col("suu") * F.col("sgg") - F.col("sug") * F.col("sug")
    a = (F.col("suy") * F.col("sgg") - F.col("sgy") * F.col("sug")) / det
    k = (F.col("sgy") * F.col("suu") - F.col("suy") * F.col("sug")) / det
    fit = (s.where(F.abs(det) > 1e-12).withColumn("A", a).withColumn("K", k)
           .withColumn("sse", F.col("syy") - 2 * F.col("A") * F.col("suy")
                       - 2 * F.col("K") * F.col("sgy") + F.col("A") * F.col("A") * F.col("suu")
                       + 2 * F.col("A") * F.col("K") * F.col("sug")
                       + F.col("K") * F.col("K") * F.col("sgg")))
    return fit.select("B", "M", "v", "A", "K", "sse")


def discovery_curve(points: DataFrame, grid: list | None = None, t: str = "t",
                    y: str = "y") -> DataFrame:
    """The best grid fit of :func:`logistic_fits` with total = A + K."""
    fit = logistic_fits(points, grid, t, y)
    best = fit.agg(F.min(F.struct("sse", "B", "M", "v", "A", "K")).alias("_b"))
    return best.select(*[F.col(f"_b.{c}").alias(c) for c in ("A", "K", "B", "M", "v", "sse")],
                       (F.col("_b.A") + F.col("_b.K")).alias("total"))


# The least-squares weights (A, K, L) of two linked surges, from the sums of both
# segments: normal matrix [[p, q, 0], [q, r, s], [0, s, w]], right side (x, y, z).
SURGE_DET = "p * (r * w - s * s) - q * q * w"
SURGE_SOLUTION = {
    "A": "(x * (r * w - s * s) - q * (y * w - s * z)) / det",
    "K": "(p * (y * w - s * z) - x * q * w) / det",
    "L": "(p * (r * z - s * y) - q * q * z + x * q * s) / det",
}


def surge_fits(points: DataFrame, topic: str = "topic", t: str = "t", y: str = "y", grid: list | None = None,
               breaks: list[float] | None = None, seconds: list[tuple[float, float]] | None = None) -> DataFrame:
    """Two linked surges for every topic: before ``brk`` the curve of
    :func:`logistic_fits` from A to K, from ``brk`` on K + (L - K) / (1 +
    exp(-B2 (t - brk)))^(1/v2).

    One row per (topic, brk, B, M, v, B2, v2) with A, K, L (none below 0) and sse.
    For fixed grid values the curve is linear in A, K and L.  The first segment's
    sums for all break points are running sums over the intervals between break
    points, so a point is expanded over the first grid once, and over the break
    points before it times the second grid; everything after that has the size of
    the parameters times the number of topics.
    """
    grid = grid if grid is not None else logistic_grid(**DEFAULT_GRID)
    breaks = sorted(breaks if breaks is not None else DEFAULT_BREAKS)
    seconds = seconds if seconds is not None else DEFAULT_SECONDS
    pts = points.select(topic, F.col(t).cast("double").alias("_t"), F.col(y).cast("double").alias("_y"))

    def sums(rows, g, keys):
        u = 1 - g
        return rows.withColumn("_g", g).withColumn("_u", u).groupBy(*keys).agg(
            *[F.sum(a * b).alias(n) for n, a, b in (
                ("uu", F.col("_u"), F.col("_u")), ("ug", F.col("_u"), F.col("_g")), ("gg", F.col("_g"), F.col("_g")),
                ("uy", F.col("_u"), F.col("_y")), ("gy", F.col("_g"), F.col("_y")), ("yy", F.col("_y"), F.col("_y")))])

    cuts = F.array(*map(F.lit, breaks))
    first = F.array(*[F.struct(F.lit(b).alias("B"), F.lit(m).alias("M"), F.lit(v).alias("v")) for b, m, v in grid])
    second = F.array(*[F.struct(F.lit(float(b)).alias("B2"), F.lit(float(v)).alias("v2")) for b, v in seconds])
    interval = F.size(F.filter(cuts, lambda c: c <= F.col("_t")))       # breaks that the point lies behind
    parts = sums(pts.withColumn("_i", interval).select("*", F.inline(first)),
                 F.pow(1 + F.exp(-F.col("B") * (F.col("_t") - F.col("M"))), -1 / F.col("v")), [topic, "B", "M", "v", "_i"])
    # A point counts for every break above it: breaks number _i and on.
    after = parts.select("*", F.explode(F.sequence(F.col("_i"), F.lit(len(breaks)))).alias("_k")).where(
        F.col("_k") < len(breaks))
    left = after.groupBy(topic, "B", "M", "v", (F.col("_k") + 1).alias("_k")).agg(
        *[F.sum(n).alias(f"{n}1") for n in ("uu", "ug", "gg", "uy", "gy", "yy")])
    behind = pts.select("*", F.posexplode(F.filter(cuts, lambda c: c <= F.col("_t"))).alias("_k", "brk"))
    right = sums(behind.withColumn("_k", F.col("_k") + 1).select("*", F.inline(second)),
                 F.pow(1 + F.exp(-F.col("B2") * (F.col("_t") - F.col("brk"))), -1 / F.col("v2")),
                 [topic, "_k", "brk", "B2", "v2"])
    both = left.join(right, [topic, "_k"]).select(
        topic, "brk", "B", "M", "v", "B2", "v2", F.col("uu1").alias("p"), F.col("ug1").alias("q"),
        (F.col("gg1") + F.col("uu")).alias("r"), F.col("ug").alias("s"), F.col("gg").alias("w"), F.col("uy1").alias("x"),
        (F.col("gy1") + F.col("uy")).alias("y"), F.col("gy").alias("z"), (F.col("yy1") + F.col("yy")).alias("yy"))
    fit = both.withColumn("det", F.expr(SURGE_DET)).where(F.abs("det") > 1e-9)
    for name, solution in SURGE_SOLUTION.items():
        fit = fit.withColumn(name, F.expr(solution))
    return fit.where("A >= 0 and K >= 0 and L >= 0").withColumn("sse", F.expr("yy - A * x - K * y - L * z")).select(
        topic, "brk", "B", "M", "v", "B2", "v2", "A", "K", "L", "sse")


def surge_curve(points: DataFrame, topic: str = "topic", **options) -> DataFrame:
    """The best fit of :func:`surge_fits` of every topic, with total = A + K + L."""
    cols = ["brk", "B", "M", "v", "B2", "v2", "A", "K", "L", "sse"]
    best = surge_fits(points, topic, **options).groupBy(topic).agg(
        F.min(F.struct(F.round("sse", 4).alias("_r"), *cols)).alias("_b"))
    return best.select(topic, *[F.col(f"_b.{c}") for c in cols],
                       (F.col("_b.A") + F.col("_b.K") + F.col("_b.L")).alias("total"))


DEFAULT_BREAKS = [i / 20 for i in range(1, 20)]
DEFAULT_SECONDS = [(b, v) for b in (1, 2, 5, 10, 20, 50) for v in (0.5, 1, 2)]
DEFAULT_GRID = dict(
    b_values=[1, 2, 5, 10, 20, 50],
    m_values=[i / 10 for i in range(0, 11)],
    v_values=[0.5, 1, 2],
)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("math",)]
