"""Word embeddings: similarity, neighbours, analogies, clusters, projections,
graphs.

Vectors are ``(word, vector array<float>)`` tables.  Similarities are
computed with array expressions (``zip_with`` + ``aggregate``) inside
whole-stage codegen; query words come from a caller-supplied, bounded list and
are expanded onto the vocabulary with a generator, so no vocabulary is ever
joined with itself.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pubsift.functions.text import cosine
from pubsift.operators.ordinals import expand_small, global_ordinal, with_scalars
from pubsift.session import materialize

SALT_BUCKETS = 64
# Of a correlation block: rows, numbers held, and blocks made of fewer rows so that tasks share the work.
BLOCK_ROWS, BLOCK_NUMBERS, LEAST_BLOCKS, TILE_ROWS = 16_384, 1 << 21, 8, 1024


def pairwise_similarity(targets: DataFrame, vectors: DataFrame, model: str | None = None) -> DataFrame:
    """(target, word, similarity): cosine of each target word against every
    word of ``vectors``.  ``targets(word)`` is a bounded query list."""
    t = (targets.select(F.col("word").alias("target")).distinct()
         .join(vectors.select(F.col("word").alias("target"), F.col("vector").alias("_tv")),
               "target"))
    out = expand_small(vectors.select("word", "vector"), t).select(
        "target", "word", cosine("_tv", "vector").alias("similarity"))
    if model is not None:
        out = out.withColumn("model", F.lit(model))
    return out


def top_k_per_group(df: DataFrame, group: str, order, k: int, item: str,
                    buckets: int = SALT_BUCKETS) -> DataFrame:
    """Top k rows per group in two phases: first inside (group, hash(item) %
    buckets), then over the at most k * buckets survivors of each group.  A
    group holding a third of all rows is thus split over ``buckets`` tasks."""
    salted = df.withColumn("_b", F.pmod(F.xxhash64(item), F.lit(buckets)))
    w1 = Window.partitionBy(group, "_b").orderBy(*order)
    first = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
    w2 = Window.partitionBy(group).orderBy(*order)
    return (first.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)
            .drop("_b", "_r"))


def nearest_words(sims: DataFrame, k: int = 10, exclude_self: bool = True) -> DataFrame:
    """k most similar words per target (ties by word)."""
    if exclude_self:
        sims = sims.where(F.col("word") != F.col("target"))
    return top_k_per_group(sims, "target", [F.desc("similarity"), F.asc("word")], k, "word")


def vector_of(vectors: DataFrame, words_signs: dict[str, float], dim: int) -> DataFrame:
    """One row ``(vector)``: the signed sum of a few words' vectors."""
    sel = vectors.where(F.col("word").isin(list(words_signs)))
    sign = F.create_map(*[x for w, s in words_signs.items() for x in (F.lit(w), F.lit(float(s)))])
    parts = sel.select(F.posexplode("vector").alias("dim", "x"),
                       F.element_at(sign, F.col("word")).alias("_s"))
    per_dim = parts.groupBy("dim").agg(F.sum(F.col("x") * F.col("_s")).alias("x"))
    return per_dim.agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("_v")) \
        .select(F.transform("_v", lambda e: e["x"]).alias("query_vector"))


def nearest_to_vector(vectors: DataFrame, query: DataFrame, k: int = 10,
                      exclude=()) -> DataFrame:
    """k words most similar to a one-row ``query(query_vector)``: a top-k report."""
    s = with_scalars(vectors, query).select(
        "word", cosine("query_vector", "vector").alias("similarity"))
    if exclude:
        s = s.where(~F.col("word").isin(list(exclude)))
    return s.orderBy(F.desc("similarity"), "word").limit(k)


def analogy(vectors: DataFrame, ref: str, minus: str, plus: str, k: int = 10,
            dim: int = 64) -> DataFrame:
    """Nearest words to ref - minus + plus (the three words excluded)."""
    q = vector_of(vectors, {ref: 1.0, minus: -1.0, plus: 1.0}, dim)
    return nearest_to_vector(vectors, q, k, exclude=(ref, minus, plus))


def common_vocabulary(a: DataFrame, b: DataFrame, casefold: bool = False,
                      top_n: int | None = None, order_col: str | None = None) -> DataFrame:
    """Words present in both models (optionally case-folded, optionally only
    the first ``top_n`` of ``b`` by ``order_col``)."""
    key = (lambda c: F.lower(c)) if casefold else (lambda c: F.col(c))
    bb = b
    if top_n is not None:
        bb = b.orderBy(order_col or "word").limit(top_n)
    return (a.select(key("word").alias("word"), F.col("vector").alias("vector_a"))
            .join(bb.select(key("word").alias("word"), F.col("vector").alias("vector_b")), "word"))


def vocab_substring(vectors: DataFrame, substring: str) -> DataFrame:
    """Words containing ``substring`` (case-folded)."""
    return vectors.where(F.lower("word").contains(substring.lower())).select("word")


def top_dims_by_variance(vectors: DataFrame, n: int = 2) -> DataFrame:
    """The n vector dimensions with the largest sample variance."""
    d = vectors.select(F.posexplode("vector").alias("dim", "x"))
    v = d.groupBy("dim").agg(F.var_samp(F.col("x").cast("double")).alias("variance"))
    return v.orderBy(F.desc("variance"), "dim").limit(n)


def polar_layout(df: DataFrame, value: str, order) -> DataFrame:
    """radius = 1 - x if x > 0 else 1 + x; angle = 2 pi * position / n in
    ``order`` (positions from a distributed ordinal)."""
    o = global_ordinal(df, order, "_pos", start=0)
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    o = with_scalars(o, n)
    return (o.withColumn("radius", F.when(F.col(value) > 0, 1 - F.col(value))
                         .otherwise(1 + F.col(value)))
            .withColumn("angle", 2 * math.pi * F.col("_pos") / F.col("_n"))
            .drop("_pos", "_n"))


def gene_disease_map(vectors: DataFrame, genes: DataFrame, disease: str, groups: int = 50, seed: int = 42) -> DataFrame:
    """(gene, similarity, radius, group_pos, angle) of the genes in the vocabulary.

    Genes of one group stand side by side: the order is that of the leaves of a
    bisecting k-means tree over the genes' vectors (Spark ML numbers them from left
    to right), then the similarity to the disease word.  ``genes(gene)`` match a
    word in lower case; angle = position * (2 pi - 1) / n + 0.5."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    known = materialize(vectors.join(genes.select("gene", F.lower("gene").alias("word")).distinct(), "word").select(
        "gene", "word", "vector", array_to_vector(F.col("vector").cast("array<double>")).alias("features")))
    target = vectors.where(F.col("word") == disease).select(F.lit(disease).alias("word"))
    near = pairwise_similarity(target, known.select("word", "vector").unionByName(
        vectors.where(F.col("word") == disease).select("word", "vector")).dropDuplicates(["word"]))
    model = BisectingKMeans(k=groups, seed=seed, predictionCol="group").fit(known)
    rows = model.transform(known).select("gene", "word", "group").join(near.select("word", "similarity"), "word")
    placed = global_ordinal(rows, ["group", "similarity", "gene"], "group_pos", start=0)
    placed = with_scalars(placed, rows.agg(F.count(F.lit(1)).alias("_n")))
    return placed.select(
        "gene", "similarity",
        F.when(F.col("similarity") > 0, 1 - F.col("similarity")).otherwise(1 + F.col("similarity")).alias("radius"),
        "group", "group_pos", (F.col("group_pos") * (2 * math.pi - 1) / F.col("_n") + 0.5).alias("angle"))


def cluster_counts(postings: DataFrame, clusters: DataFrame, id_col: str = "pmid") -> DataFrame:
    """(id, label, n): the tokens of each cluster in each document.  ``postings`` are
    tokens, or counted tokens with ``n``; they are counted before they meet their
    clusters, so a frequent word is one row a document."""
    words = postings.select(id_col, F.col("token").alias("word"), F.col("n").alias("_k")) if "n" in postings.columns \
        else postings.groupBy(id_col, F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("_k"))
    return words.join(clusters, "word").groupBy(id_col, "label").agg(F.sum("_k").alias("n"))


def idcf(postings: DataFrame, clusters: DataFrame, id_col: str = "pmid", counts: DataFrame | None = None) -> DataFrame:
    """(label, idcf): 1 / number of distinct documents containing any word of
    the cluster (``counts``: their :func:`cluster_counts`, if they are at hand)."""
    counts = cluster_counts(postings, clusters, id_col) if counts is None else counts
    return (counts.groupBy("label").agg(F.count(id_col).alias("n_docs"))      # a row a document and label
            .select("label", (1.0 / F.col("n_docs")).alias("idcf")))


def cluster_profile(postings: DataFrame, clusters: DataFrame, weights: DataFrame | None,
                    labels: DataFrame, id_col: str = "pmid", normalise: bool = False,
                    docs: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(id, label, value) for every document and every cluster label: token
    count per cluster times idcf (``weights``), or the counts normalised to
    sum 1 (``normalise``); zeros for clusters a document does not touch.
    ``labels`` is the cluster list (k rows), expanded onto each document; with
    ``docs`` a document without tokens has zeros.  ``counts`` are the
    :func:`cluster_counts`, if they are at hand."""
    counts = cluster_counts(postings, clusters, id_col) if counts is None else counts
    grid = expand_small((postings if docs is None else docs).select(id_col).distinct(), labels.select("label"))
    g = grid.join(counts, [id_col, "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if normalise:
        tot = counts.groupBy(id_col).agg(F.sum("n").alias("_t"))
        return (g.join(tot, id_col, "left")
                .select(id_col, "label",
                        F.coalesce(F.col("n") / F.col("_t"), F.lit(0.0)).alias("value")))
    return (g.join(weights, "label", "left")
            .select(id_col, "label", (F.col("n") * F.coalesce("idcf", F.lit(0.0))).alias("value")))


def mean_vector_per_cluster(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """(label, dim, mean): element-wise mean vector of each cluster."""
    v = vectors.join(clusters, "word").select("label", F.posexplode("vector").alias("dim", "x"))
    return v.groupBy("label", "dim").agg(F.avg("x").alias("mean"))


# ------------------------------------------------------------------ projection
def _moments(common: DataFrame):
    """Sum over the common words of the outer product of (1, x, y): one matrix a
    task, added up by a few tasks, then by one.  Its size is that of the vectors."""
    import numpy as np
    import pyarrow as pa

    def packed(total) -> pa.RecordBatch:
        values = [] if total is None else [total.tobytes()]
        return pa.RecordBatch.from_pydict({"m": pa.array(values, pa.binary())})

    def each(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x, y = (np.array(batch.column(c).to_pylist(), float) for c in ("x", "y"))
                z = np.hstack([np.ones((len(x), 1)), x, y])
                total = z.T @ z if total is None else total + z.T @ z
        yield packed(total)

    def add(batches):
        total = None
        for batch in batches:
            for m in batch.column("m"):
                part = np.frombuffer(m.as_py())
                total = part if total is None else total + part
        yield packed(total)

    pairs = common.select(F.col("vector_a").cast("array<double>").alias("x"),
                          F.col("vector_b").cast("array<double>").alias("y"))
    parts = pairs.mapInArrow(each, "m binary")
    for tasks in (32, 1):
        parts = parts.repartition(tasks).mapInArrow(add, "m binary")
    row = parts.first()
    if row is None:
        raise ValueError("the models have no word in common")
    flat = np.frombuffer(row["m"])
    return flat.reshape(math.isqrt(len(flat)), -1)


def _cross_moments(common: DataFrame):
    """Means of both sides, cross-covariance and variance (numpy, dim x dim)."""
    import numpy as np

    total = _moments(common)
    dim, n = (len(total) - 1) // 2, total[0, 0]
    ma, mb = total[0, 1:dim + 1] / n, total[0, dim + 1:] / n
    cov = total[1:dim + 1, dim + 1:] / n - np.outer(ma, mb)
    var_a = float(np.trace(total[1:dim + 1, 1:dim + 1]) / n - ma @ ma)
    return ma, mb, cov, var_a, int(n)


def linear_projection(a: DataFrame, b: DataFrame) -> dict:
    """Least-squares linear map y ~ M x + t from model a to model b over their
    common words, from the normal equations of the centred moments (the shortest
    solution where the words do not determine it).  Same keys as
    :func:`embedding_projection`; ``rotation`` holds M."""
    import numpy as np

    total = _moments(common_vocabulary(a, b))
    dim, n = (len(total) - 1) // 2, total[0, 0]
    ma, mb = total[0, 1:dim + 1] / n, total[0, dim + 1:] / n
    gram = total[1:dim + 1, 1:dim + 1] / n - np.outer(ma, ma)
    cross = total[1:dim + 1, dim + 1:] / n - np.outer(ma, mb)
    m = np.linalg.lstsq(gram, cross, rcond=1e-12)[0].T
    return {"rotation": m, "scale": 1.0, "shift": mb - m @ ma, "n": int(n)}


def embedding_projection(a: DataFrame, b: DataFrame) -> dict:
    """Similarity transform y ~ scale * R x + t from model a to model b over
    their common words (orthogonal Procrustes with scaling).  The data are
    reduced to dim x dim moments by Spark; the SVD of that small matrix runs
    on the driver."""
    import numpy as np

    common = common_vocabulary(a, b)
    ma, mb, cov, var_a, n = _cross_moments(common)
    u, sig, vt = np.linalg.svd(cov.T)
    d = np.ones(len(sig))
    if np.linalg.det(u @ vt) < 0:
        d[-1] = -1
    rot = u @ np.diag(d) @ vt
    scale = float((sig * d).sum() / var_a) if var_a > 0 else 1.0
    shift = mb - scale * rot @ ma
    return {"rotation": rot, "scale": scale, "shift": shift, "n": n}


def apply_projection(vectors: DataFrame, model: dict) -> DataFrame:
    """Project every vector with a fitted model (the dim x dim matrix is a
    literal in the plan: its size is bounded by the vector size)."""
    rot, scale, shift = model["rotation"], model["scale"], model["shift"]
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rot])
    sh = F.array(*[F.lit(float(x)) for x in shift])
    out = F.transform(
        F.sequence(F.lit(0), F.lit(len(shift) - 1)),
        lambda i: F.lit(scale) * F.aggregate(
            F.zip_with(F.element_at(rows, i + 1), F.col("vector"),
                       lambda r, x: r * x.cast("double")),
            F.lit(0.0), lambda acc, z: acc + z) + F.element_at(sh, i + 1))
    return vectors.withColumn("vector", out)


def projection_quality(projected: DataFrame, target: DataFrame, control: DataFrame | None = None
                       ) -> DataFrame:
    """Mean and std of cosine distance between projected and target vectors
    over the common words (and over a control word set when given)."""
    def stats(df, name):
        j = (df.select("word", F.col("vector").alias("p"))
             .join(target.select("word", F.col("vector").alias("t")), "word"))
        d = j.select((1 - cosine("p", "t")).alias("dist"))
        return d.agg(F.lit(name).alias("set"), F.avg("dist").alias("mean_distance"),
                     F.stddev_pop("dist").alias("std_distance"), F.count(F.lit(1)).alias("n"))

    out = stats(projected, "reference")
    if control is not None:
        out = out.unionByName(stats(control, "control"))
    return out


# ------------------------------------------------------------------ graphs
def correlation_blocks(n_genes: int, n_samples: int) -> int:
    """Into how many blocks the genes are split; every gene is sent to that many groups.

    Up to ``LEAST_BLOCKS`` blocks of ``BLOCK_ROWS`` genes the number does not grow."""
    rows = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(1, n_samples)))
    return max(1, -(-n_genes // rows), min(LEAST_BLOCKS, -(-n_genes // 512)))


def correlation_edges(expr: DataFrame, threshold: float = 0.7, block_rows: int | None = None,
                      gene: str = "gene", sample: str = "sample", value: str = "value") -> DataFrame:
    """Gene pairs with Pearson correlation >= threshold (no self edges, each
    unordered pair once, gene_a < gene_b).

    Genes are z-normalised (mean 0, norm 1) so correlation is a dot product,
    and split into hash blocks of about ``block_rows`` genes (by default
    :func:`correlation_blocks`).  Every pair of
    blocks (i <= j) is one group: each gene row is copied to the groups of
    its block, and a pandas function multiplies the two block matrices with
    numpy, some rows at a time, and emits only the pairs at or above the threshold.  All pairs are
    scored (inherent to the operator) but never materialised as rows, and no
    group holds more than two blocks.  A pair is correlated over the samples that
    both genes have (a value is missing if its row or the value is); pairs with
    fewer than two common samples, or without variance over them, have no edge.
    """
    import numpy as np
    import pandas as pd

    expr = expr.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    stats = expr.groupBy(gene).agg(F.avg(value).alias("_mu"),
                                   F.sqrt(F.sum(F.col(value) * F.col(value))
                                          - F.count(F.lit(1)) * F.avg(value) * F.avg(value))
                                   .alias("_norm"))
    z = (expr.join(stats, gene).where(F.col("_norm") > 0)
         .select(gene, sample, ((F.col(value) - F.col("_mu")) / F.col("_norm")).alias("z")))
    # One list of all samples, the length of every gene's row.
    samples = z.agg(F.collect_set(sample).alias("_all"))
    vec = with_scalars(z.groupBy(gene).agg(F.collect_list(F.struct(F.col(sample).alias("k"), "z")).alias("_s")), samples)
    absent = F.transform(F.array_except("_all", F.col("_s.k")), lambda k: F.struct(k.alias("k"), F.lit(None).cast("double").alias("z")))
    vec = vec.select(F.col(gene).alias("gene"),
                     F.transform(F.array_sort(F.concat("_s", absent)), lambda e: e["z"]).alias("u"))
    vec = materialize(vec)
    n, width = vec.agg(F.count(F.lit(1)), F.max(F.size("u"))).first()  # two numbers: size the blocks
    blocks = correlation_blocks(n, width or 0) if block_rows is None else max(1, -(-n // block_rows))
    b = F.pmod(F.xxhash64("gene"), F.lit(blocks))
    partners = F.sequence(F.lit(0), F.lit(blocks - 1))
    rows = vec.withColumn("_b", b).select(
        "gene", "u", "_b",
        F.explode(F.transform(partners, lambda j: F.struct(F.least(F.col("_b"), j).alias("i"),
                                                           F.greatest(F.col("_b"), j).alias("j"))))
        .alias("_pair"))
    rows = rows.select("gene", "u", "_b", F.col("_pair.i").alias("_i"), F.col("_pair.j").alias("_j"))
    cut = float(threshold)

    def complete_pairs(x, y):
        """Correlations of the rows of x and y over the columns both have."""
        mx, my = np.isfinite(x), np.isfinite(y)
        if mx.all() and my.all():
            return x @ y.T                      # normalised rows
        x, y, mx, my = np.where(mx, x, 0.0), np.where(my, y, 0.0), mx.astype(float), my.astype(float)
        n, sx, sy = mx @ my.T, x @ my.T, mx @ y.T
        vx, vy = n * ((x * x) @ my.T) - sx * sx, n * (mx @ (y * y).T) - sy * sy
        sure = (n > 1) & (vx > 1e-12) & (vy > 1e-12)
        return np.where(sure, (n * (x @ y.T) - sx * sy) / np.sqrt(np.where(sure, vx * vy, 1.0)), -np.inf)

    def block_pair(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
        left = pdf[pdf["_b"] == i]
        right = pdf[pdf["_b"] == j]
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"gene_a": [], "gene_b": [], "correlation": []})
        x, y = (np.vstack(side["u"].to_numpy()).astype(float) for side in (left, right))
        ga = left["gene"].to_numpy()
        gb = right["gene"].to_numpy()
        found = []
        for at in range(0, len(x), TILE_ROWS):      # a tile of the product at a time
            c = complete_pairs(x[at:at + TILE_ROWS], y)
            ia, ib = np.nonzero(c >= cut)
            found.append((ga[at + ia], gb[ib], c[ia, ib]))
        a, bb, v = (np.concatenate(part) for part in zip(*found))
        if i == j:  # one block against itself: each unordered pair once
            keep = a < bb
            a, bb, v = a[keep], bb[keep], v[keep]
        lo, hi = np.minimum(a, bb), np.maximum(a, bb)
        return pd.DataFrame({"gene_a": lo, "gene_b": hi, "correlation": v})

    return rows.groupBy("_i", "_j").applyInPandas(
        block_pair, "gene_a string, gene_b string, correlation double")


# ------------------------------------------------------------------ Spark ML
def word2vec_tasks(spark) -> int:
    """Tasks that train word vectors side by side: more than there are cores do not
    run at once."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def word2vec(sentences: DataFrame, tokens: str = "tokens", size: int = 100,
             min_count: int = 5, window: int = 5, seed: int = 42, max_iter: int = 1,
             num_partitions: int | None = None):
    """Skip-gram word2vec on sentence token arrays (Spark ML); returns the
    model and its (word, vector array<float>) table.

    ``num_partitions`` tasks train side by side and their vectors are averaged
    after each pass (default: the session's shuffle partitions, at most one a core:
    every task hands on the vectors of all its words, so what is shuffled is tasks x
    vocabulary); more tasks need more passes.  The vocabulary's vectors fit the driver: that is Spark
    ML's model."""
    from pyspark.ml.feature import Word2Vec

    if num_partitions is None:
        num_partitions = word2vec_tasks(sentences.sparkSession)
    w2v = Word2Vec(vectorSize=size, minCount=min_count, windowSize=window, seed=seed,
                   inputCol=tokens, outputCol="_w2v", maxIter=max_iter, numPartitions=num_partitions)
    model = w2v.fit(sentences)
    vecs = model.getVectors().select("word", _vector_to_floats("vector").alias("vector"))
    return model, vecs


def _vector_to_floats(col: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(col), "float32")


def _to_ml_vector(col: str):
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.transform(F.col(col), lambda x: x.cast("double")))


def kmeans_words(vectors: DataFrame, k: int = 100, seed: int = 42, max_iter: int = 20):
    """(word, label) from k-means over word vectors (k-means|| init)."""
    from pyspark.ml.clustering import KMeans

    data = vectors.select("word", _to_ml_vector("vector").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, initMode="k-means||").fit(data)
    return model, model.transform(data).select("word", F.col("prediction").alias("label"))


def pca_words(vectors: DataFrame, max_dims: int = 50):
    """Reduce vectors to min(max_dims, n_words) dimensions when larger."""
    from pyspark.ml.feature import PCA

    dim = len(vectors.select("vector").first()[0])
    n = vectors.count()
    k = min(max_dims, n)
    if dim <= max_dims:
        return vectors
    data = vectors.select("word", _to_ml_vector("vector").alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="_pca").fit(data)
    return model.transform(data).select("word", _vector_to_floats("_pca").alias("vector"))
