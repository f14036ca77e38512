"""Document labels (headings): top labels, label matrix, per-label models,
metrics.

Per-label models are written as DataFrame aggregations where the model has a
closed form (multinomial naive Bayes, ANOVA F feature scores), so one job
fits every label at once; iterative learners use Spark ML estimators.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pubsift.operators.ordinals import expand_small, with_scalars
from pubsift.session import materialize

ID = "pmid"


def top_labels(labels: DataFrame, k: int = 20, label: str = "meshid") -> DataFrame:
    """The k most frequent labels (ties by label id): a top-k report."""
    counts = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), label).limit(k)


def label_matrix(docs: DataFrame, labels: DataFrame, top: DataFrame, label: str = "meshid",
                 id_col: str = ID) -> DataFrame:
    """(id, label, present) for every document and every top label.

    ``top`` is a top-k table (k rows by construction), so it is broadcast and
    replicated onto each document; presence is a left join on (id, label).
    """
    grid = expand_small(docs.select(id_col).distinct(), top.select(label))
    have = labels.select(id_col, label).distinct().withColumn("present", F.lit(True))
    return (grid.join(have, [id_col, label], "left")
            .withColumn("present", F.coalesce("present", F.lit(False))))


def label_counts(matrix: DataFrame, id_col: str = ID) -> DataFrame:
    """(id, n_labels) ordered by the number of top labels, most first."""
    return (matrix.groupBy(id_col).agg(F.count_if("present").alias("n_labels"))
            .orderBy(F.desc("n_labels"), id_col))


def attach_labels(docs: DataFrame, labels: DataFrame, label: str = "meshid",
                  id_col: str = ID) -> DataFrame:
    """Each document with its sorted label array."""
    per = labels.groupBy(id_col).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return docs.join(per, id_col, "left")


def label_names(labels: DataFrame, names: DataFrame, label: str = "meshid") -> DataFrame:
    """Readable names for label ids (left join; names table is small)."""
    return labels.join(names, label, "left")


def class_rows(matrix: DataFrame, label: str = "meshid", id_col: str = ID) -> DataFrame:
    """(id, label, y) with y = 1 if present."""
    return matrix.select(id_col, label, F.col("present").cast("int").alias("y"))


def naive_bayes_fit(bow: DataFrame, ys: DataFrame, smoothing: float = 1.0,
                    label: str = "meshid", id_col: str = ID,
                    materialize_input: bool = True) -> dict:
    """Multinomial naive Bayes, one binary model per label, all labels in one
    pass.  ``bow(id, token, n)`` holds the training documents, and ``ys(id,
    label, y)`` has every one of them for every label; for labels with
    documents or features of their own see :func:`naive_bayes_per_label`.

    The two classes of a label split the training documents, so class-0
    token counts are totals minus class-1 counts; only (label, token) pairs
    seen in positive documents are stored.  The rows of a :func:`labelled_bag`
    name their labels and are not joined with ``ys``.  Returns the model tables,
    each written once: ``tokens(token, n_t)``, ``positive(label, token, n_t1)`` and
    ``classes(label, n_pos, n_neg, tot1, tot0, v)``.
    """
    if smoothing <= 0:
        raise ValueError("smoothing must be positive")
    if materialize_input:  # read by the token totals and the positive counts
        bow = materialize(bow)
    tokens = materialize(bow.groupBy("token").agg(F.sum("n").alias("n_t")))
    if "labels" in bow.columns:
        seen = bow.select(F.explode("labels").alias(label), "token", "n")
    else:
        seen = bow.join(ys.where(F.col("y") == 1).select(id_col, label), id_col)
    positive = materialize(seen.groupBy(label, "token").agg(F.sum("n").alias("n_t1")))
    totals = tokens.agg(F.sum("n_t").alias("tot"), F.count(F.lit(1)).alias("v"))
    per_label = ys.groupBy(label).agg(F.count_if(F.col("y") == 1).alias("n_pos"),
                                      F.count_if(F.col("y") == 0).alias("n_neg"))
    tot1 = positive.groupBy(label).agg(F.sum("n_t1").alias("tot1"))
    classes = (with_scalars(per_label.join(tot1, label, "left"), totals)
               .withColumn("tot1", F.coalesce("tot1", F.lit(0)))
               .withColumn("tot0", F.col("tot") - F.col("tot1")).drop("tot"))
    return {"tokens": tokens, "positive": positive, "classes": materialize(classes),
            "smoothing": smoothing, "label": label}


def naive_bayes_predict(model: dict, bow: DataFrame, id_col: str = ID,
                        docs: DataFrame | None = None, frequent_bytes: int = 32 << 20) -> DataFrame:
    """(id, label, score1, score0, y_pred); y_pred = 1 when the positive class
    scores higher.  With ``docs`` every document has a row per label: one
    without a known token is scored by the priors.

    score_c = log prior_c + sum_t n_t log(count_tc + s) - N log(total_c + s V).
    Tokens a label never saw among positives contribute log(s) to class 1 and
    the label-free log(n_t + s) to class 0, so the label-free part is one sum per
    document.  A token's counts are one row with a column per label (labels come
    from a top-k list), a document's sums likewise: a document's tokens are not
    multiplied by the labels.  Frequent tokens (``frequent_bytes`` of them) are broadcast
    and summed where the documents' rows lie, and only rare ones are joined and
    sent to their documents.
    """
    s, label = float(model["smoothing"]), model["label"]
    ls = F.lit(math.log(s))
    names = [r[0] for r in model["classes"].where(F.col(label).isNotNull()).select(label).collect()]  # a top-k list
    counts = model["positive"].groupBy("token").agg(
        F.count(F.lit(1)).alias("_k"),
        *[F.max(F.when(F.col(label) == F.lit(x), F.col("n_t1"))).alias(f"_c{i}") for i, x in enumerate(names)])
    known = materialize(model["tokens"].join(counts, "token", "left"))     # read by the cut and both joins
    gains = [c for i in range(len(names)) for c in (
        (F.log(F.col(f"_c{i}") + s) - ls).alias(f"_p{i}"),
        (F.log(F.col("n_t") - F.col(f"_c{i}") + s) - F.log(F.col("n_t") + s)).alias(f"_q{i}"))]
    weights = known.select("token", "n_t", F.log(F.col("n_t") + s).alias("_b"), *gains)
    bow = bow.select(id_col, "token", "n")
    cut = _frequent_from(known.select(F.col("n_t").alias("n")), frequent_bytes // (16 * len(names) + 64))
    if cut is None:
        rows = bow.join(weights, "token")
    else:
        often = F.broadcast(known.where(F.col("n_t") >= cut).select("token"))
        rows = bow.join(F.broadcast(weights.where(F.col("n_t") >= cut)), "token").unionByName(
            bow.join(often, "token", "left_anti").join(weights.where(F.col("n_t") < cut), "token"))
    sums = rows.groupBy(id_col).agg(
        F.sum(F.col("n") * F.col("_b")).alias("_base"), F.sum("n").alias("_len"),
        *[F.sum(F.col("n") * F.col(f"_{c}{i}")).alias(f"_{c}{i}") for i in range(len(names)) for c in "pq"])
    listed = lambda c: F.array(*[f"_{c}{i}" for i in range(len(names))]).cast("array<double>").alias(f"_{c}")
    base = sums.select(id_col, "_base", "_len", listed("p"), listed("q"))
    if docs is not None:
        base = docs.select(id_col).distinct().join(base, id_col, "left").select(
            id_col, F.coalesce("_base", F.lit(0.0)).alias("_base"), F.coalesce("_len", F.lit(0)).alias("_len"), "_p", "_q")
    place = F.coalesce(*[F.when(F.col(label) == F.lit(x), i) for i, x in enumerate(names)], F.lit(-1))
    # classes: one row per label (labels come from a top-k list).
    g = expand_small(base, model["classes"].withColumn("_at", place)).withColumn(
        "_d1", F.get("_p", F.col("_at"))).withColumn("_d0", F.get("_q", F.col("_at")))
    n_docs = F.col("n_pos") + F.col("n_neg")
    score1 = (F.log(F.col("n_pos") / n_docs) + F.col("_len") * ls + F.coalesce("_d1", F.lit(0.0))
              - F.col("_len") * F.log(F.col("tot1") + s * F.col("v")))
    score0 = (F.log(F.col("n_neg") / n_docs) + F.col("_base") + F.coalesce("_d0", F.lit(0.0))
              - F.col("_len") * F.log(F.col("tot0") + s * F.col("v")))
    out = g.select(id_col, label, score1.alias("score1"), score0.alias("score0"))
    return out.withColumn(
        "y_pred", F.when(F.col("score0").isNull() | (F.col("score1") > F.col("score0")), 1)
        .otherwise(0))


def naive_bayes_per_label(train: DataFrame, ys: DataFrame, features: DataFrame, test: DataFrame,
                          docs: DataFrame, smoothing: float = 1.0, label: str = "meshid",
                          id_col: str = ID, digits: int = 9) -> DataFrame:
    """(id, label, y_pred) of multinomial naive Bayes models that have training
    documents and features of their own.

    ``ys(id, label, y)`` are a label's training documents, ``features(label,
    token)`` its features, ``train`` and ``test`` bags of words, ``docs`` the
    documents to predict.  A document without any feature of a label is scored
    by the priors; a tie (scores equal to ``digits`` digits) or a label without
    training documents gives 0.
    """
    if smoothing <= 0:
        raise ValueError("smoothing must be positive")
    features = materialize(features.select(label, "token"))  # read by three joins
    counted = materialize(
        train.join(features, "token").join(ys, [id_col, label]).groupBy(label, "token").agg(
            F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("_n1"),
            F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("_n0")))
    sizes = features.groupBy(label).agg(F.count(F.lit(1)).alias("_v"))
    totals = counted.groupBy(label).agg(F.sum("_n1").alias("_t1"), F.sum("_n0").alias("_t0"))
    classes = materialize(
        ys.groupBy(label).agg(F.count_if(F.col("y") == 1).alias("_d1"), F.count_if(F.col("y") == 0).alias("_d0"))
        .join(sizes, label, "left").join(totals, label, "left").na.fill(0, ["_v", "_t1", "_t0"]))
    s = F.lit(float(smoothing))
    gain = (F.log((F.coalesce("_n1", F.lit(0)) + s) / (F.col("_t1") + s * F.col("_v")))
            - F.log((F.coalesce("_n0", F.lit(0)) + s) / (F.col("_t0") + s * F.col("_v"))))
    weights = (features.join(counted, [label, "token"], "left").join(classes, label)
               .select(label, "token", gain.alias("_g")))
    seen = (test.join(weights, "token").groupBy(id_col, label)
            .agg(F.sum(F.col("n") * F.col("_g")).alias("_s")))
    grid = expand_small(docs.select(id_col).distinct(), classes.select(label, "_d1", "_d0"))
    diff = F.round(F.log(F.col("_d1") / F.col("_d0")) + F.coalesce("_s", F.lit(0.0)), digits)
    sure = F.when(F.col("_d0") == 0, F.col("_d1") > 0).otherwise((F.col("_d1") > 0) & (diff > 0))
    return (grid.join(seen, [id_col, label], "left")
            .select(id_col, label, F.when(sure, 1).otherwise(0).alias("y_pred")))


def classification_metrics(pred: DataFrame, label: str = "meshid",
                           truth: str = "y", guess: str = "y_pred") -> DataFrame:
    """Per label: accuracy, precision, recall, F1 and support (0/0 gives 0)."""
    t, p = F.col(truth) == 1, F.col(guess) == 1
    m = pred.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))) \
        .otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))) \
        .otherwise(0.0)
    return (m.withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.col("n"))
            .withColumn("precision", prec).withColumn("recall", rec)
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall")
                                     / (F.col("precision") + F.col("recall"))).otherwise(0.0))
            .withColumn("support", F.col("tp") + F.col("fn"))
            .select(label, "accuracy", "precision", "recall", "f1", "support"))


def anova_f(bow: DataFrame, ys: DataFrame, label: str = "meshid", id_col: str = ID,
            sampled: bool = False, group: str | None = None) -> DataFrame:
    """(label, token, f): one-way ANOVA F of each feature between the two
    classes of each label, counting documents without the token as zeros.

    ``ys`` has every document of ``bow`` for every label, unless ``sampled``:
    then a label has documents of its own, both classes are summed from them
    and only the tokens they hold are scored.  ``group``: a column of ``bow`` and
    ``ys``, if a label's documents are those of its group; the tokens are then
    summed once a group, and once a positive label, and not for every label.

    Sparse: class-0 sums are token totals minus class-1 sums, so only the
    positive documents are joined with the bag of words; the (label, token)
    grid is the vocabulary expanded over the label list (a top-k table)."""
    per_label = ys.groupBy(label).agg(F.count_if(F.col("y") == 1).alias("n1"),
                                      F.count_if(F.col("y") == 0).alias("n0"))
    if sampled and group:
        n = F.col("n").cast("double")
        # A row a document and group: its labels, how often it stands there, and for which it is positive.
        marks = ys.groupBy(group, id_col, label).agg(F.count(F.lit(1)).alias("_m"), F.sum("y").alias("_p")).groupBy(
            group, id_col, "_m").agg(F.collect_list(F.when(F.col("_p") > 0, F.struct(label, "_p"))).alias("_pos"))
        rows = bow.join(marks, [group, id_col])
        totals = rows.groupBy(group, "token").agg(F.sum(F.col("_m") * n).alias("_S"),
                                                  F.sum(F.col("_m") * n * n).alias("_Q"))
        pos = rows.select("token", n.alias("n"), F.inline("_pos")).groupBy(label, "token").agg(
            F.sum(F.col("_p") * F.col("n")).alias("s1"), F.sum(F.col("_p") * F.col("n") * F.col("n")).alias("q1"))
        x = totals.join(ys.select(group, label).distinct().join(per_label, label), group)
        return _f_of_sums(_less_positive(x.join(pos, [label, "token"], "left")), label)
    if sampled:
        one, n1 = F.col("y") == 1, F.col("n").cast("double")
        x = (bow.join(ys, id_col).groupBy(label, "token").agg(
            F.sum(F.when(one, n1).otherwise(0.0)).alias("s1"), F.sum(F.when(one, n1 * n1).otherwise(0.0)).alias("q1"),
            F.sum(F.when(one, 0.0).otherwise(n1)).alias("s0"), F.sum(F.when(one, 0.0).otherwise(n1 * n1)).alias("q0"))
            .join(per_label, label))
        return _f_of_sums(x, label)
    bow = materialize(bow)  # token totals and positive sums read it
    totals = bow.groupBy("token").agg(F.sum("n").cast("double").alias("_S"),
                                      F.sum(F.col("n") * F.col("n")).cast("double").alias("_Q"))
    pos = (bow.join(ys.where(F.col("y") == 1).select(id_col, label), id_col)
           .groupBy(label, "token").agg(F.sum("n").cast("double").alias("s1"),
                                        F.sum(F.col("n") * F.col("n")).cast("double").alias("q1")))
    return _f_of_totals(totals, pos, per_label, label)


def _f_of_totals(totals: DataFrame, pos: DataFrame, per_label: DataFrame, label: str) -> DataFrame:
    return _f_of_sums(_less_positive(expand_small(totals, per_label).join(pos, [label, "token"], "left")), label)


def _less_positive(x: DataFrame) -> DataFrame:
    """Sums of class 0: those of all documents less those of class 1."""
    return (x.withColumn("s1", F.coalesce("s1", F.lit(0.0))).withColumn("q1", F.coalesce("q1", F.lit(0.0)))
            .withColumn("s0", F.col("_S") - F.col("s1")).withColumn("q0", F.col("_Q") - F.col("q1")))


def labelled_bag(docs: DataFrame, labels: DataFrame, top: DataFrame, split: DataFrame, text=("title", "content"),
                 label: str = "meshid", id_col: str = ID) -> DataFrame:
    """(id, split, labels, token, n): a bag of words whose rows carry the document's
    split and its top labels.  Both are joined to the documents before the text is
    cut into tokens, so later steps filter and count without joining tokens.  Tokens
    are counted inside their row; only ids that repeat are grouped, so what a task
    holds does not grow with its documents."""
    from pubsift.functions.text import tokenize
    from pubsift.operators.text import counted_tokens

    marks = labels.join(top.select(label), label, "left_semi").groupBy(id_col).agg(
        F.array_sort(F.collect_set(label)).alias("labels"))
    about = split.select(id_col, "split").join(marks, id_col, "left").select(
        id_col, "split", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))
    again = materialize(docs.select(id_col).join(split.select(id_col), id_col).groupBy(id_col).agg(
        F.count(F.lit(1)).alias("_n")).where("_n > 1").select(id_col))
    rows = docs.select(id_col, *text).join(about, id_col)

    def counted(part):
        return counted_tokens(part, tokenize(F.concat_ws(" ", *text))).select(id_col, "token", "split", "labels", "n")

    once = counted(rows.join(again, id_col, "left_anti"))
    shared = counted(rows.join(again, id_col, "left_semi")).groupBy(id_col, "token", "split", "labels").agg(
        F.sum("n").alias("n"))
    return once.unionByName(shared)


def anova_f_labelled(bag: DataFrame, per_label: DataFrame, label: str = "meshid") -> DataFrame:
    """:func:`anova_f` of the rows of a :func:`labelled_bag`; ``per_label(label, n1,
    n0)`` counts its documents.  No join with the bag."""
    n = F.col("n").cast("double")
    totals = bag.groupBy("token").agg(F.sum(n).alias("_S"), F.sum(n * n).alias("_Q"))
    pos = (bag.select(F.explode("labels").alias(label), "token", "n").groupBy(label, "token")
           .agg(F.sum(n).alias("s1"), F.sum(n * n).alias("q1")))
    return _f_of_totals(totals, pos, per_label, label)


def _f_of_sums(x: DataFrame, label: str) -> DataFrame:
    """F from the sums of both classes; null for a label with one class."""
    x = x.withColumn("n0", F.nullif("n0", F.lit(0))).withColumn("n1", F.nullif("n1", F.lit(0)))
    n = F.col("n0") + F.col("n1")
    grand = (F.col("s0") + F.col("s1")) / n
    ssb = (F.col("n1") * F.pow(F.col("s1") / F.col("n1") - grand, 2)
           + F.col("n0") * F.pow(F.col("s0") / F.col("n0") - grand, 2))
    ssw = (F.col("q1") - F.col("s1") * F.col("s1") / F.col("n1")
           + F.col("q0") - F.col("s0") * F.col("s0") / F.col("n0"))
    return x.select(label, "token",
                    F.when(ssw > 0, ssb / (ssw / (n - 2))).alias("f"))


def select_k_best(scores: DataFrame, k: int = 100, label: str = "meshid") -> DataFrame:
    """Top k features per label by F (ties by token), salted so a label's
    whole vocabulary never sits in one task."""
    from pubsift.operators.embeddings import top_k_per_group

    return top_k_per_group(scores, label, [F.desc_nulls_last("f"), F.asc("token")], k,
                           "token").drop("rank")


def rebalance_undersample(ys: DataFrame, seed: str = "42", label: str = "meshid",
                          id_col: str = ID) -> DataFrame:
    """Equal class sizes per label: the majority keeps its first
    min(n0, n1) rows in md5(seed || id) order."""
    from pubsift.operators.corpus import group_ordinal

    keyed = (ys.withColumn("_grp", F.concat_ws(":", F.col(label), F.col("y").cast("string")))
             .withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))))
    ordered = group_ordinal(keyed, "_grp", ["_h", id_col], "_o")
    sizes = ys.groupBy(label, "y").agg(F.count(F.lit(1)).alias("_n")) \
        .groupBy(label).agg(F.min("_n").alias("_keep"))
    return (ordered.join(sizes, label).where(F.col("_o") <= F.col("_keep"))
            .select(id_col, label, "y"))


def _frequent_from(counts: DataFrame, most: int) -> int | None:
    """The least ``n`` such that at most ``most`` rows of ``counts(n)`` have that many
    or more; None if there is none.  Few distinct counts occur, so they are read here."""
    cut, rows = None, 0
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("n")).collect():
        rows += r["rows"]
        if rows > most:
            break
        cut = r["n"]
    return cut


def tfidf_word_vectors(weights: DataFrame, vectors: DataFrame, id_col: str = ID,
                       token: str = "token", weight: str = "tfidf", frequent_bytes: int = 32 << 20) -> DataFrame:
    """(id, dim, value): tf-idf weighted mean of the word vectors of each
    document (words without a vector are skipped).

    The vectors of the words that most documents hold are broadcast (``frequent_bytes``
    of them) and summed where the documents' rows lie; those of the many rare words
    are joined and sent to their few documents, as whole vectors.  A document's sums
    are one row with a column per dimension."""
    vectors = vectors.select(F.col("word").alias(token), "vector")
    weights = materialize(weights.select(id_col, token, weight))    # read by the counts and both joins
    width = vectors.agg(F.max(F.size("vector"))).first()[0] or 0    # the vectors' length
    counts = materialize(weights.groupBy(token).agg(F.count(F.lit(1)).alias("n")))
    cut = _frequent_from(counts, frequent_bytes // (4 * width + 64))
    if cut is None:
        rows = weights.join(vectors, token).repartition(id_col)
    else:
        often = counts.where(F.col("n") >= cut).select(token)
        here = weights.join(F.broadcast(vectors.join(often, token, "left_semi")), token)
        rare = weights.join(F.broadcast(often), token, "left_anti").join(vectors.join(often, token, "left_anti"), token)
        rows = here.unionByName(rare.repartition(id_col))
    sums = rows.groupBy(id_col).agg(
        F.sum(weight).alias("_tw"), F.max(F.size("vector")).alias("_dims"),
        *[F.sum(F.col(weight) * F.get("vector", F.lit(i))).alias(f"_s{i}") for i in range(width)])
    listed = F.array(*[f"_s{i}" for i in range(width)]).cast("array<double>")
    return (sums.select(id_col, "_tw", F.posexplode(F.slice(listed, F.lit(1), F.greatest(F.col("_dims"), F.lit(0))))
                        .alias("dim", "_s"))
            .select(id_col, "dim", (F.col("_s") / F.col("_tw")).alias("value")))
