"""Feature scores from a labelled bag equal those from joins."""

from places import SF_SMALL
from pyspark.sql import functions as F

from pubsift.operators import corpus as C
from pubsift.operators import labels as L
from pubsift.operators import text as X
from pubsift.sources import tables as T


def test_scores_equal_those_of_the_joined_bag(spark):
    arts, mesh = T.articles(spark, SF_SMALL), T.mesh(spark, SF_SMALL)
    top = L.top_labels(mesh, 6)
    split = C.train_test_split(arts.select("pmid"), 0.25, "42")
    ys = L.class_rows(L.label_matrix(arts, mesh, top))
    bow = X.bag_of_words(X.sentence_token_table(arts))
    train = split.where("split = 'train'").select("pmid")
    bag = L.labelled_bag(arts, mesh, top, split)
    assert {(r.pmid, r.token): r.n for r in bag.collect()} == {(r.pmid, r.token): r.n for r in bow.collect()}
    ys_tr = ys.join(train, "pmid", "left_semi")
    per_label = ys_tr.groupBy("meshid").agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))
    a = {(r.meshid, r.token): r.f for r in L.anova_f_labelled(bag.where("split = 'train'"), per_label).collect()}
    b = {(r.meshid, r.token): r.f for r in L.anova_f(bow.join(train, "pmid", "left_semi"), ys_tr).collect()}
    assert a.keys() == b.keys()
    assert all((a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) <= 1e-9 * (1 + abs(b[k]))) for k in a)


def test_tokens_are_counted_inside_their_row(spark):
    """All tokens of a task were grouped by id, token, split and labels at once."""
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (1, ["a"])], "pmid long, t array<string>")
    out = X.counted_tokens(rows, F.col("t")).select("pmid", "token", "n")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 1), (1, "a", 1), (1, "b", 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan


def test_repeated_ids_are_counted_together(spark):
    docs = spark.createDataFrame([(1, "a b", "b c"), (1, "b", "x"), (2, "c", None), (None, "d", "d"), (3, "", "")],
                                 "pmid long, title string, content string")
    split = spark.createDataFrame([(1, "train"), (1, "test"), (2, "train"), (None, "train"), (3, "test")],
                                  "pmid long, split string")
    labels = spark.createDataFrame([(1, "L"), (1, "M"), (2, "N")], "pmid long, meshid string")
    top = spark.createDataFrame([("L",), ("M",)], "meshid string")
    bag = L.labelled_bag(docs, labels, top, split)
    got = sorted((r.pmid, r.token, r.split, tuple(r.labels), r.n) for r in bag.collect())
    one = [(1, t, s, ("L", "M"), n) for t, n in (("b", 3), ("c", 1), ("x", 1)) for s in ("train", "test")]
    assert got == sorted([*one, (2, "c", "train", (), 1)])


def test_bags_counted_in_rows_equal_those_of_tokens(spark):
    docs = spark.createDataFrame([(1, "a1 b1", "b1. c1 b1"), (1, "b1", "x1"), (2, None, "c1! D1-e1"), (None, "d1", "d1"),
                                  (3, "", "")], "pmid long, title string, content string")
    rows = lambda df: sorted((tuple(r) for r in df.select("pmid", "token", "n").collect()), key=str)
    assert rows(X.bag_of_words(X.document_bag(docs))) == rows(X.bag_of_words(X.sentence_token_table(docs)))


def test_naive_bayes_adds_up_the_rows_of_an_id(spark):
    """The query no longer groups its bag: parts of a document give the same model."""
    parts = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (2, "b", 1), (2, "b", 2), (3, "a", 1), (3, "b", 1)],
                                  "pmid long, token string, n long")
    ys = spark.createDataFrame([(1, "L", 1), (2, "L", 0)], "pmid long, meshid string, y int")
    train = F.col("pmid") < 3

    def scores(bow):
        found = L.naive_bayes_predict(L.naive_bayes_fit(bow.where(train), ys), bow.where(~train)).collect()
        return [(r.pmid, r.meshid, round(r.score1, 9), round(r.score0, 9)) for r in found]

    assert scores(parts) == scores(X.bag_of_words(parts))


def _bayes(spark):
    import random

    rng = random.Random(5)
    ids = list(range(1, 41)) + [7]
    docs = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(12)), f"rare{i % 9} tail") for i in ids] + [(99, "", None)]
    marks = [(i, m) for i in range(1, 41) for m in ("L_a", "L_b", "L_c") if rng.random() < 0.4] + [(3, None), (4, "L_a")]
    split = [(i, "test" if i % 4 == 0 else "train") for i in ids] + [(7, "test"), (99, "test")]
    return (spark.createDataFrame(docs, "pmid long, title string, content string"),
            spark.createDataFrame(marks, "pmid long, meshid string"),
            spark.createDataFrame([("L_a",), ("L_b",), ("L_c",), ("L_none",), (None,)], "meshid string"),
            spark.createDataFrame(split, "pmid long, split string").distinct())


def test_naive_bayes_of_labelled_rows(spark, capsys):
    """every token of a document became a row for each label and was sent to it; now neither
    frequent nor rare tokens are, and the scores are those of their definition."""
    import math
    from collections import Counter

    docs, marks, top, split = _bayes(spark)
    side = {s: split.where(F.col("split") == s).select("pmid") for s in ("train", "test")}
    ys = L.class_rows(L.label_matrix(side["train"], marks, top))
    bag = L.labelled_bag(docs, marks, top, split)
    model = L.naive_bayes_fit(bag.where("split = 'train'"), ys, materialize_input=False)
    found = [L.naive_bayes_predict(model, bag.where("split = 'test'"), docs=side["test"], frequent_bytes=b)
             for b in (32 << 20, 112 * 6, 0)]
    found[0].explain()
    assert "hashpartitioning(pmid" in (text := capsys.readouterr().out)
    assert not any("meshid" in line for line in text.splitlines() if "hashpartitioning(pmid" in line)
    plain = X.bag_of_words(X.document_bag(docs))
    old = L.naive_bayes_fit(plain.join(side["train"], "pmid", "left_semi"), ys)
    found.append(L.naive_bayes_predict(old, plain.join(side["test"], "pmid", "left_semi"), docs=side["test"]))

    words = {}
    for r in plain.collect():
        words.setdefault(r.pmid, Counter())[r.token] += r.n
    train, test = ([r.pmid for r in side[s].collect()] for s in ("train", "test"))
    given = {(r.pmid, r.meshid) for r in marks.collect()}
    vocab = {t for i in train for t in words.get(i, ())}
    want = {}
    for lab in ("L_a", "L_b", "L_c"):
        scores = {}
        for y in (1, 0):
            part = [i for i in train if ((i, lab) in given) == bool(y)]
            n = sum((words.get(i, Counter()) for i in part), Counter())
            scores[y] = lambda i, n=n, p=math.log(len(part) / len(train)), t=sum(n.values()): p + sum(
                k * math.log((n[w] + 1) / (t + len(vocab))) for w, k in words.get(i, Counter()).items() if w in vocab)
        want |= {(i, lab): (round(scores[1](i), 6), round(scores[0](i), 6)) for i in test}
    for out in found:
        rows = out.collect()
        assert len(rows) == 5 * len(test) and len(want) == 3 * len(test)
        assert {(r.pmid, r.meshid): (round(r.score1, 6), round(r.score0, 6)) for r in rows if (r.pmid, r.meshid) in want} == want
        assert all(r.y_pred == (r.score1 > r.score0) for r in rows if (r.pmid, r.meshid) in want)
        assert all(r.y_pred == 0 for r in rows if r.meshid in (None, "L_none"))
