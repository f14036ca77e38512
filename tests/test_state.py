"""Keyed state in runs, and stored postings."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from pubsift.operators import search as S
from pubsift.operators.postings import PostingsStore
from pubsift.session import scratch_path
from pubsift.streaming.state import KeyedState


def newest(rows):
    return rows.groupBy("k").agg(F.max(F.struct("t", "v")).alias("_l"), F.sum("n").alias("n")).select("k", "_l.*", "n")


def state(spark):
    return KeyedState(spark, scratch_path(spark, f"state-{uuid.uuid4().hex}"), newest)


def test_batches_equal_one_reduction_and_writes_follow_the_batch(spark):
    rng = random.Random(1)
    s, every, written, first = state(spark), [], [], 0
    for epoch in range(14):
        size = 4000 if epoch == 0 else 40
        rows = [(rng.randrange(6000), epoch * 10_000 + i, rng.random(), 1) for i in range(size)]
        every += rows
        written.append(s.apply(spark.createDataFrame(rows, "k int, t int, v double, n int").coalesce(1), epoch))
        first = first or written[0]
    # The large first run is not rewritten by small batches.
    assert max(written[1:]) < first
    assert len(s.cover()) <= 6
    expect = {}
    for k, t, v, n in every:
        old = expect.get(k, (-1, None, 0))
        expect[k] = (max(old[:2], (t, v)) + (old[2] + 1,))
    assert {r.k: (r.t, r.v, r.n) for r in s.read().collect()} == expect


def test_a_repeated_epoch_starts_from_the_runs_before_it(spark):
    s, schema = state(spark), "k int, t int, v double, n int"
    assert s.read() is None
    for epoch in range(4):
        s.apply(spark.createDataFrame([(1, epoch, 0.5, 1), (epoch, epoch, 0.0, 1)], schema), epoch)
    before = sorted(map(tuple, s.read().collect()))
    for epoch in (3, 3):
        s.apply(spark.createDataFrame([(1, epoch, 0.5, 1), (epoch, epoch, 0.0, 1)], schema), epoch)
        assert sorted(map(tuple, s.read().collect())) == before


WORDS = ["alpha", "beta", "gamma", "the", "of", "x-ray"]
QUERIES = {"a": {"all_of": ["the of"]}, "b": {"any_of": ["alpha beta gamma", "X-Ray"], "none_of": ["of the"]},
           "c": {"all_of": ["beta", "the the"], "any_of": ["gamma", "alpha"]}, "d": {"none_of": ["alpha", "zzz"]},
           "e": {"all_of": ["--"]}, "f": {"any_of": ["--", "zzz"]}, "g": {"all_of": ["beta"], "none_of": ["--"]}}


def random_docs(rng, ids):
    return [(i, " ".join(rng.choices(WORDS, k=rng.randrange(12)))) for i in ids]


@pytest.fixture(scope="module")
def store(spark):
    rng = random.Random(4)
    store = PostingsStore(spark, scratch_path(spark, f"postings-{uuid.uuid4().hex}"), buckets=8)
    with pytest.raises(ValueError):
        store.documents()
    docs = dict(random_docs(rng, range(200)))
    docs[7] = None
    store.add(spark.createDataFrame(list(docs.items()), "pmid long, content string"))
    new = dict(random_docs(rng, range(150, 260)))
    store.add(spark.createDataFrame(list(new.items()), "pmid long, content string"))
    store.remove(spark.createDataFrame([(i,) for i in range(0, 260, 9)], "pmid long"))
    back = dict(random_docs(rng, [9, 18]))
    store.add(spark.createDataFrame(list(back.items()), "pmid long, content string"))
    live = {i: t for i, t in (docs | new).items() if i % 9} | back
    return store, live


def brute(text, all_of=(), any_of=(), none_of=()):
    import regex

    j = " " + " ".join(regex.findall(S.TOKEN_RUN, (text or "").lower())) + " "

    def has(item):
        words = regex.findall(S.TOKEN_RUN, item.lower())
        return bool(words) and f" {' '.join(words)} " in j

    return all(map(has, all_of)) and (not any_of or any(map(has, any_of))) and not any(map(has, none_of))


def test_stored_postings_and_filters_against_brute_force(spark, store):
    store, live = store
    expect = sorted((q, i) for q, spec in QUERIES.items() for i, t in live.items() if brute(t, **spec))
    assert sorted(map(tuple, store.tag(QUERIES).collect())) == expect
    docs = spark.createDataFrame(list(live.items()), "pmid long, content string")
    assert sorted((r.query, r.pmid) for r in S.tag_documents_by_query(docs, QUERIES).collect()) == expect
    for q, spec in QUERIES.items():
        ids = [i for name, i in expect if name == q]
        assert sorted(r.pmid for r in S.text_match(docs, **spec).collect()) == ids
        assert sorted(r.pmid for r in store.text_match(**spec).collect()) == ids


def test_a_question_reads_its_buckets_only(store):
    store, _ = store
    rows = store.postings(["alpha"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(token,alpha)" in plan or "In(token" in plan
    assert {f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}      # readable layout
    assert {r.token for r in rows.select("token").distinct().collect()} == {"alpha"}


def test_one_question_is_a_filter_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "the of")], "pmid long, content string")
    for df in (S.text_match(docs, ["the of"]), S.tag_documents_by_query(docs, QUERIES)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
