"""Blocks of the correlation graph: copies of a gene do not follow the input, tiles change no edge."""

import random

from pubsift.operators import embeddings as EM


def test_copies_of_a_gene(spark):
    assert {EM.correlation_blocks(n, 64) for n in (10_000, 100_000)} == {8}
    assert EM.correlation_blocks(615_000, 64) <= 40
    assert EM.correlation_blocks(0, 0) == EM.correlation_blocks(300, 64) == 1
    assert EM.correlation_blocks(100_000, 4_096) == 196     # two blocks of 2M numbers at most


def test_tiles(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(f"g{i}", s, rnd.gauss(0, 1)) for i in range(23) for s in range(6)]
    expr = spark.createDataFrame(rows, "gene string, sample int, value double")
    whole = {tuple(r) for r in EM.correlation_edges(expr, 0.2).collect()}
    monkeypatch.setattr(EM, "TILE_ROWS", 4)
    tiled = {tuple(r) for r in EM.correlation_edges(expr, 0.2).collect()}
    assert {r[:2] for r in tiled} == {r[:2] for r in whole} and len(whole) > 20
