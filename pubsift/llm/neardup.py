"""MinHash near-duplicate groups, confirmed on full shingle sets.

A text is lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; its set
holds the distinct ``SHINGLE``-word shingles (fewer words: the whole sequence).
Texts with ``100 * |A & B| >= 75 * |A | B|`` are linked.

1. Equal word sequences become one node, so copies are never compared.
2. ``HASHES`` universal hash minima per node, in ``BANDS`` bands.  A pair at the
   threshold shares no band with probability (1 - 0.75^4)^32 = 5e-6.
3. Every bucket is a star around its smallest node: linear in the bucket.  Star
   edges are checked by signature, then confirmed on full sets.
4. Connected components by alternating large-star and small-star.
5. Buckets whose other members still lie in different components are compared
   exactly, whatever their size: members outside the bucket's largest component
   against all members, in pairs of blocks of bounded size that emit only links
   joining two components.  Then components once more.

Nothing is capped: a large bucket makes more blocks, not larger ones.

Cases: null or empty texts have an empty set and link with nothing; rows that
repeat an id or a text are rows of one node; a null id takes the component of
its text, if that has an id; an empty table gives no rows.  Extra columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubsift.llm.common import Workspace, as_bytes, frame

SHINGLE = 5
HASHES, BANDS = 128, 32
THRESHOLD_PCT = 75
# Share of equal minima below which a star edge is not worth a full check.  At
# the threshold the share has mean 0.75 and deviation 0.038: 6.5 deviations.
MIN_AGREEMENT = 0.5
BLOCK_SHINGLES = 250_000

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS: dict[bytes, int] = {}           # per worker: hashes of words seen lately


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_WORDS) > 200_000:
        _WORDS.clear()
    known, out = _WORDS.get, []
    for w in words:
        h = known(w)
        if h is None:
            h = _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingle_set(data: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    words = data.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = _word_hashes(words)
    n = max(1, len(w) - k + 1)
    h = np.full(n, np.uint64(min(k, len(w))))
    for i in range(min(k, len(w))):
        h = (h ^ w[i:i + n]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of ``HASHES`` universal (multiply-shift) hashes: 32 bits each."""
    x = (shingles >> np.uint64(32)) ^ (shingles & np.uint64(0xFFFFFFFF))
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(x), 512):
        np.minimum(low, (_A[:, None] * x[None, i:i + 512] + _B[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def _fingerprint(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        data = bytes(t)
        s = shingle_set(data)
        node = hashlib.blake2b(b" ".join(data.lower().split()), digest_size=16).digest()
        out.append((len(s), node, signature(s).tobytes() if len(s) else None))
    return frame(out, ["n", "node", "sig"])


def _full_set(texts: pd.Series) -> pd.DataFrame:
    return frame([(hashlib.blake2b(b" ".join(bytes(t).lower().split()), digest_size=16).digest(),
                   shingle_set(bytes(t)).tobytes()) for t in texts], ["node", "shingles"])


def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal minima of two signatures."""
    return pd.Series([float(np.mean(np.frombuffer(x, "<u4") == np.frombuffer(y, "<u4")))
                      for x, y in zip(a, b)], dtype="float64")


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    """The link rule on two full sets."""
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        if 100 * min(len(x), len(y)) < THRESHOLD_PCT * max(len(x), len(y)):
            out.append(False)
            continue
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(100 * both >= THRESHOLD_PCT * (len(x) + len(y) - both))
    return pd.Series(out, dtype=bool)


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """``(bucket, node, n)``, one row per band."""
    width = 4 * HASHES // BANDS
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    return (nodes.select("node", "n", "sig", band.alias("band"))
            .select(F.xxhash64("band", F.substring("sig", F.col("band") * width + 1, F.lit(width))).alias("bucket"),
                    "node", "n"))


def components(links: DataFrame, ws: Workspace, tag: str) -> DataFrame:
    """``(node, root)`` of every node with a link, by alternating stars."""

    def star(pairs: DataFrame, keep) -> DataFrame:
        """Link ``v`` of each ``(u, v)`` to the least of u and u's neighbours; the
        minimum is combined map-side, the join may split a hot ``u``."""
        # Written, so that both sides of the join are plain exchanges, which
        # adaptive execution may split.
        low = ws.put(pairs.groupBy("u").agg(F.min("v").alias("m")), f"{tag}-low")
        m = F.least("u", "m")
        joined = pairs.join(low, "u")
        return (joined.where(keep).select(F.greatest("v", m).alias("u"), F.least("v", m).alias("v"))
                .unionByName(low.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v")))
                .where(F.col("u") != F.col("v")).distinct())

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = ws.put(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .where("u != v").distinct(), f"{tag}-0")
    seen, step = mark(edges), 0
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u move to the least of the neighbourhood;
        # u itself keeps its own link to it.
        large = star(both, F.col("v") > F.col("u"))
        # Small star: u and its lower neighbours.
        edges = ws.put(star(ws.put(large, f"{tag}-large{step}"), F.lit(True)), f"{tag}-{step + 1}")
        now = mark(edges)
        ws.drop(f"{tag}-large{step}", f"{tag}-{step}")
        step += 1
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _join_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exact links between components inside one pair of blocks: a spanning set."""
    pdf = pdf.drop_duplicates("node")
    nodes, comps = pdf["node"].tolist(), pd.factorize(pdf["comp"])[0]
    sets = [np.frombuffer(x, "<u8") for x in pdf["shingles"]]
    sizes = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    order = np.argsort(code, kind="stable")
    posting, start = doc[order], np.concatenate(([0], np.cumsum(count)))
    parent = list(range(int(comps.max()) + 1))

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    # The largest component is reached from the members of the others.
    largest = np.bincount(comps).argmax()
    at, out = np.concatenate(([0], np.cumsum(sizes))), []
    for i in np.flatnonzero(comps != largest):
        own = code[at[i]:at[i + 1]][shared[at[i]:at[i + 1]]]
        if not len(own):
            continue
        length = count[own]
        pick = np.repeat(start[own] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        both = np.bincount(posting[pick], minlength=len(sets))
        for j in np.flatnonzero((100 * both >= THRESHOLD_PCT * (sizes + sizes[i] - both)) & (comps != comps[i])):
            a, b = find(int(comps[i])), find(int(comps[j]))
            if a != b:
                parent[a] = b
                out.append((nodes[i], nodes[int(j)]))
    return pd.DataFrame(out, columns=["u", "v"]).astype(object)


def _block_rows(members: DataFrame, sets: DataFrame, block: int, ws: Workspace) -> DataFrame:
    """Rows of the block pairs ``(bucket, kind, i, j)`` that cover every pair of
    members in different components of a bucket.  ``members``: (bucket, node, n, comp)."""
    per_comp = members.groupBy("bucket", "comp").agg(F.sum("n").alias("s"))
    per_bucket = ws.put(per_comp.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("s", "comp")).alias("major"),
        F.max("s").alias("major_s"), F.sum("s").alias("all_s")).where("comps > 1"), "unsettled")
    up = lambda c: F.ceil(c / block).cast("int")
    rows = members.join(per_bucket, "bucket").withColumn("is_major", F.col("comp") == F.col("major"))
    rows = (rows.withColumn("small", F.col("all_s") <= 2 * block)
            .withColumn("nb", F.greatest(up(F.col("all_s") - F.col("major_s")), F.lit(1)))
            .withColumn("nm", F.greatest(up(F.col("major_s")), F.lit(1))))
    b = F.pmod(F.xxhash64("node"), F.when(F.col("is_major"), F.col("nm")).otherwise(F.col("nb"))).cast("int")
    rows = rows.withColumn("b", b)
    minor = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: F.struct(
            F.lit("minor").alias("kind"), F.least("b", k).alias("i"), F.greatest("b", k).alias("j"))),
        F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda k: F.struct(
            F.lit("major").alias("kind"), F.col("b").alias("i"), k.alias("j"))))
    major = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: F.struct(
        F.lit("major").alias("kind"), k.alias("i"), F.col("b").alias("j")))
    one = F.array(F.struct(F.lit("all").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    unit = F.when(F.col("small"), one).when(F.col("is_major"), major).otherwise(minor)
    return (rows.select("bucket", "node", "comp", F.explode(unit).alias("unit"))
            .join(sets, "node").select("bucket", "unit", "node", "comp", "shingles"))


def near_duplicates(spark: SparkSession, docs: DataFrame, block: int = BLOCK_SHINGLES) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every document."""
    ws = Workspace(spark, "neardup")
    fingerprint = F.pandas_udf(_fingerprint, "n long, node binary, sig binary")
    full_set = F.pandas_udf(_full_set, "node binary, shingles binary")
    agreement = F.pandas_udf(_agreement, "double")
    similar = F.pandas_udf(_similar, "boolean")
    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("data"))
    prints = ws.put(data.select("doc_id", fingerprint("data").alias("p")).select("doc_id", "p.*"), "prints")
    # Rows of a node have one signature; partial aggregation folds hot copies.
    nodes = ws.put(prints.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
    buckets = bucket_rows(nodes)
    # Written before the join (as other aggregates below), so that adaptive
    # execution may split a hot bucket.
    centers = ws.put(buckets.groupBy("bucket").agg(
        F.min("node").alias("center"), F.max("node").alias("last"),
        F.count(F.lit(1)).alias("members")).where("center < last"), "centers")
    members = ws.put(buckets.join(centers.select("bucket", "center", "members"), "bucket")
                     .where(F.col("node") != F.col("center")), "members")

    star = members.select(F.col("node").alias("u"), F.col("center").alias("v")).distinct()
    sig = nodes.select("node", "sig")
    star = (star.join(sig.select(F.col("node").alias("u"), F.col("sig").alias("su")), "u")
            .join(sig.select(F.col("node").alias("v"), F.col("sig").alias("sv")), "v")
            .where(agreement("su", "sv") >= MIN_AGREEMENT).select("u", "v"))
    star = ws.put(star, "star")

    # Members of a bucket with one other member are settled by their star edge.
    rest = members.where("members > 2").select("bucket", "node", "n")
    wanted = (star.select(F.col("u").alias("node")).unionByName(star.select(F.col("v").alias("node")))
              .unionByName(rest.select("node")).distinct())
    reps = nodes.select("node", F.col("rep").alias("doc_id")).join(wanted, "node", "left_semi").select("doc_id").distinct()
    sets = ws.put(data.join(reps, "doc_id", "left_semi").select(full_set("data").alias("p")).select("p.*")
                  .dropDuplicates(["node"]), "sets").where(F.length("shingles") > 0)

    links = (star.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
             .join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
             .where(similar("a", "b")).select("u", "v"))
    links = ws.put(links, "links")
    comp = ws.put(components(links, ws, "first"), "comp")
    placed = rest.join(comp, "node", "left").select(
        "bucket", "node", "n", F.coalesce("root", "node").alias("comp"))
    more = _block_rows(placed, sets, block, ws).groupBy("bucket", "unit").applyInPandas(
        lambda pdf: _join_blocks(pdf), "u binary, v binary")
    more = ws.put(more, "more")
    if not more.isEmpty():
        lifted = (more.join(comp.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left")
                  .join(comp.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left")
                  .select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")))
        second = ws.put(components(lifted, ws, "second"), "second")
        comp = (comp.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "full_outer")
                .select(F.coalesce("node", "root").alias("node"), F.coalesce("top", "root").alias("root"))
                .unionByName(second).distinct())
        comp = ws.put(comp.groupBy("node").agg(F.min("root").alias("root")), "final")

    rows = prints.join(comp, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root"))
    rows = ws.put(rows, "rows")
    least = ws.put(rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return (rows.join(least, "root", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())))
