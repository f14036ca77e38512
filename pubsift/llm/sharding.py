"""Balanced label propagation: documents to shards, equal texts together.

DataFrame functions only.  The graph links documents of equal text.  Law
``rows``: shard sizes in rows differ by one at most.

1. Every linked document starts in a shard drawn from a hash of its row and votes
   for it.  The label of a group is the shard with most votes that has room for
   the whole group; its documents move there together, under the quota that the
   shard has left, large groups first.
2. Groups that found no room vote again: each takes an open shard with room for
   all of it, drawn by the room left.  Rounds go on until all groups of a phase
   are settled; phases go from groups of more than a quarter of a shard, to those
   of more than a 64th, to the rest, so that small groups fill what large ones
   leave.
3. A group is cut only if no shard has room for it whole.  It then fills the
   shard with most room and the rest goes on as a smaller group.  As its rows are
   more than any room left, fewer groups than shards can be in that state, and a
   cut fills a shard: there are at most as many cuts as shards.
4. Documents without links, which cut no edge, fill the shards up.

A group that holds a third of all rows is never gathered: labels come from
counts per (group, shard), and positions from counts per hash bucket plus a
row number inside one bucket.  The driver sees one row per shard, and the groups
that must be cut.

Cases: null texts are equal to each other (size 1); repeated rows are documents
of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pubsift.llm.common import Workspace, as_bytes

N_SHARDS = 8
ROWS_PER_BUCKET = 20_000
GROUPS_PER_BUCKET = 2_000
PHASES = (1 / 4, 1 / 64, 0)     # groups of more than this share of a shard


def describe(docs: DataFrame) -> DataFrame:
    """``(rid, doc_id, size, text_crc32, grp)``; narrow, to be written once."""
    data = as_bytes("text")
    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id",
                       (F.length(data) + 1).cast("long").alias("size"),
                       F.crc32(data).alias("text_crc32"),
                       F.unhex(F.sha2(data, 256)).alias("grp"))


def positions(rows: DataFrame, by: list[str], buckets: int, salt: int) -> DataFrame:
    """Add ``_pos``, 0, 1, ... within ``by``: offsets per hash bucket, and a row
    number inside a bucket.  Needs a unique ``rid``; ``salt`` sets the buckets apart
    from what else was decided by a hash of it."""
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64("rid", F.lit(salt)), F.lit(buckets)))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # One row per bucket: ROWS_PER_BUCKET times fewer than the documents.
    offsets = (dealt.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
               .select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("rid"))
    return (dealt.join(offsets, [*by, "_b"])
            .withColumn("_pos", F.col("_off") + inside - 1).drop("_b", "_off"))


def _pick(values: dict[int, object], key: Column, other) -> Column:
    """A lookup by shard, as a CASE expression."""
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _eligible(room: dict[int, int]) -> Column:
    """Shards with room for a whole group of ``n``: ``(s, r)``."""
    rooms = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(r).cast("long").alias("r")) for s, r in sorted(room.items())])
    return F.filter(rooms, lambda x: x["r"] >= F.col("n"))


def _drawn(eligible: Column, salt: int) -> Column:
    """One of the eligible shards, drawn by a hash with the room as weight."""
    total = F.aggregate(eligible, F.lit(0).cast("long"), lambda a, x: a + x["r"])
    start = F.struct(F.pmod(F.xxhash64("grp", F.lit(salt)), total).alias("left"), F.lit(-1).alias("s"))
    return F.aggregate(eligible, start, lambda a, x: F.when(a["left"] < 0, a).otherwise(F.struct(
        (a["left"] - x["r"]).alias("left"), x["s"].alias("s"))))["s"]


def _admit(cand: DataFrame, room: dict[int, int], buckets: int) -> DataFrame:
    """Groups ``(grp, n, target)`` with ``won``: from the largest size class on, those
    that fit one after the other.  Only the bucket where a shard fills up is
    ranked group by group."""
    level = (-F.floor(F.log2("n")) * buckets + F.pmod(F.xxhash64("grp"), F.lit(buckets))).cast("long")
    cand = cand.withColumn("_l", level)
    before = Window.partitionBy("target").orderBy("_l").rowsBetween(Window.unboundedPreceding, -1)
    # One row per size class and bucket.
    sums = (cand.groupBy("target", "_l").agg(F.sum("n").alias("_n"))
            .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    limit = _pick(room, F.col("target"), 0)
    first = sums.where(F.col("_before") + F.col("_n") > limit).groupBy("target").agg(
        F.min(F.struct("_l", "_before")).alias("x")).collect()          # one row a shard
    edge = _pick({r["target"]: r["x"][0] for r in first}, F.col("target"), 1 << 62)
    taken = _pick({r["target"]: r["x"][1] for r in first}, F.col("target"), 0)
    running = Window.partitionBy("target").orderBy(F.desc("n"), "grp").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cand.where(F.col("_l") == edge).withColumn("won", F.sum("n").over(running) + taken <= limit)
    return cand.where(F.col("_l") != edge).withColumn("won", F.col("_l") < edge).unionByName(ranked).drop("_l")


class Cuts:
    """Groups that no shard has room for: which of their documents go where."""

    def __init__(self) -> None:
        self.ranges: dict[bytes, list[tuple[int, int, int]]] = {}

    def cut(self, grp: bytes, n: int, room: dict[int, int]) -> int:
        """Fill shards with documents of the group until the rest fits one; its size."""
        ranges = self.ranges.setdefault(grp, [])
        while n > max(room.values()):
            shard = max(room, key=lambda s: (room[s], -s))
            start = ranges[-1][1] if ranges else 0
            ranges.append((start, start + room[shard], shard))
            n, room[shard] = n - room[shard], 0
        return n


def settle_groups(votes: DataFrame, capacity: dict[int, int], ws: Workspace) -> tuple[DataFrame, Cuts, dict[int, int]]:
    """Groups ``(grp, n, votes)`` to shards: ``(grp, shard)``, the cuts, the room left."""
    room, cuts, settled, step = dict(capacity), Cuts(), None, 0
    per_shard, above = max(capacity.values()), None
    for share in PHASES:
        low = int(share * per_shard)
        active = votes.where((F.col("n") > low) & (F.col("n") <= above if above is not None else F.lit(True)))
        above, fresh = low, True
        while True:
            n_active, largest = active.agg(F.count(F.lit(1)), F.max("n")).first()
            if not n_active:
                break
            while largest > max(room.values()):
                # Fewer than the shards: each is larger than any room, and all together have room.
                for r in active.where(F.col("n") > max(room.values())).orderBy(F.desc("n"), "grp").collect():
                    left = cuts.cut(bytes(r["grp"]), r["n"], room)
                    mine = F.col("grp") == F.lit(bytearray(r["grp"]))
                    active = active.withColumn("n", F.when(mine, F.lit(left)).otherwise(F.col("n")).cast("long"))
                largest = active.agg(F.max("n")).first()[0]
            fits = _eligible(room)
            liked = F.filter("votes", lambda v: F.exists(fits, lambda x: x["s"] == v["s"]))
            drawn = _drawn(fits, step)
            target = F.coalesce(F.get(liked, F.lit(0))["s"], drawn) if fresh else drawn
            cand = ws.put(active.withColumn("target", target), f"cand{step}")
            judged = ws.put(_admit(cand, room, max(1, n_active // GROUPS_PER_BUCKET)), f"judged{step}")
            for r in judged.where("won").groupBy("target").agg(F.sum("n").alias("n")).collect():
                room[r["target"]] -= r["n"]
            won = judged.where("won").select("grp", F.col("target").cast("int").alias("shard"))
            settled = won if settled is None else settled.unionByName(won)
            active, fresh, step = judged.where(~F.col("won")).select(*votes.columns), False, step + 1
    if settled is None:
        settled = votes.select("grp", F.lit(0).alias("shard")).where(F.lit(False))
    return settled, cuts, room


def propagate(linked: DataFrame, capacity: dict[int, int], ws: Workspace,
              buckets: int = 16) -> tuple[DataFrame, dict[int, int]]:
    """Settle the linked documents ``(rid, grp)``: ``(rid, shard)``, and the room left."""
    shards = sorted(capacity)
    at = F.element_at(F.array(*map(F.lit, shards)), (F.pmod(F.xxhash64("rid"), F.lit(len(shards))) + 1).cast("int"))
    votes = linked.groupBy("grp", at.alias("s")).agg(F.count(F.lit(1)).alias("c")).groupBy("grp").agg(
        F.sum("c").alias("n"), F.sort_array(F.collect_list(F.struct("c", "s")), asc=False).alias("votes"))  # one a shard
    placed, cuts, room = settle_groups(ws.put(votes, "votes"), capacity, ws)
    placed = ws.put(placed, "placed_groups")
    if not cuts.ranges:
        return linked.join(placed, "grp").select("rid", "shard"), room
    is_cut = F.col("grp").isin([F.lit(bytearray(g)) for g in cuts.ranges])
    parts = positions(linked.where(is_cut), ["grp"], buckets, salt=103).join(placed, "grp", "left")
    shard = F.col("shard")                      # the rest follows its group
    for grp, ranges in cuts.ranges.items():
        for start, end, s in ranges:
            shard = F.when((F.col("grp") == F.lit(bytearray(grp))) & F.col("_pos").between(start, end - 1),
                           F.lit(s)).otherwise(shard)
    whole = linked.where(~is_cut).join(placed, "grp").select("rid", "shard")
    return whole.unionByName(parts.select("rid", shard.cast("int").alias("shard"))), room


def assign_shards(spark: SparkSession, docs: DataFrame, n_shards: int = N_SHARDS,
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every document."""
    ws = Workspace(spark, "sharding")
    base = ws.put(describe(docs), "base")
    n = base.count()
    buckets = max(16, -(-n // rows_per_bucket))
    capacity = {s: n // n_shards + (s < n % n_shards) for s in range(n_shards)}
    # Written, so that both sides of the join are plain exchanges, which adaptive
    # execution may split at a hot group.
    groups = ws.put(base.groupBy("grp").agg(F.count(F.lit(1)).alias("n_grp")).where("n_grp > 1"), "groups")
    linked = ws.put(base.select("rid", "grp").join(groups.select("grp"), "grp"), "linked")
    settled, room = propagate(linked, capacity, ws, buckets)
    settled = ws.put(settled, "settled")
    # Whatever is not settled fills the room left, shard after shard.
    loose = positions(base.select("rid").join(settled, "rid", "left_anti"), [], buckets, salt=101)
    shard, edges, total = F.lit(None).cast("int"), [], 0
    for s in sorted(room):
        total += room[s]
        edges.append((s, total))
    for s, end in reversed(edges):
        shard = F.when(F.col("_pos") < end, F.lit(s)).otherwise(shard)
    placed = ws.put(settled.unionByName(loose.select("rid", shard.cast("int").alias("shard"))), "placed")
    rows = positions(base.select("rid", "doc_id", "size", "text_crc32").join(placed, "rid"), ["shard"], buckets, salt=102)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                       F.col("_pos").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
