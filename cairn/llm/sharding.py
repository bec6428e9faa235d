"""Sharding by balanced label propagation.

Documents that belong together are members of a hub (a group of equal texts, an edge, a
host). Labels are shards. In each round the members of every hub are counted by label, in
a join of members with labels; a document outside the label that most of its neighbours
have moves there, if that shard has room: demand beyond a shard's quota is admitted by a
hash, in the share that the quota allows. Documents without links then fill the shards up
to even sizes. What reaches the driver has a row per shard, per bucket of a fixed number,
or per document larger than a five-hundredth of a shard, of which there is a bounded number.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.arrays import as_bytes
from cairn.plans.durable import discard, durable, pick

HEAVY = 500  # a free document larger than this fraction of a shard is dealt out by itself
BUCKETS = 65_536
FULL = 0.06  # a shard with less of its quota left takes no more movers


def _share(c: Column) -> Column:
    """A hash of a row, even in [0, 1)."""
    return F.pmod(c, F.lit(1 << 52)) / float(1 << 52)


def _loads(labelled: DataFrame) -> dict[int, int]:
    return {r[0]: int(r[1]) for r in labelled.groupBy("label").agg(F.sum("size")).collect()}  # a row per shard


def _propagate(linked: DataFrame, members: DataFrame, shards: int, quota: float, rounds: int) -> DataFrame:
    """Labels of linked documents (uid, size, label) when none gains by moving any more."""
    state = durable(linked.withColumn("label", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")), "labels")
    for turn in range(rounds):
        load = _loads(state)
        room = [max(0.0, quota - load.get(s, 0)) for s in range(shards)]
        has_room = F.element_at(F.array(*[F.lit(r > FULL * quota) for r in room]), F.col("label") + 1)
        roomy = [i for i in range(shards) if room[i] > FULL * quota]
        votes = members.join(state, "uid").groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
        # Of a hub at most a row per shard; the fullest with room, the least of several.
        offered = F.max(F.when(has_room, F.struct("n", (-F.col("label")).alias("to")))).alias("best")
        best = votes.groupBy("hub").agg(offered, F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
        # A small hub between full shards moves as a whole to one with room.
        aside = F.element_at(F.array(*[F.lit(i) for i in roomy or [0]]), F.pmod(F.xxhash64("hub"), F.lit(len(roomy) or 1)).cast("int") + 1)
        small = F.when((F.col("bytes") <= FULL * quota) & F.lit(bool(roomy)), F.struct("n", (-aside).alias("to")))
        best = best.select("hub", F.coalesce("best", small).alias("best")).filter("best is not null")
        here = votes.select("hub", "label", F.col("n").alias("mine"))
        offers = members.join(state, "uid").join(here, ["hub", "label"]).join(best, "hub")
        offers = offers.select("uid", "size", "label", (-F.col("best.to")).alias("to"), (F.col("best.n") - F.col("mine")).alias("gain"))
        offers = offers.filter((F.col("to") != F.col("label")) & ((F.col("gain") > 0) | ((F.col("gain") == 0) & ((F.col("to") < F.col("label")) | ~has_room))))
        wants = offers.groupBy("uid").agg(F.max(F.struct("gain", (-F.col("to")).alias("to"), "size")).alias("w")).select("uid", (-F.col("w.to")).alias("to"), F.col("w.size").alias("size"))
        wants = durable(wants, "wants")
        demand = {r[0]: int(r[1]) for r in wants.groupBy("to").agg(F.sum("size")).collect()}
        if not demand:
            discard(wants)
            break
        allowed = F.element_at(F.array(*[F.lit(1.0 if demand.get(s, 0) <= room[s] else 0.95 * room[s] / demand[s]) for s in range(shards)]), F.col("to") + 1)
        moves = wants.filter(_share(F.xxhash64("uid", F.lit(turn))) < allowed).select("uid", "to")
        after = durable(state.join(moves, "uid", "left").select("uid", "size", F.coalesce("to", "label").alias("label")), "labels")
        discard(state, wants)
        state = after
    return state


def balanced_labels(nodes: DataFrame, members: DataFrame, shards: int, rounds: int | None = None, slack: float = 0.002) -> DataFrame:
    """(uid, label): a shard from 0 for each node (uid unique, size), near in bytes.

    ``members`` (uid, hub) says which nodes belong together; an edge is a hub of two. Linked
    nodes may fill a shard up to its even share, or ``slack`` beyond where nothing free is
    left to even it out. A hub larger than a shard fills about one shard a round; there are
    as many rounds as shards at most. No nodes give no labels.
    """
    ids = members.select("uid").distinct()
    linked = durable(nodes.join(ids, "uid", "left_semi").select("uid", "size"), "linked")
    free = nodes.join(ids, "uid", "left_anti").select("uid", "size")
    total, n = (int(x or 0) for x in nodes.agg(F.sum("size"), F.count(F.lit(1))).first())
    bound = int(linked.agg(F.sum("size")).first()[0] or 0)
    share = total / shards
    quota = bound / shards + 0.9 * (total - bound) / shards + slack * share
    state = _propagate(linked, members, shards, quota, rounds or shards)

    # Large free documents, largest first, each into the emptiest shard: fewer than
    # HEAVY * shards rows, since each takes more than share / HEAVY of the total.
    load = _loads(state)
    heap = [(load.get(s, 0), s) for s in range(shards)]
    heapq.heapify(heap)
    large = []
    for r in sorted(free.filter(F.col("size") > share / HEAVY).collect(), key=lambda r: (-r["size"], r["uid"])):
        filled, s = heapq.heappop(heap)
        large.append((r["uid"], s))
        heapq.heappush(heap, (filled + r["size"], s))
    spark = nodes.sparkSession
    placed = spark.createDataFrame(large or [(0, 0)], "uid long, label int").limit(len(large))

    # Small ones are laid end to end and cut where shards are full. Buckets give every
    # document its place without a global order: a running sum in its bucket, and the
    # sum of the buckets before.
    small = free.filter(F.col("size") <= share / HEAVY)
    buckets = max(1, min(BUCKETS, n // 2_000))
    small = small.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int"))
    sums = {r[0]: int(r[1]) for r in small.groupBy("bucket").agg(F.sum("size")).collect()}
    before, at = [], 0
    for b in range(buckets):
        before.append((b, at))
        at += sums.get(b, 0)
    lacks = [max(0.0, share - filled) for filled, _ in sorted(heap, key=lambda x: x[1])]
    scale = at / sum(lacks) if sum(lacks) else 0.0
    ends, end = [], 0.0
    for x in lacks:
        end += x * scale
        ends.append(end)
    starts = spark.createDataFrame(before, "bucket int, before long")
    run = Window.partitionBy("bucket").orderBy("uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before") + F.sum("size").over(run) - F.col("size") / 2
    if any(lacks):
        bounds = F.array(*[F.lit(float(x)) for x in ends[:-1]])
        label = F.size(F.filter(bounds, lambda x: x <= F.col("middle")))
    else:
        label = F.pmod(F.xxhash64("uid"), F.lit(shards))
    dealt = small.join(F.broadcast(starts), "bucket").withColumn("middle", middle).select("uid", label.cast("int").alias("label"))
    return state.select("uid", "label").union(placed).union(dealt)


def with_slots(df: DataFrame, rows: int) -> DataFrame:
    """Number the rows of each shard from 0 without a gap, in many tasks to a shard."""
    parts = max(1, min(BUCKETS, rows // 200_000))
    d = df.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int"))
    counts = d.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.select("shard", "part", (F.sum("n").over(order) - F.col("n")).alias("before"))
    inside = Window.partitionBy("shard", "part").orderBy("uid")
    d = d.withColumn("inside", F.row_number().over(inside)).join(before, ["shard", "part"])
    return d.withColumn("slot", (F.col("before") + F.col("inside") - 1).cast("long")).drop("part", "before", "inside")


def shard_documents(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into a shard of near equal bytes, equal texts together.

    Columns: ``id_col``, size (UTF-8 bytes and 16), text_crc32, law (``bytes``), shard,
    slot (gapless from 0 in its shard), grown_shard (null under this law). A group larger
    than the room of a shard is cut into as few parts as its rooms allow.

    Null texts have size 16 and are equal to each other, not to the empty text. Rows that
    repeat are documents of their own; null ids pass through; an empty table gives an empty
    table; other columns don't matter.
    """
    d = pick(df, _id=id_col, _text=text_col).withColumn("_text", as_bytes("_text"))
    size = (F.coalesce(F.octet_length("_text"), F.lit(0)) + 16).cast("long")
    crc = F.coalesce(F.crc32("_text"), F.lit(0)).cast("long")
    hub = F.coalesce(F.unhex(F.md5("_text")), F.lit(b""))
    base = durable(d.select(F.monotonically_increasing_id().alias("uid"), F.col("_id"), size.alias("size"), crc.alias("text_crc32"), hub.alias("hub")), "documents")
    groups = base.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hub")
    members = durable(base.join(groups, "hub").select("uid", "hub"), "members")
    labels = balanced_labels(base.select("uid", "size"), members, shards)
    out = base.drop("hub").join(labels.withColumnRenamed("label", "shard"), "uid")
    out = with_slots(out, base.count())
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_balanced_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in forty shards of near equal bytes."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
