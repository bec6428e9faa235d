"""MinHash near-dedup with an LSH forest.

Every distinct shingle set gets 128 least hashes, 16 trees of 8. In a tree the sets are
sorted by their 8 values, so that the longest common prefixes stand side by side: a set's
candidates are its next ``NEAR`` rows, as long as they share a prefix of ``LEAST_DEPTH``.
The depth so fits the region: where few sets share a prefix, 4 values are enough; where
thousands do, the nearest rows are those that share 5, 6 or all 8. One sorted order is
dealt out by ranges of (tree, values, set), which splits a region of any size, and the rows
at the ranges' ends are scanned once more together.

Links are confirmed on the full sets, in three rounds: first each set with the candidate
that shares most with it; then all candidates that still lie in different components; then
what regions with more sets than a row has neighbours can hide. There sets of different
components meet in shingles that are rare among the region's sets, which misses nothing, and
texts of one template, however many, hardly meet at all. What a round moves is the sets of
its pairs, and a group of near copies is joined by about one link per member, not by its
pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.arrays import PIECES, U, as_bytes, binary, bitmap, has, hash_words, input_bytes, merge_pieces, mixed, power_of_two, split_cells, texts, words_of
from cairn.llm.components import connected_components
from cairn.llm.skew import join_unique
from cairn.plans.durable import discard, durable, pick

TREES, DEPTH, LEAST_DEPTH, NEAR = 16, 8, 4, 3
FACTORS = mixed(np.arange(1, TREES * DEPTH + 1, dtype=U)) | U(1)
SHIFTS = mixed(np.arange(1001, TREES * DEPTH + 1001, dtype=U))
STEP = 200_000  # shingles that are hashed at a time


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``k`` lower-cased words.

    Fewer words make one shingle; no words make none.
    """
    words = words_of(text.lower()) if text else []
    if not words:
        return np.zeros(0, U)
    h = hash_words(words)
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(words[:k]), U)
    for i in range(min(k, len(h))):
        out = mixed(out * U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each of the 128 least hashes; one row for each set, none empty."""
    out = np.empty((len(sets), TREES * DEPTH), np.uint16)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (n == 0 or n + len(sets[j]) <= STEP):
            n += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        first = np.r_[0, np.cumsum([len(s) for s in sets[i : j - 1]])].astype(np.int64)
        for c in range(TREES * DEPTH):
            least = np.minimum.reduceat(flat * FACTORS[c] + SHIFTS[c], first)
            out[i:j, c] = (mixed(least) >> U(48)).astype(np.uint16)
        i = j
    return out


def _sign(k: int):
    def sign(batches):
        for batch in batches:
            values = texts(batch, "_text")
            sets = [shingle_set(v, k) for v in values]
            full = [s for s in sets if len(s)]
            rows = iter(signatures(full)) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    binary([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]),
                    binary([hashlib.md5(v or b"").digest() for v in values]),
                    binary([next(rows).astype(">u2").tobytes() if len(s) else None for s in sets]),
                ],
                names=["_id", "n_shingles", "set_key", "text_key", "signature"],
            )

    return sign


ROWS = "a binary, b binary, lcp int, tree int, prefix binary"


def _scan(ends: bool):
    """Pairs of near rows of a sorted order; with ``ends``, its first and last rows instead."""

    def out(a, b, lcp, tree, prefix):
        return pa.RecordBatch.from_arrays([a, b, lcp, tree, prefix], names=["a", "b", "lcp", "tree", "prefix"])

    def edge(tree, prefix, key):
        none = pa.nulls(len(tree))
        return out(binary(key), none.cast(pa.binary()), none.cast(pa.int32()), pa.array(tree, pa.int32()), binary(prefix))

    def scan(batches):
        tree, prefix, key, begun = np.zeros(0, np.int32), [], [], 0
        for batch in batches:
            held = len(key)
            tree = np.r_[tree, batch.column(0).to_numpy().astype(np.int32)]
            prefix, key = prefix + batch.column(1).to_pylist(), key + batch.column(2).to_pylist()
            if ends and begun < NEAR and len(key) > held:
                more = min(NEAR - begun, len(key) - held)
                yield edge(tree[held : held + more], prefix[held : held + more], key[held : held + more])
                begun += more
            rows = np.frombuffer(b"".join(prefix), np.uint16).reshape(-1, DEPTH)
            keys = np.array(key, dtype=object)
            for step in range(1, NEAR + 1):
                if ends or len(key) <= step:
                    break
                lcp = np.cumprod(rows[step:] == rows[:-step], axis=1).sum(axis=1)
                ok = (lcp >= LEAST_DEPTH) & (tree[step:] == tree[:-step])
                ok[: max(0, held - step)] = False  # pairs of rows that were there before
                if ok.any():
                    left, right = keys[:-step][ok].tolist(), keys[step:][ok].tolist()
                    none = pa.nulls(len(left))
                    yield out(binary([min(x) for x in zip(left, right, strict=True)]), binary([max(x) for x in zip(left, right, strict=True)]), pa.array(lcp[ok], pa.int32()), none.cast(pa.int32()), none.cast(pa.binary()))
            tree, prefix, key = tree[-NEAR:], prefix[-NEAR:], key[-NEAR:]
        if ends and len(key):
            yield edge(tree, prefix, key)

    return scan


def _candidates(signed: DataFrame) -> DataFrame:
    """Pairs of set keys (a < b) with the sum of their common prefixes; written."""
    nodes = signed.filter("set_key is not null").groupBy("set_key").agg(F.first("signature").alias("signature"))
    trees = nodes.select("set_key", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    trees = trees.select("tree", F.expr(f"substring(signature, tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("prefix"), "set_key")
    order = ["tree", "prefix", "set_key"]
    dealt = trees.repartitionByRange(*order).sortWithinPartitions(*order)
    pairs = dealt.mapInArrow(_scan(False), ROWS)
    # At most 2 * NEAR rows of each range: the ranges' number bounds them, not the data.
    edges = dealt.mapInArrow(_scan(True), ROWS).select("tree", "prefix", F.col("a").alias("set_key")).distinct()
    across = edges.repartitionByRange(1, *order).sortWithinPartitions(*order).mapInArrow(_scan(False), ROWS)
    both = pairs.unionByName(across).filter("a <> b")
    return durable(both.groupBy("a", "b").agg(F.sum("lcp").alias("shared")), "candidates")


def _key_cells(keys: list[bytes], cell_bits: int) -> np.ndarray:
    parts = np.frombuffer(b"".join(keys), U).reshape(-1, 2) >> U(64 - cell_bits)
    return parts + np.array([0, 1 << cell_bits], U)


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int, cell_bits: int) -> DataFrame:
    """(set_key, members) for the sets of ``wanted`` (set_key, text_key); written.

    A bitmap of fixed width tells the scan which texts may be wanted, so that only those
    are cut into shingles and moved; the join leaves just the wanted ones.
    """

    def mark(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            if keys:
                cells = split_cells(np.unique(_key_cells(keys, cell_bits)))
                yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), binary([b""] * len(cells)), binary([c[1].tobytes() for c in cells])], names=["slice", "once", "more"])

    bits = docs.sparkSession.sparkContext.broadcast(bitmap(merge_pieces(wanted.select("text_key").mapInArrow(mark, PIECES)), cell_bits + 1))

    def cut(batches):
        seen, given = np.frombuffer(bits.value, np.uint8), set()
        for batch in batches:
            values = texts(batch, "_text")
            keys = [hashlib.md5(v or b"").digest() for v in values]
            hit = has(seen, _key_cells(keys, cell_bits)).all(axis=1) if keys else []
            some = {x: v for x, v, ok in zip(keys, values, hit, strict=True) if ok and x not in given}
            if len(given) < 1_000_000:  # copies that a task has given already needn't be moved again
                given.update(some)
            yield pa.RecordBatch.from_arrays([binary(list(some)), binary([shingle_set(v, k).tobytes() for v in some.values()])], names=["text_key", "members"])

    sets = docs.select("_text").mapInArrow(cut, "text_key binary, members binary").join(wanted, "text_key")
    out = durable(sets.groupBy("set_key").agg(F.first("members").alias("members")), "sets")
    bits.unpersist()
    return out


def _alike(percent: int):
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True):
            a, b = np.frombuffer(p, U), np.frombuffer(q, U)
            if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                out.append(False)
                continue
            both = np.sort(np.concatenate((a, b)), kind="stable")
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            out.append(100 * common >= percent * (len(a) + len(b) - common))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(alike, T.BooleanType())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("set_key").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("set_key").alias("b"), F.col("members").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.filter(_alike(percent)("x", "y")).select("a", "b")


def _apart(pairs: DataFrame, tops: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components, with these."""
    of = lambda end: tops.select(F.col("set_key").alias(end), F.col("top").alias(f"top_{end}"))
    return pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").filter("top_a <> top_b")


def _merged(tops: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    roots = connected_components(_apart(links, tops).select(F.col("top_a").alias("a"), F.col("top_b").alias("b")))
    after = join_unique(tops, roots.withColumnRenamed("node", "top"), "top", tops.count())
    return durable(after.select("set_key", F.coalesce("root", "top").alias("top")), "tops")


SALTS = 16


def _crowd(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """(set_key, top, n) of the sets whose neighbours a sorted order can hide; written.

    They lie in a region, the sets with one prefix of LEAST_DEPTH in one tree, that has more
    sets than a row has neighbours, not all in one component.
    """
    rows = nodes.join(tops, "set_key").select("set_key", "top", "n", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    region = F.xxhash64("tree", F.expr(f"substring(signature, tree * {2 * DEPTH} + 1, {2 * LEAST_DEPTH})"))
    rows = rows.select("set_key", "top", "n", region.alias("region"), F.pmod(F.xxhash64("set_key"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = rows.groupBy("region", "top").agg(F.count(F.lit(1)).alias("rows"))
    regions = parts.groupBy("region").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("tops"))
    regions = regions.filter((F.col("rows") > NEAR + 1) & (F.col("tops") > 1)).select("region", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return durable(rows.join(regions, ["region", "salt"], "left_semi").select("set_key", "top", "n").distinct(), "crowd")


AT_ONCE = 500_000  # shingles that a task hands on at a time


def _shingles(batches):
    """A row for each shingle of each set."""
    for batch in batches:
        keys, sizes, members = batch.column(0), [], []
        held, begun = 0, 0
        for i, m in enumerate(batch.column(1).to_pylist()):
            members.append(np.frombuffer(m, np.int64))
            sizes.append(len(members[-1]))
            held += sizes[-1]
            if held >= AT_ONCE or i + 1 == batch.num_rows:
                of = np.repeat(np.arange(begun, i + 1), sizes)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(np.concatenate(members))], names=["set_key", "shingle"])
                held, begun, sizes, members = 0, i + 1, [], []


SMALL = 256  # rows of a shingle that are compared as they are; more are dealt by sizes first
CELL = 2_048  # rows on a side of what is compared at once
BAND = 1.02  # sizes of a band differ by this factor at most


def _band(n):
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(BAND))).cast("int")


def _rare_shingles(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, set_key, top, n, place): where each set's rarest shared shingles stand in it; written.

    A set's shingles are ordered by the number of crowded sets that have them, the rarest
    first. Of two sets alike enough, the first common shingle stands early in both, with
    enough shingles after it to make up what they must share; so only the first ones count,
    and of these those that no other set has don't.
    """
    members = crowd.select("set_key").join(sets, "set_key").select("set_key", "members")
    rows = durable(members.mapInArrow(_shingles, "set_key binary, shingle long"), "shingles")
    counts = durable(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1"), "shared-shingles")
    total = int(crowd.agg(F.sum("n")).first()[0] or 0)
    shared = join_unique(rows, counts, "shingle", total, inner=True)
    ordered = shared.groupBy("set_key").agg(F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("s")).join(crowd, "set_key")
    alone = F.col("n") - F.size("s")  # these come first, and meet nothing
    first = F.greatest(F.lit(0), F.floor(F.col("n") * (100 - percent) / 100) + 1 - alone).cast("int")
    ordered = ordered.select("set_key", "top", "n", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), first)).alias("i", "x"))
    out = durable(ordered.select(F.col("x.shingle").alias("shingle"), "set_key", "top", "n", (F.col("alone") + F.col("i")).cast("long").alias("place")), "rare-shingles")
    discard(rows, counts)
    return out


def _reaches(percent: int, partner: str):
    """Whether a set's shingles from its place on are enough for a partner of so many."""
    return (F.col("n") - F.col("place")) * (100 + percent) >= percent * (F.col("n") + F.col(partner))


def _groups(rows: DataFrame, key: list[str], percent: int) -> DataFrame:
    """Rows in groups with sets of more than one component: with the group's size, those outside its largest component, and that.

    What no partner in its group can be alike enough to is left out before: at its place the
    set has too few shingles left even for the group's smallest, and what is in the largest
    component meets only those outside it.
    """
    total = rows.count()

    def grouped(d: DataFrame) -> DataFrame:
        parts = d.groupBy(*key, "top").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"))
        groups = parts.groupBy(*key).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("tops"), F.max(F.struct("rows", "top")).alias("main"), F.min("least").alias("least"))
        return groups.filter("tops > 1").select(*key, "rows", (F.col("rows") - F.col("main.rows")).alias("outside"), F.col("main.top").alias("main"), "least")

    def joined(d: DataFrame, g: DataFrame) -> DataFrame:
        if len(key) > 1:
            return d.join(g, key)
        return join_unique(d, g, key[0], total, inner=True)

    near = joined(rows, durable(grouped(rows).select(*key, "least"), "groups")).filter(_reaches(percent, "least")).drop("least")
    near = durable(near, "near-rows")
    near = durable(joined(near, durable(grouped(near).drop("least"), "groups")), "near-rows")
    reach = F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent) - F.col("n")
    asking = near.filter("top <> main").groupBy(*key).agg(F.min("n").alias("least"), F.max(reach).alias("most"))
    of_main = (F.col("n") <= F.col("most")) & _reaches(percent, "least")
    asked = joined(near, durable(asking, "asking")).filter((F.col("top") != F.col("main")) | of_main).drop("least", "most", "rows", "outside")
    asked = durable(asked, "near-rows")
    sizes = asked.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("top") != F.col("main"), 1)).alias("outside"))
    return joined(asked, durable(sizes, "groups"))


def _meet(percent: int):
    def meet(table: pa.Table) -> pa.Table:
        """Pairs of one shingle that can be alike enough and lie in different components."""
        keys, asks = table["set_key"].to_pylist(), np.array(table["asks"].to_pylist(), dtype=bool)
        _, top = np.unique(np.array(table["top"].to_pylist(), dtype=object), return_inverse=True)
        n, place, own = (table[c].to_numpy() for c in ("n", "place", "own"))
        split = table["low"][0].as_py() != table["high"][0].as_py()
        there, left = np.flatnonzero(~asks), n - place
        a, b = [], []
        for i in np.flatnonzero(asks):
            # Common shingles are at most those from here on, in either set.
            least = np.minimum(left[i], left[there]) * (100 + percent) >= percent * (n[i] + n[there])
            for j in there[least & (top[there] != top[i]) & ((own[there] != own[i]) | (not split))]:
                a.append(min(keys[i], keys[j]))
                b.append(max(keys[i], keys[j]))
        return pa.table([binary(a), binary(b)], names=["a", "b"]).group_by(["a", "b"]).aggregate([])

    return meet


def _hidden(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of crowded sets in different components that can share ``percent``; none else of these is.

    Sets meet in the shingles that are rare among them. Where one shingle has many, they are
    dealt by bands of sizes, each set to the bands in which a partner may lie for its place:
    texts made from one template, whose own words come first, then meet in none. A group's
    sets outside its largest component are compared with all of it, in blocks of a bounded
    number of rows of some fifty bytes, and only pairs that pass leave a task.
    """
    rows = durable(_groups(_rare_shingles(crowd, sets, percent), ["shingle"], percent), "grouped")
    none = F.lit(-1)
    few = rows.filter(F.col("rows") <= SMALL).select("*", none.alias("low"), none.alias("high"), none.alias("own"))
    many = rows.filter(F.col("rows") > SMALL).drop("rows", "outside", "main")
    least = F.ceil(F.col("n") * percent / 100)
    most = F.least(F.floor(F.col("n") * 100 / percent), F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent) - F.col("n"))
    many = many.filter(least <= most).withColumn("own", _band(F.col("n"))).withColumn("other", F.explode(F.sequence(_band(least), _band(most))))
    many = many.select("shingle", "set_key", "top", "n", "place", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own")
    key = ["shingle", "low", "high"]
    many = _groups(durable(many, "banded"), key, percent)
    blocks = lambda c: F.ceil(F.col(c) / CELL).cast("int")
    dealt = few.unionByName(many.select(*few.columns)).withColumn("down", blocks("rows")).withColumn("across", blocks("outside"))
    own = lambda c: F.pmod(F.xxhash64("set_key"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    light = [*key, "set_key", "top", "n", "place", "own"]
    there = dealt.select(*light, F.lit(False).alias("asks"), own("down").alias("block"), every("across").alias("side"))
    ask = dealt.filter("top <> main").select(*light, F.lit(True).alias("asks"), every("down").alias("block"), own("across").alias("side"))
    return there.union(ask).groupBy(*key, "block", "side").applyInArrow(_meet(percent), "a binary, b binary").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, leads: bool = False) -> DataFrame:
    """The component of near copies of every document.

    Columns: ``id_col``, n_shingles, component_id, kept; with ``leads``, also text_key (MD5 of
    the text) and first. Two documents are linked when 100 * intersection >= percent * union of
    their shingle sets; component_id is the least id that links reach, and kept says that the
    document has it. first is true for one (id, text) of each component: the least id, null
    ids last, then the least text_key.

    Null and empty texts and texts without words have an empty set, are linked with nothing
    and are kept. Equal sets are one node, so copies cost no pairs. Rows that repeat an id
    share its verdict; null ids come last, and a component without any id has a null
    component_id and is kept. An empty table gives an empty table; other columns don't
    matter, whatever their names. Two sets that share 80 in 100 shingles meet in no tree
    with a probability of 0.0002, and less the more they share.
    """
    d = pick(df, _id=id_col, _text=text_col).withColumn("_text", as_bytes("_text"))
    kind = d.schema["_id"].dataType.simpleString()
    signed = durable(d.mapInArrow(_sign(shingle), f"_id {kind}, n_shingles long, set_key binary, text_key binary, signature binary"), "signed")
    candidates = _candidates(signed)

    ends = candidates.select(F.col("a").alias("set_key")).union(candidates.select(F.col("b").alias("set_key"))).distinct()
    nodes = signed.join(ends, "set_key").groupBy("set_key").agg(F.max(F.struct("text_key", "signature")).alias("x"), F.max("n_shingles").alias("n"))
    nodes = durable(nodes.select("set_key", "n", "x.text_key", "x.signature"), "nodes")
    sets = _sets_of(d, nodes.select("set_key", "text_key"), shingle, power_of_two(input_bytes(df, 1 << 30) / 100, 18, 29))

    # Round 1: each set with the candidate that shares most with it.
    turned = candidates.union(candidates.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    best = turned.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    best = durable(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "best")
    tops = _merged(nodes.select("set_key", F.col("set_key").alias("top")), _confirmed(best, sets, percent))
    # Round 2: the other candidates, round 3: what crowded regions hide, as far as still apart.
    rest = _apart(candidates.join(best, ["a", "b"], "left_anti"), tops)
    tops = _merged(tops, _confirmed(rest, sets, percent))
    crowd = _crowd(nodes, tops)
    if not crowd.isEmpty():
        tops = _merged(tops, _confirmed(_hidden(crowd, sets, percent), sets, percent))

    # Copies are one row, then components, before anything meets the documents again.
    of = [F.min("_id").alias("least")] + ([F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "text_key")).alias("lead")] if leads else [])
    names = [x for x in ("least", "lead") if x == "least" or leads]
    own = durable(signed.filter("set_key is not null").groupBy("set_key").agg(*of).join(tops, "set_key", "left"), "own")
    joined = own.filter("top is not null")
    least = durable(joined.groupBy("top").agg(*[F.min(x).alias(x) for x in names]), "least")
    linked = join_unique(joined.select("set_key", "top"), least, "top", joined.count(), inner=True).select("set_key", *names)
    verdicts = durable(own.filter("top is null").select("set_key", *names).union(linked), "verdicts")

    columns = ["_id", "n_shingles", "set_key"] + (["text_key"] if leads else [])
    final = join_unique(signed.select(*columns), verdicts, "set_key", signed.count())
    component = F.when(F.col("set_key").isNull(), F.col("_id")).otherwise(F.col("least"))
    kept = F.col("_id").eqNullSafe(component)
    out = [F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), kept.alias("kept")]
    if leads:
        out += ["text_key", (kept & (F.col("set_key").isNull() | (F.col("text_key") == F.col("lead.text_key")))).alias("first")]
    return final.select(*out)


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Components of documents that share 80 in 100 of their four-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)
