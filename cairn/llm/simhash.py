"""SimHash fingerprints, and all pairs of them within a Hamming radius.

A text's terms are its pairs of neighbouring words (a lone word is one), weighted by their
letters and their number; every term's hash votes on each of 128 signed bits. For a radius
r the bits are cut into r + 1 blocks: of two fingerprints within it one block is equal, so
they meet in one of r + 1 tables, each the fingerprints permuted to begin with its block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.arrays import U, as_bytes, binary, hash_words, input_bytes, mixed, texts, words_of
from cairn.llm.skew import join_unique
from cairn.plans.durable import durable, pick

BITS = 128
SIGNS = ((np.arange(256)[:, None] >> np.arange(8)) & 1) * 2.0 - 1.0  # a byte's eight votes
AT_ONCE = 400_000  # terms that vote at a time


def fingerprints(values: list[bytes]) -> list[bytes]:
    """128 bits of each text; without words, all zero."""
    out: list[bytes] = []
    i = 0
    while i < len(values):
        terms, weights, n, j = [], [], 0, i
        while j < len(values) and (j == i or n < AT_ONCE):
            words = words_of(values[j].lower())
            h = hash_words(words)
            letters = np.fromiter(map(len, words), np.float64, count=len(words))
            if len(h) > 1:
                h, letters = h[:-1] * U(3) + mixed(h[1:]), letters[:-1] + letters[1:]
            terms.append(mixed(h))
            weights.append(letters)
            n += len(h)
            j += 1
        t, w = np.concatenate(terms), np.concatenate(weights)
        doc = np.repeat(np.arange(j - i), [len(x) for x in terms]) << 8
        votes = np.empty((j - i, BITS))
        for half in range(BITS // 64):
            of = mixed(t + U(half)).view(np.uint8).reshape(-1, 8)
            for k in range(8):
                met = np.bincount(doc + of[:, k], weights=w, minlength=(j - i) << 8).reshape(-1, 256)
                votes[:, 64 * half + 8 * k : 64 * half + 8 * k + 8] = met @ SIGNS
        out += [row.tobytes() for row in np.packbits(votes > 0, axis=1)]
        i = j
    return out


def _likeness(a: list[bytes], b: list[bytes]) -> list[float]:
    x = np.frombuffer(b"".join(a), np.uint8) ^ np.frombuffer(b"".join(b), np.uint8)
    return (1 - np.bitwise_count(x.reshape(-1, BITS // 8)).sum(axis=1) / BITS).tolist()


FIELDS = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _judge(kind: pa.DataType, ids: list, values: list[bytes], marks: list[bytes], nexts: list[bytes], next_marks: list[bytes]) -> list:
    """The columns of FIELDS for documents and those that follow them."""
    chars = [v.decode() for v in values]
    edited = [(s[: len(s) - len(s) // 2] + x.decode()[: len(s) // 2]).encode() for s, x in zip(chars, nexts, strict=True)]
    edited_marks = fingerprints(edited)
    sums = pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string())
    return [pa.array(ids, kind), pa.array([len(s) for s in chars], pa.int64()), sums, binary(marks), binary(edited_marks), pa.array(_likeness(marks, edited_marks), pa.float64()), pa.array(_likeness(marks, next_marks), pa.float64())]


def _squeeze(batches):
    """Texts compressed one by one: what the ranges' shuffle writes is a third less."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), binary([squeeze.compress(v or b"") for v in texts(batch, "_text")])], names=["_id", "_text"])


RANGE_BYTES = 64 << 20  # of the input to a range of ids
NAMES = ["_id", *[f.split()[0] for f in FIELDS.split(", ")]]
ENDS = "part long, head binary, head_mark binary, tail binary, tail_mark binary"


def _sequence(batches):
    """Documents of a sorted range with their successors; its two ends as a row apart."""
    part = TaskContext.get().partitionId()
    kind, held, head, squeezed = None, None, None, zstandard.ZstdDecompressor()
    for batch in batches:
        kind = batch.column(0).type
        ids, values = batch.column(0).to_pylist(), [squeezed.decompress(v) for v in texts(batch, "_text")]
        if not ids:
            continue
        marks = fingerprints(values)
        head = head or (values[0], marks[0])
        if held:
            ids, values, marks = [held[0], *ids], [held[1], *values], [held[2], *marks]
        held = (ids[-1], values[-1], marks[-1])
        if len(ids) > 1:
            cols = _judge(kind, ids[:-1], values[:-1], marks[:-1], values[1:], marks[1:])
            none = pa.nulls(len(ids) - 1, pa.binary())
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(none), pa.int64()), none, none, none, none], names=[*NAMES, *[f.split()[0] for f in ENDS.split(", ")]])
    if held:
        row = {"_id": pa.array([held[0]], kind), "part": pa.array([part], pa.int64()), "head": binary([head[0]]), "head_mark": binary([head[1]]), "tail": binary([held[1]]), "tail_mark": binary([held[2]])}
        types = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
        names = [*NAMES, *[f.split()[0] for f in ENDS.split(", ")]]
        yield pa.RecordBatch.from_arrays([row[n] if n in row else pa.nulls(1, types.get(n, pa.binary())) for n in names], names=names)


def _across(batches):
    for batch in batches:
        col = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()  # noqa: E731,B023
        if batch.num_rows:
            cols = _judge(batch.column(0).type, col("_id"), col("tail"), col("tail_mark"), col("head"), col("head_mark"))
            yield pa.RecordBatch.from_arrays(cols, names=NAMES)


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; written.

    Columns: ``id_col``, n_chars, edited_sha256, fingerprint and edited_fingerprint (16
    bytes), near_edited, near_next (1 less the share of bits that differ). The edited text's
    last half is the head of the next document's, by id; the first follows the last.

    Documents are dealt out by ranges of ids, once; a range hands only its first and last
    document on. Null texts are empty; texts without words have a zero fingerprint; null
    ids come first; rows with one id follow each other in a fixed order; a lone document
    follows itself; an empty table gives an empty table; other columns don't matter.
    """
    d = pick(df, _id=id_col, _text=text_col).withColumn("_text", as_bytes("_text"))
    kind = d.schema["_id"].dataType.simpleString()
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df, 1 << 30) // RANGE_BYTES)
    dealt = d.mapInArrow(_squeeze, f"_id {kind}, _text binary").repartitionByRange(n, "_id").sortWithinPartitions("_id", "_text")
    done = durable(dealt.mapInArrow(_sequence, f"_id {kind}, {FIELDS}, {ENDS}"), "fingerprints")
    ends = done.filter("part is not null")
    # One number per range; texts meet by a join on it.
    order = ends.select("part").withColumn("after", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))))
    tails = ends.select("_id", "part", "tail", "tail_mark").join(order, "part")
    across = tails.join(ends.select(F.col("part").alias("after"), "head", "head_mark"), "after").select("_id", "tail", "tail_mark", "head", "head_mark")
    last = across.mapInArrow(_across, f"_id {kind}, {FIELDS}")
    return done.filter("part is null").select(*NAMES).union(last).withColumnRenamed("_id", id_col)


CELL = 2_048  # fingerprints on a side of what is compared at once


def _masks(radius: int) -> np.ndarray:
    """The bits of each block, a row of two words each."""
    if not 0 < radius < 16:
        raise ValueError("radius must be from 1 to 15")
    cuts = np.linspace(0, BITS, radius + 2).round().astype(int).tolist()
    rows = [np.packbits([cuts[k] <= i < cuts[k + 1] for i in range(BITS)]) for k in range(radius + 1)]
    return np.stack(rows).view(U)


def _dealt(marks: DataFrame, masks: np.ndarray, mark_col: str) -> DataFrame:
    """The permuted tables' buckets in cells: m, table, key, own, x, y.

    A bucket of any size is cut into blocks, and a cell is two blocks of it.
    """
    m = durable(pick(marks, m=mark_col).filter("m is not null").distinct(), "marks")

    def permute(batches):
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), U).reshape(-1, BITS // 64)
            for k, mask in enumerate(masks):
                first = rows & mask
                key = mixed(first[:, 0] + U(k)) ^ mixed(first[:, 1] + U(k + 99))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k] * len(rows), pa.int32()), pa.array(key.view(np.int64))], names=["m", "table", "key"])

    tables = m.mapInArrow(permute, "m binary, table int, key long")
    sizes = durable(tables.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    total = int(sizes.agg(F.sum("n")).first()[0] or 0)
    rows = join_unique(tables, sizes, "key", total, inner=True, counts=sizes.select("key", F.col("n").alias("__n")))
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / CELL).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int"))
    rows = rows.select("key", "table", "m", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return rows.select("key", "table", "m", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))


def _near(table: pa.Table, masks: np.ndarray, radius: int):
    """Of one cell, each row with the later rows within the radius and their distances.

    A pair that an earlier table has brought together too is left to that table, so every
    pair comes once.
    """
    rows = np.frombuffer(b"".join(table["m"].to_pylist()), U).reshape(-1, BITS // 64)
    own, x, y, k = table["own"].to_numpy(), table["x"][0].as_py(), table["y"][0].as_py(), table["table"][0].as_py()
    right = np.flatnonzero(own == y)
    for i in np.flatnonzero(own == x):
        others = right if x != y else right[right > i]
        apart = rows[others] ^ rows[i]
        distance = np.bitwise_count(apart).sum(axis=1)
        fit = distance <= radius
        for mask in masks[:k]:
            fit &= ((apart & mask) != 0).any(axis=1)
        yield i, others[fit], distance[fit]


def within_radius(marks: DataFrame, radius: int = 3, mark_col: str = "fingerprint") -> DataFrame:
    """Pairs (a < b) of distinct fingerprints that differ in ``radius`` bits at most: a, b, distance.

    Equal fingerprints are one. Two blocks of a bucket are compared by one task, which gives
    the pairs within the radius and no other. Null fingerprints are left out; no fingerprints
    give no pairs. Where a number is enough, ``near_marks`` gives it without the pairs.
    """
    masks = _masks(radius)

    def compare(table: pa.Table) -> pa.Table:
        keys, a, b, apart = table["m"].to_pylist(), [], [], []
        for i, others, distance in _near(table, masks, radius):
            a += [min(keys[i], keys[j]) for j in others]
            b += [max(keys[i], keys[j]) for j in others]
            apart += distance.tolist()
        return pa.table([binary(a), binary(b), pa.array(apart, pa.int32())], names=["a", "b", "distance"])

    return _dealt(marks, masks, mark_col).groupBy("key", "table", "x", "y").applyInArrow(compare, "a binary, b binary, distance int")


def near_marks(marks: DataFrame, radius: int = 3, mark_col: str = "fingerprint") -> DataFrame:
    """The number of other distinct fingerprints within ``radius`` bits: fingerprint, near_marks.

    Tasks count, and Spark adds their counts: at most a row per fingerprint and cell leaves
    them. Fingerprints without any such other have no row.
    """
    masks = _masks(radius)

    def count(table: pa.Table) -> pa.Table:
        met = np.zeros(table.num_rows, np.int64)
        for i, others, _ in _near(table, masks, radius):
            met[i] += len(others)
            met[others] += 1
        some = np.flatnonzero(met)
        return pa.table([table["m"].combine_chunks().take(pa.array(some)), pa.array(met[some])], names=["fingerprint", "n"])

    counts = _dealt(marks, masks, mark_col).groupBy("key", "table", "x", "y").applyInArrow(count, "fingerprint binary, n long")
    return counts.groupBy("fingerprint").agg(F.sum("n").alias("near_marks"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and how many others lie within three bits of each."""
    done = compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    near = durable(near_marks(done, radius=3), "near-marks")
    out = join_unique(done, near, "fingerprint", done.count(), nulls=False)
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_chars", "edited_sha256", hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next", F.coalesce("near_marks", F.lit(0)).cast("long").alias("near_marks"))
