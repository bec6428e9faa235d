"""Substring dedup: a count-min prefilter, then exact groups of what it lets through.

A window is ``length`` consecutive words. Its anchor is the least hash of the shorter grams
in it, so equal windows have equal anchors, and a sketch of anchors counts every window at
least as often as it occurs. The sketches of all partitions are merged; windows whose
anchor is estimated to occur twice are grouped exactly, by 96 bits of two hashes.

The exact step moves windows in blocks, not as rows: a task writes its windows by slice of
the hash space, each distinct hash of a block once; a slice's task answers each block with
a bit per hash; a block's task turns its bits into word ranges of its documents. A passage
in a third of all documents so costs one entry per block, and no task meets it whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.arrays import PIECES, SLICE_BITS, U, as_bytes, binary, bitmap, has, hash_words, input_bytes, merge_pieces, mixed, power_of_two, repeated_cells, split_cells, texts, words_of
from cairn.llm.skew import join_unique
from cairn.plans.durable import discard, durable, pick

GRAM = 16  # words of a gram; the longer, the rarer by chance and the more anchors
BLOCK_WORDS = 1_000_000  # whose hashes a task holds at once
ROWS = 2  # of the sketch
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _rolling(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``length`` values, modulo 2**64."""
    n = len(h)
    up = np.cumprod(np.full(n, base, U))
    down = np.cumprod(np.full(n, pow(base, -1, 1 << 64), U))
    sums = np.zeros(n + 1, U)
    np.cumsum(h * up, out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * down[: n - length + 1])


def _sliding(x: np.ndarray, width: int, pick_one) -> np.ndarray:
    """``pick_one`` (minimum or maximum) over all runs of ``width`` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick_one(x[:-step], x[step:])
        done += step
    return x


class Block:
    """The windows of some documents, laid end to end.

    ``h``: word hashes; ``starts``: whether a window may start at a word; ``least``: the
    anchor of the window that starts there.
    """

    def __init__(self, docs: list[np.ndarray], length: int):
        self.length = length
        self.counts = np.array([len(d) for d in docs], np.int64)
        self.first = np.r_[0, np.cumsum(self.counts)]
        self.h = np.concatenate(docs) if docs else np.zeros(0, U)
        n = len(self.h)
        self.starts = np.zeros(n, bool)
        gram = min(GRAM, length)
        self.span = length - gram + 1
        if n < length:
            self.least = np.zeros(0, U)
            return
        at = np.arange(n)
        self.starts[: n - length + 1] = (at + length <= np.repeat(self.first[1:], self.counts))[: n - length + 1]
        self.grams = _rolling(self.h, gram, BASES[0])
        self.least = _sliding(self.grams, self.span, np.minimum)  # n - length + 1 values

    def anchors(self) -> np.ndarray:
        """The grams that are the least of some window, once for each place."""
        if not len(self.least):
            return np.zeros(0, U)
        live = np.where(self.starts[: len(self.least)], self.least, U(0))
        pad = np.zeros(self.span - 1, U)
        most = _sliding(np.r_[pad, live, pad], self.span, np.maximum)  # of the windows over each gram
        return self.grams[(most == self.grams) & (most > U(0))]


def _cells(values: np.ndarray, cell_bits: int) -> list[np.ndarray]:
    """The cell of each value in each row of the sketch; rows lie one after another."""
    top = U(64 - cell_bits)
    return [(values >> top) + U(0), (mixed(values + U(BASES[1])) >> top) + U(1 << cell_bits)]


def _blocks(batches, column: str, length: int) -> Iterator[tuple[list, Block]]:
    """Cut batches into blocks of about BLOCK_WORDS words: their texts and windows."""
    for batch in batches:
        values = texts(batch, column)
        i = 0
        while i < len(values):
            docs, j, n = [], i, 0
            while j < len(values) and n < BLOCK_WORDS:
                docs.append(hash_words(words_of(values[j])))
                n += len(docs[-1])
                j += 1
            yield values[i:j], Block(docs, length)
            i = j


MOST_BITS = 30  # of the broadcast bitmap: 128 MiB
MOST_SLICE_BITS = 26  # of what a merging task holds, a byte a cell: 64 MiB


def _sketch(docs: DataFrame, length: int, cell_bits: int) -> tuple[bytes, int]:
    """A bitmap of the merged sketch's cells that count two or more, and its width in bits.

    The sketch is as wide as the input asks for, since no task holds more than a slice of
    it. Its repeated cells are few; hashed into a bitmap with eight bits or more for each,
    they are what tasks need to know.
    """
    slice_bits = min(MOST_SLICE_BITS, max(SLICE_BITS, cell_bits - 11))

    def count(batches):
        for _, block in _blocks(batches, "_text", length):
            values, times = np.unique(block.anchors(), return_counts=True)
            for cells in _cells(values, cell_bits):
                order = np.argsort(cells, kind="stable")
                cell, first = np.unique(cells[order], return_index=True)
                many = np.add.reduceat(times[order], first) >= 2 if len(cell) else np.zeros(0, bool)
                once, more = dict(split_cells(cell[~many], slice_bits)), dict(split_cells(cell[many], slice_bits))
                keys = sorted({*once, *more})
                none = np.zeros(0, np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), binary([once.get(k, none).tobytes() for k in keys]), binary([more.get(k, none).tobytes() for k in keys])], names=["slice", "once", "more"])

    repeated = durable(repeated_cells(docs.select("_text").mapInArrow(count, PIECES), slice_bits), "cells")
    n = (repeated.agg(F.sum(F.octet_length("cells"))).first()[0] or 0) // 4
    width = power_of_two(8 * n, SLICE_BITS, MOST_BITS)

    def mark(batches):
        for batch in batches:
            for k, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = split_cells(np.unique(_places((U(k) << U(slice_bits)) + np.frombuffer(cells, np.uint32).astype(U), width)))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), binary([b""] * len(found)), binary([f[1].tobytes() for f in found])], names=["slice", "once", "more"])

    bits = bitmap(merge_pieces(repeated.mapInArrow(mark, PIECES)), width)
    discard(repeated)
    return bits, width


def _places(cells: np.ndarray, width: int) -> np.ndarray:
    """Where the bitmap keeps each cell of the sketch."""
    return mixed(cells) >> U(64 - width)


def cell_bits_for(n_bytes: int) -> int:
    """Width of a row of the sketch: eight cells to an anchor or more.

    One word in ten is an anchor, and a word is taken to be four bytes of the input.
    """
    return power_of_two(n_bytes / 5, 18, 42)


HASH = np.dtype([("a", "<u8"), ("b", "<u4")])
SLICE_BYTES, MOST_SLICES = 8 << 20, 20_000  # of the input to a slice; rows that a block is cut into at most
ANSWER_BYTES = 64 << 20  # of hashes that an answering task holds, or a little more
ENTRIES = "block binary, slice int, hashes binary, twice binary, fresh binary, place binary, firsts binary, keys binary"
SPANS = "array<struct<start: long, end: long>>"


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n, bitorder="little").astype(bool)


def _entries(block: Block, at: np.ndarray, values: list, slices: int) -> pa.RecordBatch:
    """The windows at ``at`` by slice: distinct hashes, which stand there twice, and places.

    ``fresh`` tells where, among the sorted windows of a slice, another hash begins. The
    first row also has where each text of the block begins and the texts' keys.
    """
    one = _rolling(block.h, block.length, BASES[0])[at]
    two = _rolling(block.h, block.length, BASES[1])[at]
    part = ((two >> U(40)) % U(slices)).astype(np.int32)
    low = two.astype(np.uint32)
    order = np.lexsort((low, one, part))
    one, low, part, place = one[order], low[order], part[order], at[order].astype(np.uint32)
    fresh = np.r_[True, (one[1:] != one[:-1]) | (low[1:] != low[:-1]) | (part[1:] != part[:-1])]
    heads = np.flatnonzero(fresh)
    twice = np.diff(np.r_[heads, len(one)]) >= 2
    hashes = np.empty(len(heads), HASH)
    hashes["a"], hashes["b"] = one[heads], low[heads]
    begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = np.r_[begins[1:], len(one)]
    h_begins, h_ends = np.searchsorted(heads, begins), np.searchsorted(heads, ends)
    n, name = len(begins), uuid.uuid4().bytes
    first = [block.first[:-1].astype(np.int64).tobytes()] + [None] * (n - 1)
    keys = [b"".join(hashlib.md5(v or b"").digest() for v in values)] + [None] * (n - 1)
    cols = [
        binary([name] * n),
        pa.array(part[begins], pa.int32()),
        binary([hashes[i:j].tobytes() for i, j in zip(h_begins, h_ends, strict=True)]),
        binary([_bits(twice[i:j]) for i, j in zip(h_begins, h_ends, strict=True)]),
        binary([_bits(fresh[i:j]) for i, j in zip(begins, ends, strict=True)]),
        binary([place[i:j].tobytes() for i, j in zip(begins, ends, strict=True)]),
        binary(first),
        binary(keys),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["block", "slice", "hashes", "twice", "fresh", "place", "firsts", "keys"])


def _split(parts: int):
    """Each block's hashes of a slice in ``parts``, by bits that the slice doesn't depend on."""

    def split(batches):
        for batch in batches:
            out: list[tuple] = []
            for block, k, hashes, twice in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                known = np.frombuffer(hashes, HASH)
                part, flags = _part(known, parts), _flags(twice, len(known))
                for p in np.unique(part).tolist():
                    mine = part == p
                    out.append((block, k, p, known[mine].tobytes(), _bits(flags[mine])))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([binary(cols[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), binary(cols[3]), binary(cols[4])], names=["block", "slice", "part", "hashes", "twice"])

    return split


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes["a"] % U(parts)).astype(np.int64)


def _answer(table: pa.Table) -> pa.Table:
    """A part of a slice: which hashes of each block stand in two blocks, or twice in one."""
    keys = [np.frombuffer(x, HASH) for x in table["hashes"].to_pylist()]
    twice = [_flags(x, len(k)) for x, k in zip(table["twice"].to_pylist(), keys, strict=True)]
    a, b = np.concatenate([k["a"] for k in keys]), np.concatenate([k["b"] for k in keys])
    order = np.lexsort((b, a))
    fresh = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    group = np.cumsum(fresh) - 1
    total = np.bincount(group, weights=1.0 + np.concatenate(twice)[order])
    good = np.empty(len(a), bool)
    good[order] = total[group] >= 2
    replies = [_bits(g) for g in np.split(good, np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table([table["block"], table["slice"], table["part"], binary(replies)], names=["block", "slice", "part", "bits"])


def _spans_of(length: int, parts: int):
    def spans(left: pa.Table, right: pa.Table) -> pa.Table:
        """One block: its repeated windows as word ranges of each text."""
        bits = {(k, p): x for k, p, x in zip(*(right[c].to_pylist() for c in ("slice", "part", "bits")), strict=True)}
        at, first, keys = [np.zeros(0, np.int64)], None, b""
        for row in zip(*(left[c].to_pylist() for c in ("slice", "hashes", "fresh", "place", "firsts", "keys")), strict=True):
            place = np.frombuffer(row[3], np.uint32)
            group = np.cumsum(_flags(row[2], len(place))) - 1
            part = _part(np.frombuffer(row[1], HASH), parts)
            good = np.zeros(len(part), bool)
            for p in np.unique(part).tolist():
                mine = np.flatnonzero(part == p)
                good[mine] = _flags(bits[row[0], p], len(mine))
            at.append(place[good[group]].astype(np.int64))
            if row[4] is not None:
                first, keys = np.frombuffer(row[4], np.int64), row[5]
        at = np.sort(np.concatenate(at))
        doc = np.searchsorted(first, at, side="right") - 1 if len(at) else at
        out_key, out_ranges = [], []
        for i in np.unique(doc).tolist():
            mine = at[slice(*np.searchsorted(doc, [i, i + 1]))] - first[i]
            cut = np.flatnonzero(np.diff(mine) > length) + 1  # windows that touch make one range
            out_key.append(keys[16 * i : 16 * i + 16])
            out_ranges.append([{"start": int(x[0]), "end": int(x[-1]) + length} for x in np.split(mine, cut)])
        return pa.table([binary(out_key), pa.array(out_ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["text_key", "ranges"])

    return spans


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def repeated_ranges(df: DataFrame, text_col: str = "text", length: int = 35, cell_bits: int | None = None, answer_bytes: int = ANSWER_BYTES) -> DataFrame:
    """Word ranges covered by windows that start in more than one place.

    One row for each distinct text that has such a range: ``text_key`` (MD5 of its UTF-8)
    and ``ranges`` (array of struct<start, end>, ascending, disjoint, end exclusive). Copies
    of a text count as places of their own. Null, empty and shorter texts have no windows.
    """
    spark = df.sparkSession
    n_bytes = input_bytes(df, 1 << 30)
    cell_bits = cell_bits or cell_bits_for(n_bytes)
    slices = min(MOST_SLICES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // SLICE_BYTES))
    d = pick(df, _text=text_col).select(as_bytes("_text").alias("_text"))
    sketch, width = _sketch(d, length, cell_bits)
    bits = spark.sparkContext.broadcast(sketch)

    def flag(batches):
        seen = np.frombuffer(bits.value, np.uint8)
        for values, block in _blocks(batches, "_text", length):
            at = np.flatnonzero(block.starts[: len(block.least)])
            for row in range(ROWS):
                at = at[has(seen, _places(_cells(block.least[at], cell_bits)[row], width))]
            if len(at):
                yield _entries(block, at, values, slices)

    entries = durable(d.mapInArrow(flag, ENTRIES), "windows")
    # Slices are of the input; what came through may still be too much of one for a task.
    most = entries.groupBy("slice").agg(F.sum(F.octet_length("hashes")).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-most // answer_bytes))
    asked = entries.select("block", "slice", "hashes", "twice").mapInArrow(_split(parts), "block binary, slice int, part int, hashes binary, twice binary")
    replies = asked.groupBy("slice", "part").applyInArrow(_answer, "block binary, slice int, part int, bits binary")
    mine = entries.select("block", "slice", "hashes", "fresh", "place", "firsts", "keys").groupBy("block")
    ranges = mine.cogroup(replies.groupBy("block")).applyInArrow(_spans_of(length, parts), f"text_key binary, ranges {SPANS}")
    # Copies of a text have the same ranges, from whichever block they come.
    out = durable(ranges.groupBy("text_key").agg(F.first("ranges").alias("ranges")), "ranges")
    bits.unpersist()
    discard(entries)
    return out


CUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cutter(layout: bool):
    def cut(text: pa.Array, ranges: pa.Array) -> pa.Array:
        n_words, n_removed, kept = [], [], []
        for t, gone in zip(text.to_pylist(), ranges.to_pylist(), strict=True):
            words = words_of(t)
            removed = sum(r["end"] - r["start"] for r in gone or ())
            edges = [0, *(x for r in gone or () for x in (r["start"], r["end"])), len(words)]
            runs = [(i, j) for i, j in zip(edges[::2], edges[1::2], strict=True) if i < j]
            n_words.append(len(words))
            n_removed.append(removed)
            if layout and not removed:
                kept.append(t)
            elif layout:
                at = [m.span() for m in WORD.finditer(t)]
                kept.append(b"\n".join(t[at[i][0] : at[j - 1][1]] for i, j in runs))
            else:
                kept.append(b" ".join(w for i, j in runs for w in words[i:j]))
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), binary(kept).cast(pa.string())], names=["n_words", "n_removed", "kept_text"])

    return F.arrow_udf(cut, CUT)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, layout: bool = False, carry: dict[str, str] | None = None, cell_bits: int | None = None, answer_bytes: int = ANSWER_BYTES) -> DataFrame:
    """Take out of every text the words that windows in more than one place cover.

    One row out per row in: ``id_col``, n_words, n_removed, kept_text, ranges, and the
    columns of ``carry`` (new name to old name). kept_text is the kept words joined by one
    space; with ``layout``, an untouched text stays as it is and kept stretches of another
    keep their white space, on lines of their own.

    Null and empty texts have no words and an empty kept_text (with ``layout``, what they
    were). Rows that repeat are copies of each other, so both lose their windows; null and
    tied ids pass through, since rows meet by text only; an empty table gives an empty
    table; other columns don't matter, whatever their names.
    """
    carry = carry or {}
    ranges = repeated_ranges(df, text_col, length, cell_bits, answer_bytes).withColumnRenamed("text_key", "_key")
    d = pick(df, _id=id_col, _text=text_col, **{f"_carry_{k}": v for k, v in carry.items()})
    d = d.withColumn("_text", as_bytes("_text")).withColumn("_key", text_key(F.col("_text")))
    # Copies that a third of all documents are don't meet in one task.
    d = join_unique(d, ranges, "_key", df.count()).withColumn("_cut", _cutter(layout)("_text", "ranges"))
    return d.select(F.col("_id").alias(id_col), "_cut.n_words", "_cut.n_removed", "_cut.kept_text", "ranges", *[F.col(f"_carry_{k}").alias(k) for k in carry])


def op4_repeated_substrings(spark, sf_dir: str) -> DataFrame:
    """Every document without the 35-word windows that stand anywhere else."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS w FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY w) AS c FROM s) WHERE c > 1),
g AS (SELECT DISTINCT r, i + k AS i FROM m, range(0, 35) AS o(k)),
x AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
k AS (SELECT x.r, string_agg(w, ' ' ORDER BY x.i) AS t, count(*) AS n FROM x ANTI JOIN g ON x.r = g.r AND x.i = g.i GROUP BY x.r)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r"""
