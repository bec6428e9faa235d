"""Numpy pieces that the corpus operators share: words, hashes, bitmaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of anything but space and TAB to CR: ``bytes.split`` cuts at just these."""
    return text.split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all (splitmix's finisher)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def binary(values: list) -> pa.Array:
    return pa.array(values, type=pa.binary())


def texts(batch: pa.RecordBatch, name: str) -> list:
    """A binary or string column as bytes."""
    c = batch.column(batch.schema.get_field_index(name))
    return (c if pa.types.is_binary(c.type) else c.cast(pa.binary())).to_pylist()


def power_of_two(x: float, least: int, most: int) -> int:
    """The bits of the first power of two that is not under ``x``, within limits."""
    return min(most, max(least, int(np.ceil(np.log2(max(1.0, x))))))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


SLICE_BITS = 18  # a slice of a bitmap has so many cells; it is what one merging step holds


def split_cells(cells: np.ndarray, slice_bits: int = SLICE_BITS) -> list[tuple[int, np.ndarray]]:
    """Sorted cells by slice: slice number, cells within it as uint32."""
    if not len(cells):
        return []
    k = (cells >> U(slice_bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(k)) + 1
    low = (cells & U((1 << slice_bits) - 1)).astype(np.uint32)
    return list(zip(k[np.r_[0, cuts]].tolist(), np.split(low, cuts), strict=True))


PIECES = "slice int, once binary, more binary"


def _merged(pieces: DataFrame, slice_bits: int, give, schema: str) -> DataFrame:
    """Sum sketches of partitions, cell by cell; ``give(slice, cells)`` of those with two or more.

    ``pieces`` has a slice's cells that a partition met once and those it met more often.
    Each slice is merged by one task that reads its pieces one after another and keeps one
    byte per cell, whatever their number.
    """

    def merge(batches):
        at, seen = None, None
        for batch in batches:
            for k, once, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != at:
                    if at is not None and (seen >= 2).any():
                        yield give(at, seen >= 2)
                    at, seen = k, np.zeros(1 << slice_bits, np.uint8)
                cells = np.frombuffer(once, np.uint32)
                seen[cells] = np.minimum(seen[cells] + 1, 2)
                seen[np.frombuffer(more, np.uint32)] = 2
        if at is not None and (seen >= 2).any():
            yield give(at, seen >= 2)

    return pieces.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, schema)


def repeated_cells(pieces: DataFrame, slice_bits: int) -> DataFrame:
    """slice, cells (packed uint32): the cells that count two or more."""
    give = lambda k, hit: pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), binary([np.flatnonzero(hit).astype(np.uint32).tobytes()])], names=["slice", "cells"])
    return _merged(pieces, slice_bits, give, "slice int, cells binary")


def merge_pieces(pieces: DataFrame) -> dict[int, bytes]:
    """The cells that count two or more as bits, by slice.

    The answer has 2**SLICE_BITS / 8 bytes for each slice that has such a cell, and the
    number of slices is fixed by the bitmap's width.
    """
    give = lambda k, hit: pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), binary([np.packbits(hit, bitorder="little").tobytes()])], names=["slice", "bits"])
    return {r.slice: bytes(r.bits) for r in _merged(pieces, SLICE_BITS, give, "slice int, bits binary").collect()}


def bitmap(slices: dict[int, bytes], cell_bits: int) -> bytes:
    """One bitmap of 2**cell_bits cells from its slices."""
    out = bytearray(max(1, (1 << cell_bits) // 8))
    step = (1 << SLICE_BITS) // 8
    for k, bits in slices.items():
        out[k * step : (k + 1) * step] = bits
    return bytes(out)


def has(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Which cells are set."""
    return (bits[(cells >> U(3)).astype(np.int64)] >> (cells & U(7)).astype(np.uint8)) & np.uint8(1) != 0


def input_bytes(df: DataFrame, otherwise: int) -> int:
    """Spark's estimate of what a plan reads; ``otherwise`` where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if 0 < n < 1 << 60 else otherwise


def as_bytes(name: str):
    return F.col(name).cast("string").cast("binary")
