"""Bounded-space online packing of token sequences.

Each task keeps a fixed number of open windows. A document goes into the window that it
fills best; when it fits in none, the fullest is closed and a new one opened. Before a
window is closed with room worth a cut, the head of the waiting document fills it: that is
the only place where a document shorter than a window is cut. Windows still open when a
task ends are merged, a bounded number to a task, best fit first, without cutting anything
or moving a token. A task's memory is its open windows, whatever it reads.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.arrays import as_bytes, binary, spread
from cairn.plans.durable import durable, pick

MEMO = 400_000  # remembered parts of a worker, twice
AT_ONCE = 8 << 20  # bytes of text that are cut at a time
# Pieces of other characters are asked for whole. In the rest only ASCII marks end a part;
# not where a part may be a contraction or a text may hold an added token.
OTHER = r"[^!-~À-ÖØ-öø-įı-ɏ]|'|<\|"
MARKS = r"([!-/:-@\[-`{-~]+)"


class WordTokens:
    """Ids of texts, for tokenizers that drop white space and never look across it.

    A text's ids are those of its pieces one after another, and a piece's those of its
    letters and its marks, in lower case. So only distinct parts are asked for: texts are
    cut and counted in Arrow, parts are remembered up to a fixed number, and the ids put
    together in numpy.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, parts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        ask = []
        for x in parts:
            if x not in memo:
                if x in older:
                    memo[x] = older[x]
                else:
                    ask.append(x)
        for x, e in zip(ask, self.tokenizer.encode_batch_fast(ask, add_special_tokens=False), strict=True):
            memo[x] = array("I", e.ids).tobytes()
        return [memo[x] for x in parts]

    def _encode(self, values: pa.Array) -> list[np.ndarray]:
        words = pc.ascii_split_whitespace(values)
        cut = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        code, pieces = coded.indices.to_numpy(), coded.dictionary
        whole = pc.match_substring_regex(pieces, OTHER)
        split = pc.replace_substring_regex(pc.ascii_lower(pieces), MARKS, r" \1 ")
        parts = pc.ascii_split_whitespace(pc.if_else(whole, pieces, split))
        part_cut = parts.offsets.to_numpy().astype(np.int64)
        part_coded = parts.flatten().dictionary_encode()
        part_code, ids = part_coded.indices.to_numpy(), self._ids(part_coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, count=len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), "<u4")
        starts = np.cumsum(sizes) - sizes
        # Words to parts to ids.
        of_word = part_code[spread(part_cut[:-1][code], np.diff(part_cut)[code])]
        out = flat[spread(starts[of_word], sizes[of_word])]
        of_piece = np.diff(np.r_[0, np.cumsum(sizes[part_code])][part_cut])
        ends = np.r_[0, np.cumsum(of_piece[code])][cut]
        return [out[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, values: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each of some texts (binary, UTF-8); null is empty."""
        values = values.cast(pa.binary()).fill_null(b"")
        sizes = np.cumsum(pc.binary_length(values).to_numpy())
        at = 0
        while at < len(values):
            before = sizes[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, before + AT_ONCE, side="right")))
            yield from self._encode(values.slice(at, upto - at).cast(pa.string()))
            at = upto


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


class OpenWindows:
    """Best fit over a fixed number of open windows, kept in order of what they hold.

    ``place`` gives the windows that it closes. A window is a list of pieces
    (document, start, length); a piece's size is its length.
    """

    def __init__(self, size: int, count: int, least_cut: int):
        self.size, self.count, self.least_cut = size, count, least_cut
        self.held: list[tuple[int, int]] = []  # (filled, number), ascending
        self.windows: dict[int, list] = {}
        self.next = 0

    def place(self, doc: int, length: int) -> list[list]:
        closed, start = [], 0
        while length - start >= self.size:
            closed.append([(doc, start, self.size)])
            start += self.size
        left = length - start
        if not left:
            return closed
        at = bisect_left(self.held, (self.size - left + 1, -1)) - 1  # the fullest with room
        if at < 0 and len(self.held) >= self.count:
            filled, number = self.held.pop()
            window, room = self.windows.pop(number), self.size - filled
            if room >= self.least_cut and left - room >= self.least_cut:
                window.append((doc, start, room))
                start, left = start + room, left - room
            closed.append(window)
        elif at >= 0:
            filled, number = self.held.pop(at)
            window = self.windows[number]
            window.append((doc, start, left))
            if filled + left == self.size:
                closed.append(self.windows.pop(number))
            else:
                insort(self.held, (filled + left, number))
            return closed
        insort(self.held, (left, self.next))
        self.windows[self.next] = [(doc, start, left)]
        self.next += 1
        return closed

    def rest(self) -> list[list]:
        return [self.windows[n] for _, n in reversed(self.held)]


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, part long, window long, offset long, leftover boolean"
MERGED = 1 << 20  # numbers of merging groups begin here; no task's number comes so far


def _pack(path: str, end_id: int, size: int, count: int, least_cut: int, with_ids: bool):
    tail = np.array([end_id], "<u4")

    def pack(batches):
        tokens = word_tokens(path)
        part = TaskContext.get().partitionId()
        open_, number = OpenWindows(size, count, least_cut), 0
        held: dict[int, list] = {}  # of documents with pieces in open windows: id, tokens, packed ids, pieces to come
        out: list[list] = []
        doc = 0

        def close(window, leftover):
            nonlocal number
            offset = 0
            for d, start, length in window:
                x = held[d]
                ids = x[2][4 * start : 4 * (start + length)]
                out.append([x[0], start, length, zlib.crc32(ids), x[1], part, number, offset, leftover, ids if with_ids else None])
                offset += length
                x[3] -= length
                if not x[3]:
                    del held[d]
            number += 1

        def emit(schema):
            cols = list(zip(*out, strict=True)) or [()] * 10
            out.clear()
            arrays = [pa.array(cols[0], schema)] + [pa.array(c, pa.int64()) for c in cols[1:8]] + [pa.array(cols[8], pa.bool_()), binary(list(cols[9]))]
            return pa.RecordBatch.from_arrays(arrays, names=["_id", *[x.split()[0] for x in PIECES.split(", ")], "ids"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for i, found in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1)), strict=True):
                ids = np.append(found, tail).tobytes()
                n = len(ids) // 4
                held[doc] = [i, n, ids, n]
                for window in open_.place(doc, n):
                    close(window, False)
                doc += 1
                if len(out) >= 20_000:
                    yield emit(kind)
        for window in open_.rest():
            close(window, True)
        if out:
            yield emit(kind)

    return pack


def _merge(size: int):
    """Leftover windows of one group, packed best fit from the longest down."""

    def merge(table: pa.Table) -> pa.Table:
        window = list(zip(table["part"].to_pylist(), table["window"].to_pylist(), strict=True))
        sizes: dict[tuple, int] = {}
        for key, n in zip(window, table["length"].to_pylist(), strict=True):
            sizes[key] = sizes.get(key, 0) + n
        held: list[tuple[int, int]] = []
        target: dict[tuple, tuple[int, int]] = {}
        number = 0
        for key, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
            at = bisect_left(held, (size - n + 1, -1)) - 1
            filled, to = held.pop(at) if at >= 0 else (0, number)
            number += at < 0
            target[key] = (to, filled)
            insort(held, (filled + n, to))
        put = lambda name, values: table.set_column(table.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        table = put("offset", [target[k][1] + o for k, o in zip(window, table["offset"].to_pylist(), strict=True)])
        return put("window", [target[k][0] for k in window])

    return merge


MERGED_AT_A_TIME = 2_048  # windows of a merging group; with ids, 32 MiB


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, size: int = 4096, open_windows: int = 64, least_cut: int = 32, with_ids: bool = False) -> DataFrame:
    """Pack every document's ids, closed by ``end_id``, into sequences of ``size`` at most.

    One row per piece: ``id_col``, start (ids of its document before it), length, ids_crc32
    (of the ids as little-endian 32-bit values), doc_tokens, sequence_id, offset (place in
    its sequence, gapless from 0), and with ``with_ids`` the packed ids.

    Null, empty and blank texts are one id long. Rows that repeat an id are documents of
    their own; null ids pass through; a document of several windows fills them one after
    another; an empty table gives an empty table; other columns don't matter. The pieces
    are written once, so a sequence never depends on which executor reads them again.
    """
    spark = df.sparkSession
    d = pick(df, _id=id_col, _text=text_col).withColumn("_text", as_bytes("_text"))
    kind = d.schema["_id"].dataType.simpleString()
    pieces = durable(d.mapInArrow(_pack(tokenizer_path, end_id, size, open_windows, least_cut, with_ids), f"_id {kind}, {PIECES}, ids binary"), "pieces")

    full, left = pieces.filter("not leftover"), pieces.filter("leftover")
    groups = 1 + left.select("part", "window").distinct().count() // MERGED_AT_A_TIME
    left = left.withColumn("group", F.pmod(F.xxhash64("part", "window"), F.lit(groups)).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields)
    left = left.groupBy("group").applyInArrow(_merge(size), schema).withColumn("part", F.col("group") + MERGED)
    both = full.unionByName(left.drop("group"))
    out = [F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("part") * (1 << 40) + F.col("window")).alias("sequence_id"), "offset"]
    return both.select(*out, *(["ids"] if with_ids else []))


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packed_sequences(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe())
