"""BPE encoding and decoding with a minimal acyclic lexicon.

The corpus' most frequent words are counted in Spark, and their ids compiled into a minimal
acyclic automaton: equal suffixes share states, and every arc carries the number of words
that it passes over, so that a path's sum is the word's number and that number's row holds
its ids. The automaton is one flat file that Spark hands to every executor and workers map
into memory. A word it doesn't have is merged here, pair by pair in the order of the
vocabulary's merge list; the tokenizer library has no part in it.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import struct
import uuid
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.arrays import as_bytes, binary, spread, texts
from cairn.plans.durable import discard, durable, pick, write_bytes

# Letters and numbers (first and last of a run, in hex) that the tokenizer's
# Unicode version, 16, doesn't have yet. To it they are marks.
NEWER = """558 558 58b 58c 88f 88f c5c c5c cdc cdc 208f 208f 209d 209f a7ce a7cf a7d2 a7d2 a7d4 a7d4 a7dd a7dd
a7e2 a7e2 a7f1 a7f1 ab6c ab6d 107bb 107bf 10940 10959 10ec5 10ec7 10ed9 10eee 11b0a 11b0a 11db0 11ddb 11de0 11de9
11df1 11df1 1246f 1246f 12475 1247f 12550 12686 16ea0 16eb8 16ebb 16ed3 16ff2 16ff6 187f8 187ff 18cd6 18cda 18d09 18d20
18d80 18df2 18e00 19191 191a0 191d2 1b123 1b128 1b168 1b168 1d6a6 1d6a6 1df1f 1df24 1df2b 1df81 1df90 1df96 1dfcd 1dfff
1e6c0 1e6de 1e6e0 1e6e2 1e6e4 1e6e5 1e6e7 1e6ed 1e6f0 1e6f4 1e6fe 1e6ff 2b73a 2b73f 2b81e 2b81e 2cea2 2cead 323b0 33479 3d000 3fc3f"""
_newer = "".join(f"{chr(int(x, 16))}-{chr(int(y, 16))}" for x, y in zip(NEWER.split()[::2], NEWER.split()[1::2], strict=True))
_l, _n = rf"[\p{{L}}--[{_newer}]]", rf"[\p{{N}}--[{_newer}]]"
# Fixed value: how the tokenizer cuts a text into words.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_l}+| ?{_n}+| ?[^\s{_l}{_n}]+|\s+(?!\S)|\s+", regex.V1)
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space beside white space, or at an end: such texts are cut by the whole pattern.
UNEVEN = f"{SPACE}{SPACE}|^{SPACE}|{SPACE}$"
#: Pieces with other characters or a contraction are cut by the whole pattern too.
OTHER = r"[^!-~À-ÖØ-öø-ɏ]|'"
RUNS = r"([!-/:-@\[-`{-~]+|[0-9]+)"
MEMO = 200_000  # remembered words of a worker, twice
AT_ONCE = 4 << 20  # bytes of text that are cut at a time
LONG = 400  # bytes of a word that are merged by a heap


class Merges:
    """The merge list of a byte-level vocabulary, and its added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("lstrip", "rstrip", "single_word", "normalized") if any(t[k] for t in spec["added_tokens"])]
        if odd or spec["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut.get("use_regex", True):
            raise ValueError(f"a byte-level vocabulary without {', '.join(odd) or 'a normalizer or prefix'} is needed")
        ids = model["vocab"]
        self.byte = [ids[c] for _, c in sorted((b, c) for c, b in _byte_of().items())]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for pair in model["merges"]:
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[ids[x], ids[y]] = len(self.made)
            self.made.append(ids[x + y])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"]}
        longest = sorted(self.added, key=lambda a: (-len(a), a))
        self.any_added = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None

    def ids(self, word: bytes) -> list[int]:
        """The lowest pair in the list is merged first, of several the leftmost."""
        if len(word) > LONG:
            return self._long(word)
        parts, get, none = [self.byte[b] for b in word], self.rank.get, len(self.made)
        ranks = [get(x, none) for x in zip(parts, parts[1:])]  # noqa: B905
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def _long(self, word: bytes) -> list[int]:
        """The same for a long word, with a heap over a linked list."""
        parts, n = [self.byte[b] for b in word], len(word)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        get = self.rank.get
        heap = [(r, i) for i, x in enumerate(zip(parts, parts[1:])) if (r := get(x)) is not None]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or get((parts[i], parts[j])) != least:
                continue  # merged with something else meanwhile
            parts[i], parts[j], after[i] = self.made[least], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k))
        return [p for p in parts if p >= 0]

    def pieces(self, text: str) -> list[str]:
        """A text at its added tokens, which stand at odd places."""
        return self.any_added.split(text) if self.any_added else [text]


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


class Builder:
    """Minimal acyclic automaton of sorted words, one word at a time.

    A finished state is looked up by its finality and arcs, so equal suffixes are one state.
    """

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.states: list[tuple[bool, tuple]] = []  # final, ((byte, target), ...)
        self.path: list[list] = [[False, []]]  # of the last word: final, arcs without the open one
        self.word = b""

    def _close(self, depth: int) -> None:
        while len(self.path) - 1 > depth:
            final, arcs = self.path.pop()
            key = (final, tuple(arcs))
            state = self.known.get(key)
            if state is None:
                state = self.known[key] = len(self.states)
                self.states.append(key)
            self.path[-1][1].append((self.word[len(self.path) - 1], state))

    def add(self, word: bytes) -> None:
        common = len(os.path.commonprefix((word, self.word)))
        self._close(common)
        self.word = word
        self.path += [[False, []] for _ in word[common:]]
        self.path[-1][0] = True

    def finish(self) -> tuple[list, int]:
        self._close(0)
        final, arcs = self.path[0]
        self.states.append((final, tuple(arcs)))
        return self.states, len(self.states) - 1


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A lexicon file: header, arcs by state, ids by word number.

    Arcs lie together by state, and so do their fields: all bytes, all flags (whether the
    target is final, whether the arc is its state's last), first arcs of the targets, words
    passed over.
    """
    builder, order = Builder(), sorted(w for w in words if w)
    for w in order:
        builder.add(w)
    states, root = builder.finish()
    below = [0] * len(states)  # words that end at or after a state; targets come before sources
    first, arcs = [0] * len(states), 1  # arc 0 is of states without arcs
    for i, (final, out) in enumerate(states):
        below[i] = final + sum(below[t] for _, t in out)
        first[i] = arcs if out else 0
        arcs += len(out)
    byte, flags = np.zeros(arcs, np.uint8), np.zeros(arcs, np.uint8)
    target_, over = np.zeros(arcs, "<u4"), np.zeros(arcs, "<u4")
    at = 1
    for final, out in states:
        passed = int(final)
        for k, (b, target) in enumerate(out):
            byte[at], flags[at], target_[at], over[at] = b, int(states[target][0]) | (2 if k + 1 == len(out) else 0), first[target], passed
            passed += below[target]
            at += 1
    ends = np.cumsum([0] + [len(words[w]) for w in order]).astype("<u4")
    ids = np.array([i for w in order for i in words[w]], "<u4")
    return struct.pack("<4sIII", b"MAL2", arcs, len(order), first[root]) + b"".join(x.tobytes() for x in (byte, flags, target_, over, ends, ids))


class Lexicon:
    """A lexicon in a mapped file: bytes of a word to its packed ids, or None. Nothing of it is copied."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        magic, arcs, self.words, self.root = struct.unpack_from("<4sIII", self.map)
        if magic != b"MAL2":
            raise ValueError("not a lexicon")
        at = 16
        fields = []
        for kind, count in (("B", arcs), ("B", arcs), ("I", arcs), ("I", arcs), ("I", self.words + 1)):
            size = count * struct.calcsize(kind)
            fields.append(self.map[at : at + size].cast(kind))
            at += size
        self.byte, self.flags, self.next, self.passed, self.ends = fields
        self.ids = self.map[at:]

    def get(self, word: bytes) -> bytes | None:
        at, number, final = self.root, 0, False
        byte, flags = self.byte, self.flags
        for c in word:
            if not at:
                return None
            while byte[at] != c:
                if flags[at] & 2 or byte[at] > c:
                    return None
                at += 1
            number += self.passed[at]
            final = flags[at] & 1
            at = self.next[at]
        if not final:
            return None
        return bytes(self.ids[4 * self.ends[number] : 4 * self.ends[number + 1]])


class Encoder:
    """Ids of whole texts: remembered words, then the lexicon, then exact merges.

    Where white space stands alone, no word reaches over it but for the space before it. So
    texts are cut at spaces and line ends in Arrow, distinct pieces into runs of letters,
    digits and marks, and only distinct words looked up; numpy puts their ids together.
    """

    def __init__(self, path: str, lexicon: str):
        self.merges, self.lexicon = merges(path), Lexicon(lexicon)
        # Added tokens with white space in them would be cut in two before they are seen.
        self.other = "|".join([OTHER, *[pc_escape(a) for a in self.merges.added]])
        self.uneven = "|".join([UNEVEN, *[pc_escape(a) for a in self.merges.added if regex.search(r"\s", a)]])
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of words as the tokenizer cuts them."""
        if len(self.memo) > MEMO:
            self.older, self.memo = self.memo, {}
        memo, older, get, merge = self.memo, self.older, self.lexicon.get, self.merges.ids
        for w in words:
            if w not in memo:
                ids = older.get(w)
                if ids is None:
                    b = w.encode()
                    ids = get(b)
                    if ids is None:
                        ids = array("I", merge(b)).tobytes()
                memo[w] = ids
        return [memo[w] for w in words]

    def _whole(self, values: list[str]) -> list[bytes]:
        """Ids of texts or pieces that the whole pattern cuts."""
        flat, ends, added = [], [], {}
        for v in values:
            for i, part in enumerate(self.merges.pieces(v)):
                if i % 2:
                    added[len(flat)] = array("I", [self.merges.added[part]]).tobytes()
                    flat.append("")
                else:
                    flat += WORDS.findall(part)
            ends.append(len(flat))
        ids = self._ids(flat)
        for i, x in added.items():
            ids[i] = x
        return [b"".join(ids[i:j]) for i, j in zip([0, *ends], ends)]  # noqa: B905

    def _even(self, values: pa.Array) -> list[np.ndarray]:
        cut = pc.split_pattern(pc.replace_substring(values, "\n", " \n "), " ")
        ends = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        code, pieces = coded.indices.to_numpy(), coded.dictionary
        line = pc.index(pieces, "\n").as_py()
        # A piece has the space before it unless a text or a line begins there.
        bare = code == line
        bare[1:] |= code[:-1] == line
        bare[ends[:-1][np.diff(ends) > 0]] = True
        key, piece_of = _distinct(code.astype(np.int64) * 2 + ~bare, 2 * len(pieces))
        pieces, led = pieces.take(pa.array(key >> 1)), (key & 1).astype(bool)
        whole = pc.match_substring_regex(pieces, self.other)
        runs = pc.ascii_split_whitespace(pc.if_else(whole, "\0", pc.replace_substring_regex(pieces, RUNS, r" \1 ")))
        # Marks and digits at an end leave empty strings there; they have no ids.
        run_ends = runs.offsets.to_numpy().astype(np.int64)
        run_coded = runs.flatten().dictionary_encode()
        run, texts_ = run_coded.indices.to_numpy().astype(np.int64), run_coded.dictionary.to_pylist()
        full = np.array([bool(t) for t in texts_], bool)
        # The first run that isn't empty carries the space.
        heads = run_ends[:-1] + ~full[run[np.minimum(run_ends[:-1], len(run) - 1)]]
        lead = np.zeros(len(run), bool)
        lead[heads[led & (heads < run_ends[1:])]] = True
        word, word_of = _distinct(run * 2 + lead, 2 * len(texts_))
        words = [" " + texts_[w >> 1] if w & 1 else texts_[w >> 1] for w in word.tolist()]
        at = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        word_of[run_ends[at]] = len(words) + np.arange(len(at))
        ids = self._ids(words) + self._whole([" " + t if x else t for t, x in zip(pieces.take(pa.array(at)).to_pylist(), led[at].tolist(), strict=True)])
        sizes = np.fromiter(map(len, ids), np.int64, count=len(ids)) >> 2
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        in_text = word_of[spread(run_ends[:-1][piece_of], np.diff(run_ends)[piece_of])]
        out = flat[spread(starts[in_text], sizes[in_text])]
        of_piece = np.diff(np.r_[0, np.cumsum(sizes[word_of])][run_ends])
        at = np.r_[0, np.cumsum(of_piece[piece_of])][ends]
        return [out[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]

    def encode(self, values: pa.Array) -> list[np.ndarray]:
        """The ids of each of some texts (binary, UTF-8); null is empty."""
        values = values.cast(pa.binary()).fill_null(b"")
        sizes = np.cumsum(pc.binary_length(values).to_numpy())
        out: list = []
        at = 0
        while at < len(values):
            before = sizes[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, before + AT_ONCE, side="right")))
            some = values.slice(at, upto - at).cast(pa.string())
            odd = pc.match_substring_regex(some, self.uneven)
            even = iter(self._even(some.filter(pc.invert(odd))))
            out += [np.frombuffer(self._whole([t.as_py()])[0], "<u4") if o else next(even) for t, o in zip(some, odd.to_pylist(), strict=True)]
            at = upto
        return out


def pc_escape(text: str) -> str:
    """A literal for Arrow's patterns."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def _distinct(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``key`` (all under ``n``), and which of them each is."""
    there = np.zeros(n, bool)
    there[key] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[key]


_encoders: dict[tuple, Encoder] = {}


def _encoder(path: str, lexicon: str) -> Encoder:
    """The worker's encoder; ``lexicon`` is the name of a file that Spark has handed out."""
    key = (path, lexicon)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, SparkFiles.get(lexicon))
    return _encoders[key]


def hand_out(spark, lexicon: bytes) -> str:
    """Have Spark give every executor the lexicon as a file, late ones and replaced ones too; its name.

    The file lies in the shared folder; its size is fixed by the number of words.
    """
    name = f"lexicon-{uuid.uuid4().hex}"
    spark.sparkContext.addFile(write_bytes(spark, name, lexicon))
    return name


def frequent_words(df: DataFrame, text_col: str = "text", most: int = 65_536) -> list[str]:
    """The ``most`` most frequent words of all texts, as the tokenizer cuts them.

    Tasks count pieces between white space and hand on what they have whenever it reaches a
    fixed number of entries; Spark sums. How many words a lexicon has is its parameter.
    """

    def count(batches):
        held: Counter = Counter()

        def out():
            got = pa.RecordBatch.from_arrays([binary(list(held)), pa.array(list(held.values()), pa.int64())], names=["piece", "n"])
            held.clear()
            return got

        for batch in batches:
            for t in texts(batch, "_text"):
                pieces = (t or b"").split()
                for i in range(0, len(pieces), 100_000):
                    held.update(pieces[i : i + 100_000])
                    if len(held) > 200_000:
                        yield out()
        if held:
            yield out()

    d = pick(df, _text=text_col).select(as_bytes("_text").alias("_text"))
    counts = d.mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = durable(counts.withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "counts")
    # Steps of an eighth of a doubling, a few hundred: the words of the last step that
    # would pass ``most`` stay out, and the driver gets ``most`` rows at the most.
    steps = sorted(counts.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    least, total = 1 << 30, 0
    for step, n in steps:
        total += n
        if total > most:
            break
        least = step
    words: Counter = Counter()
    for row in counts.filter(F.col("step") >= least).collect():
        for w in WORDS.findall(" " + bytes(row.piece).decode()):
            words[w] += row.n
    discard(counts)
    return [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:most]]


def build_lexicon(tokenizer_path: str, words: list[str]) -> bytes:
    ids = merges(tokenizer_path).ids
    return compile_lexicon({w.encode(): ids(w.encode()) for w in words})


IDS = T.ArrayType(T.IntegerType())


def _encoded(e: Encoder, text: pa.Array) -> pa.ListArray:
    ids = e.encode(text)
    ends = np.cumsum([0] + [len(x) for x in ids])
    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encoder(spark, tokenizer_path: str, lexicon: bytes):
    """A column function: text (as bytes) to its ids. Null and empty texts have none."""
    name = hand_out(spark, lexicon)

    def encode(text: pa.Array) -> pa.Array:
        return _encoded(_encoder(tokenizer_path, name), text)

    return F.arrow_udf(encode, IDS)


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies, by the rule they follow."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_vocabularies: dict[str, pa.Array] = {}


def vocabulary(tokenizer_path: str) -> pa.Array:
    """The bytes of every id, added tokens included."""
    if tokenizer_path not in _vocabularies:
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of()
        tokens = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}
        out = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        _vocabularies[tokenizer_path] = binary(out)
    return _vocabularies[tokenizer_path]


TEXTS = 1_000  # texts that are put together at a time


def _decoded(known: pa.Array, ids: pa.ListArray) -> pa.Array:
    ids = ids.fill_null([]) if ids.null_count else ids
    ends = np.r_[0, np.cumsum(pc.list_value_length(ids).to_numpy())].astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), known.take(ids.flatten())), b"")
    try:
        return joined.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())


def decoder(tokenizer_path: str):
    """A column function: ids to text; bytes that aren't UTF-8 become U+FFFD."""

    def decode(ids: pa.Array) -> pa.Array:
        known = vocabulary(tokenizer_path)
        parts = [_decoded(known, ids.slice(i, TEXTS)) for i in range(0, len(ids), TEXTS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.arrow_udf(decode, T.StringType())


def encode_and_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 65_536) -> DataFrame:
    """Every document's ids and the text that they decode to: ``id_col``, ids, decoded.

    Null and empty texts have no ids and decode to the empty text. Rows that repeat each
    give a row; null ids pass through; an empty table gives an empty table; other columns
    don't matter. Texts are taken whole, and the tokenizer's truncation and padding are off.
    """
    d = pick(df, _id=id_col, _text=text_col).withColumn("_text", as_bytes("_text"))
    kind = d.schema["_id"].dataType.simpleString()
    lexicon = build_lexicon(tokenizer_path, frequent_words(df, text_col, lexicon_words))
    name = hand_out(df.sparkSession, lexicon)

    def both(batches):
        # Given on a few texts at a time: ids are longer than the texts that they are of.
        e, known = _encoder(tokenizer_path, name), vocabulary(tokenizer_path)
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                some = batch.slice(i, TEXTS)
                ids = _encoded(e, some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0), ids, _decoded(known, ids)], names=["_id", "ids", "decoded"])

    return d.mapInArrow(both, f"_id {kind}, ids array<int>, decoded string").withColumnRenamed("_id", id_col)


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    out = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_bpe())
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
