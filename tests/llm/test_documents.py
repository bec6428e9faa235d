"""Operators over documents: brute force on the smallest tables, and odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cairn.llm import bpe, minhash, packing, quality, sharding, simhash, substrings
from tests.llm.conftest import words


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


def split(text):
    return (text or "").encode().split()


def near(rows, k, percent=80):
    """Components by comparing all sets: {id: least id}."""
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in split(t)]
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_sql(spark, data, duck):
    from tests.conftest import same_rows as same

    from cairn.llm import catalogue

    for name, sql in catalogue.oracle_sql().items():
        same(catalogue.queries()[name](spark, data), duck, sql)


def test_quality_of_odd_rows(odd, none, clashing):
    got = quality.clean_lines(clashing).collect()
    assert len(got) == odd.count() and quality.clean_lines(none).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[3].n_words == 0 and by[3].base_failed and by[3].clean_text == ""
    assert by[5].n_words == 0 and by[6].n_words == 20_000
    assert quality.clean_lines(odd).filter("kept").count() == sum(r.kept for r in got)


def test_repeated_words(spark):
    text = "a b c x a b c y " + words(50) + " a b c"
    r = quality.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_repeat_words == 9


def test_line_rules(spark, duck):
    """Lines that stay and lines that go, and the SQL's verdict on them."""
    paragraph = words(40) + " under the privacy policy of the house, which is a long story."
    stay = ["A sentence that stays.", paragraph, "Wer zurück will, der muss weiter.", "See https://a.example.com for all that was said there.", "", words(50)]
    go = ["Home | News | Sport | Contact | More", "All rights reserved.", "Alle Rechte vorbehalten.", "Tous droits réservés !", "Todos los derechos reservados.", "x### y*** z$$$ t%%%.", "Startseite.", "Leer más:", "https://a.example.com www.b.example.com.", "No ending", "Licensed under the terms."]
    text = [(i, x) for i, x in enumerate(stay + go)]
    got = {r.doc_id: r.lines_removed for r in quality.clean_lines(spark.createDataFrame(text, "doc_id long, text string")).collect()}
    assert got == {i: int(i >= len(stay)) for i in got}
    con = duck.cursor()
    con.execute("CREATE TEMP TABLE lines(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO lines VALUES (?, ?)", text)
    assert dict(con.sql(quality.SQL.replace("FROM documents", "FROM lines")).project("doc_id, lines_removed").fetchall()) == got


def clean(text):
    """(kept, clean text) of a document, line by line in plain Python."""
    import re

    r, ws = quality.LineRules(), " \t\n\x0b\x0c\r"
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    out = []
    for line in (text or "").split("\n"):
        t = line.strip(ws)
        pieces, small = sum(c in " \t" for c in t) + 1, t.lower()
        bars = sum(c in quality.SEPARATORS for c in t)
        bad = t[-1:] not in quality.ENDINGS and pieces < r.bare_words
        bad |= sum(c in quality.SYMBOLS for c in t) * 100 > len(t) * r.symbol_percent
        bad |= bars >= r.min_separators and bars * 4 >= pieces
        bad |= len(t) <= quality.LONGEST_NAVIGATION and pieces <= 4 and bool(re.search(quality._navigation(), small))
        bad |= len(re.findall(quality.LINKS, t)) * 100 > pieces * r.link_percent
        bad |= pieces <= r.boilerplate_words and any(re.search(b, small) for b in quality.BOILERPLATE)
        if not t or not bad:
            out.append(line)
    all_ = len("".join(w))
    base = len(w) < r.min_words or 100 * len(again) > 50 * len(w)
    return not base and (all_ - len("".join(re.findall(r"[^\x20\x09-\x0D]+", "\n".join(out))))) * 100 <= all_ * r.max_lost_percent, "\n".join(out)


def test_quality_by_brute_force(spark, data, texts):
    got = quality.clean_lines(spark.read.parquet(f"{data}/documents.parquet")).collect()
    assert {r.doc_id: (r.kept, r.clean_text) for r in got} == {i: clean(t) for i, t in texts.items()}


def covered(rows, length=35):
    """Words removed from each row, by dictionary of windows."""
    seen = Counter(tuple(w[i : i + length]) for _, t in rows for w in [split(t)] for i in range(len(w) - length + 1))
    out = []
    for i, t in rows:
        w = split(t)
        gone = {k for s in range(len(w) - length + 1) if seen[tuple(w[s : s + length])] > 1 for k in range(s, s + length)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return out


def test_substrings_of_odd_rows(odd, none, clashing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    key = lambda r: (str(r[0]), r[3])
    got = sorted(((r.doc_id, r.n_words, r.n_removed, (r.kept_text or "").encode()) for r in substrings.remove_repeats(clashing, cell_bits=18).collect()), key=key)
    assert got == sorted(covered(rows), key=key)
    assert substrings.remove_repeats(none).count() == 0


def test_periodic_text(spark):
    """Windows of one text that equal each other, none elsewhere."""
    rows = [(1, "a b " * 40), (2, words(34)), (3, "z " * 35), (4, "z " * 36), (5, words(100, "q"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, (r.kept_text or "").encode()) for r in substrings.remove_repeats(df).collect())
    assert got == sorted(covered(rows))


def test_crowded_sketch(spark, duck):
    """A sketch far too small lets everything through; the result is the same."""
    rows = duck.sql("SELECT doc_id, text FROM documents WHERE length(text) < 3000").fetchall()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in substrings.remove_repeats(df, cell_bits=18).collect())
    assert got == sorted((i, n) for i, _, n, _ in covered(rows))


def test_answers_in_parts(spark, duck):
    """Slices that are too large for a task are answered in parts; the result is the same."""
    rows = duck.sql("SELECT doc_id, text FROM documents WHERE length(text) < 3000").fetchall()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in substrings.remove_repeats(df, answer_bytes=500).collect())
    assert got == sorted((i, n) for i, _, n, _ in covered(rows))


def test_layout_is_kept(spark):
    shared = words(40, "s")
    rows = [(1, f"Head one.\nHead two.\n{shared}\nTail  one."), (2, shared), (3, "left  as\nit is")]
    got = {r.doc_id: r.kept_text for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), layout=True).collect()}
    assert got == {1: "Head one.\nHead two.\nTail  one.", 2: "", 3: "left  as\nit is"}


def test_near_duplicates(spark, data, texts):
    top, sizes = near(texts.items(), 4)
    got = minhash.op6_near_duplicates(spark, data).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got} == {i: (top[i], sizes[i], top[i] == i) for i in texts}


def test_crowded_region(spark):
    """Many copies with a few changed words each: components as brute force has them."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.choice(120, size=int(rng.integers(1, 9)), replace=False):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    top, _ = near(rows, 5)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == top and 1 < len(set(top.values())) < 150


def test_near_duplicates_of_odd_rows(odd, none, clashing):
    got = minhash.near_duplicates(clashing).collect()
    assert len(got) == odd.count() and minhash.near_duplicates(none).count() == 0
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by[1] == {(56, 1, True)} and by[2] == {(56, 1, False)}
    assert by[3] == {(0, 3, True)} and by[4] == {(0, 4, True)} and by[9] == {(1, 9, True)}


def check_packing(got, ids, size):
    """Every id in one piece, sequences gapless and not too long."""
    at, filled = defaultdict(list), defaultdict(list)
    for r in got:
        at[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    assert set(at) == set(ids)
    for i, rows in at.items():
        want, copies = ids[i][0], len(ids[i])
        spans = Counter((r.start, r.length) for r in rows)
        assert sum(n * c for (_, n), c in spans.items()) == len(want) * copies
        for r in rows:
            assert r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())
    for spans in filled.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end and length > 0
            end += length
        assert end <= size


def test_packing(spark, data, texts, odd, none, clashing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.word_bpe())
    encode = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]
    got = packing.op2_packed_sequences(spark, data).collect()
    check_packing(got, {i: [encode(x)] for i, x in texts.items()}, 4096)
    assert 1 - sum(r.length for r in got) / (4096 * len({r.sequence_id for r in got})) < 0.05
    ids = {i: [encode(x)] for i, x in [(r.doc_id, r.text) for r in odd.collect()] if i not in (None, 2)}
    rows = packing.pack_documents(clashing, packing.word_bpe(), size=64, open_windows=4).collect()
    whole = [r for r in rows if r.doc_id not in (None, 2)]
    assert {r.doc_id for r in whole} == set(ids)
    for r in whole:
        part = ids[r.doc_id][0][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert sum(r.length for r in rows) == sum(len(encode(r.text)) for r in odd.collect())
    assert packing.pack_documents(none, packing.word_bpe()).count() == 0


def test_open_windows():
    o = packing.OpenWindows(10, 2, 2)
    assert o.place(0, 10) == [[(0, 0, 10)]]
    assert o.place(1, 6) == [] and o.place(2, 7) == []
    assert o.place(3, 3) == [[(2, 0, 7), (3, 0, 3)]]
    assert o.place(4, 7) == [] and o.place(5, 4) == [[(1, 0, 6), (5, 0, 4)]]
    assert o.place(6, 8) == [] and o.place(7, 25) == [[(7, 0, 10)], [(7, 10, 10)], [(6, 0, 8), (7, 20, 2)]]


def test_word_tokens_remember_boundedly(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 3)
    import pyarrow as pa
    from tokenizers import Tokenizer

    w, t = packing.WordTokens(packing.word_bpe()), Tokenizer.from_file(packing.word_bpe())
    for text in ["the quick, brown fox", "jumps over the", "lazy dog. the quick"] * 2:
        assert next(w.encode(pa.array([text.encode()]))).tolist() == t.encode(text, add_special_tokens=False).ids
    assert len(w.memo) <= 3 + 5


def test_simhash(spark, data, texts):
    order = sorted(texts)
    got = {r.doc_id: r for r in simhash.op7_simhash(spark, data).collect()}
    bits = lambda x: np.unpackbits(np.frombuffer(bytes.fromhex(x), np.uint8))
    for n, i in enumerate(order):
        after = order[(n + 1) % len(order)]
        t, x = texts[i], texts[after]
        edited = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_next == pytest.approx(1 - (bits(r.fingerprint) != bits(got[after].fingerprint)).mean())
        assert r.near_edited == pytest.approx(1 - (bits(r.fingerprint) != bits(r.edited_fingerprint)).mean())
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9


def vote(text):
    """A text's fingerprint, every term and bit by itself."""
    import xxhash

    full = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & full
        return x ^ (x >> 31)

    w = text.encode().lower().split()
    h = [xxhash.xxh3_64_intdigest(x) for x in w]
    terms = [((h[i] * 3 + mix(h[i + 1])) & full, len(w[i]) + len(w[i + 1])) for i in range(len(w) - 1)] if len(w) > 1 else [(x, len(y)) for x, y in zip(h, w, strict=True)]
    votes = [0] * 128
    for term, weight in terms:
        for half in range(2):
            bits = mix((mix(term) + half) & full)
            for k in range(64):
                votes[64 * half + k] += weight if bits >> k & 1 else -weight
    return int("".join("1" if v > 0 else "0" for v in votes), 2).to_bytes(16, "big").hex()


def test_simhash_votes(spark, data, texts):
    """Fingerprints, those of edited texts and the number of near ones, by brute force."""
    order = sorted(texts)
    got = {r.doc_id: r for r in simhash.op7_simhash(spark, data).collect()}
    for n, i in enumerate(order):
        t, x = texts[i], texts[order[(n + 1) % len(order)]]
        assert got[i].fingerprint == vote(t)
        if n % 5 == 0:
            assert got[i].edited_fingerprint == vote(t[: len(t) - len(t) // 2] + x[: len(t) // 2])
    marks = {r.fingerprint for r in got.values()}
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    for r in got.values():
        assert r.near_marks == sum(m != r.fingerprint and apart(m, r.fingerprint) <= 3 for m in marks)


def test_hamming_radius(spark):
    rng = np.random.default_rng(2)
    marks = [rng.bytes(16) for _ in range(40)]
    for m in list(marks):
        for flips in (1, 3, 4):
            b = np.unpackbits(np.frombuffer(m, np.uint8))
            b[rng.choice(128, flips, replace=False)] ^= 1
            marks.append(np.packbits(b).tobytes())
    df = spark.createDataFrame([(bytearray(m),) for m in marks + marks[:5]] + [(None,)], "fingerprint binary")
    apart = lambda a, b: int(np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum())
    ids = sorted(set(marks))
    for radius in (2, 3, 5):
        want = {(a, b, apart(a, b)) for n, b in enumerate(ids) for a in ids[:n] if apart(a, b) <= radius}
        pairs = [(bytes(r.a), bytes(r.b), r.distance) for r in simhash.within_radius(df, radius).collect()]
        assert set(pairs) == want and len(pairs) == len(want)
        counts = Counter(x for a, b, _ in want for x in (a, b))
        assert {bytes(r.fingerprint): r.near_marks for r in simhash.near_marks(df, radius).collect()} == counts


def test_a_large_bucket(spark, monkeypatch):
    """Fingerprints with one block in common, more than a cell holds."""
    monkeypatch.setattr(simhash, "CELL", 20)
    rng = np.random.default_rng(9)
    head, base = rng.bytes(4), rng.bytes(12)
    marks = {head + base} | {head + rng.bytes(12) for _ in range(60)}
    for i in range(96):
        b = np.unpackbits(np.frombuffer(base, np.uint8))
        b[i] ^= 1
        marks.add(head + np.packbits(b).tobytes())
    df = spark.createDataFrame([(bytearray(m),) for m in marks], "fingerprint binary")
    got = {bytes(r.fingerprint): r.near_marks for r in simhash.near_marks(df, 3).collect()}
    apart = lambda a, b: (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    want = {m: sum(m != x and apart(m, x) <= 3 for x in marks) for m in marks}
    assert got == {m: n for m, n in want.items() if n}

def test_simhash_of_odd_rows(odd, none, clashing):
    got = simhash.compare_with_next(clashing).collect()
    assert len(got) == odd.count() and simhash.compare_with_next(none).count() == 0
    same = {bytes(r.fingerprint) for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1
    one = simhash.compare_with_next(odd.filter("doc_id = 9")).first()
    assert one.near_next == 1.0 and one.n_chars == 3


def test_bpe(spark, data, texts, odd, none, clashing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.byte_bpe())
    for r in bpe.op9_bpe_round_trip(spark, data).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    got = sorted((list(r.ids), r.decoded) for r in bpe.encode_and_decode(clashing, bpe.byte_bpe()).collect())
    want = sorted((t.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in odd.collect())
    assert got == want
    assert bpe.encode_and_decode(none, bpe.byte_bpe()).count() == 0


def test_lexicon(tmp_path):
    known = {b"": [], b"do": [1], b"dog": [2, 3], b"dogs": [4], b"cats": [5], b"cat": [6, 7, 8], b"\xc3\xa9s": [9]}
    (tmp_path / "a").write_bytes(bpe.compile_lexicon(known))
    (tmp_path / "b").write_bytes(bpe.compile_lexicon({}))
    lex = bpe.Lexicon(str(tmp_path / "a"))
    for w, ids in known.items():
        assert not w or np.frombuffer(lex.get(w), "<u4").tolist() == ids
    assert lex.get(b"d") is None and lex.get(b"dogss") is None and lex.get(b"x") is None and lex.get(b"ca") is None
    assert bpe.Lexicon(str(tmp_path / "b")).get(b"a") is None


@pytest.fixture(scope="module")
def coder(tmp_path_factory):
    """An encoder with a lexicon of few words, and the library's tokenizer."""
    from tokenizers import Tokenizer

    path = tmp_path_factory.mktemp("lexicon") / "x"
    path.write_bytes(bpe.build_lexicon(bpe.byte_bpe(), [" the", "don", "'t", " été", "中文", "\n"]))
    return bpe.Encoder(bpe.byte_bpe(), str(path)), Tokenizer.from_file(bpe.byte_bpe())


def test_no_library_on_the_way(coder, monkeypatch):
    """Ids come from the lexicon and the merge list alone."""
    import pyarrow as pa
    import tokenizers

    e, t = coder
    values = ["the été don't", "x" * 3000 + " abcabc" * 500, "a<|endoftext|>b <|endoftext|>", "  two\n\n spaces "]
    want = [t.encode(v, add_special_tokens=False).ids for v in values]
    monkeypatch.setattr(tokenizers, "Tokenizer", None)
    assert [x.tolist() for x in e.encode(pa.array([v.encode() for v in values]))] == want


def test_every_character(coder):
    """Letters, numbers, spaces and marks are told apart as the library does, for each code point."""
    import pyarrow as pa

    e, t = coder
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 20_000):
        text = "".join(f"a{c}1{c}! {c}" for c in chars[i : i + 20_000])
        assert e.encode(pa.array([text.encode()]))[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_random_unicode(coder):
    import pyarrow as pa

    e, t = coder
    rng = np.random.default_rng(4)
    pool = ["a", "b", "the", " ", " ", " ", "\n", "\t", "  ", "'s", "'ll", "'", "9", "12", "é", "ß", "中", "文", "и", "我", "\u3000", "\u00a0", "\u200d", "🙂", "👩\u200d🚀", "<|endoftext|>", "<|", "٣", "½", "!", "...", "_", "\r\n", "\x00", "\u0301", "ab" * 300, chr(0x10940), chr(0x16FF4)]
    values = ["".join(rng.choice(pool, size=int(rng.integers(1, 40)))) for _ in range(3_000)]
    got = e.encode(pa.array([v.encode() for v in values]))
    for v, x in zip(values, got, strict=True):
        assert x.tolist() == t.encode(v, add_special_tokens=False).ids, repr(v)


def test_long_words_merge_alike(coder):
    e, t = coder
    rng = np.random.default_rng(6)
    for n in (1, 2, 399, 400, 401, 5_000):
        w = "".join(rng.choice(list("abcdeinrst"), size=n)).encode()
        assert e.merges.ids(w) == e.merges._long(w) == t.encode(w.decode(), add_special_tokens=False).ids
    assert len(e.merges.ids(b"a" * 300_000)) < 300_000


def test_many_words_in_one_text(spark):
    """Counts are handed on within a text, not only after it."""
    df = spark.createDataFrame([(1, words(250_000) + " " + "w1 " * 9)], "doc_id long, text string")
    got = bpe.frequent_words(df, most=5)
    assert got == [" w"] or " w" in got


def test_lexicon_shares_suffixes():
    b = bpe.Builder()
    for w in sorted([b"walking", b"talking", b"walked", b"talked"]):
        b.add(w)
    states, _ = b.finish()
    assert len(states) == 9  # of 25 letters


def check_shards(got, rows, shards):
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    size = Counter()
    slots = defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(0 <= s < shards for s in size) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    return size


def test_sharding(spark, data, texts):
    got = sharding.op1_balanced_shards(spark, data).collect()
    size = check_shards(got, texts.items(), 40)
    for r in got:
        b = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 16, zlib.crc32(b), "bytes", None)
    assert max(size.values()) - min(size.values()) <= max(r.size for r in got)


def test_sharding_of_a_large_group(spark):
    rows = [(i, "copy " * 30 if i < 400 else words(20 + i % 17, f"u{i}_")) for i in range(1200)] + [(2000 + i, f"pair{i // 2} " * 20) for i in range(40)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    size = check_shards(got, rows, 8)
    even = sum(size.values()) / 8
    assert max(size.values()) < 1.02 * even and min(size.values()) > 0.98 * even
    at = {r.doc_id: r.shard for r in got}
    assert len({at[i] for i in range(400)}) <= 5
    assert all(at[2000 + i] == at[2001 + i] for i in range(0, 40, 2))


def test_sharding_of_odd_rows(odd, none, clashing):
    got = sharding.shard_documents(clashing, 3).collect()
    check_shards(got, [(r.doc_id, r.text) for r in odd.collect()], 3)
    assert sharding.shard_documents(none, 3).count() == 0


def test_template_documents(spark):
    """20,000 texts of one template below the threshold, and some that it hides: work in proportion."""
    import time

    rng = np.random.default_rng(8)
    template = [f"t{i}" for i in range(80)]
    rows = [(i, " ".join(template + [f"u{i}_{k}" for k in range(24)])) for i in range(20_000)]
    rows += [(30_000 + i, " ".join(template + [f"u{i}_{k}" for k in range(24)][: 20 + i % 3] + ["x"])) for i in range(0, 300, 3)]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[k] for k in order], "doc_id long, text string").repartition(8)
    began = time.perf_counter()
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    took = time.perf_counter() - began
    assert got == {i: i - 30_000 if i >= 30_000 else i for i, _ in rows}
    assert took < 240


def test_hidden_pairs_are_few(spark):
    """What crowded sets of a template are asked about is linear, not their pairs."""
    sets, top = [], []
    for i in range(3_000):
        s = np.unique(np.r_[np.arange(1, 801), np.arange(10_000 + 1_000 * i, 10_000 + 1_000 * i + 180 + i % 40)]).astype(np.int64)
        sets.append((i.to_bytes(16, "little"), bytearray(s.tobytes()), len(s)))
    sets.append(((9_999).to_bytes(16, "little"), bytearray(np.frombuffer(bytes(sets[7][1]), np.int64)[:-40].tobytes()), sets[7][2] - 40))
    crowd = spark.createDataFrame([(bytearray(k), bytearray(k), n) for k, _, n in sets], "set_key binary, top binary, n long")
    held = spark.createDataFrame([(bytearray(k), m) for k, m, _ in sets], "set_key binary, members binary")
    pairs = {(int.from_bytes(r.a, "little"), int.from_bytes(r.b, "little")) for r in minhash._hidden(crowd, held, 80).collect()}
    assert (7, 9_999) in {tuple(sorted(p)) for p in pairs} and len(pairs) < 100


def test_hot_keys_are_broadcast(spark):
    from cairn.llm.skew import join_unique

    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 99), (None, 7), (3, 8)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (5, "c")], "k long, w string")
    want = sorted([(1, i, "a") for i in range(50)] + [(2, 99, "b"), (3, 8, None), (None, 7, None)], key=str)
    for least in (10, 10_000):
        assert sorted([tuple(r) for r in join_unique(left, right, "k", 53, least=least).select("k", "v", "w").collect()], key=str) == want
        assert sorted(tuple(r) for r in join_unique(left, right, "k", 53, inner=True, least=least).select("k", "v", "w").collect()) == sorted(x for x in want if x[2])
