import hashlib
import io

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.errors import CairnError
from cairn.operators import chunking as c

DEFAULT = c.ChunkerConfig()


def noise(n, seed=1):
    return np.random.default_rng(seed).integers(0, 256, n, dtype=np.uint8).tobytes()


def byte_by_byte(data, config):
    """The definition, one byte at a time."""
    strict, loose = config.masks
    out, start = [], 0
    while start < len(data):
        n = len(data) - start
        end = n
        if n > config.min_size:
            n = end = min(n, config.max_size)
            h = 0
            for i in range(config.min_size, n):
                h = ((h << 1) + int(c.GEAR[data[start + i]])) % 2**64
                if not h & (strict if i < min(config.avg_size, n) else loose):
                    end = i + 1
                    break
        start += end
        out.append(start)
    return out


def test_byte_table_is_pinned():
    assert hashlib.sha256(c.GEAR.astype("<u8").tobytes()).hexdigest() == "d29093e6712e90f0bc37a7f04c5354412a53527b1c94cba195bdba6a7158a4d1"


def test_masks():
    assert DEFAULT.masks == (0x924A494929250000, 0x8891122444890000)
    assert c.SMALL.masks == (0x8210841084210000, 0x8020100402010000)
    assert c.spread_mask(1) == 1 << 16


@pytest.mark.parametrize("sizes", [(0, 64, 128, 1), (64, 64, 128, 1), (64, 128, 100, 1), (64, 100, 200, 1), (64, 128, 256, 4), (64, 128, 256, -1)])
def test_invalid_configs(sizes):
    with pytest.raises(CairnError):
        c.ChunkerConfig(*sizes)


CONFIGS = [c.SMALL, c.ChunkerConfig(16, 32, 64, 0), c.ChunkerConfig(64, 128, 128, 3), c.ChunkerConfig(1000, 2048, 9000, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=700), st.integers(0, 3000).map(lambda n: b"ab" * n), st.integers(0, 6000).map(noise)), max_size=5), st.sampled_from(CONFIGS))
def test_same_cuts_as_byte_by_byte(files, config):
    want = [byte_by_byte(f, config) for f in files]
    assert [list(map(int, x)) for x in c.cuts_of(files, config)] == want
    assert [c.cuts(f, config) for f in files] == want
    for f, ends in zip(files, want, strict=True):
        got = list(c.stream(io.BytesIO(f).read, config, size=997))
        assert b"".join(x for _, x in got) == f and [o + len(x) for o, x in got] == ends


@pytest.mark.parametrize("n", [0, 1, 100, 16383, 16384, 65536, 262144, 262145, 3 << 20])
def test_lossless(n):
    data = noise(n)
    parts = c.split(data, DEFAULT)
    assert b"".join(parts) == data and all(parts)
    assert all(DEFAULT.min_size < len(p) <= DEFAULT.max_size for p in parts[:-1])


def shared(data, after, shift):
    old, new = set(c.cuts(data, DEFAULT)[:-1]), [e - shift for e in c.cuts(after, DEFAULT)[:-1]]
    return np.mean([e in old for e in new])


def test_resync_after_a_byte_before():
    data = noise(6 << 20, 42)
    assert shared(data, b"\xab" + data, 1) >= 0.95


def test_resync_after_a_byte_within():
    data = noise(4 << 20, 99)
    after = data[: 2 << 20] + b"\xcd" + data[2 << 20 :]
    head = [e for e in c.cuts(data, DEFAULT) if e <= 2 << 20]
    assert c.cuts(after, DEFAULT)[: len(head)] == head
    tail = [e - 1 for e in c.cuts(after, DEFAULT) if e > (2 << 20) + DEFAULT.max_size]
    assert np.mean([e in set(c.cuts(data, DEFAULT)) for e in tail]) >= 0.95


def test_stream_gives_what_it_has_before_an_error():
    data, calls = noise(300_000), iter([b"x"])

    def read(n):
        if next(calls, None):
            return data
        raise OSError("gone")

    got = []
    with pytest.raises(OSError, match="gone"):
        for _, chunk in c.stream(read, DEFAULT):
            got.append(chunk)
    assert b"".join(got) == data


def test_chunks_of_a_table(spark):
    files = {f"f{i}": noise(n, i) for i, n in enumerate([0, 1, 5000, 70_000])} | {"big": noise(5 << 20, 9)}
    df = spark.createDataFrame([(k, bytearray(v), 1) for k, v in files.items()] + [("null", None, 2)], "path string, content binary, idx int")
    rows = c.cdc_chunks(df, DEFAULT, with_data=True).collect()
    for k, v in files.items():
        mine = sorted((r.idx, r.offset, r.length, r.blob_id, bytes(r.data)) for r in rows if r.path == k)
        assert b"".join(m[4] for m in mine) == v and [m[0] for m in mine] == list(range(len(mine)))
        assert all(hashlib.sha256(m[4]).hexdigest() == m[3] and len(m[4]) == m[2] for m in mine)
        assert [m[1] + m[2] for m in mine] == c.cuts(v, DEFAULT)
    assert not [r for r in rows if r.path == "null"]
    blocks = c.fixed_blocks(df, 1000, with_data=True).filter("path = 'f2'").orderBy("idx").collect()
    assert b"".join(bytes(b.data) for b in blocks) == files["f2"] and len(blocks) == 5
