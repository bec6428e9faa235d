import hashlib
import os
import threading

import pytest

from cairn.errors import CairnError, Kind
from cairn.operators.blocks import GIB
from cairn.retry import Policy
from cairn.sources import devices, files
from cairn.sources.stores import LocalStore, MemoryStore, PrefixStore, RetryingStore


@pytest.fixture(params=["local", "synced", "memory", "prefix", "retrying"])
def store(request, tmp_path):
    if request.param in ("local", "synced"):
        return LocalStore(tmp_path / "s", fsync=request.param == "synced")
    if request.param == "prefix":
        return PrefixStore(LocalStore(tmp_path / "s", fsync=False), "some/where")
    inner = MemoryStore()
    if request.param == "retrying":
        inner.faults = [CairnError(Kind.THROTTLED, "x", "slow down")]
        return RetryingStore(inner, Policy(sleep=lambda s: None))
    return inner


def test_put_get_list_delete(store):
    store.put("a/b", b"one")
    store.put("a/b", b"two")
    store.put("c", b"")
    assert store.get("a/b") == b"two" and store.get("c") == b"" and store.stat("a/b").size == 3
    assert sorted(o.key for o in store.list()) == ["a/b", "c"]
    assert [o.key for o in store.list("a/")] == ["a/b"] and list(store.list("zz")) == []
    store.delete("a/b")
    store.delete("a/b")
    for call in (store.get, store.stat):
        with pytest.raises(CairnError) as e:
            call("a/b")
        assert e.value.kind is Kind.NOT_FOUND


def test_create_once(store):
    assert store.create("k/x", b"1") and not store.create("k/x", b"2") and store.get("k/x") == b"1"


def test_one_of_many_creates(tmp_path):
    s, won = LocalStore(tmp_path, fsync=False), []
    threads = [threading.Thread(target=lambda i=i: won.append(s.create("k", str(i).encode()))) for i in range(16)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(won) == 1 and [o.key for o in s.list()] == ["k"]


def test_ranges(store):
    """Every offset up to past the end with every length, as slices have it."""
    data = bytes(range(65, 74))
    store.put("o", data)
    for o in range(len(data) + 3):
        for n in range(-1, len(data) + 2):
            assert store.get_range("o", o, n) == (data[o:] if n < 0 else data[o : o + n])
    with pytest.raises(CairnError):
        store.get_range("o", -3, 1)


def refused():
    """Each segment that no key may have, at each place of a key; roots, forbidden characters, lengths."""
    for odd in ("", ".", ".."):
        yield from ("/".join([*"kl"[:i], odd, *"kl"[i:]]) for i in range(3))
    yield from (f"k{c}l" for c in "\0\\")
    yield from ("", "é" * 513, "k/" * 512 + "l")


@pytest.mark.parametrize("key", list(refused()))
def test_bad_keys(store, key):
    with pytest.raises(CairnError) as e:
        store.put(key, b"")
    assert e.value.kind is Kind.INVALID


def test_unfinished_writes_stay_hidden(tmp_path):
    s = LocalStore(tmp_path, fsync=False)
    s.put("d/x", b"1")
    (tmp_path / "d" / ".tmp-123").write_bytes(b"half")
    assert [o.key for o in s.list()] == ["d/x"]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, size in {"a/b": 3, "a.txt": 1, "a/z/deep": 70_000, "_hidden": 5, ".dot": 2, "empty": 0, "sp ace+é%41": 4}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(os.urandom(size))
    os.symlink("a.txt", root / "link")
    os.mkfifo(root / "pipe")
    return root


def test_walk(spark, tree):
    got = [e[0] for e in files.walk(files.open_root(str(tree)))]
    assert got == [".dot", "_hidden", "a/b", "a/z/deep", "a.txt", "empty", "sp ace+é%41"]
    read = {r.path: (r.size, bytes(r.content)) for r in files.read(spark, str(tree)).collect()}
    assert set(read) == set(got) and all(read[p] == ((tree / p).stat().st_size, (tree / p).read_bytes()) for p in got)
    listed = files.entries(spark, str(tree))
    assert listed.count() == 7 and files.entries(spark, str(tree / "a" / "z")).count() == 1
    for bad in (str(tree / "nothing"), str(tree / "a.txt")):
        with pytest.raises(CairnError):
            files.open_root(bad)


def test_contents_by_spark(spark, tree):
    (tree / "pipe").unlink()
    got = {r.path: bytes(r.content) for r in files.contents(spark, str(tree)).collect()}
    assert got["a/b"] == (tree / "a/b").read_bytes() and got["sp ace+é%41"] == (tree / "sp ace+é%41").read_bytes()


def test_rfc3339():
    assert files.rfc3339(1_700_000_000_000_000_000) == "2023-11-14T22:13:20Z"
    assert files.rfc3339(1_700_000_000_120_000_000) == "2023-11-14T22:13:20.12Z"


def device(**more):
    blocks = {i: bytes([i % 256]) * 100 for i in (0, 3, 4, 9, 700)}
    changed = blocks | {3: b"new", 11: b"added"}
    return devices.FakeService({"s1": blocks, "s2": changed}, **more)


def test_listing_goes_on_after_empty_pages():
    s = devices.BlockSource(device(empty_pages=2), "s1", clock=lambda: 0)
    assert [r.index for r in s.list_blocks()] == [0, 3, 4, 9, 700] and s.size() == 8 * GIB
    assert s.read_block(next(iter(s.list_blocks()))) == bytes(100)
    assert [(c.ref.index, c.is_new) for c in devices.BlockSource(device(), "s2", clock=lambda: 0).list_changed("s1")] == [(3, False), (11, True)]


def test_block_faults():
    ref = devices.BlockRef(3, "s1:3", 10.0)
    with pytest.raises(CairnError) as e:
        devices.BlockSource(device(), "s1", clock=lambda: 11).read_block(ref)
    assert e.value.kind is Kind.EXPIRED
    with pytest.raises(CairnError) as e:
        devices.BlockSource(device(corrupt={3}), "s1", clock=lambda: 0).read_block(ref)
    assert e.value.kind is Kind.CORRUPT
    assert devices.BlockSource(device(corrupt={3}), "s1", verify=False, clock=lambda: 0).read_block(ref)
    slow = device(faults=[CairnError(Kind.THROTTLED, "x", ""), CairnError(Kind.TRANSIENT, "x", "")])
    assert devices.BlockSource(slow, "s1", policy=Policy(sleep=lambda s: None), clock=lambda: 0).read_block(ref)
    backwards = device()
    backwards.list_blocks = lambda *a: {"blocks": [{"index": 5, "token": "t"}, {"index": 5, "token": "t"}], "next": None}
    with pytest.raises(CairnError):
        list(devices.BlockSource(backwards, "s1").list_blocks())
    with pytest.raises(CairnError):
        devices.check(b"", "", "MD5")
    assert [devices.clamp_page(x) for x in (0, 1, 500, 99_999)] == [10_000, 100, 500, 10_000]


def test_device_table(spark):
    source = devices.BlockSource(device(), "s1", clock=lambda: 0)
    for parts in (0, 1, 3):
        rows = devices.table(spark, source, parts, with_data=True).collect()
        assert {r.block_index: bytes(r.data) for r in rows} == source.service.snapshots["s1"]
        assert all(r.blob_id == hashlib.sha256(r.data).hexdigest() and r.length == len(r.data) for r in rows) and len(rows) == 5
    assert devices.table(spark, devices.BlockSource(devices.FakeService({"s1": {}}), "s1")).count() == 0
    assert devices.table(spark, devices.BlockSource(devices.PatternService(0), "s1")).count() == 0


def test_device_is_read_in_tasks(spark):
    source = devices.BlockSource(devices.PatternService(25_000), "s")
    out = devices.table(spark, source, 7)
    assert out.rdd.getNumPartitions() == 7
    assert sorted(r.block_index for r in out.collect()) == [i for i in range(25_000) if i % 3]
    with pytest.raises(Exception, match="doesn't hold"):
        devices.table(spark, devices.BlockSource(device(corrupt={9}), "s1", clock=lambda: 0)).collect()


def test_listing_of_a_range():
    s = devices.BlockSource(device(), "s1", clock=lambda: 0)
    assert [r.index for r in s.list_blocks(3, 9)] == [3, 4] and [r.index for r in s.list_blocks(5)] == [9, 700]
