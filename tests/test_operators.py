import hashlib

import numpy as np
import pytest

from cairn.errors import CairnError, Kind, is_retryable, kind_of, kind_of_status
from cairn.functions import scalars as S
from cairn.operators import blocks, index, packs, restore, snapshots, verify
from cairn.retry import Policy

ID = lambda x: hashlib.sha256(str(x).encode()).hexdigest()


def fold(sizes, target):
    out, pack, filled = [], 0, 0
    for n in sizes:
        if filled >= target:
            pack, filled = pack + 1, 0
        out.append((pack, filled))
        filled += n
    return out


def test_pack_assembly(spark):
    rng = np.random.default_rng(3)
    rows = [(ID(i), int(n)) for i, n in enumerate(rng.integers(1, 400, 500))]
    got = packs.assemble(spark.createDataFrame(rows, "blob_id string, length long"), 1000, lane_digits=1).collect()
    assert len(got) == 500
    for lane in "0123456789abcdef":
        mine = sorted((r for r in got if r.lane == lane), key=lambda r: r.blob_id)
        assert [(r.pack, r.offset) for r in mine] == fold([r.length for r in mine], 1000)
    one = packs.assemble(spark.createDataFrame([("a", 150), ("b", 60), ("c", 60)], "blob_id string, length long"), 100, lane_digits=0)
    assert packs.pack_rows(one).count() == 2


def test_pack_codec():
    blobs = [(hashlib.sha256(d).hexdigest(), d) for d in (bytes([i]) * (1024 + 7 * i) for i in range(20))]
    pack_id, body, entries = packs.encode(blobs + blobs[:3])
    assert pack_id == hashlib.sha256(body).hexdigest() and len(entries) == 20
    r = packs.Reader(body)
    assert [r.read(b) for b, _ in blobs] == [d for _, d in blobs] and r.verify() == 20
    assert r.lookup("0" * 64) is None
    assert packs.read_header(lambda o, n: body[o : o + n], len(body)) == entries
    with pytest.raises(packs.ShortTail):
        packs.parse_tail(body[-12:], len(body))
    n = len(body)
    for bad in (body[:-1] + b"X", body[:-12] + (0).to_bytes(4, "little") + body[-8:], body[:-12] + (n).to_bytes(4, "little") + body[-8:], body[:-12] + (1 << 31).to_bytes(4, "little") + body[-8:], body[-400:]):
        with pytest.raises((CairnError, packs.ShortTail)):
            packs.parse_tail(bad, len(bad))
    with pytest.raises(CairnError):
        packs.encode([])
    broken = packs.Reader(b"Z" + body[1:])
    with pytest.raises(CairnError) as e:
        broken.read(blobs[0][0])
    assert e.value.kind is Kind.CORRUPT


def test_pack_entries_of_files(spark):
    pack_id, body, entries = packs.encode([(ID(i), str(i).encode()) for i in range(5)])
    got = packs.entries_of(spark.createDataFrame([(pack_id, bytearray(body))], "pack_id string, content binary")).collect()
    assert [(r.blob_id, r.offset, r.length) for r in got] == [(e["id"], e["offset"], e["length"]) for e in entries]


def test_index_codec():
    rows = [(ID(i), ID(-i), i * 1024, 4096) for i in range(50)]
    data = index.dump(rows)
    assert index.load(data) == rows and index.load(index.dump([])) == []
    assert index.load(index.dump([rows[0], (rows[0][0], ID("x"), 1, 2)])) == [rows[0]]
    for bad in (data[:10], b"X" + data[1:], data[:-1], data + b"x", data[:8] + (1 << 40).to_bytes(8, "little") + data[16:]):
        with pytest.raises(CairnError) as e:
            index.load(bad)
        assert e.value.kind is Kind.CORRUPT


def test_index_tables(spark):
    entries = spark.createDataFrame([("b1", "p2", 0, 5), ("b1", "p1", 9, 5), ("b1", "p1", 3, 5), ("b2", "p9", 0, 1)], index.SCHEMA)
    won = {r.blob_id: (r.pack_id, r.offset) for r in index.first_wins(entries).collect()}
    assert won == {"b1": ("p1", 3), "b2": ("p9", 0)}
    present = spark.createDataFrame([("p2",), ("p9",)], "pack_id string")
    assert {r.blob_id: r.pack_id for r in index.rebuild(entries, present).collect()} == {"b1": "p2", "b2": "p9"}
    assert [r.blob_id for r in index.insert(entries.filter("blob_id = 'b1'"), entries).collect()] == ["b2"]
    assert index.delete(entries, present.selectExpr("'b1' AS blob_id")).count() == 1


def test_shard_balance(spark):
    ids = spark.range(102_400).selectExpr("sha2(concat('balance-', id), 256) AS blob_id")
    s = index.shard_stats(ids).first()
    assert s["mean"] == 400 and s["least"] > 0 and s["sigma"] <= 3 * 20


SNAP = {"id": "", "kind": "files", "created_at": "2024-01-02T03:04:05.000000006Z", "source": "/a<b>&c", "files": [{"path": "e", "size": 0, "mode": 420, "mod_time": "2024-01-01T00:00:00Z", "chunks": []}, {"path": "f/é", "size": 3, "mode": 420, "mod_time": "2024-01-01T00:00:00Z", "chunks": [ID(1)]}], "stats": {"files_total": 2}}


def test_manifest_form():
    text = snapshots.canonical(SNAP)
    assert text.startswith('{"id":"","kind":"files","created_at":"2024-01-02T03:04:05.000000006Z","source":"/a\\u003cb\\u003e\\u0026c","files":[{"path":"e"')
    assert '"chunks":null' in text and '"hostname"' not in text and text.endswith('"duration_ns":0}}')
    whole = SNAP | {"id": snapshots.compute_id(SNAP)}
    snapshots.verify(whole)
    assert snapshots.content_id_of(whole) == snapshots.content_id_of(whole | {"created_at": "x"})
    for bad in (whole | {"source": "x"}, whole | {"id": "abc"}, whole | {"id": ""}):
        with pytest.raises(CairnError):
            snapshots.verify(bad)


BLOCK = {"index": 0, "blob": ID(1)}


@pytest.mark.parametrize(
    "bad",
    [
        {"kind": "tapes"},
        {"kind": "files", "blocks": [BLOCK]},
        {"kind": "blocks", "files": SNAP["files"], "block_size": 5},
        {"kind": "blocks", "blocks": [BLOCK]},
        {"kind": "files", "files": [SNAP["files"][0] | {"path": ""}]},
        {"kind": "files", "files": [SNAP["files"][0] | {"size": -1}]},
        {"kind": "blocks", "block_size": 5, "blocks": [BLOCK | {"index": -1}]},
        {"kind": "blocks", "block_size": 5, "blocks": [BLOCK | {"blob": S.ZERO_ID}]},
    ],
)
def test_invalid_manifests(spark, bad):
    with pytest.raises(CairnError):
        snapshots.validate(bad)
    files = [(f["path"], f["size"]) for f in bad.get("files", [])]
    rows = [(bad["kind"], bad.get("block_size"), files, [(b["index"], b["blob"]) for b in bad.get("blocks", [])])]
    df = spark.createDataFrame(rows, "kind string, block_size long, files array<struct<path:string,size:long>>, blocks array<struct<index:long,blob:string>>")
    assert df.select(S.snapshot_problem(df.kind, df.block_size, df.files, df.blocks).alias("p")).first().p


def test_resolve(spark):
    rows = [("aaaaaaaa11", 5), ("aaaaaaaa22", 7), ("bbbbbbbb33", 7)]
    df = spark.createDataFrame(rows, "id string, created_at long")
    assert snapshots.resolve(df, "latest").first().id == "aaaaaaaa22"
    assert snapshots.resolve(df, "bbbbbbbb").first().id == "bbbbbbbb33"
    for ref in ("aaaaaaaa", "bbbb", "cccccccc"):
        with pytest.raises(CairnError):
            snapshots.resolve(df, ref)


def test_verify_and_collect(spark):
    ix = spark.createDataFrame([("b1", "p1", 0, 1), ("b2", "p2", 0, 1)], index.SCHEMA)
    refs = spark.createDataFrame([("s1", "b1"), ("s2", "b1"), ("s2", "b9")], "snapshot_id string, blob_id string")
    present = spark.createDataFrame([("p2", 10), ("p3", 5)], "pack_id string, size long")
    r = verify.summary(refs, ix, present).first()
    assert (r.snapshots, r.packs, r.blobs_referenced, r.dangling, r.missing, r.orphans, r.ok) == (2, 2, 2, 1, 1, 2, False)
    assert verify.dangling(refs, ix).first().snapshot_id == "s2"
    assert tuple(verify.reclaimable(refs, ix, present).first()) == (0, 0, False)
    good = spark.createDataFrame([("p1", 1), ("p3", 5)], "pack_id string, size long")
    assert tuple(verify.reclaimable(refs.filter("blob_id = 'b1'"), ix, good).first()) == (1, 5, True)


def test_restore_from_packs(spark):
    parts = {"f": [b"one", b"two", b"one"], "g": []}
    ids = {d: hashlib.sha256(d).hexdigest() for d in (b"one", b"two")}
    pack_id, body, entries = packs.encode([(i, d) for d, i in ids.items()])
    ix = spark.createDataFrame([(e["id"], pack_id, e["offset"], e["length"]) for e in entries], index.SCHEMA)
    stored = spark.createDataFrame([(pack_id, bytearray(body))], "pack_id string, content binary")
    refs = spark.createDataFrame([(p, i, ids[d]) for p, ds in parts.items() for i, d in enumerate(ds)], "path string, idx int, blob_id string")
    files = spark.createDataFrame([("f", 9), ("g", 0), ("lost", 4)], "path string, size long")
    got = {r.path: (bytes(r.content), r.ok) for r in restore.rebuild(files, restore.fetch(refs, ix, stored)).collect()}
    assert got == {"f": (b"onetwoone", True), "g": (b"", True), "lost": (b"", False)}
    assert verify.broken_blobs(ix, stored).count() == 0
    bad = spark.createDataFrame([(pack_id, bytearray(b"X" + body[1:]))], "pack_id string, content binary")
    assert [r.blob_id for r in verify.broken_blobs(ix, bad).collect()] == [ids[b"one"]]


def test_request_cost():
    c = blocks.request_cost(8 << 30, 16_384)
    assert c["blocks"] == 16_384 and c["list_requests"] == 2 and c["get_requests"] == 16_384


def test_retry():
    waits, tries = [], []
    p = Policy(sleep=waits.append)

    def op(errors):
        tries.append(1)
        if errors:
            raise errors.pop(0)
        return "done"

    assert p.run(lambda e=[CairnError(Kind.TRANSIENT, "x", 1), CairnError(Kind.THROTTLED, "x", 1)]: op(e)) == "done"
    assert len(waits) == 2 and all(0 <= w <= 0.6 for w in waits)
    for kind in (Kind.CORRUPT, Kind.UNKNOWN, Kind.EXPIRED):
        n = len(tries)
        with pytest.raises(CairnError):
            p.run(lambda k=kind: op([CairnError(k, "x", 1)]))
        assert len(tries) == n + 1
    n = len(tries)
    with pytest.raises(CairnError):
        p.run(lambda: op([CairnError(Kind.TRANSIENT, "x", 1)]))
    assert len(tries) == n + 5
    assert max(p.delay(50, True) for _ in range(100)) <= 10


def test_errors():
    assert [kind_of_status(s) for s in (404, 412, 403, 503, 500, 400)] == [Kind.NOT_FOUND, Kind.ALREADY_EXISTS, Kind.PERMISSION, Kind.THROTTLED, Kind.TRANSIENT, Kind.INVALID]
    assert kind_of(ValueError()) is Kind.UNKNOWN and kind_of(KeyboardInterrupt()) is Kind.CANCELED
    assert is_retryable(CairnError(Kind.THROTTLED, "a", "b")) and not is_retryable(ValueError())
