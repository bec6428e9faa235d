"""Runs whose files, blobs and index entries never lie on the driver, and the parts that make it so."""

import json
import random

import pytest

from cairn.errors import CairnError, Kind
from cairn.operators import index, snapshots
from cairn.plans import runs
from cairn.sources import files

MOST = 256  # shards of the index


@pytest.mark.parametrize("name", ["backup_stats", "garbage_collected", "backup_restore"])
def test_the_driver_holds_no_blobs(name, spark, data, monkeypatch):
    """No table of the driver's, and nothing that it collects, has a row for each blob; nor is the tree walked there."""
    from pyspark.sql.classic.dataframe import DataFrame

    collect, make = DataFrame.collect, type(spark).createDataFrame

    def few(n):
        assert n <= MOST, f"{n} rows on the driver"

    def collected(self):
        out = collect(self)
        few(len(out))
        return out

    def made(self, rows, *a, **b):
        few(getattr(rows, "num_rows", None) or len(rows))
        return make(self, rows, *a, **b)

    monkeypatch.setattr(DataFrame, "collect", collected)
    monkeypatch.setattr(type(spark), "createDataFrame", made)
    monkeypatch.setattr(files, "walk", lambda *_: pytest.fail("walked on the driver"))
    assert runs.queries()[name](spark, data).count() > 0


def test_listing_in_rounds(spark, tmp_path, monkeypatch):
    """Directories that a task leaves are listed by the next round, each file once."""
    for i in range(60):
        f = tmp_path / "r" / f"a{i % 3}" / f"b{i % 7}" / ("c/" * (i % 4)) / f"{i}"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * i)
    want = sorted(files.walk(tmp_path / "r"))
    for spree in (1, 5, 10_000):
        monkeypatch.setattr(files, "SPREE", spree)
        assert sorted(map(tuple, files.entries(spark, str(tmp_path / "r")).collect())) == want


def test_index_files(spark, tmp_path):
    """A table's file is the dump of its rows, and is read as the dump is; so is one with ids that repeat."""
    r = random.Random(5)
    rows = [(r.randbytes(32).hex(), r.randbytes(32).hex(), i, r.randrange(1 << 40)) for i in range(2000)] + [("ab" + "00" * 31, "00" * 32, 7, 1), ("00" * 32, "ff" * 32, 0, 0)]
    at = str(tmp_path / "index")
    for some in (rows, []):
        index.write(spark.createDataFrame(some, index.SCHEMA).repartition(5), at)
        body = (tmp_path / "index").read_bytes()
        assert body == index.dump(sorted(some))
        assert sorted(map(tuple, index.read(spark, at).collect())) == sorted(some)
    twice = [rows[0], rows[1], (rows[0][0], "11" * 32, 3, 4)]
    (tmp_path / "index").write_bytes(index.dump(twice))
    assert sorted(map(tuple, index.read(spark, at).collect())) == sorted(index.load(index.dump(twice))) == sorted(rows[:2])
    whole = index.dump(rows)
    for bad in (b"", whole[:15], b"X" + whole[1:], whole[:-1], whole + b"x", index.dump([("00" * 32, "00" * 32, 1 << 63, 1)]), whole[:8] + b"\xff" * 8 + whole[16:]):
        (tmp_path / "index").write_bytes(bad)
        for read in (lambda: index.read(spark, at), lambda b=bad: index.load(b)):
            with pytest.raises(CairnError) as e:
                read()
            assert e.value.kind is Kind.CORRUPT


def manifest(n):
    entries = [{"path": f"p{i}/<&> é\"\\", "size": i, "mode": 420, "mod_time": "2020-01-01T00:00:00Z", "chunks": [f"{j:064x}" for j in range(i % 4)]} for i in range(n)]
    out = {"kind": "files", "created_at": "now", "source": '{"path":""', "hostname": "h", "files": entries, "stats": {"files_total": n}}
    return out | {"id": snapshots.compute_id(out)}


@pytest.mark.parametrize("n", [0, 1, 700])
@pytest.mark.parametrize("layout", ["indented", "compact", "late"])
def test_manifests_in_a_stream(spark, tmp_path, n, layout):
    """Any layout of a manifest passes as it does when read whole; one that was changed is refused."""
    s = manifest(n)
    late = {k: s[k] for k in ("files", "stats", "source", "kind", "id", "hostname", "created_at")}
    text = json.dumps(late) if layout == "late" else snapshots.canonical(s, 2 if layout == "indented" else None)
    at = tmp_path / s["id"]
    at.write_text(text, encoding="utf-8")
    small = lambda f: lambda k: f.read(min(k, 7))
    rest = {}
    with at.open(encoding="utf-8") as f:
        assert [e["path"] for _, e in snapshots.elements(small(f), rest)] == [e["path"] for e in s["files"]]
    assert {k: v for k, v in snapshots.head(str(at)).items() if k != "files"} == {k: v for k, v in rest.items() if k != "files"}
    got = snapshots.rows(spark.createDataFrame([(str(at),)], "file string")).orderBy("place").collect()
    assert [(r.snapshot, r.path, r.size, r.chunks) for r in got] == [(s["id"], e["path"], e["size"], e["chunks"]) for e in s["files"]]
    for bad in (text.replace("now", "new"), text[:-1], text + "x", "", "[]", text.replace('"kind"', '"kinds"')):
        at.write_text(bad, encoding="utf-8")
        with pytest.raises(CairnError) as e:
            snapshots.head(str(at))
        assert e.value.kind is Kind.CORRUPT


def test_manifests_are_written_as_canonical(spark, tmp_path):
    """What passes through the driver in parts is the canonical text, and its id is the hash of it."""
    from cairn.repository import SNAPSHOTS, Repository
    from cairn.sources.stores import LocalStore

    repo = Repository.create(spark, LocalStore(tmp_path / "repo", fsync=False))
    for n in (0, 700):
        s = manifest(n)
        s["files"].sort(key=lambda e: e["path"].split("/"))
        s["id"] = snapshots.compute_id(s)
        rows = spark.createDataFrame([tuple(e.values()) for e in s["files"]], "path string, size long, mode int, mod_time string, chunks array<string>")
        saved = repo.save_snapshot({k: v for k, v in s.items() if k not in ("files", "id")}, rows.repartition(3))
        assert saved["id"] == s["id"] and saved["files"] == s["files"] and len(saved["files"]) == n
        assert repo.store.get(SNAPSHOTS + s["id"]).decode() == snapshots.canonical(s, 2)
    assert [o.key for o in repo.store.list(SNAPSHOTS)] and len(repo.list_snapshots()) == 2
