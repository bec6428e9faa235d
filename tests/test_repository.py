import hashlib
import json
import os
import random
import shutil
import signal
import subprocess
import sys
import time
from pathlib import Path

import pytest

from cairn import cli
from cairn.errors import CairnError, Kind
from cairn.operators.chunking import ChunkerConfig
from cairn.repository import INDEX, PACKS, Config, Repository, nanoseconds, now
from cairn.sources.files import rfc3339
from cairn.sources.stores import LocalStore

LIMITS = ChunkerConfig()
#: Files of sizes at and around each limit of the chunker, alternately in two folders, and some of many chunks.
SIZES = {f"{'x/' * (i % 3)}s{n}": n for i, n in enumerate(sorted({0, 7, *[limit + d for limit in (LIMITS.min_size, LIMITS.avg_size, LIMITS.max_size) for d in (-1, 0, 1)], 5 * LIMITS.max_size}))}


MODED = next(p for p, n in SIZES.items() if n == 7)


def fill(root: Path, sizes=SIZES):
    for path, n in sizes.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(random.Random(path).randbytes(n))


@pytest.fixture
def source(tmp_path):
    fill(tmp_path / "src")
    return tmp_path / "src"


@pytest.fixture
def repo(spark, tmp_path):
    return Repository.create(spark, LocalStore(tmp_path / "repo", fsync=False))


def same(a: Path, b: Path):
    files = lambda r: {p.relative_to(r).as_posix(): p.read_bytes() for p in r.rglob("*") if p.is_file()}
    return files(a) == files(b)


def test_round_trip(repo, source, tmp_path):
    os.chmod(source / MODED, 0o640)
    s = repo.backup(str(source))
    assert [f["path"] for f in s["files"]] == sorted(SIZES, key=lambda p: p.split("/"))
    assert s["stats"]["bytes_total"] == sum(SIZES.values()) == s["stats"]["bytes_new"] + s["stats"]["bytes_deduped"]
    got = repo.restore("latest", str(tmp_path / "out"))
    assert got["files"] == len(SIZES) and same(source, tmp_path / "out")
    a, b = (source / MODED).stat(), (tmp_path / "out" / MODED).stat()
    assert a.st_mtime_ns == b.st_mtime_ns and b.st_mode & 0o777 == 0o640
    with pytest.raises(Exception, match="already exists"):
        repo.restore("latest", str(tmp_path / "out"))
    repo.restore(s["id"][:10], str(tmp_path / "out"), overwrite=True)
    report = repo.verify(full=True)
    assert report.ok and report.blobs_read == report.blobs_referenced > 0 and not report.orphan_packs


def test_again_stores_nothing(spark, repo, source):
    first = repo.backup(str(source))
    second = Repository.open(spark, repo.store).backup(str(source))
    assert second["stats"]["blobs_new"] == second["stats"]["packs_written"] == 0 and second["files"] == first["files"]
    assert [s["id"] for s in repo.list_snapshots()] == sorted([first["id"], second["id"]])


def test_a_byte_before_stores_little(repo, tmp_path):
    root = tmp_path / "one"
    fill(root, {"f": 4 << 20})
    repo.backup(str(root))
    (root / "f").write_bytes(b"\xab" + (root / "f").read_bytes())
    again = repo.backup(str(root))["stats"]
    assert again["bytes_new"] <= 0.05 * again["bytes_total"]


def test_progress(repo, source):
    told = []
    s = repo.backup(str(source), progress=told.append)["stats"]
    assert told[0]["files"] == len(SIZES) and told[0]["bytes"] == sum(SIZES.values())
    assert told[1] == {"blobs_new": s["blobs_new"], "blobs_deduped": s["blobs_deduped"]}


def test_copies_are_stored_once(repo, tmp_path):
    fill(tmp_path / "c", {"0": 1 << 20})
    for i in "123":
        shutil.copy(tmp_path / "c" / "0", tmp_path / "c" / i)
    s = repo.backup(str(tmp_path / "c"))["stats"]
    assert s["bytes_deduped"] / (s["bytes_new"] + s["bytes_deduped"]) >= 0.7


def test_dry_run_and_cap(repo, source):
    before = sorted(o.key for o in repo.store.list())
    assert repo.backup(str(source), dry_run=True)["stats"]["packs_written"] >= 1
    with pytest.raises(CairnError):
        repo.backup(str(source), max_bytes=1000)
    assert sorted(o.key for o in repo.store.list()) == before


def test_empty_tree(repo, tmp_path):
    (tmp_path / "none").mkdir()
    s = repo.backup(str(tmp_path / "none"))
    assert s["stats"]["files_total"] == 0 and repo.restore("latest", str(tmp_path / "o"))["files"] == 0


def test_small_packs(spark, source, tmp_path):
    config = Config(created_at=now(), chunker_min_size=256, chunker_avg_size=1024, chunker_max_size=4096, pack_target_size=100_000)
    r = Repository.create(spark, LocalStore(tmp_path / "r", fsync=False), config)
    assert r.backup(str(source))["stats"]["packs_written"] > 5
    r.restore("latest", str(tmp_path / "o"))
    assert same(source, tmp_path / "o") and r.config.chunker() == ChunkerConfig(256, 1024, 4096, 2)


def test_lost_index_is_rebuilt(spark, repo, source, tmp_path):
    repo.backup(str(source))
    for damage in (lambda: repo.store.delete(INDEX), lambda: repo.store.put(INDEX, b"junk")):
        damage()
        again = Repository.open(spark, repo.store)
        assert again.entries == repo.entries
        assert again.backup(str(source))["stats"]["blobs_new"] == 0


def test_damage_is_found(spark, repo, source):
    repo.backup(str(source))
    pack = next(o.key for o in repo.store.list(PACKS))
    body = repo.store.get(pack)
    repo.store.put(pack, b"\xff" + body[1:])
    assert repo.verify().ok and not repo.verify(full=True).ok
    repo.store.delete(pack)
    report = repo.verify()
    assert not report.ok and report.missing_packs == [pack.split("/")[-1]]
    with pytest.raises(CairnError):
        repo.collect_garbage()
    lost = Repository.open(spark, repo.store)
    assert not lost.entries
    repo.store.put(pack, body)
    repo.store.put("packs/zz/stray", b"")
    assert repo.verify().problems
    snapshot = next(o.key for o in repo.store.list("snapshots/"))
    doc = json.loads(repo.store.get(snapshot))
    repo.store.put(snapshot, json.dumps(doc | {"source": "elsewhere"}).encode())
    with pytest.raises(CairnError):
        repo.verify()


def test_lanes(spark, tmp_path):
    """Enough new bytes are dealt into lanes, and come back."""
    fill(tmp_path / "many", {f"f{i}": 1 << 18 for i in range(8)})
    config = Config(created_at=now(), chunker_min_size=256, chunker_avg_size=1024, chunker_max_size=4096, pack_target_size=20_000)
    r = Repository.create(spark, LocalStore(tmp_path / "r", fsync=False), config)
    assert r.backup(str(tmp_path / "many"))["stats"]["packs_written"] > 64
    r.restore("latest", str(tmp_path / "o"))
    assert same(tmp_path / "many", tmp_path / "o") and r.verify(full=True).ok


def test_garbage(spark, repo, source, tmp_path):
    kept = repo.backup(str(source))
    fill(tmp_path / "more", {"m": 1 << 20})
    gone = repo.backup(str(tmp_path / "more"))
    repo.store.delete("snapshots/" + gone["id"])
    dry = repo.collect_garbage(dry_run=True)
    assert dry["packs"] == 1 and dry["bytes"] > 1 << 20 and repo.verify().packs == 2
    assert repo.collect_garbage()["packs"] == 1 and repo.collect_garbage()["packs"] == 0
    again = Repository.open(spark, repo.store)
    assert again.verify(full=True).ok and again.list_snapshots()[0]["id"] == kept["id"]
    assert again.backup(str(tmp_path / "more"))["stats"]["blobs_new"] > 0


def test_a_run_that_died_is_adopted(spark, repo, source):
    repo.backup(str(source))
    for o in list(repo.store.list("snapshots/")):
        repo.store.delete(o.key)
    repo.store.delete(INDEX)
    again = Repository.open(spark, repo.store)
    assert len(again.verify().orphan_packs) == 1
    assert again.backup(str(source))["stats"]["blobs_new"] == 0 and again.verify(full=True).ok


def test_configs(spark, tmp_path):
    s = LocalStore(tmp_path / "c", fsync=False)
    with pytest.raises(CairnError) as e:
        Repository.open(spark, s)
    assert e.value.kind is Kind.NOT_FOUND
    Repository.create(spark, s)
    with pytest.raises(CairnError) as e:
        Repository.create(spark, s)
    assert e.value.kind is Kind.ALREADY_EXISTS
    doc = json.loads(s.get("config"))
    for change, kind in (({"format_version": 2}, Kind.UNSUPPORTED), ({"chunker_avg_size": 3}, Kind.CORRUPT), ({"pack_target_size": 0}, Kind.CORRUPT)):
        s.put("config", json.dumps(doc | change).encode())
        with pytest.raises(CairnError) as e:
            Repository.open(spark, s)
        assert e.value.kind is kind


def outside():
    """Paths that lead, or could lead, out of a target: a step up at each place, roots, nothing, NUL."""
    parts = ["p", "q", "r"]
    yield from ("/".join([*parts[:i], "..", *parts[i:]]) for i in range(len(parts) + 1))
    yield from ("", "/", "/".join(["", *parts]), "p\0q", "..")


@pytest.mark.parametrize("path", list(outside()))
def test_restore_stays_below_its_target(repo, source, tmp_path, path):
    """A manifest that names such a path is refused before a byte is written."""
    from cairn.operators import snapshots
    from cairn.repository import safe_path

    assert not safe_path(path) and safe_path("..p/q..")
    good = repo.backup(str(source))
    bad = good | {"id": "", "files": [*good["files"][:2], good["files"][0] | {"path": path}]}
    bad["id"] = snapshots.compute_id(bad)
    repo.store.put("snapshots/" + bad["id"], snapshots.canonical(bad, indent=2).encode())
    with pytest.raises(CairnError):
        repo.restore(bad["id"], str(tmp_path / "t" / "u"))
    assert not (tmp_path / "t").exists()


def test_times():
    for ns in (0, 1_700_000_000_123_456_789, 1_700_000_000_500_000_000):
        assert nanoseconds(rfc3339(ns)) == ns


def test_command_line(spark, source, tmp_path, capsys):
    r, out = str(tmp_path / "r"), str(tmp_path / "o")
    assert cli.main(["init", "--repo", r]) == 0 and cli.main(["init", "--repo", r]) == 1
    capsys.readouterr()
    assert cli.main(["snapshots", "--repo", r]) == 0 and not capsys.readouterr().out
    assert cli.main(["backup", "--repo", r, "--source", str(source), "--estimate"]) == 0
    assert f"{len(SIZES)} files" in capsys.readouterr().out
    assert cli.main(["backup", "--repo", r, "--source", str(source), "--upload-workers", "2"]) == 0
    assert cli.main(["backup", "--repo", r, "--source", str(source), "--dry-run"]) == 0
    text = capsys.readouterr().out
    assert "known: 0 blobs" in text and "new: 0 blobs" in text and "kept nothing" in text
    assert cli.main(["list", "--repo", r]) == 0
    fields = capsys.readouterr().out.strip().split("\t")
    assert len(fields) == 5 and fields[2:] == [str(len(SIZES)), str(sum(SIZES.values())), str(source)]
    assert cli.main(["restore", "--repo", r, "--snapshot", "latest", "--target", out]) == 0 and same(source, Path(out))
    assert cli.main(["verify", "--full", "--repo", r]) == 0 and capsys.readouterr().out.count("ok: 1 snapshots") == 1
    assert cli.main(["gc", "--dry-run", "--repo", r]) == 0 and cli.main(["gc", "--repo", r]) == 0
    assert cli.main(["version"]) == 0 and cli.main([]) == 2 and cli.main(["nothing"]) == 2
    LocalStore(r).delete(next(o.key for o in LocalStore(r).list(PACKS)))
    assert cli.main(["verify", "--repo", r]) == 1
    assert [cli.human_bytes(n) for n in (0, 1023, 1024, 1536, 1 << 40, 1 << 60)] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "1.0 TiB", "1024.0 PiB"]


def test_killed_runs_leave_a_good_repository(spark, source, tmp_path):
    r = str(tmp_path / "r")
    store = LocalStore(r)
    Repository.create(spark, store)
    for wait in (5.0, 7.5):
        p = subprocess.Popen([sys.executable, "-m", "cairn", "backup", "--repo", r, "--source", str(source)], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
        time.sleep(wait)
        if p.poll() is None:
            os.killpg(p.pid, signal.SIGKILL)
        p.wait()
        again = Repository.open(spark, store)
        assert again.verify(full=True).ok
    again = Repository.open(spark, store)
    again.backup(str(source))
    again.restore("latest", str(tmp_path / "o"))
    assert same(source, tmp_path / "o")


def test_streaming_ingest(spark, tmp_path):
    from cairn.operators.chunking import SMALL, cdc_chunks
    from cairn.streaming.ingest import ingest

    inbox, table = tmp_path / "in", str(tmp_path / "blobs")
    inbox.mkdir()
    a, b = random.Random(1).randbytes(30_000), random.Random(2).randbytes(9_000)
    want = set()
    for name, data in (("1.bin", a), ("2.bin", a + b)):
        (inbox / name).write_bytes(data)
        stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(inbox))
        q = ingest(stream, table, str(tmp_path / "cp"), SMALL)
        q.awaitTermination()
        want |= {r.blob_id for r in cdc_chunks(spark.createDataFrame([(name, bytearray(data))], "path string, content binary"), SMALL).collect()}
    got = [r.blob_id for r in spark.read.parquet(table).collect()]
    assert len(got) == len(set(got)) and set(got) == want and hashlib.sha256(a[: len(a)]).hexdigest()
