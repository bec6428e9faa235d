"""Command line: init, backup, restore, snapshots, verify, gc, version."""

from __future__ import annotations

import argparse
import sys
import time

from cairn import __version__
from cairn.errors import CairnError, Kind, kind_of


def human_bytes(n: int) -> str:
    unit = next((i for i in range(5, 0, -1) if n >= 1024**i), 0)
    return f"{n / 1024**unit:.1f} {'KMGTP'[unit - 1]}iB" if unit else f"{n} B"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cairn", description="Deduplicating backups on Spark.")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *aliases: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about, aliases=list(aliases))
        p.set_defaults(name=name)
        if name != "version":
            p.add_argument("--repo", required=True, help="repository path")
        return p

    command("init", "make a repository")
    p = command("backup", "store a directory")
    p.add_argument("--source", required=True, help="directory to back up")
    p.add_argument("--dry-run", action="store_true", help="measure without writing")
    p.add_argument("--max-bytes", type=int, default=0, help="refuse to read more (0: no limit)")
    p.add_argument("--skip-unreadable", action="store_true", help="skip what can't be read")
    p.add_argument("--chunk-workers", type=int, default=0, help="cores for tasks (0: all)")
    p.add_argument("--upload-workers", type=int, default=0, help="tasks that write packs (0: as Spark deals)")
    p.add_argument("--estimate", action="store_true", help="tell files, bytes and requests without reading them")
    p.add_argument("-v", action="store_true", help="log more")
    p = command("restore", "write a snapshot's files")
    p.add_argument("--snapshot", required=True, help='id, its first eight characters or more, or "latest"')
    p.add_argument("--target", required=True, help="directory to write into")
    p.add_argument("--overwrite", action="store_true", help="replace files that are there")
    p.add_argument("--workers", type=int, default=0, help="cores for tasks (0: all)")
    command("snapshots", "list snapshots", "list")
    p = command("verify", "check the repository")
    p.add_argument("--full", action="store_true", help="read and hash every blob")
    p = command("gc", "delete packs that nothing needs")
    p.add_argument("--dry-run", action="store_true", help="report only")
    command("version", "print the version")
    return out


def session(workers: int = 0):
    from pyspark.sql import SparkSession

    from cairn.plans.shipping import ship

    spark = SparkSession.getActiveSession()
    if spark is None:
        n = workers or "*"
        spark = SparkSession.builder.master(f"local[{n}]").appName("cairn").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def run(args: argparse.Namespace) -> int:
    from cairn.repository import Repository
    from cairn.sources.stores import LocalStore

    if args.name == "version":
        print(f"cairn {__version__}")
        return 0
    spark = session(getattr(args, "chunk_workers", 0) or getattr(args, "workers", 0))
    store, began = LocalStore(args.repo), time.monotonic()
    if args.name == "init":
        layout = Repository.create(spark, store).config.format_version
        print(f"new repository below {args.repo}, layout {layout}")
        return 0
    r = Repository.open(spark, store)
    say = {"backup": backup, "restore": restore, "snapshots": snapshots, "verify": verify, "gc": gc}[args.name]
    spark.sparkContext.setJobGroup(GROUP, f"cairn {args.name}", interruptOnCancel=True)
    try:
        for line in say(r, args):
            print(line)
    except KeyboardInterrupt:
        spark.sparkContext.cancelJobGroup(GROUP)  # tasks that still run stop too
        raise
    if args.name in ("backup", "restore"):
        print(f"in {time.monotonic() - began:.1f} s")
    return 0


GROUP = "cairn"


def backup(r, args):
    if args.estimate:
        e = r.estimate(args.source, args.skip_unreadable)
        yield f"would read {e['files']} files of {human_bytes(e['bytes'])} and make {e['requests']} requests at most"
        return
    told = (lambda x: print(", ".join(f"{k}={v}" for k, v in x.items()), file=sys.stderr)) if args.v else None
    s = r.backup(args.source, args.dry_run, args.max_bytes, args.skip_unreadable, progress=told, pack_tasks=args.upload_workers)
    n = s["stats"]
    yield f"read {n['files_total']} files, {human_bytes(n['bytes_total'])}"
    yield f"new: {n['blobs_new']} blobs, {human_bytes(n['bytes_new'])}, in {n['packs_written']} packs"
    total = n["bytes_new"] + n["bytes_deduped"]
    yield f"known: {n['blobs_deduped']} blobs, {human_bytes(n['bytes_deduped'])}, {100 * n['bytes_deduped'] / total if total else 0:.0f} % of all"
    yield "kept nothing, as asked (--dry-run)" if args.dry_run else f"kept as {s['id']}"


def restore(r, args):
    got = r.restore(args.snapshot, args.target, args.overwrite)
    yield f"wrote {got['files']} files, {human_bytes(got['bytes'])}, of {got['snapshot']} below {args.target}"


def snapshots(r, args):
    """A line for each, fields between tabs: id, time, files, bytes, tree."""
    for s in r.list_snapshots():
        yield "\t".join([s["id"], s["created_at"], str(s["stats"]["files_total"]), str(s["stats"]["bytes_total"]), s["source"]])


def verify(r, args):
    report = r.verify(args.full)
    yield report.summary()
    for p in report.problems:
        print(p, file=sys.stderr)
    if report.orphan_packs:
        yield f"{len(report.orphan_packs)} packs are in no snapshot; gc frees them"
    if not report.ok:
        raise CairnError(Kind.CORRUPT, "verify", "the repository is damaged")


def gc(r, args):
    got = r.collect_garbage(args.dry_run)
    yield f"{'to free' if got['dry_run'] else 'freed'}: {got['packs']} packs, {human_bytes(got['bytes'])}"


def main(argv: list[str] | None = None) -> int:
    """0 when done, 1 for a failure, 2 for wrong arguments, 130 when interrupted."""
    try:
        return run(parser().parse_args(argv))
    except SystemExit as e:
        return int(e.code or 0)
    except KeyboardInterrupt:
        print("stopped; what was begun is not a snapshot", file=sys.stderr)
        return 130
    except Exception as e:
        if kind_of(e) is Kind.CANCELED:
            return 130
        print(f"cairn: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
