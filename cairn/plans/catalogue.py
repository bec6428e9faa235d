"""The registered queries of the core operators, each with the SQL that gives the same rows.

Inputs: a document or page is a file (its id the path, its text the content). The older
state of a repository holds the benchmark's and the conversations' texts, the newer one the
documents; an edited state has a mark before the text of the French documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import blocks, chunking, dedup, index, objects, packs, restore, snapshots, verify
from cairn.plans.durable import durable
from cairn.sources import devices

BLOCK = 512
TARGET = 65_536


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _files(spark: SparkSession, d: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    return _read(spark, d, table).select(F.col(key).alias("path"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content"))


def _edited(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    text = F.concat(F.when(F.col("lang") == "fr", "X").otherwise(""), F.coalesce("text", F.lit("")))
    return docs.select(F.col("doc_id").alias("path"), text.cast("binary").alias("content"))


def _older(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of what the repository held before."""
    bench = _files(spark, d, "benchmark", "item_id")
    talks = _read(spark, d, "conversations").select(F.col("conv_id").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return chunking.fixed_blocks(bench.union(talks), BLOCK)


def _blocks(spark: SparkSession, d: str, with_data: bool = False) -> DataFrame:
    return chunking.fixed_blocks(_files(spark, d), BLOCK, with_data=with_data)


def _cdc(spark: SparkSession, d: str) -> DataFrame:
    return chunking.cdc_chunks(_files(spark, d), chunking.SMALL)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    blobs = _blocks(spark, d).groupBy("blob_id").agg(F.max("length").alias("length"))
    return packs.assemble(blobs, TARGET, lane_digits=1)


def _index(spark: SparkSession, d: str) -> DataFrame:
    """Index whose packs are named after their lane and number."""
    at = F.concat("lane", F.lit("-"), F.col("pack").cast("string"))
    return _packed(spark, d).select("blob_id", at.alias("pack_id"), "offset", "length")


def _stored(spark: SparkSession, d: str, at: DataFrame) -> DataFrame:
    """The packs' bytes: pack_id, content, of an index's blobs in the order of their offsets."""
    blob = F.unhex("blob_id").alias("blob")
    data = _blocks(spark, d, with_data=True).select(blob, "data").dropDuplicates(["blob"])
    return at.select(blob, "pack_id", "offset").join(data, "blob").groupBy("pack_id").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY offset)").alias("content"))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """What two snapshots reference: the documents', and the edited documents'."""
    now = chunking.fixed_blocks(_edited(spark, d), BLOCK).select(F.lit("s2").alias("snapshot_id"), "blob_id")
    return _blocks(spark, d).select(F.lit("s1").alias("snapshot_id"), "blob_id").union(now)


def _present(spark: SparkSession, at: DataFrame) -> DataFrame:
    """Packs in the store of an index: lane ``f``'s are lost, and one per lane ``0`` to ``3`` is a stray."""
    size = at.groupBy("pack_id").agg(F.sum("length").alias("size"))
    stray = spark.range(4).select(F.concat(F.lit("stray-"), F.col("id").cast("string")).alias("pack_id"), (F.col("id") * 100 + 7).alias("size"))
    return size.filter(~F.startswith("pack_id", F.lit("f"))).union(stray)


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """One snapshot per source: id of its name, created when its longest document says."""
    docs = _read(spark, d, "documents")
    return docs.groupBy("source").agg(F.max("n_chars").alias("created_at"), F.count(F.lit(1)).alias("files")).select(F.sha2("source", 256).alias("id"), "source", "created_at", "files")


def content_address(spark, d):
    f = _files(spark, d)
    i = S.content_id(F.col("content"))
    return f.select("path", i.alias("blob_id"), S.short_id(i).alias("short"), S.shard_of(i).alias("shard"), S.is_zero(i).alias("zero"))


def parse_ids(spark, d):
    up = F.when(F.octet_length("content") % 2 == 0, F.upper(S.content_id(F.col("content")))).otherwise(F.decode(F.col("content"), "UTF-8"))
    return _files(spark, d).select("path", S.parse_id(up).alias("id"))


def fixed_blocks(spark, d):
    return _blocks(spark, d)


def cdc_chunks(spark, d):
    return _cdc(spark, d)


def dedup_stats_fixed(spark, d):
    return dedup.run_stats(_blocks(spark, d))


def dedup_stats_cdc(spark, d):
    return dedup.run_stats(_cdc(spark, d))


def incremental_dedup(spark, d):
    return dedup.new_blobs(_blocks(spark, d), _older(spark, d))


def incremental_stats(spark, d):
    files = _files(spark, d).select("path", F.octet_length("content").cast("long").alias("size"))
    return dedup.run_stats(_blocks(spark, d), _older(spark, d), files)


def index_first_wins(spark, d):
    entries = _blocks(spark, d).select("blob_id", F.col("path").cast("string").alias("pack_id"), "offset", "length")
    return index.first_wins(entries)


def index_lookup(spark, d):
    asked = chunking.fixed_blocks(_edited(spark, d), BLOCK).select("path", "idx", "blob_id")
    return index.lookup(asked, _index(spark, d))


def index_insert(spark, d):
    entries = _blocks(spark, d).select("blob_id", F.col("path").cast("string").alias("pack_id"), "offset", "length")
    return index.insert(_older(spark, d), entries)


def rebuild_index(spark, d):
    at = durable(_index(spark, d), "index")
    return index.rebuild(at, _present(spark, at))


def pack_assembly(spark, d):
    return _packed(spark, d)


def pack_sizes(spark, d):
    return packs.pack_rows(_packed(spark, d))


def shard_histogram(spark, d):
    return index.shard_histogram(_index(spark, d))


def shard_stats(spark, d):
    return index.shard_stats(_index(spark, d)).withColumn("sigma", F.round("sigma", 6))


def snapshot_manifest(spark, d):
    files = _files(spark, d).select("path", F.octet_length("content").cast("long").alias("size"))
    out = snapshots.manifest(_blocks(spark, d), files)
    return out.select("path", "size", F.array_join("chunks", ",").alias("chunks"))


def snapshot_blob_ids(spark, d):
    return snapshots.blob_ids(_blocks(spark, d))


def list_snapshots(spark, d):
    return snapshots.listed(_snapshots(spark, d))


def latest_snapshot(spark, d):
    return snapshots.latest(_snapshots(spark, d))


def resolve_prefix(spark, d):
    """Snapshots whose id begins like that of source ``src7``."""
    import hashlib

    return snapshots.matching(_snapshots(spark, d), hashlib.sha256(b"src7").hexdigest()[:10])


def snapshot_validity(spark, d):
    """What is wrong with a manifest per source: its files are the documents; some are of blocks."""
    docs = _read(spark, d, "documents")
    files = F.collect_list(F.struct(F.when(F.col("n_chars") > 20, "lang").otherwise("").alias("path"), (F.col("n_chars") - 10).alias("size")))
    m = docs.groupBy("source").agg(files.alias("files"))
    none = F.lit(None).cast("array<struct<index:bigint,blob:string>>")
    kind = F.when(F.length("source") == 4, "files").when(F.endswith("source", F.lit("5")), "disks").otherwise("blocks")
    return m.select("source", S.snapshot_problem(kind, F.lit(512), F.col("files"), none).alias("problem"))


def verify_dangling(spark, d):
    return verify.dangling(_refs(spark, d), _index(spark, d))


def verify_missing(spark, d):
    at = durable(_index(spark, d), "index")
    return verify.missing_packs(_refs(spark, d), at, _present(spark, at))


def verify_orphans(spark, d):
    at = durable(_index(spark, d), "index")
    return verify.orphan_packs(_refs(spark, d), at, _present(spark, at))


def verify_summary(spark, d):
    at = durable(_index(spark, d), "index")
    return verify.summary(_refs(spark, d), at, _present(spark, at))


def verify_full(spark, d):
    """Blobs that no longer hash to their id after a byte is put before the French documents."""
    # A pack a document: its bytes as they are now, its entries by the ids they were stored under.
    stored = _blocks(spark, d).select("path", "idx", "blob_id")
    now = chunking.fixed_blocks(_edited(spark, d), BLOCK).select("path", "idx", "offset", "length")
    entries = stored.join(now, ["path", "idx"]).withColumn("pack_id", F.col("path").cast("string"))
    held = _edited(spark, d).select(F.col("path").cast("string").alias("pack_id"), "content")
    return verify.broken_blobs(entries, held, ("path", "idx")).select("path", "idx", "blob_id")


def gc_plan(spark, d):
    """What a collection would free: of all present packs, and of those that nothing needs."""
    refs, at = _blocks(spark, d).select(F.lit("s1").alias("snapshot_id"), "blob_id"), durable(_index(spark, d), "index")
    size = at.groupBy("pack_id").agg(F.sum("length").alias("size"))
    stray = _present(spark, at).filter(F.startswith("pack_id", F.lit("stray")))
    whole = verify.reclaimable(refs, at, size.union(stray)).withColumn("case", F.lit("whole"))
    return whole.union(verify.reclaimable(refs, at, _present(spark, at)).withColumn("case", F.lit("lost")))


def restore_files(spark, d):
    files = _files(spark, d).select("path", F.octet_length("content").cast("long").alias("size"))
    at = _index(spark, d)
    blobs = restore.fetch(_blocks(spark, d).select("path", "idx", "blob_id"), at, _stored(spark, d, at))
    out = restore.rebuild(files, blobs)
    return out.select("path", "size", S.content_id(F.col("content")).alias("content_id"), "ok")


def restore_totals(spark, d):
    out = restore_files(spark, d)
    return out.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum(F.when(F.col("ok"), 0).otherwise(1)).cast("long").alias("failed"))


def _device(blocks_: DataFrame) -> DataFrame:
    return blocks_.select("path", F.col("idx").alias("block_index"), "blob_id")


def changed_blocks(spark, d):
    now, then = _device(chunking.fixed_blocks(_edited(spark, d), BLOCK)), _device(_blocks(spark, d))
    return blocks.changed(now, then, ("path", "block_index"))


def sparse_blocks(spark, d):
    """Written blocks of a device: the documents' blocks but those that begin with a space, its holes."""
    held = _blocks(spark, d, with_data=True).filter(F.substring("data", 1, 1) != F.lit(b" "))
    return blocks.listed(held.select(F.concat("path", F.lit(":"), F.col("idx")).alias("block_index"), "blob_id"))


def device_blocks(spark, d):
    """A device with a block for every document, two of three written, listed and read in tasks."""
    n = _read(spark, d, "documents").count()
    return devices.table(spark, devices.BlockSource(devices.PatternService(n), "snap"))


def listing_order(spark, d):
    """Places where the conversations' turns, taken as a block listing by their roles' lengths, don't rise."""
    c = _read(spark, d, "conversations").select(F.col("conv_id").alias("snapshot"), F.col("turn").alias("place"), F.length("role").alias("block_index"))
    return blocks.disordered(c)


def checksum_verify(spark, d):
    data = _blocks(spark, d, with_data=True)
    stated = F.when(F.col("idx") == 3, F.lit("bad")).otherwise(S.checksum(F.col("data")))
    return data.select("path", "idx", S.checksum(F.col("data")).alias("checksum"), S.checksum_ok(F.col("data"), stated, F.lit("SHA256")).alias("ok"))


def boundary_resync(spark, d):
    """Boundaries that stay where they were after a byte is put before each document: cut by content, and in blocks."""
    old = _files(spark, d)
    new = old.withColumn("content", F.concat(F.lit(b"\xab"), "content"))
    cdc = chunking.resync(chunking.cdc_chunks(old, chunking.SMALL), chunking.cdc_chunks(new, chunking.SMALL))
    fixed = chunking.resync(chunking.fixed_blocks(old, BLOCK), chunking.fixed_blocks(new, BLOCK))
    return cdc.withColumn("cut", F.lit("content")).union(fixed.withColumn("cut", F.lit("fixed")))


def chunk_size_distribution(spark, d):
    return chunking.size_distribution(_cdc(spark, d), chunking.SMALL)


def backup_estimate(spark, d):
    files = _files(spark, d).select("path", F.octet_length("content").cast("long").alias("size"))
    return dedup.estimate(files, TARGET)


def byte_cap(spark, d):
    """By source, whether reading it would pass a cap of a hundred thousand bytes."""
    docs = _read(spark, d, "documents").select("source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return dedup.over_byte_cap(docs, 100_000, ("source",))


def safe_paths(spark, d):
    """Whether the path of a page's URL, and the same below ``..``, may be restored."""
    u = _read(spark, d, "pages").select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("u"))
    u = u.select("page_id", "u", F.regexp_replace("u", "^[a-z]+://", "").alias("p"))
    return u.select("page_id", S.safe_path(F.col("p")).alias("plain"), S.safe_path(F.concat(F.lit("../"), "p")).alias("above"), S.safe_path(F.concat(F.lit("/"), "p")).alias("rooted"))


def valid_keys(spark, d):
    u = _read(spark, d, "pages").select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("u"))
    return u.select("page_id", S.valid_key(F.col("u")).alias("url"), S.valid_key(F.regexp_replace("u", "^[a-z]+://", "")).alias("bare"))


def list_prefix(spark, d):
    """Objects below one host's prefix, hidden ones left out."""
    o = _read(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("key"), F.octet_length("html").cast("long").alias("size"))
    return objects.listed(o, "www.")


def put_if_absent(spark, d):
    """Objects that a conditional create would add: benchmark items whose text no conversation turn has."""
    new = _read(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("key"))
    there = _read(spark, d, "conversations").select(F.sha2("text", 256).alias("key"))
    return objects.put_if_absent(there, new).select("item_id", "key")


def get_range(spark, d):
    """Ranges of every document: from 10, 16 bytes; from its last tenth to the end; past the end; none."""
    f = _files(spark, d).withColumn("n", F.octet_length("content"))
    cut = lambda o, k: F.hex(S.byte_range(F.col("content"), o, k))
    n = F.col("n")
    return f.select("path", cut(F.lit(10), F.lit(16)).alias("part"), cut(n - F.floor(n / 10).cast("int"), F.lit(-1)).alias("tail"), cut(n - 2, F.lit(50)).alias("past"), cut(F.lit(0), F.lit(0)).alias("none"), cut(F.lit(-1), F.lit(4)).alias("before"))


def human_bytes(spark, d):
    f = _files(spark, d).select("path", F.octet_length("content").cast("long").alias("n"))
    return f.select("path", S.human_bytes(F.col("n")).alias("size"), S.human_bytes(F.col("n") * 1_000_000).alias("large"))


def page_sizes(spark, d):
    return _read(spark, d, "documents").select("doc_id", S.page_size(F.col("n_chars") - F.col("n_chars") % 7 * F.col("n_chars"), 1000).cast("long").alias("page"))


def pack_keys(spark, d):
    i = S.content_id(F.col("content"))
    f = _files(spark, d).select("path", S.pack_key(i).alias("key"))
    return f.select("path", "key", S.pack_id_of(F.col("key")).alias("pack_id"), S.pack_id_of(F.concat("key", F.lit("~"))).alias("stray"))


def expired_tokens(spark, d):
    """Events taken as block tokens with an hour to live: those that had run out at the last event."""
    e = _read(spark, d, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL 60 MINUTES")).alias("expiry"))
    last = _read(spark, d, "events").agg(F.max("ts").alias("now"))
    return e.crossJoin(F.broadcast(last)).select("event_id", S.expired(F.col("expiry"), F.col("now")).alias("expired"))


def _objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects by language and number of the documents: key, size."""
    docs = _read(spark, d, "documents")
    return docs.select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("key"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))


def object_put(spark, d):
    """A put of an empty object for every benchmark item, under keys of which some are taken."""
    docs = _read(spark, d, "documents").filter("doc_id % 3 = 0")
    new = docs.select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("key"), F.lit(0).cast("long").alias("size"))
    more = _read(spark, d, "benchmark").select(F.concat(F.lit("items/"), F.col("item_id").cast("string")).alias("key"), F.lit(0).cast("long").alias("size"))
    return objects.put(_objects(spark, d), new.union(more))


def object_stat(spark, d):
    keys = _read(spark, d, "documents").select(F.concat_ws("/", "lang", F.lit("src7"), F.col("doc_id").cast("string")).alias("key"))
    return objects.stat(_objects(spark, d), keys)


def object_delete(spark, d):
    keys = _read(spark, d, "documents").select(F.concat_ws("/", F.lit("fr"), "source", F.col("doc_id").cast("string")).alias("key"))
    return objects.delete(_objects(spark, d), keys)


def object_prefix(spark, d):
    return objects.prefixed(_objects(spark, d), "/de/")


def _pack_files(spark, d):
    """The pack files of the documents' blocks, in lanes by the first digit of their ids."""
    data = _blocks(spark, d, with_data=True).select("blob_id", "data").dropDuplicates(["blob_id"])
    return packs.files(_packed(spark, d), data)


def pack_files(spark, d):
    return _pack_files(spark, d).select("lane", "pack", "pack_id", "blobs", "size")


def pack_entries(spark, d):
    """What the headers at the packs' tails say."""
    return packs.entries_of(_pack_files(spark, d))


def pack_validity(spark, d):
    """Packs as they are, cut by a byte, with another magic, and with nothing but a trailer."""
    f, n = _pack_files(spark, d).select("lane", "pack", "content"), F.octet_length("content")
    cut = lambda a, b: F.substring(F.col("content"), F.lit(a) if isinstance(a, int) else a, b)
    cases = {"whole": F.col("content"), "cut": cut(1, n - 1), "magic": F.concat(cut(1, n - 1), F.lit(b"9")), "bare": cut(n - 11, F.lit(12)), "short": cut(1, F.lit(5))}
    made = [f.select(F.concat_ws("-", "lane", F.col("pack").cast("string"), F.lit(c)).alias("pack_id"), x.alias("content")) for c, x in cases.items()]
    out = made[0]
    for m in made[1:]:
        out = out.union(m)
    return packs.problems(out)


def pack_verified(spark, d):
    return packs.verified(_pack_files(spark, d))


def pack_lookup(spark, d):
    """The blocks of the edited documents, looked for in the pack that their first digit's lane begins with."""
    entries = _index(spark, d)
    asked = chunking.fixed_blocks(_edited(spark, d), BLOCK).select(F.concat(F.substring("blob_id", 1, 1), F.lit("-0")).alias("pack_id"), "blob_id").distinct()
    return packs.lookup(entries, asked)


def rebuild_from_packs(spark, d):
    """An index from nothing but pack files, those of lane ``0`` lost."""
    stored = _pack_files(spark, d)
    return index.rebuild(packs.entries_of(stored), stored.filter("lane <> '0'"))


def fetch_blobs(spark, d):
    """Every block of every document, from the index to its pack and cut out of it."""
    at = _index(spark, d)
    got = restore.fetch(_blocks(spark, d).select("path", "idx", "blob_id"), at, _stored(spark, d, at))
    return got.select("path", "idx", "blob_id", F.octet_length("data").alias("length"), S.is_content(F.col("data"), F.col("blob_id")).alias("ok"))


def index_size(spark, d):
    return index.size(_index(spark, d))


def index_delete(spark, d):
    """The index without what the edited documents still have."""
    return index.delete(_index(spark, d), chunking.fixed_blocks(_edited(spark, d), BLOCK))


def _hashed_index(spark, d):
    return _index(spark, d).withColumn("pack_id", F.sha2("pack_id", 256))


def index_dump(spark, d):
    return index.dumped(_hashed_index(spark, d)).select("shard", "entries", F.sha2("content", 256).alias("sha256"))


def index_load(spark, d):
    return index.loaded(index.dumped(_hashed_index(spark, d)))


def _manifests(spark, d):
    """A manifest a source: its documents as files, with their blocks."""
    files = _files(spark, d).select("path", F.octet_length("content").cast("long").alias("size"))
    rows = snapshots.manifest(_blocks(spark, d), files).join(_read(spark, d, "documents").select(F.col("doc_id").alias("path"), "source"), "path")
    one = F.struct(F.lpad(F.col("path").cast("string"), 12, "0").alias("path"), "size", F.lit(420).alias("mode"), F.lit("2024-01-01T00:00:00Z").alias("mod_time"), "chunks")
    out = rows.groupBy("source").agg(F.sort_array(F.collect_list(one)).alias("files"))
    return out.withColumns({"kind": F.lit("files"), "created_at": F.lit("2024-01-02T03:04:05Z")})


def snapshot_ids(spark, d):
    return snapshots.ids(_manifests(spark, d))


def snapshot_integrity(spark, d):
    """Manifests under the ids that they had; of sources ending in 3 the time was changed since."""
    m = _manifests(spark, d)
    late = F.when(F.endswith("source", F.lit("3")), F.lit("2024-01-02T03:04:06Z")).otherwise(F.col("created_at"))
    return snapshots.broken(m.join(snapshots.ids(m), "source").withColumn("created_at", late))


def cdc_stream(spark, d):
    return chunking.streamed_chunks(_files(spark, d), chunking.SMALL, read=1000)


def unreadable_blocks(spark, d):
    """Blocks read with tokens that ran out, data that is too long and checksums that don't hold."""
    b = _blocks(spark, d, with_data=True)
    stated = F.when(F.col("idx") % 5 == 2, F.lit("bad")).otherwise(S.checksum(F.col("data")))
    data = F.when(F.col("idx") % 5 == 4, F.rpad("data", blocks.BLOCK_SIZE + 1, b"x")).otherwise(F.col("data"))
    b = b.select("path", "idx", data.alias("data"), stated.alias("checksum"), F.when(F.col("idx") % 5 == 1, F.lit(10.0)).when(F.col("idx") % 5 == 3, F.lit(90.0)).alias("expiry"))
    return blocks.unreadable(b, F.lit(60.0)).select("path", "idx", "why")


def request_costs(spark, d):
    """What reading a device of a source's documents would take: a gibibyte for each, a block for each character."""
    docs = _read(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("gib"), F.sum("n_chars").alias("written"))
    out = blocks.costs(docs.select("source", (F.col("gib") * blocks.GIB).alias("size"), "written"))
    return out.withColumn("usd", F.round("usd", 9))


def walk_order(spark, d):
    """The place of every page's path in a walk of its host, folders in order of their names."""
    from pyspark.sql import Window

    u = _read(spark, d, "pages").select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-z]+://", "").alias("p"))
    u = u.withColumn("host", F.substring_index("p", "/", 1))
    place = F.row_number().over(Window.partitionBy("host").orderBy(S.walk_order(F.col("p")), "page_id"))
    return u.select("page_id", "host", place.cast("long").alias("place"))


def config_validity(spark, d):
    """Chunk sizes made of the documents' numbers, most of which can't be."""
    i = F.col("doc_id")
    docs = _read(spark, d, "documents").select("doc_id", (i % 7 * 64).alias("least"), F.when(i % 3 == 0, F.lit(256)).otherwise(i % 5 * 100).cast("long").alias("average"), (i % 11 * 100).alias("most"), (i % 6 - 1).alias("normalization"), (i % 13).alias("target"))
    return docs.select("doc_id", S.config_problem(*[F.col(c) for c in ("least", "average", "most", "normalization", "target")]).alias("problem"))


def retry_waits(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 12).alias("attempt"), (F.col("doc_id") % 2 == 1).alias("throttled"))
    return docs.withColumn("longest", F.round(S.longest_wait(F.col("attempt"), F.col("throttled")), 6))


def status_kinds(spark, d):
    """Documents' numbers taken as answers of a service: the kind of error, and whether to try again."""
    docs = _read(spark, d, "documents").select("doc_id", S.status_kind(F.col("doc_id") % 250 + 380).alias("kind"))
    return docs.withColumn("again", S.retryable(F.col("kind")))


NAMES = [
    "object_put object_stat object_delete object_prefix pack_files pack_entries pack_validity pack_verified pack_lookup rebuild_from_packs",
    "fetch_blobs index_size index_delete index_dump index_load snapshot_ids snapshot_integrity cdc_stream",
    "unreadable_blocks request_costs walk_order config_validity retry_waits status_kinds",
    "content_address parse_ids fixed_blocks cdc_chunks dedup_stats_fixed dedup_stats_cdc incremental_dedup incremental_stats",
    "index_first_wins index_lookup index_insert rebuild_index pack_assembly pack_sizes shard_histogram shard_stats",
    "snapshot_manifest snapshot_blob_ids list_snapshots latest_snapshot resolve_prefix snapshot_validity",
    "verify_dangling verify_missing verify_orphans verify_summary verify_full gc_plan restore_files restore_totals",
    "changed_blocks sparse_blocks device_blocks listing_order checksum_verify boundary_resync chunk_size_distribution",
    "backup_estimate byte_cap safe_paths valid_keys list_prefix put_if_absent get_range human_bytes page_sizes pack_keys expired_tokens",
]


def queries() -> dict:
    return {name: globals()[name] for line in NAMES for name in line.split()}


def oracle_sql() -> dict[str, str]:
    from cairn.plans.oracles import oracles

    return oracles(BLOCK, TARGET)
