"""SQL with the same rows as the registered queries, for an engine that reads the same tables."""

from __future__ import annotations

from cairn.operators.chunking import GEAR, SMALL, ChunkerConfig

FILES = "f AS (SELECT doc_id AS path, encode(coalesce(text, '')) AS c FROM documents)"
EDITED = "e AS (SELECT doc_id AS path, encode(CASE WHEN lang = 'fr' THEN 'X' ELSE '' END || coalesce(text, '')) AS c FROM documents)"
OLD = "o AS (SELECT item_id AS path, encode(coalesce(text, '')) AS c FROM benchmark UNION ALL SELECT conv_id, encode(coalesce(text, '')) FROM conversations)"
FULL, ONES = "18446744073709551616::UHUGEINT", "18446744073709551615::UHUGEINT"


def blocks(name: str, source: str, size: int) -> str:
    """CTE of fixed blocks: path, idx, offset, length, blob_id, hx."""
    return f"""{name} AS (SELECT path, i::INT AS idx, (i * {size})::BIGINT AS "offset", (length(hx) // 2)::BIGINT AS length, sha256(unhex(hx)) AS blob_id, hx FROM (
      SELECT path, i, substr(h, 1 + 2 * {size} * i, 2 * {size}) AS hx FROM (SELECT path, hex(c) AS h, unnest(range((octet_length(c) + {size} - 1) // {size})) AS i FROM {source})))"""


def cdc(name: str, source: str, config: ChunkerConfig = SMALL) -> str:
    """CTEs of content-defined chunks, the last called ``name``: path, idx, offset, length, blob_id.

    ``h`` is the hash over the last 64 bytes, by doubling; a chunk's own hash at its first
    63 tests leaves out what came before the chunk's byte MIN.
    """
    strict, loose = config.masks
    lo, avg, hi = config.min_size, config.avg_size, config.max_size
    gear = ", ".join(f"('{i:02X}', {int(v)}::UHUGEINT)" for i, v in enumerate(GEAR))
    powers = ", ".join(f"({k}, {1 << k}::UHUGEINT)" for k in range(65))
    n = name
    steps = [f"{n}_h0 AS (SELECT path, i, v AS h FROM (SELECT path, i, substr(hx, 2 * i + 1, 2) AS x FROM (SELECT path, hx, unnest(range(n)) AS i FROM {n}_d)) JOIN {n}_g ON x = b)"]
    for k in range(6):
        steps.append(f"{n}_h{k + 1} AS (SELECT path, i, (h + coalesce(lag(h, {1 << k}) OVER (PARTITION BY path ORDER BY i), 0::UHUGEINT) * {1 << (1 << k)}::UHUGEINT) & {ONES} AS h FROM {n}_h{k})")
    return f"""{n}_g(b, v) AS (VALUES {gear}), {n}_p(l, p) AS (VALUES {powers}),
    {n}_d AS (SELECT path, hex(c) AS hx, octet_length(c) AS n FROM {source}),
    {", ".join(steps)},
    {n}_h AS MATERIALIZED (SELECT * FROM {n}_h6),
    {n}_c(path, e, n) AS (SELECT path, 0::BIGINT, n FROM {n}_d UNION ALL
      SELECT c.path, CASE WHEN c.n - c.e <= {lo} THEN c.n ELSE coalesce((
          SELECT min(x.i) + 1 FROM {n}_h x JOIN {n}_h w ON w.path = x.path JOIN {n}_p p ON p.l = least(64, x.i - (c.e + {lo - 1}))
          WHERE x.path = c.path AND w.i = c.e + {lo - 1} AND x.i >= c.e + {lo} AND x.i < least(c.n, c.e + {hi})
            AND ((CASE WHEN x.i - (c.e + {lo - 1}) < 64 THEN (x.h + {FULL} - ((w.h * p.p) & {ONES})) & {ONES} ELSE x.h END)
              & (CASE WHEN x.i < least(c.e + {avg}, c.n) THEN {strict}::UHUGEINT ELSE {loose}::UHUGEINT END)) = 0), least(c.n, c.e + {hi})) END, c.n
      FROM {n}_c c WHERE c.e < c.n),
    {n} AS (SELECT path, idx, "offset", length, sha256(unhex(substr(hx, 2 * "offset" + 1, 2 * length))) AS blob_id FROM (
      SELECT path, (row_number() OVER w - 1)::INT AS idx, e AS "offset", lead(e) OVER w - e AS length FROM {n}_c WINDOW w AS (PARTITION BY path ORDER BY e)) JOIN {n}_d USING (path) WHERE length IS NOT NULL)"""


def packed(source: str, target: int) -> str:
    """CTEs of pack assembly in 16 lanes, the last called ``k``."""
    return f"""pb AS (SELECT substr(blob_id, 1, 1) AS lane, blob_id, max(length) AS length, row_number() OVER (PARTITION BY substr(blob_id, 1, 1) ORDER BY blob_id) AS rn FROM {source} GROUP BY blob_id),
    k AS (SELECT lane, rn, 0::BIGINT AS pack, 0::BIGINT AS seq, 0::BIGINT AS "offset", blob_id, length FROM pb WHERE rn = 1 UNION ALL
      SELECT b.lane, b.rn, CASE WHEN k."offset" + k.length >= {target} THEN k.pack + 1 ELSE k.pack END, CASE WHEN k."offset" + k.length >= {target} THEN 0 ELSE k.seq + 1 END,
        CASE WHEN k."offset" + k.length >= {target} THEN 0 ELSE k."offset" + k.length END, b.blob_id, b.length FROM k JOIN pb b ON b.lane = k.lane AND b.rn = k.rn + 1),
    ix AS (SELECT blob_id, lane || '-' || pack AS pack_id, "offset", length FROM k)"""


def stats(source: str, extra: str = "", stored: str = "false") -> str:
    return f"""SELECT count(*) AS chunks, count(DISTINCT CASE WHEN NOT s THEN blob_id END) AS blobs_new, count(*) - count(DISTINCT CASE WHEN NOT s THEN blob_id END) AS blobs_deduped,
      bytes_new, (sum(length) - bytes_new)::BIGINT AS bytes_deduped, CASE WHEN sum(length) > 0 THEN (sum(length) - bytes_new)::DOUBLE / sum(length)::DOUBLE ELSE 0 END AS dedup_ratio{extra}
      FROM (SELECT *, {stored} AS s FROM {source}), (SELECT coalesce(sum(length), 0)::BIGINT AS bytes_new FROM (SELECT DISTINCT blob_id, length FROM {source} WHERE NOT {stored})) GROUP BY bytes_new"""


def oracles(size: int, target: int) -> dict[str, str]:
    b, eb, ob = blocks("b", "f", size), blocks("eb", "e", size), blocks("ob", "o", size)
    pk = packed("b", target)
    base = f"WITH RECURSIVE {FILES}, {b}"
    with_index = f"{base}, {pk}"
    refs = f"{with_index}, {EDITED}, {eb}, refs AS (SELECT 's1' AS snapshot_id, blob_id FROM b UNION ALL SELECT 's2', blob_id FROM eb)"
    sizes = "sz AS (SELECT pack_id, sum(length)::BIGINT AS size FROM ix GROUP BY 1), stray AS (SELECT 'stray-' || i AS pack_id, (i * 100 + 7)::BIGINT AS size FROM range(4) AS r(i))"
    present = f"{refs}, {sizes}, pr AS (SELECT * FROM sz WHERE NOT starts_with(pack_id, 'f') UNION ALL SELECT * FROM stray), used AS (SELECT DISTINCT pack_id FROM ix SEMI JOIN refs USING (blob_id))"
    dangling = "dg AS (SELECT blob_id, min(snapshot_id) AS snapshot_id FROM refs WHERE blob_id NOT IN (SELECT blob_id FROM ix) GROUP BY 1)"
    content = cdc("q", "f")
    segments = lambda c: f"string_split({c}, '/')"
    human = lambda n: "CASE " + " ".join(f"WHEN {n} >= {1024**i}::BIGINT THEN printf('%.1f {u}iB', {n} / {float(1024**i)}::DOUBLE)" for i, u in reversed([*enumerate("KMGTP", 1)])) + f" ELSE printf('%d B', {n}) END"
    snaps = "sn AS (SELECT sha256(source) AS id, source, max(n_chars) AS created_at, count(*) AS files FROM documents GROUP BY source)"
    key_ok = lambda k: f"(octet_length(encode({k})) BETWEEN 1 AND 1024 AND NOT contains({k}, chr(92)) AND len(list_filter({segments(k)}, lambda x: x IN ('', '.', '..'))) = 0)"
    safe = lambda p: f"({p} <> '' AND NOT starts_with({p}, '/') AND NOT list_contains({segments(p)}, '..'))"
    bare = "regexp_replace(coalesce(url, ''), '^[a-z]+://', '')"
    gc = lambda p, case: f"""SELECT CASE WHEN ok THEN n ELSE 0 END AS packs, CASE WHEN ok THEN s ELSE 0 END AS bytes, ok AS allowed, '{case}' AS "case" FROM (
        SELECT (SELECT count(*) FROM used1 ANTI JOIN {p} USING (pack_id)) = 0 AS ok, count(*) AS n, coalesce(sum(size), 0)::BIGINT AS s FROM {p} ANTI JOIN used1 USING (pack_id))"""  # noqa: E731
    moved = lambda name, a, z: f"(SELECT '{name}' AS cut, count(*) AS boundaries, count(x.path) AS matched, count(x.path) / count(*)::DOUBLE AS rate FROM {z} y LEFT JOIN {a} x ON x.path = y.path AND x.\"offset\" + x.length + 1 = y.\"offset\" + y.length)"
    pct = lambda p: f"min(CASE WHEN r = floor((n - 1) * {p / 100}) THEN length END) AS p{p}"
    entries = 'SELECT blob_id, path::VARCHAR AS pack_id, "offset", length FROM b'
    first = f'SELECT blob_id, pack_id, "offset", length FROM (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY pack_id, "offset") AS r FROM ({entries})) WHERE r = 1'
    keyed = "o AS (SELECT lang || '/' || source || '/' || doc_id AS key, octet_length(encode(coalesce(text, '')))::BIGINT AS size, lang, source, doc_id FROM documents)"
    little = lambda x, n: " || ".join(f"substr(printf('%0{2 * n}X', {x}), {2 * i + 1}, 2)" for i in reversed(range(n)))
    # Pack files in hex: the blobs, the header as text, its length and the magic.
    encoded = f"""hd AS (SELECT DISTINCT blob_id, hx FROM b), pj AS (SELECT lane, pack, count(*) AS blobs, string_agg(hx, '' ORDER BY seq) AS body,
      hex(encode('{{"version":1,"entries":[' || string_agg('{{"id":"' || k.blob_id || '","offset":' || k."offset" || ',"length":' || k.length || '}}', ',' ORDER BY seq) || ']}}')) AS head FROM k JOIN hd ON hd.blob_id = k.blob_id GROUP BY 1, 2),
    pf AS (SELECT lane, pack, blobs, body || head || {little("length(head) // 2", 4)} || hex(encode('DBPACK01')) AS hx FROM pj),
    pi AS (SELECT lane, pack, blobs, sha256(unhex(hx)) AS pack_id, (length(hx) // 2)::BIGINT AS size FROM pf)"""
    with_files = f"{with_index}, {encoded}"
    manifests = f"""{base}, c AS (SELECT path, string_agg('"' || blob_id || '"', ',' ORDER BY idx) AS x FROM b GROUP BY 1),
    m AS (SELECT source, string_agg('{{"path":"' || lpad(doc_id::VARCHAR, 12, '0') || '","size":' || octet_length(encode(coalesce(text, ''))) || ',"mode":420,"mod_time":"2024-01-01T00:00:00Z","chunks":' || coalesce('[' || x || ']', 'null') || '}}', ',' ORDER BY lpad(doc_id::VARCHAR, 12, '0')) AS f
      FROM documents LEFT JOIN c ON c.path = doc_id GROUP BY 1)"""
    zeros = ",".join(f'"{x}":0' for x in ("files_total", "blocks_total", "bytes_total", "blobs_new", "blobs_deduped", "bytes_new", "bytes_deduped", "packs_written", "duration_ns"))
    hashed = f"{with_index}, hi AS (SELECT blob_id, sha256(pack_id) AS pack_id, \"offset\", length FROM ix)"
    status = "CASE WHEN s IN (404) THEN 'not found' WHEN s = 412 THEN 'already exists' WHEN s = 403 THEN 'permission denied' WHEN s IN (429, 503) THEN 'throttled' WHEN s = 409 OR s BETWEEN 500 AND 599 THEN 'transient' WHEN s BETWEEN 400 AND 499 THEN 'invalid' ELSE 'unknown' END"
    added = {
        "object_put": f"WITH {keyed} SELECT key, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE size END AS size FROM o UNION ALL SELECT 'items/' || item_id, 0 FROM benchmark",
        "object_stat": f"WITH {keyed} SELECT lang || '/src7/' || doc_id AS key, source = 'src7' AS there, CASE WHEN source = 'src7' THEN size END AS size FROM o",
        "object_delete": f"WITH {keyed} SELECT key, size FROM o WHERE lang <> 'fr'",
        "object_prefix": f"WITH {keyed} SELECT source || '/' || doc_id AS key, size FROM o WHERE lang = 'de'",
        "pack_files": f"{with_files} SELECT lane, pack, pack_id, blobs, size FROM pi",
        "pack_entries": f'{with_files} SELECT pack_id, blob_id, "offset", length FROM k JOIN pi ON pi.lane = k.lane AND pi.pack = k.pack',
        "pack_validity": f"{with_files} SELECT lane || '-' || pack || '-' || c AS pack_id, p AS problem FROM pi, (VALUES ('whole', NULL), ('cut', 'corrupt'), ('magic', 'corrupt'), ('bare', 'corrupt'), ('short', 'corrupt')) AS v(c, p)",
        "pack_verified": f"{with_files} SELECT pack_id, blobs FROM pi",
        "pack_lookup": f'{with_index}, {EDITED}, {eb} SELECT a.pack_id, a.blob_id, ix."offset", ix.length FROM (SELECT DISTINCT substr(blob_id, 1, 1) || \'-0\' AS pack_id, blob_id FROM eb) a LEFT JOIN ix ON ix.pack_id = a.pack_id AND ix.blob_id = a.blob_id',
        "rebuild_from_packs": f"{with_files} SELECT blob_id, pack_id, \"offset\", length FROM k JOIN pi ON pi.lane = k.lane AND pi.pack = k.pack WHERE k.lane <> '0'",
        "fetch_blobs": f"{base} SELECT path, idx, blob_id, length::INT AS length, true AS ok FROM b",
        "index_size": f"{base} SELECT count(DISTINCT blob_id) AS blobs FROM b",
        "index_delete": f"{with_index}, {EDITED}, {eb} SELECT * FROM ix ANTI JOIN eb USING (blob_id)",
        "index_dump": f"""{hashed} SELECT substr(blob_id, 1, 2) AS shard, count(*) AS entries, sha256(unhex(hex(encode('DBIDX001')) || {little("count(*)", 8)} ||
            string_agg(blob_id || pack_id || {little('"offset"', 8)} || {little("length", 8)}, '' ORDER BY blob_id))) AS sha256 FROM hi GROUP BY 1""",
        "index_load": f"{hashed} SELECT * FROM hi",
        "snapshot_ids": f"{manifests} SELECT source, sha256('{{\"id\":\"\",\"kind\":\"files\",\"created_at\":\"2024-01-02T03:04:05Z\",\"source\":\"' || source || '\",\"files\":[' || f || '],\"stats\":{{{zeros}}}}}') AS id FROM m",
        "snapshot_integrity": "SELECT DISTINCT source, NOT ends_with(source, '3') AS whole FROM documents",
        "cdc_stream": f"WITH RECURSIVE {FILES}, {content} SELECT * FROM q",
        "unreadable_blocks": f"{base} SELECT path, idx, CASE idx % 5 WHEN 1 THEN 'expired' WHEN 4 THEN 'too long' ELSE 'checksum' END AS why FROM b WHERE idx % 5 IN (1, 2, 4)",
        "request_costs": """SELECT source, count(*) * 1073741824 AS size, sum(n_chars)::BIGINT AS written, count(*) * 2048 AS blocks, ceil(sum(n_chars) / 10000)::BIGINT AS list_requests, sum(n_chars)::BIGINT AS get_requests,
            round(ceil(sum(n_chars) / 10000) / 1000 * 0.0006::DOUBLE + sum(n_chars)::DOUBLE / 1000 * 0.003::DOUBLE, 9) AS usd FROM documents GROUP BY source""",
        "walk_order": f"SELECT page_id, split_part(p, '/', 1) AS host, row_number() OVER (PARTITION BY split_part(p, '/', 1) ORDER BY {segments('p')}, page_id) AS place FROM (SELECT page_id, {bare} AS p FROM pages)",
        "config_validity": """SELECT doc_id, CASE WHEN a <= 0 THEN 'no least size' WHEN v <= a OR m < v THEN 'sizes out of order' WHEN (v & (v - 1)) <> 0 THEN 'average not a power of two' WHEN n NOT BETWEEN 0 AND 3 THEN 'normalization out of range' WHEN t <= 0 THEN 'pack target of no size' END AS problem
            FROM (SELECT doc_id, doc_id % 7 * 64 AS a, CASE WHEN doc_id % 3 = 0 THEN 256 ELSE doc_id % 5 * 100 END AS v, doc_id % 11 * 100 AS m, doc_id % 6 - 1 AS n, doc_id % 13 AS t FROM documents)""",
        "retry_waits": "SELECT doc_id, doc_id % 12 AS attempt, doc_id % 2 = 1 AS throttled, round(least(10.0::DOUBLE, 0.1::DOUBLE * pow(2, doc_id % 12) * CASE WHEN doc_id % 2 = 1 THEN 3 ELSE 1 END), 6) AS longest FROM documents",
        "status_kinds": f"SELECT doc_id, kind, kind IN ('throttled', 'transient') AS again FROM (SELECT doc_id, {status} AS kind FROM (SELECT doc_id, doc_id % 250 + 380 AS s FROM documents))",
    }
    return added | {
        "content_address": f"WITH {FILES} SELECT path, sha256(c) AS blob_id, substr(sha256(c), 1, 12) AS short, substr(sha256(c), 1, 2) AS shard, sha256(c) = repeat('0', 64) AS zero FROM f",
        "parse_ids": f"WITH {FILES} SELECT path, CASE WHEN regexp_full_match(t, '[0-9a-fA-F]{{64}}') THEN lower(t) END AS id FROM (SELECT path, CASE WHEN octet_length(c) % 2 = 0 THEN upper(sha256(c)) ELSE decode(c) END AS t FROM f)",
        "fixed_blocks": f'{base} SELECT path, idx, "offset", length, blob_id FROM b',
        "cdc_chunks": f"WITH RECURSIVE {FILES}, {content} SELECT * FROM q",
        "dedup_stats_fixed": f"{base} {stats('b')}",
        "dedup_stats_cdc": f"WITH RECURSIVE {FILES}, {content} {stats('q')}",
        "incremental_dedup": f"{base}, {OLD}, {ob} SELECT blob_id, max(length) AS length, count(*) AS copies FROM b WHERE blob_id NOT IN (SELECT blob_id FROM ob) GROUP BY 1",
        "incremental_stats": f"{base}, {OLD}, {ob}, t AS (SELECT count(*) AS files_total, coalesce(sum(octet_length(c)), 0)::BIGINT AS bytes_total FROM f) SELECT * FROM ({stats('b', stored='(blob_id IN (SELECT blob_id FROM ob))')}), t",
        "index_first_wins": f"{base} {first}",
        "index_lookup": f'{with_index}, {EDITED}, {eb} SELECT path, idx, eb.blob_id, pack_id, ix."offset", ix.length FROM eb LEFT JOIN ix ON ix.blob_id = eb.blob_id',
        "index_insert": f"{base}, {OLD}, {ob} SELECT * FROM ({first}) WHERE blob_id NOT IN (SELECT blob_id FROM ob)",
        "rebuild_index": f"{present} SELECT * FROM ix SEMI JOIN pr USING (pack_id)",
        "pack_assembly": f'{with_index} SELECT lane, pack, seq, "offset", blob_id, length FROM k',
        "pack_sizes": f"{with_index} SELECT lane, pack, count(*) AS blobs, sum(length)::BIGINT AS size FROM k GROUP BY 1, 2",
        "shard_histogram": f"{with_index} SELECT shard, count(blob_id) AS n FROM (SELECT lower(printf('%02X', i)) AS shard FROM range(256) AS r(i)) LEFT JOIN ix ON substr(blob_id, 1, 2) = shard GROUP BY 1",
        "shard_stats": f"{with_index} SELECT avg(n) AS mean, min(n) AS least, max(n) AS most, round(stddev_pop(n), 6) AS sigma FROM (SELECT shard, count(blob_id) AS n FROM (SELECT lower(printf('%02X', i)) AS shard FROM range(256) AS r(i)) LEFT JOIN ix ON substr(blob_id, 1, 2) = shard GROUP BY 1)",
        "snapshot_manifest": f"{base} SELECT f.path, octet_length(c)::BIGINT AS size, coalesce(x, '') AS chunks FROM f LEFT JOIN (SELECT path, string_agg(blob_id, ',' ORDER BY idx) AS x FROM b GROUP BY 1) g ON g.path = f.path",
        "snapshot_blob_ids": f"{base} SELECT blob_id, path, idx FROM (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY path, idx) AS r FROM b) WHERE r = 1",
        "list_snapshots": f"WITH {snaps} SELECT * FROM sn ORDER BY id",
        "latest_snapshot": f"WITH {snaps} SELECT * FROM sn ORDER BY created_at DESC, id LIMIT 1",
        "resolve_prefix": f"WITH {snaps} SELECT * FROM sn WHERE starts_with(id, substr(sha256('src7'), 1, 10))",
        "snapshot_validity": """SELECT source, CASE WHEN length(source) <> 4 AND ends_with(source, '5') THEN 'unknown kind' WHEN length(source) <> 4 THEN 'files among blocks'
            WHEN bool_or(n_chars <= 20) THEN 'file without path' WHEN bool_or(n_chars < 10) THEN 'file of negative size' END AS problem FROM documents GROUP BY source""",
        "verify_dangling": f"{refs}, {dangling} SELECT * FROM dg",
        "verify_missing": f"{present} SELECT pack_id FROM used ANTI JOIN pr USING (pack_id)",
        "verify_orphans": f"{present} SELECT pack_id, size FROM pr ANTI JOIN used USING (pack_id)",
        "verify_summary": f"""{present}, {dangling}, s AS (SELECT (SELECT count(DISTINCT snapshot_id) FROM refs) AS snapshots, (SELECT count(*) FROM pr) AS packs, (SELECT count(DISTINCT blob_id) FROM refs) AS blobs_referenced,
            (SELECT count(*) FROM dg) AS dangling, (SELECT count(*) FROM used ANTI JOIN pr USING (pack_id)) AS missing, (SELECT count(*) FROM pr ANTI JOIN used USING (pack_id)) AS orphans) SELECT *, dangling = 0 AND missing = 0 AS ok FROM s""",
        "verify_full": f"{base}, {EDITED}, {eb} SELECT b.path, b.idx, b.blob_id FROM b JOIN eb ON b.path = eb.path AND b.idx = eb.idx WHERE b.blob_id <> eb.blob_id",
        "gc_plan": f"{present}, used1 AS (SELECT DISTINCT pack_id FROM ix SEMI JOIN b USING (blob_id)), whole AS (SELECT * FROM sz UNION ALL SELECT * FROM stray) {gc('whole', 'whole')} UNION ALL {gc('pr', 'lost')}",
        "restore_files": f"WITH {FILES} SELECT path, octet_length(c)::BIGINT AS size, sha256(c) AS content_id, true AS ok FROM f",
        "restore_totals": f"WITH {FILES} SELECT count(*) AS files, sum(octet_length(c))::BIGINT AS bytes, 0::BIGINT AS failed FROM f",
        "changed_blocks": f"{base}, {EDITED}, {eb} SELECT eb.path, eb.idx AS block_index, eb.blob_id, b.blob_id IS NULL AS is_new FROM eb LEFT JOIN b ON b.path = eb.path AND b.idx = eb.idx WHERE b.blob_id IS NULL OR b.blob_id <> eb.blob_id",
        "sparse_blocks": f"{base} SELECT path || ':' || idx AS block_index, blob_id FROM b WHERE substr(hx, 1, 2) <> '20'",
        "device_blocks": "SELECT i AS block_index, sha256('snap ' || i) AS blob_id, length('snap ' || i)::BIGINT AS length FROM range((SELECT count(*) FROM documents)) AS r(i) WHERE i % 3 <> 0",
        "listing_order": "SELECT snapshot, place, block_index FROM (SELECT conv_id AS snapshot, turn AS place, length(role)::INT AS block_index, lag(length(role)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE block_index <= p",
        "checksum_verify": f"{base} SELECT path, idx, base64(unhex(blob_id)) AS checksum, idx <> 3 AS ok FROM b",
        "boundary_resync": f"{base}, p AS (SELECT path, unhex('AB' || hex(c)) AS c FROM f), {blocks('pb', 'p', size)}, {content}, {cdc('w', 'p')} {moved('content', 'q', 'w')} UNION ALL {moved('fixed', 'b', 'pb')}",
        "chunk_size_distribution": f"""WITH RECURSIVE {FILES}, {content}, body AS (SELECT length FROM (SELECT *, max(idx) OVER (PARTITION BY path) AS last FROM q) WHERE idx < last),
            s AS (SELECT length, row_number() OVER (ORDER BY length) - 1 AS r, count(*) OVER () AS n FROM body)
            SELECT count(*) AS n, sum(length)::DOUBLE / count(*) AS mean, min(length) AS min, {", ".join(pct(p) for p in (10, 50, 90, 99))}, max(length) AS max, count(*) FILTER (length = {SMALL.max_size}) AS forced FROM s""",
        "backup_estimate": f"WITH {FILES} SELECT count(*) AS files, sum(octet_length(c))::BIGINT AS bytes, (ceil(sum(octet_length(c)) / {target}.0) + 2)::BIGINT AS requests FROM f",
        "byte_cap": "SELECT source, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes, sum(octet_length(encode(coalesce(text, '')))) > 100000 AS over FROM documents GROUP BY source",
        "safe_paths": f"SELECT page_id, {safe('p')} AS plain, {safe(chr(39) + '../' + chr(39) + ' || p')} AS above, {safe(chr(39) + '/' + chr(39) + ' || p')} AS rooted FROM (SELECT page_id, {bare} AS p FROM pages)",
        "valid_keys": f"SELECT page_id, {key_ok('u')} AS url, {key_ok('p')} AS bare FROM (SELECT page_id, coalesce(url, '') AS u, {bare} AS p FROM pages)",
        "list_prefix": f"SELECT * FROM (SELECT {bare} AS key, octet_length(encode(html))::BIGINT AS size FROM pages) WHERE starts_with(key, 'www.') AND NOT starts_with(regexp_extract(key, '[^/]*$'), '.tmp-')",
        "put_if_absent": "SELECT item_id, sha256(text) AS key FROM benchmark WHERE sha256(text) NOT IN (SELECT sha256(text) FROM conversations WHERE text IS NOT NULL)",
        "get_range": f"""WITH {FILES} SELECT path, substr(h, 21, 32) AS part, substr(h, 2 * (n - n // 10) + 1) AS tail, CASE WHEN n >= 2 THEN substr(h, 2 * (n - 2) + 1) END AS past, '' AS none, NULL::VARCHAR AS before
            FROM (SELECT path, hex(c) AS h, octet_length(c) AS n FROM f)""",
        "human_bytes": f"WITH {FILES} SELECT path, {human('n')} AS size, {human('(n * 1000000)')} AS large FROM (SELECT path, octet_length(c)::BIGINT AS n FROM f)",
        "page_sizes": "SELECT doc_id, least(greatest(CASE WHEN a = 0 THEN 1000 ELSE a END, 100), 10000)::BIGINT AS page FROM (SELECT doc_id, n_chars - n_chars % 7 * n_chars AS a FROM documents)",
        "pack_keys": f"WITH {FILES} SELECT path, 'packs/' || substr(i, 1, 2) || '/' || i AS key, i AS pack_id, NULL::VARCHAR AS stray FROM (SELECT path, sha256(c) AS i FROM f)",
        "expired_tokens": "SELECT event_id, ts + INTERVAL 60 MINUTE < (SELECT max(ts) FROM events) AS expired FROM events",
    }
