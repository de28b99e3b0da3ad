"""Queries over operators.inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import paths as P
from tidemark.operators import inventory as I
from tidemark.plans.registry import query


@query("normalize_index", "scan", sql="""t AS (SELECT *, CASE file_type WHEN 'directory' THEN 2 WHEN 'symlink' THEN 3 ELSE 1 END AS tag, mtime_sec IS NOT NULL AND mtime_nsec IS NOT NULL AS exact FROM scan)
  SELECT CAST(shard_index AS BIGINT) * 1099511627776 + row_in_shard AS row_id, substr(path, 8) AS path, CAST(size AS BIGINT) AS size, CAST(permissions | CASE tag WHEN 2 THEN 16384 WHEN 3 THEN 40960 ELSE 32768 END AS BIGINT) AS mode, tag AS file_type,
    CAST(CASE WHEN exact THEN mtime_sec ELSE floor(mtime_us / 1000000) END AS BIGINT) AS mtime_sec, CAST(CASE WHEN exact THEN mtime_nsec ELSE (mtime_us - floor(mtime_us / 1000000) * 1000000) * 1000 END AS BIGINT) AS mtime_nsec,
    CAST(floor(atime_us / 1000000) AS BIGINT) AS atime_sec, CAST((atime_us - floor(atime_us / 1000000) * 1000000) * 1000 AS BIGINT) AS atime_nsec, CAST(uid AS BIGINT) AS uid, CAST(gid AS BIGINT) AS gid, CAST(nlink AS BIGINT) AS nlink, inode, symlink_target FROM t""")
def normalize_index(scan):
    return I.normalize(scan, "/export/").drop("fsid", "shard_index")


@query("norm_split_row_id", "catalog", sql="SELECT row_id >> 40 AS shard, count(*) AS n, max(row_id & 1099511627775) AS last_row FROM catalog GROUP BY 1")
def norm_split_row_id(catalog):
    parts = I.split_row_id(F.col("row_id"))
    return catalog.select(parts.alias("p")).groupBy("p.shard").agg(F.count("*").alias("n"), F.max("p.row").alias("last_row"))


@query("sc_type_from_mode", "scan", sql="SELECT CASE file_type WHEN 'directory' THEN 2 WHEN 'symlink' THEN 3 ELSE 1 END AS file_type, count(*) AS n FROM scan GROUP BY 1")
def sc_type_from_mode(scan):
    tag = I.file_type_tag(F.col("file_type"))
    return scan.select(I.type_from_mode(I.full_mode(F.col("permissions"), tag)).alias("file_type")).groupBy("file_type").agg(F.count("*").alias("n"))


PATTERNS = {"tenth": "/p[0-9]*0/", "fives": "_5$", "snapshots": P.SNAPSHOT_DIRS}
HITS = """h AS (SELECT *, CASE WHEN regexp_matches(t, '/p[0-9]*0/') THEN 'tenth' WHEN regexp_matches(t, '_5$') THEN 'fives' WHEN regexp_matches(t, '(^|/)(\\.snapshot|\\.zfs/snapshot|~snapshot)(/|$)') THEN 'snapshots' END AS hit
  FROM (SELECT *, CASE WHEN path LIKE '/%' THEN path ELSE concat('/', path) END AS t FROM odd_paths) x)"""


@query("filter_inventory", "odd_paths", sql=f"{HITS} SELECT path, size FROM h WHERE hit IS NULL")
def filter_inventory(entries):
    return I.filter_inventory(entries, PATTERNS)[0].select("path", "size")


@query("filter_inventory_counts", "odd_paths", sql=f"{HITS} SELECT hit AS pattern, count(*) AS excluded FROM h WHERE hit IS NOT NULL GROUP BY hit")
def filter_inventory_counts(entries):
    return I.filter_inventory(entries, PATTERNS)[1]


@query("flt_snapshot_dirs", "odd_paths", sql="SELECT path FROM odd_paths WHERE NOT regexp_matches(path, '(^|/)(\\.snapshot|\\.zfs/snapshot|~snapshot)(/|$)')")
def flt_snapshot_dirs(entries):
    return I.exclude_snapshots(entries).select("path")


@query("path_audit", "odd_paths", sql="""SELECT path, 'unsafe_path' AS finding FROM odd_paths WHERE NOT (path = '/' OR (path LIKE '/%' AND NOT regexp_matches(path, '/(/|\\.{1,2}(/|$))') AND NOT regexp_matches(path, './$')))
  UNION ALL SELECT path, 'partial_file' FROM odd_paths WHERE file_type = 1 AND regexp_matches(regexp_extract(path, '[^/]*$'), '^\\..+\\.[^.]+\\.[0-9]+\\.partial$')
  UNION ALL SELECT path, 'bad_file_type' FROM odd_paths WHERE file_type NOT BETWEEN 1 AND 7 UNION ALL SELECT path, 'unsupported_type' FROM odd_paths WHERE file_type BETWEEN 4 AND 7
  UNION ALL SELECT path, 'boundary_size' FROM odd_paths WHERE file_type = 1 AND size IN (1048575, 1048576, 1048577, 1073741823, 1073741824, 1073741825)""")
def path_audit(entries):
    return I.path_audit(entries)


@query("sc_path_parts", "obs_source", sql="SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, count(*) AS children, max(length(path) - length(replace(path, '/', ''))) AS depth, min(regexp_extract(path, '[^/]*$')) AS first_name FROM obs_source GROUP BY 1")
def sc_path_parts(source):
    p = F.col("path")
    return source.groupBy(P.parent(p).alias("parent")).agg(F.count("*").alias("children"), F.max(P.depth(p)).cast("long").alias("depth"), F.min(P.basename(p)).alias("first_name"))


@query("sc_path_b64", "obs_source", sql="SELECT path, to_base64(encode(repeat(path, 6))) AS b64 FROM obs_source")
def sc_path_b64(source):
    return source.select("path", P.path_b64(F.repeat("path", F.lit(6))).alias("b64"))


@query("sc_history_path", "catalog", sql="SELECT substr(path, 2) AS path FROM catalog")
def sc_history_path(catalog):
    return catalog.select(P.history_path(F.col("path")).alias("path"))


BATCH_BYTES, BATCH_FILES = 1 << 20, 100
# From one batch of each shard to the next: its last row is the last that both limits let in, and at least its first.
BATCHES = f"""o AS MATERIALIZED (SELECT shard_index, row_id, size, row_number() OVER w AS rn, sum(size) OVER w AS cum FROM catalog WINDOW w AS (PARTITION BY shard_index ORDER BY row_id)),
  b AS (SELECT shard_index, CAST(-1 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS last, CAST(0 AS HUGEINT) AS held FROM (SELECT DISTINCT shard_index FROM catalog) z
    UNION ALL SELECT x.shard_index, x.batch + 1, x.last + 1, max(e.rn), max(e.cum) FROM (SELECT b.*, k FROM b, range(1, {BATCH_FILES + 1}) t(k)) x JOIN o e ON e.shard_index = x.shard_index AND e.rn = x.last + x.k
      WHERE x.k = 1 OR e.cum - x.held <= {BATCH_BYTES} GROUP BY x.shard_index, x.batch, x.last),
  batched AS MATERIALIZED (SELECT c.*, b.batch FROM catalog c JOIN o ON c.row_id = o.row_id JOIN b ON b.shard_index = o.shard_index AND o.rn BETWEEN b.first AND b.last)"""
ROLES = f"""RECURSIVE {BATCHES}, k AS (SELECT *, inode IS NOT NULL AND nlink > 1 AND file_type = 1 AS keyed, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM batched),
  r0 AS (SELECT *, CASE WHEN keyed THEN CASE WHEN row_number() OVER (PARTITION BY shard_index, batch, keyed, CASE WHEN keyed THEN fsid END, CASE WHEN keyed THEN inode ELSE row_id END ORDER BY row_id) = 1 THEN 'first' ELSE 'link' END END AS link_role,
    row_number() OVER (PARTITION BY shard_index, batch, parent ORDER BY row_id) AS turn, min(row_id) OVER (PARTITION BY shard_index, batch, parent) AS seen FROM k),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY shard_index, batch ORDER BY turn, seen, row_id) AS INTEGER) AS spread_order FROM r0),
  p AS (SELECT *, CASE WHEN file_type = 3 THEN 'symlink' WHEN file_type = 2 THEN 'dir_attrs' WHEN file_type <> 1 THEN 'skip' WHEN link_role = 'link' THEN 'hardlink_existing' WHEN size = 0 THEN 'empty' ELSE 'copy' END AS action,
    concat(mtime_sec, '.', lpad(CAST(coalesce(mtime_nsec, 0) AS VARCHAR), 9, '0')) AS m, concat(atime_sec, '.', lpad(CAST(coalesce(atime_nsec, 0) AS VARCHAR), 9, '0')) AS a,
    array_to_string(list_filter([CASE WHEN uid IS NOT NULL AND gid IS NOT NULL THEN concat('chown:', uid, ':', gid) END, concat('chmod:', mode & 4095),
      CASE WHEN mtime_sec IS NOT NULL THEN concat('utimes:', CASE WHEN atime_sec IS NOT NULL THEN a ELSE m END, ':', m) END], lambda x: x IS NOT NULL), ';') AS attributes,
    CASE WHEN file_type = 1 THEN CASE WHEN size < 1048576 THEN 'small' WHEN size < 1073741824 THEN 'medium' ELSE 'large' END END AS size_class FROM r)"""


@query("copy_plan", "catalog", sql=f"{ROLES} SELECT row_id, batch, spread_order, action, link_role, attributes, size_class FROM p")
def copy_plan(catalog):
    return I.copy_plan(catalog, BATCH_BYTES, BATCH_FILES).select("row_id", "batch", "spread_order", "action", "link_role", "attributes", "size_class")


@query("copy_plan_rollup", "catalog", sql=f"{ROLES} SELECT CAST(shard_index AS INTEGER) AS shard_index, action, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM p GROUP BY 1, 2")
def copy_plan_rollup(catalog):
    return I.plan_rollup(I.copy_plan(catalog, BATCH_BYTES, BATCH_FILES)).withColumn("shard_index", F.col("shard_index").cast("int"))


@query("win_hardlink_order", "catalog", sql=f"{ROLES} SELECT row_id, link_role FROM r WHERE link_role IS NOT NULL")
def win_hardlink_order(catalog):
    batched = I.assign_batches(catalog, BATCH_BYTES, BATCH_FILES)
    return I.link_roles(batched, ["shard_index", "batch"]).where("link_role is not null").select("row_id", "link_role")


@query("win_microbatch", "catalog", sql=f"RECURSIVE {BATCHES} SELECT CAST(shard_index AS BIGINT) AS shard_index, row_id, batch FROM batched")
def win_microbatch(catalog):
    return I.assign_batches(catalog, BATCH_BYTES, BATCH_FILES).select(F.col("shard_index").cast("long").alias("shard_index"), "row_id", "batch")


@query("win_interleave", "catalog", sql="""n AS (SELECT *, (row_id & 1099511627775) // 1000 AS batch, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM catalog),
  t AS (SELECT *, row_number() OVER (PARTITION BY shard_index, batch, parent ORDER BY row_id) AS turn, min(row_id) OVER (PARTITION BY shard_index, batch, parent) AS seen FROM n)
  SELECT row_id, CAST(row_number() OVER (PARTITION BY shard_index, batch ORDER BY turn, seen, row_id) AS INTEGER) AS spread_order FROM t""")
def win_interleave(catalog):
    batched = catalog.withColumn("batch", F.floor(F.col("row_id").bitwiseAND((1 << 40) - 1) / 1000))
    return I.interleave(batched, ["shard_index", "batch"]).select("row_id", "spread_order")


@query("win_deepest_first", "catalog", sql="SELECT row_id, length(path) - length(replace(path, '/', '')) AS depth FROM catalog WHERE file_type = 2 ORDER BY depth DESC, row_id")
def win_deepest_first(catalog):
    return I.deepest_first(catalog).select("row_id", F.col("depth").cast("long").alias("depth"))


DOWN = """e AS (SELECT shard_index, row_id, 'NULL_MTIME' AS downgrade FROM catalog WHERE mtime_sec IS NULL UNION ALL SELECT shard_index, row_id, 'NULL_ATIME' FROM catalog WHERE atime_sec IS NULL
    UNION ALL SELECT shard_index, row_id, 'NULL_OWNER' FROM catalog WHERE uid IS NULL OR gid IS NULL UNION ALL SELECT shard_index, row_id, 'SYMLINK_MODE' FROM catalog WHERE file_type = 3 AND mode & 511 <> 511
    UNION ALL SELECT shard_index, min(row_id), 'FSID_UNGROUPED' FROM catalog WHERE fsid IS NULL AND nlink > 1 AND file_type = 1 GROUP BY shard_index)"""


@query("sc_null_downgrades", "catalog", sql=f"{DOWN} SELECT row_id, downgrade FROM e")
def sc_null_downgrades(catalog):
    return I.expected_downgrades(catalog).select("row_id", "downgrade")


@query("fidelity_forecast", "catalog", "sink_rows", sql=f"""{DOWN}, x AS (SELECT shard_index, downgrade, count(*) AS expected FROM e GROUP BY 1, 2), s AS (SELECT row_id % 9 AS shard_index, downgrade, count(*) AS recorded FROM sink_rows WHERE sink = 'downgrade' GROUP BY 1, 2)
  SELECT CAST(coalesce(x.shard_index, s.shard_index) AS BIGINT) AS shard_index, coalesce(x.downgrade, s.downgrade) AS downgrade, coalesce(expected, 0) AS expected, coalesce(recorded, 0) AS recorded FROM x FULL OUTER JOIN s ON x.shard_index = s.shard_index AND x.downgrade = s.downgrade""")
def fidelity_forecast(catalog, sinks):
    recorded = sinks.where("sink = 'downgrade'").select((F.col("row_id") % 9).alias("shard_index"), "downgrade")
    return I.fidelity_forecast(catalog, recorded).withColumn("shard_index", F.col("shard_index").cast("long"))


@query("stability_audit", "obs_source", "obs_destination", sql="""j AS (SELECT s.path, s.file_type AS t, s.file_type IS DISTINCT FROM d.file_type AS ct, s.size IS DISTINCT FROM d.size AS cs, s.mtime_sec IS DISTINCT FROM d.mtime_sec OR s.mtime_nsec IS DISTINCT FROM d.mtime_nsec AS cm,
    s.ctime_sec IS DISTINCT FROM d.ctime_sec OR s.ctime_nsec IS DISTINCT FROM d.ctime_nsec AS cc, s.ino IS DISTINCT FROM d.ino - 1000000000 AS ci, s.mode IS DISTINCT FROM d.mode OR s.uid IS DISTINCT FROM d.uid OR s.gid IS DISTINCT FROM d.gid OR s.nlink IS DISTINCT FROM d.nlink AS ca,
    concat('type ', s.file_type, ' -> ', d.file_type) AS xt, concat('size ', s.size, ' -> ', d.size) AS xs, concat('identity 1:', s.ino, ' -> 1:', d.ino - 1000000000) AS xi,
    concat('mtime ', s.mtime_sec, '.', lpad(CAST(s.mtime_nsec AS VARCHAR), 9, '0'), ' -> ', d.mtime_sec, '.', lpad(CAST(d.mtime_nsec AS VARCHAR), 9, '0')) AS xm,
    concat('ctime ', s.ctime_sec, '.', lpad(CAST(s.ctime_nsec AS VARCHAR), 9, '0'), ' -> ', d.ctime_sec, '.', lpad(CAST(d.ctime_nsec AS VARCHAR), 9, '0')) AS xc FROM obs_source s JOIN obs_destination d ON s.path = d.path),
  f AS (SELECT path, CASE WHEN t = 2 AND (ct OR cs OR cm OR cc OR ci OR ca) THEN 'unstable_directory' WHEN t = 1 AND (cs OR cm OR cc) THEN 'torn_copy' WHEN t = 1 AND ci THEN 'replaced' END AS finding,
    array_to_string(list_filter([CASE WHEN ct THEN xt END, CASE WHEN cs THEN xs END, CASE WHEN cm THEN xm END, CASE WHEN cc THEN xc END, CASE WHEN ci THEN xi END], lambda x: x IS NOT NULL), ', ') AS changes FROM j)
  SELECT * FROM f WHERE finding IS NOT NULL""")
def stability_audit(before, after):
    return I.stability_audit(before, after.withColumns({"ino": F.col("ino") - 1000000000, "dev": F.lit(1)}))


@query("agg_estate_profile", "catalog", sql="""k AS (SELECT *, coalesce(nlink > 1 AND inode IS NOT NULL AND file_type = 1, FALSE) AS keyed FROM catalog),
  t AS (SELECT file_type, CASE WHEN file_type = 1 THEN CASE WHEN size < 1048576 THEN 'small' WHEN size < 1073741824 THEN 'medium' ELSE 'large' END ELSE 'none' END AS size_class, length(path) - length(replace(path, '/', '')) AS depth, uid, size,
    CASE WHEN NOT keyed OR row_number() OVER (PARTITION BY keyed, fsid, inode ORDER BY row_id) = 1 THEN size ELSE 0 END AS once, CASE WHEN file_type = 1 THEN greatest(size - allocated_blocks * 512, 0) END AS sparse FROM k)
  SELECT file_type, size_class, depth, uid, CAST(GROUPING(file_type, size_class, depth, uid) AS INTEGER) AS level, CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(once) AS BIGINT) AS bytes_once, CAST(coalesce(sum(sparse), 0) AS BIGINT) AS sparse_bytes
  FROM t GROUP BY GROUPING SETS ((file_type, size_class), (file_type), (size_class), (depth), (uid), ())""")
def agg_estate_profile(catalog):
    return I.estate_profile(catalog)
