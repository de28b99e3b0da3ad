"""Queries over operators.reconcile."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import reconcile as R
from tidemark.plans.registry import query

GROUPED = """
  linked AS (SELECT side, dev, ino, min(path) AS group_root, count(*) AS members FROM entries WHERE file_type = 1 AND nlink > 1 GROUP BY side, dev, ino HAVING count(*) > 1),
  grouped AS MATERIALIZED (SELECT e.*, g.group_root FROM entries e LEFT JOIN linked g ON e.side = g.side AND e.dev = g.dev AND e.ino = g.ino AND e.file_type = 1),
  shown AS (SELECT *, to_base64(encode(symlink_target)) AS target_b64, to_base64(encode(group_root)) AS root_b64 FROM grouped),
  seen AS MATERIALIZED (SELECT *, concat('{"file_type":', file_type, ',"size":', size, ',"mode":', mode & 4095, ',"uid":', uid, ',"gid":', gid, ',"mtime_sec":', mtime_sec, ',"mtime_nsec":', mtime_nsec,
      ',"symlink_target_b64":', CASE WHEN target_b64 IS NULL THEN 'null' ELSE concat('"', target_b64, '"') END, ',"hardlink_group_b64":', CASE WHEN root_b64 IS NULL THEN 'null' ELSE concat('"', root_b64, '"') END, '}') AS observed FROM shown),
  s AS (SELECT * FROM seen WHERE side = 0), d AS (SELECT * FROM seen WHERE side = 1),
  j AS MATERIALIZED (SELECT coalesce(s.path, d.path) AS path, s.path AS sp, d.path AS dp, s.observed so, d.observed do_, s.file_type st, d.file_type dt, s.size ss, d.size ds, s.mode & 4095 sm, d.mode & 4095 dm, s.uid su, d.uid du, s.gid sg, d.gid dg,
    s.mtime_sec sx, d.mtime_sec dx, CAST(floor(s.mtime_nsec / 1000) AS BIGINT) sn, CAST(floor(d.mtime_nsec / 1000) AS BIGINT) dn, s.target_b64 sl, d.target_b64 dl, s.root_b64 sr, d.root_b64 dr, s.group_root src_root, d.group_root dst_root FROM s FULL OUTER JOIN d ON s.path = d.path),
  diffs AS (SELECT path, 'missing_destination' AS kind, so AS expected, CAST(NULL AS VARCHAR) AS observed FROM j WHERE dp IS NULL UNION ALL SELECT path, 'unexpected_destination', NULL, do_ FROM j WHERE sp IS NULL
    UNION ALL SELECT path, 'unsupported_feature', 'a regular file, a directory or a symlink', CASE WHEN sp IS NULL THEN CAST(dt AS VARCHAR) WHEN dp IS NULL THEN CAST(st AS VARCHAR) ELSE concat('{"source":', st, ',"destination":', dt, '}') END FROM j WHERE st IN (0,4,5,6,7) OR dt IN (0,4,5,6,7)
    UNION ALL SELECT path, 'type', CAST(st AS VARCHAR), CAST(dt AS VARCHAR) FROM j WHERE st <> dt
    UNION ALL SELECT path, 'size', CAST(ss AS VARCHAR), CAST(ds AS VARCHAR) FROM j WHERE st = 1 AND dt = 1 AND ss <> ds UNION ALL SELECT path, 'mode', CAST(sm AS VARCHAR), CAST(dm AS VARCHAR) FROM j WHERE sm <> dm
    UNION ALL SELECT path, 'owner', concat('{"uid":', su, ',"gid":', sg, '}'), concat('{"uid":', du, ',"gid":', dg, '}') FROM j WHERE su <> du OR sg <> dg
    UNION ALL SELECT path, 'mtime', concat('{"sec":', sx, ',"usec":', sn, '}'), concat('{"sec":', dx, ',"usec":', dn, '}') FROM j WHERE sp IS NOT NULL AND dp IS NOT NULL AND (sx <> dx OR sn <> dn)
    UNION ALL SELECT path, 'symlink_target', sl, dl FROM j WHERE st = 3 AND dt = 3 AND sl IS DISTINCT FROM dl
    UNION ALL SELECT path, 'hardlink_group', sr, dr FROM j WHERE sp IS NOT NULL AND dp IS NOT NULL AND sr IS DISTINCT FROM dr)"""

BLOBS = """
  hashed AS (SELECT coalesce(s.path, d.path) AS path, CASE WHEN s.path IS NULL OR d.path IS NULL THEN 'missing' WHEN s.content IS NULL OR d.content IS NULL THEN 'unreadable'
      WHEN sha256(s.content) <> sha256(d.content) THEN 'content' ELSE 'match' END AS outcome, sha256(s.content) AS src_sha256, sha256(d.content) AS dst_sha256,
      CAST(octet_length(encode(s.content)) AS BIGINT) AS src_bytes, CAST(octet_length(encode(d.content)) AS BIGINT) AS dst_bytes
    FROM blobs_source s FULL OUTER JOIN blobs_destination d ON s.path = d.path)"""


@query("join_namespace", "entries", sql="s AS (SELECT * FROM entries WHERE side = 0), d AS (SELECT * FROM entries WHERE side = 1) SELECT coalesce(s.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'source' WHEN s.path IS NULL THEN 'destination' ELSE 'both' END AS place, s.size AS src_size, d.size AS dst_size FROM s FULL OUTER JOIN d ON s.path = d.path")
def join_namespace(entries):
    return R.pair_sides(entries).select("path", "place", "src_size", "dst_size")


@query("join_hardlink_attach", "entries", sql=GROUPED + " SELECT side, path, group_root FROM grouped WHERE group_root IS NOT NULL")
def join_hardlink_attach(entries):
    return R.with_groups(entries).where("group_root is not null").select("side", "path", "group_root")


@query("join_eligible", "entries", sql="SELECT path FROM entries WHERE side = 0 AND file_type = 1 INTERSECT SELECT path FROM entries WHERE side = 1 AND file_type = 1")
def join_eligible(entries):
    return R.eligible_paths(entries)


@query("join_both_count", "entries", sql="SELECT count(*) AS n FROM (SELECT path FROM entries WHERE side = 0 INTERSECT SELECT path FROM entries WHERE side = 1) t")
def join_both_count(entries):
    return R.both_sides(entries).agg(F.count("*").alias("n"))


@query("agg_counts", "entries", sql="SELECT side, file_type, count(*) AS n FROM entries GROUP BY side, file_type")
def agg_counts(entries):
    return R.observation_counts(entries)


@query("agg_hardlinks", "entries", sql=GROUPED + " SELECT side, CAST(dev AS INTEGER) AS dev, ino, group_root, members FROM linked")
def agg_hardlinks(entries):
    return R.hardlink_groups(entries)


@query("compare_entries", "entries", sql=GROUPED + " SELECT path, kind, expected, observed FROM diffs")
def compare_entries(entries):
    return R.compare_entries(entries)


@query("sc_observed", "entries", sql=GROUPED + " SELECT side, path, observed FROM seen")
def sc_observed(entries):
    return R.with_groups(entries).select("side", "path", R.observed().alias("observed"))


@query("agg_mismatch_kinds", "entries", sql=GROUPED + " SELECT kind, count(*) AS n FROM diffs GROUP BY kind")
def agg_mismatch_kinds(entries):
    return R.mismatch_counts(R.compare_entries(entries))


@query("compare_unpreserved", "entries", sql=GROUPED + " SELECT kind, count(*) AS n FROM diffs WHERE kind NOT IN ('mode', 'owner', 'mtime') GROUP BY kind")
def compare_unpreserved(entries):
    return R.mismatch_counts(R.compare_entries(entries, R.Preserve(mode=False, owner=False, times=False)))


@query("content_compare", "blobs_source", "blobs_destination", sql=BLOBS + " SELECT * FROM hashed")
def content_compare(source, destination):
    return R.content_compare(source, destination)


@query("agg_content_totals", "blobs_source", "blobs_destination", sql=BLOBS + """ SELECT count(*) AS checked, count(*) FILTER (outcome = 'match') AS matched, count(*) FILTER (outcome = 'content') AS differing,
    count(*) FILTER (outcome = 'unreadable') AS unreadable, count(*) FILTER (outcome = 'missing') AS missing,
    CAST(coalesce(sum(src_bytes) FILTER (outcome IN ('match', 'content')), 0) AS BIGINT) AS bytes_source, CAST(coalesce(sum(dst_bytes) FILTER (outcome IN ('match', 'content')), 0) AS BIGINT) AS bytes_destination FROM hashed""")
def agg_content_totals(source, destination):
    return R.content_totals(R.content_compare(source, destination))


@query("set_unreadable", "issues", sql="SELECT DISTINCT coalesce(side, 0) AS side, path FROM issues")
def set_unreadable(issues):
    return R.unique_bad(issues, issues.where("operation = 'read'"))


@query("set_unstable", "unstable", sql="SELECT DISTINCT side, path FROM unstable")
def set_unstable(unstable):
    return R.unique_bad(unstable, unstable.limit(0))


@query("agg_report_status", "entries", "issues", "unstable", sql=GROUPED + """ SELECT *, CASE WHEN unreadable + unstable > 0 THEN 'inconclusive' WHEN mismatches > 0 THEN 'mismatched' ELSE 'passed' END AS status
    FROM (SELECT (SELECT count(*) FROM diffs) AS mismatches, (SELECT count(*) FROM (SELECT DISTINCT coalesce(side, 0), path FROM issues)) AS unreadable, (SELECT count(*) FROM (SELECT DISTINCT side, path FROM unstable)) AS unstable) t""")
def agg_report_status(entries, issues, unstable):
    return R.verdict(R.mismatch_counts(R.compare_entries(entries)), R.unique_bad(issues, issues.limit(0)), R.unique_bad(unstable, unstable.limit(0)))


@query("sink_mismatches", "issues", "unstable", "entries", "blobs_source", "blobs_destination", sql=GROUPED + "," + BLOBS + """ SELECT 0 AS phase, coalesce(side, 0) AS side, path, 'unreadable' AS kind FROM issues
    UNION ALL SELECT 1, side, path, 'unstable' FROM unstable UNION ALL SELECT 2, -1, path, kind FROM diffs UNION ALL SELECT 3, -1, path, 'content' FROM hashed WHERE outcome = 'content'""")
def sink_mismatches(issues, unstable, entries, source, destination):
    return R.ordered_mismatches(issues, unstable, R.compare_entries(entries), R.content_compare(source, destination))


@query("sink_report", "entries", sql=GROUPED + """ SELECT (SELECT count(*) FROM entries WHERE side = 0) AS source_entries, (SELECT count(*) FROM entries WHERE side = 1) AS destination_entries,
    (SELECT count(*) FROM j WHERE sp IS NOT NULL AND dp IS NOT NULL) AS on_both, (SELECT count(*) FROM diffs) AS mismatches, (SELECT count(DISTINCT path) FROM diffs) AS mismatched_paths""")
def sink_report(entries):
    return R.report_totals(R.pair_sides(entries, groups=True))


@query("set_hardlink_partition", "entries", sql=GROUPED + """, sets AS (SELECT side, group_root, count(*) AS members, list_sort(list(path)) AS paths FROM grouped WHERE group_root IS NOT NULL GROUP BY side, group_root)
    SELECT a.side, a.group_root, a.members FROM sets a WHERE NOT EXISTS (SELECT 1 FROM sets b WHERE b.side <> a.side AND b.group_root = a.group_root AND b.paths = a.paths)""")
def set_hardlink_partition(entries):
    return R.group_diff(entries)


PLACES = "SELECT hex(encode(path)) AS path_hex, row_number() OVER (ORDER BY path) AS place FROM obs_source"


@query("sort_raw_path", "obs_source", sql=PLACES)
@query("sort_raw_path_all", "obs_source", sql=PLACES)
def sort_raw_path(source):
    return R.sort_raw_path(source).select(F.hex("path").alias("path_hex"), "place")
