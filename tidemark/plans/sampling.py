"""Queries over operators.sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import reconcile as R
from tidemark.operators import sampling as S
from tidemark.plans.reconcile import GROUPED
from tidemark.plans.registry import query

RUN, SEED = "run-7", 42
HEAD = (S.DOMAIN + len(RUN).to_bytes(8, "big") + RUN.encode() + SEED.to_bytes(8, "big")).hex()
RANK = f"sha256(unhex('{HEAD}') || unhex(printf('%016x', octet_length(encode(path)))) || encode(path))"
GOOD = "good AS (SELECT sp AS path, ss AS size FROM j WHERE st = 1 AND dt = 1)"
MUST = f"""{GROUPED}, {GOOD},
  risk AS (SELECT DISTINCT * FROM evidence_raw),
  members AS (SELECT g.path, g.group_root, good.path IS NOT NULL AS good FROM grouped g LEFT JOIN good ON g.path = good.path WHERE g.side = 0 AND g.group_root IS NOT NULL),
  why AS (SELECT path, CASE reason WHEN 'migration_failure' THEN 4 WHEN 'migration_downgrade' THEN 8 ELSE 16 END AS bits FROM risk WHERE path IN (SELECT path FROM good)
    UNION ALL SELECT min(path), 2 FROM members WHERE good GROUP BY group_root
    UNION ALL SELECT path, 1 FROM diffs WHERE path IN (SELECT path FROM good)
    UNION ALL SELECT path, 32 FROM good WHERE size IN (1048575, 1048576, 1048577, 1073741823, 1073741824, 1073741825)),
  must AS (SELECT path, CAST(bit_or(bits) AS INTEGER) AS reasons FROM why GROUP BY path)"""
SAMPLE = f"""{MUST},
  rest AS (SELECT path, {RANK} AS rank, row_number() OVER (ORDER BY {RANK}, path) AS place FROM good WHERE path NOT IN (SELECT path FROM must)),
  chosen AS (SELECT path, reasons, {RANK} AS rank FROM must UNION ALL SELECT path, 64, rank FROM rest WHERE place <= greatest(0, 12000 - (SELECT count(*) FROM must)))"""
TARGET = 12000


@query("top_rank", "obs_source", sql=f"SELECT path, {RANK} AS rank FROM obs_source")
def top_rank(source):
    return source.select("path", S.rank(RUN, SEED, F.col("path")).alias("rank"))


@query("top_seeded", "obs_source", sql=f"SELECT path, {RANK} AS rank FROM obs_source ORDER BY rank, path LIMIT 500")
def top_seeded(source):
    return S.seeded(source, 500, RUN, SEED)


@query("set_evidence", "evidence_raw", sql="SELECT DISTINCT path, reason, source, source_etag FROM evidence_raw")
def set_evidence(raw):
    return S.evidence(raw.where("source = 'failures'"), raw.where("source = 'downgrades'"), raw.where("source = 'shards'"))


@query("set_reason_union", "evidence_raw", sql="SELECT path, CAST(bit_or(CASE reason WHEN 'migration_failure' THEN 4 WHEN 'migration_downgrade' THEN 8 ELSE 16 END) AS INTEGER) AS reasons FROM evidence_raw GROUP BY path")
def set_reason_union(raw):
    return S.reason_masks(raw)


@query("set_ineligible", "entries", "evidence_raw", sql=f"{MUST} SELECT DISTINCT path FROM risk WHERE path NOT IN (SELECT path FROM good) UNION SELECT group_root FROM members GROUP BY group_root HAVING NOT bool_or(good)")
def set_ineligible(entries, raw):
    return S.ineligible(entries, raw)


@query("agg_ineligible_groups", "entries", "evidence_raw", sql=f"{MUST} SELECT group_root, count(*) AS members FROM members GROUP BY group_root HAVING NOT bool_or(good)")
def agg_ineligible_groups(entries, raw):
    return S.ineligible_groups(entries)


@query("select_sample", "entries", "evidence_raw", sql=f"{SAMPLE} SELECT path, reasons, rank FROM chosen")
def select_sample(entries, raw):
    return S.select_sample(entries, S.evidence(raw), RUN, SEED, TARGET)


@query("agg_selection_summary", "entries", "evidence_raw", sql=f"""{SAMPLE},
  named AS (SELECT 'selected' AS reason FROM chosen UNION ALL SELECT CASE WHEN reasons & 63 <> 0 THEN 'risk' ELSE 'only_seeded' END FROM chosen
    UNION ALL SELECT n.reason FROM chosen JOIN (VALUES (1, 'metadata_mismatch'), (2, 'hardlink_group'), (4, 'migration_failure'), (8, 'migration_downgrade'), (16, 'retried_shard'), (32, 'bucket_boundary'), (64, 'seeded')) n(b, reason) ON chosen.reasons & n.b <> 0)
  SELECT reason, count(*) AS n FROM named GROUP BY reason""")
def agg_selection_summary(entries, raw):
    return S.selection_summary(S.select_sample(entries, S.evidence(raw), RUN, SEED, TARGET))


@query("join_jobs", "entries", "evidence_raw", sql=f"{SAMPLE} SELECT c.path, c.reasons, j.ss AS src_size, j.ds AS dst_size, j.src_root, j.dst_root FROM chosen c JOIN j ON c.path = j.path AND j.sp IS NOT NULL AND j.dp IS NOT NULL")
def join_jobs(entries, raw):
    return S.jobs_with_baselines(S.select_sample(entries, S.evidence(raw), RUN, SEED, TARGET), entries).select("path", "reasons", "src_size", "dst_size", "src_root", "dst_root")


@query("sample_stratified", "catalog", sql="""keyed AS (SELECT *, md5(concat('9/', row_id)) AS k, (row_id & 1099511627775) // 4096 AS block FROM catalog),
  links AS (SELECT * FROM keyed WHERE file_type = 3 ORDER BY k LIMIT 32),
  turns AS (SELECT *, row_number() OVER (PARTITION BY shard_index, block ORDER BY k) AS turn FROM keyed WHERE file_type <> 3),
  rest AS (SELECT * FROM turns ORDER BY turn, k LIMIT (SELECT 1000 - count(*) FROM links))
  SELECT row_id, path, file_type FROM links UNION ALL SELECT row_id, path, file_type FROM rest""")
def sample_stratified(catalog):
    return S.spread_sample(catalog, 1000, 9)


@query("join_retried", "claims", "shards", "obs_source", sql="""SELECT o.path, s.shard FROM obs_source o JOIN shards s ON CAST(s.shard_no AS BIGINT) = CAST(floor(o.ino / 10) AS BIGINT)
    WHERE o.file_type = 1 AND EXISTS (SELECT 1 FROM claims c WHERE c.shard = s.shard AND c.state = 'completed' AND c.epoch > 1)""")
def join_retried(claims, shards, source):
    # The index of the run: which shard each path is in, with the object version it was read from.
    order = F.floor(F.col("ino") / 10).cast("long")
    index = source.select("path", "file_type", F.concat(F.lit("part-"), F.lpad(order.cast("string"), 8, "0"), F.lit(".parquet")).alias("shard"), F.concat(F.lit("e"), order.cast("string")).alias("etag"))
    return S.retried_paths(claims, shards, index)


@query("join_failures_index", "sink_rows", "lineitem", sql="""f AS (SELECT row_id, shard, phase FROM sink_rows WHERE sink = 'failure'),
  i AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, min(concat('/p', l_partkey)) AS path, min(CAST(l_quantity AS BIGINT)) AS size FROM lineitem GROUP BY 1)
  SELECT f.row_id, f.shard, f.phase, i.path AS index_path, i.size FROM f LEFT JOIN i ON f.row_id = i.row_id""")
def join_failures_index(sinks, lineitem):
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id")
    index = lineitem.groupBy(key).agg(F.min(F.concat(F.lit("/p"), F.col("l_partkey").cast("string"))).alias("path"), F.min(F.col("l_quantity").cast("long")).alias("size")).withColumn("file_type", F.lit(1))
    return S.explain_failures(sinks.where("sink = 'failure'"), index).select("row_id", "shard", "phase", "index_path", "size")


@query("join_sample_check", "obs_source", "entries", sql="""p AS (SELECT path, file_type, CASE WHEN ino % 41 = 1 THEN size + 1 ELSE size END AS size, mode, uid, gid, mtime_sec FROM obs_source WHERE ino % 5 = 0
    UNION ALL SELECT concat('lost/', path), file_type, size, mode, uid, gid, mtime_sec FROM obs_source WHERE ino % 500 = 0),
  j AS (SELECT p.*, s.path sp, d.path dp, s.file_type st, d.file_type dt, s.size ss, d.size ds, s.mode sm, d.mode dm, s.uid su, d.uid du, s.gid sg, d.gid dg, s.mtime_sec sx, d.mtime_sec dx
    FROM p LEFT JOIN entries s ON s.side = 0 AND s.path = p.path LEFT JOIN entries d ON d.side = 1 AND d.path = p.path)
  SELECT path, 'source_missing' AS category FROM j WHERE sp IS NULL UNION ALL SELECT path, 'destination_missing' FROM j WHERE dp IS NULL
  UNION ALL SELECT path, 'source_changed' FROM j WHERE sp IS NOT NULL AND (file_type, size, mode, uid, gid, mtime_sec) <> (st, ss, sm, su, sg, sx)
  UNION ALL SELECT path, 'file_type' FROM j WHERE st <> dt UNION ALL SELECT path, 'mode' FROM j WHERE sm <> dm UNION ALL SELECT path, 'uid' FROM j WHERE su <> du
  UNION ALL SELECT path, 'gid' FROM j WHERE sg <> dg UNION ALL SELECT path, 'mtime' FROM j WHERE sx <> dx UNION ALL SELECT path, 'size' FROM j WHERE st = 1 AND dt = 1 AND ss <> ds""")
def join_sample_check(source, entries):
    columns = ["path", "file_type", "size", "mode", "uid", "gid", "mtime_sec"]
    scanned = source.where("ino % 5 = 0").withColumn("size", F.col("size") + F.when(F.col("ino") % 41 == 1, 1).otherwise(0)).select(*columns)
    lost = source.where("ino % 500 = 0").withColumn("path", F.concat(F.lit("lost/"), "path")).select(*columns)
    return S.check_sample(scanned.unionByName(lost), entries)


@query("src_risk_artifact", "evidence_raw", sql="SELECT DISTINCT to_base64(encode(path)) AS path_b64, reason, source, source_etag FROM evidence_raw")
def src_risk_artifact(raw):
    from tidemark.functions.paths import path_b64

    return S.evidence(raw).select(path_b64(F.col("path")).alias("path_b64"), "reason", "source", "source_etag")


@query("sc_bucket_boundary", "obs_source", sql="SELECT size, count(*) AS n FROM obs_source WHERE size IN (1048575, 1048576, 1048577) AND file_type = 1 GROUP BY size")
def sc_bucket_boundary(source):
    return source.where(S.is_boundary(F.col("size")) & (F.col("file_type") == R.REGULAR)).groupBy("size").agg(F.count("*").alias("n"))
