"""Queries that write tables of the estate and the run, and read them back through sources.tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.inventory import normalize
from tidemark.plans.registry import query
from tidemark.scratch import scratch_path
from tidemark.sources import tables as S


@query("src_legacy_scan", "scan", sql="SELECT shard_index, count(*) AS n, max(row_in_shard) AS last_row, CAST(sum(size) AS BIGINT) AS bytes FROM scan GROUP BY shard_index")
def src_legacy_scan(scan):
    spark, path = scan.sparkSession, scratch_path(scan.sparkSession, "scan")
    columns = scan.drop("shard_index", "row_in_shard")
    # One file a shard: a range partitioner draws its bounds from a sample, and may put two shards into one.
    columns.withColumn("_r", (F.col("uid") % 8).cast("int")).repartitionById(8, "_r").sortWithinPartitions("path").drop("_r").write.parquet(f"{path}/scans/first")
    found = S.check_scan_contract(S.read_scan(spark, path), required={"path": "string", "file_type": "string"})
    return found.groupBy("shard_index").agg(F.count("*").alias("n"), F.max("row_in_shard").alias("last_row"), F.sum("size").alias("bytes"))


@query("src_scan_contract", "scan", sql="SELECT count(*) AS n, count(mtime_sec) AS mtime_sec, 0 AS atime_sec, count(symlink_target) AS links FROM scan")
def src_scan_contract(scan):
    typed = scan.select("*", F.col("path").alias("atime_sec")).withColumns({c: F.col(c).cast(t) for c, t in {"permissions": "int", "uid": "bigint", "gid": "bigint", "nlink": "bigint", "size": "bigint"}.items()})
    checked = S.check_scan_contract(typed)  # an optional column of another type counts as absent
    return checked.agg(F.count("*").alias("n"), F.count("mtime_sec").alias("mtime_sec"), F.count("atime_sec").cast("int").alias("atime_sec"), F.count("symlink_target").alias("links"))


def _index(catalog):
    """An index with planted problems: file types that don't exist, and row ids of another shard."""
    path = scratch_path(catalog.sparkSession, "index")
    bad = F.when(F.col("row_id") % 97 == 0, 9).otherwise(F.col("file_type"))
    strayed = F.when(F.col("row_id") % 89 == 1, F.col("row_id") + (1 << 40)).otherwise(F.col("row_id"))
    S.write_index(catalog.drop("symlink_target").withColumns({"file_type": bad, "row_id": strayed}), path)
    return path


@query("src_index", "catalog", sql="SELECT CASE WHEN row_id % 97 = 0 THEN 'file_type' WHEN row_id % 89 = 1 THEN 'shard' END AS problem, count(*) AS n, 0 AS links, count(uid) AS owned FROM catalog GROUP BY 1")
def src_index(catalog):
    found = S.read_index(catalog.sparkSession, _index(catalog))
    return found.groupBy("problem").agg(F.count("*").alias("n"), F.count("symlink_target").cast("int").alias("links"), F.count("uid").alias("owned"))


@query("sink_index", "catalog", sql="SELECT CAST(shard_index AS INTEGER) AS shard_index, count(*) AS stamped, count(*) AS found FROM catalog GROUP BY 1")
def sink_index(catalog):
    return S.row_counts(catalog.sparkSession, _index(catalog)).withColumn("shard_index", F.col("shard_index").cast("int"))


@query("src_index_footer", "catalog", sql="SELECT CAST(count(*) AS BIGINT) AS rows, count(DISTINCT shard_index) AS shards FROM catalog")
def src_index_footer(catalog):
    footers = S.read_footers(catalog.sparkSession, f"{_index(catalog)}/index")
    per_file = footers.groupBy("file").agg(F.max("rows").alias("rows"))
    return per_file.agg(F.sum("rows").alias("rows"), F.countDistinct(F.regexp_extract("file", r"shard_index=(\d+)", 1)).alias("shards"))


RUN_KEYS = 1000


def _manifest_all(shards):
    """One document for each range of RUN_KEYS shard numbers: more shards make more manifests, not larger ones."""
    entry = F.struct(F.col("shard").alias("key"), F.col("n_rows").alias("rows"), F.col("n_bytes").alias("bytes"), "etag")
    run = F.concat(F.lit("run-"), F.floor(F.col("shard_no") / RUN_KEYS).cast("string"))
    return shards.groupBy(run.alias("run_id")).agg(F.collect_list(entry).alias("shards")).select(F.to_json(F.struct("run_id", "shards")).alias("body"))


RUNS = f"r AS (SELECT concat('run-', CAST(floor(shard_no / {RUN_KEYS}) AS BIGINT)) AS run_id, * FROM shards)"
RUN_TOTALS = f"{RUNS} SELECT run_id, '/' AS root, count(*) AS shards, CAST(sum(n_rows) AS BIGINT) AS total_rows FROM r GROUP BY run_id"
RUN_SHARDS = f"{RUNS} SELECT run_id, shard, n_rows, n_bytes, etag FROM r"


@query("src_manifest", "shards", sql=RUN_TOTALS)
@query("src_manifest_all", "shards", sql=RUN_TOTALS)
def src_manifest_all(shards):
    path = scratch_path(shards.sparkSession, "manifest")
    _manifest_all(shards).write.text(path)
    runs = S.manifest_run(shards.sparkSession.read.text(path).withColumnRenamed("value", "body"))
    return runs.select("run_id", "root", F.col("shards").cast("long").alias("shards"), "total_rows")


@query("src_manifest_shards", "shards", sql=RUN_SHARDS)
@query("src_manifest_shards_all", "shards", sql=RUN_SHARDS)
def src_manifest_shards(shards):
    return S.manifest_shards(_manifest_all(shards)).select("run_id", "shard", "n_rows", "n_bytes", "etag")


@query("src_claims", "claims", "shards", sql="SELECT shard, CASE WHEN epoch = 2 AND state = 'active' THEN 'unparseable' ELSE state END AS state, CASE WHEN epoch = 2 AND state = 'active' THEN NULL ELSE host END AS host FROM claims")
def src_claims(claims, shards):
    body = F.to_json(F.struct("host", "claimed_utc", "epoch", "state"))
    garbage = (F.col("epoch") == 2) & (F.col("state") == "active")
    objects = claims.select(F.concat(F.lit("s3://run/shards/"), "shard", F.lit(".claim")).alias("key"), F.when(garbage, "{oops").otherwise(body).alias("body"))
    foreign = objects.limit(5).withColumn("key", F.lit("s3://run/shards/unknown.claim"))
    return S.claims(objects.unionByName(foreign), shards, surface=True).select("shard", "state", "host")


@query("src_progress", "progress", sql="SELECT host, files_ok, CASE WHEN host IN ('h1', 'h2') THEN 0 ELSE heartbeat_sec END AS heartbeat_sec, 0 AS files_fenced FROM progress")
def src_progress(progress):
    old = F.to_json(F.struct("host", "heartbeat_utc", "files_ok"))
    new = F.to_json(F.struct("host", "heartbeat_utc", "files_ok", "heartbeat_sec", "held_etag"))
    found = S.progress(progress.select(F.when(F.col("host").isin("h1", "h2"), old).otherwise(new).alias("body")))
    return found.select("host", "files_ok", F.col("heartbeat_sec").cast("int").alias("heartbeat_sec"), F.col("files_fenced").cast("int").alias("files_fenced"))


def _sink(rows, sink: str):
    torn = F.concat(F.lit('{"TORN_COPY":{"pre":1,"post":2}}'))
    name = F.when(F.col("downgrade") == "TORN_COPY", torn).otherwise(F.concat(F.lit('"'), "downgrade", F.lit('"')))
    line = F.concat(F.lit('{"row_id":'), F.col("row_id").cast("string"), F.lit(',"path_b64":"L3A=","phase":"'), "phase", F.lit('","downgrade":'), name, F.lit("}"))
    key = F.concat(F.lit(f"s3://run/{sink}s/host-"), "host", F.lit("/"), "shard", F.lit("-e"), F.col("epoch").cast("string"), F.lit(".jsonl"))
    return S.sink_lines(rows.where(F.col("sink") == sink).select(key.alias("key"), line.alias("line")))


@query("src_failures", "sink_rows", sql="SELECT row_id, host, shard AS stem, CAST(epoch AS INTEGER) AS epoch, phase FROM sink_rows WHERE sink = 'failure'")
def src_failures(rows):
    return _sink(rows, "failure").select("row_id", "host", "stem", "epoch", "phase")


@query("src_downgrades", "sink_rows", sql="SELECT row_id, host, downgrade FROM sink_rows WHERE sink = 'downgrade'")
def src_downgrades(rows):
    return _sink(rows, "downgrade").select("row_id", "host", "downgrade")


@query("src_events", "event_log", sql="SELECT kind, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs, count(client_seq) AS stamped FROM event_log WHERE seq > 1000 GROUP BY kind")
def src_events(events):
    path = scratch_path(events.sparkSession, "events")
    S.write_events(events.withColumn("schema_version", F.lit(S.SCHEMA_VERSION)), path, chunk=400)
    return S.read_events(events.sparkSession, path, since=1000).groupBy("kind").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"), F.count("client_seq").alias("stamped"))


@query("src_snapshot", "event_log", sql="SELECT job_id, max(seq) AS last_seq FROM event_log GROUP BY job_id")
def src_snapshot(events):
    spark, path = events.sparkSession, scratch_path(events.sparkSession, "state")
    for version, part in ((1, events.where("seq <= 5000")), (2, events.where("seq <= 9000")), (3, events)):
        S.write_state({"jobs": part.groupBy("job_id").agg(F.max("seq").alias("last_seq"))}, path, version, keep=2)
    return S.read_state(spark, path, "jobs")


@query("src_audit", "event_log", sql="SELECT CAST(CAST(event_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM event_log WHERE kind = 'ErrorEmitted' AND event_at < TIMESTAMP '2024-01-11 00:00:00' GROUP BY 1")
def src_audit(events):
    spark, path = events.sparkSession, scratch_path(events.sparkSession, "audit")
    rows = events.where("kind = 'ErrorEmitted'").select("seq", "job_id", F.to_date("event_at").cast("string").alias("day"))
    S.write_partitioned(rows, path, "day", "json")
    return S.read_partitioned(spark, path, rows.schema, "json").where("day < '2024-01-11'").groupBy("day").agg(F.count("*").alias("n"))


@query("src_observations", "entries", sql="SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM entries WHERE side = 1")
def src_observations(entries):
    spark, path = entries.sparkSession, scratch_path(entries.sparkSession, "entries")
    S.write_partitioned(entries, path, "side")
    return S.read_partitioned(spark, path, entries.schema).where("side = 1").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("src_risk_roundtrip", "evidence_raw", sql="SELECT DISTINCT path, reason, source, source_etag FROM evidence_raw")
def src_risk_roundtrip(raw):
    path = scratch_path(raw.sparkSession, "evidence")
    S.evidence_lines(raw).write.text(path)
    return S.read_evidence(raw.sparkSession.read.text(path))


@query("src_rewrite_report", "shards", sql="SELECT CAST(shard_no % 7 AS INTEGER) AS part, count(*) AS shards, CAST(sum(n_rows) AS BIGINT) AS rows, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM shards GROUP BY 1")
def src_rewrite_report(shards):
    entry = F.struct(F.col("shard").alias("name"), F.col("n_rows").alias("rows"), F.col("n_bytes").alias("bytes"), F.col("etag").alias("sha256"))
    bodies = shards.groupBy(F.floor(F.col("shard_no") / RUN_KEYS).alias("g")).agg(F.to_json(F.struct(F.collect_list(entry).alias("shards"))).alias("body"))
    found = S.rewrite_report(bodies)
    part = (F.regexp_extract("shard", r"(\d+)", 1).cast("long") % 7).cast("int")
    return found.groupBy(part.alias("part")).agg(F.count("*").alias("shards"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


@query("norm_rewrite", "scan", sql="SELECT file_type, count(*) AS n, min(path) AS first FROM (SELECT CASE file_type WHEN 'directory' THEN 2 WHEN 'symlink' THEN 3 ELSE 1 END AS file_type, substr(path, 8) AS path FROM scan) t GROUP BY file_type")
def norm_rewrite(scan):
    path = scratch_path(scan.sparkSession, "canonical")
    S.write_index(normalize(scan, "/export"), path)
    return S.read_index(scan.sparkSession, path).where("problem is null").groupBy("file_type").agg(F.count("*").alias("n"), F.min("path").alias("first"))
