"""Queries over operators.runstate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import runstate as R
from tidemark.plans.registry import query

NOW = "1998-07-30 00:00:45"
STATUS = "status AS (SELECT s.shard, s.n_rows, coalesce(c.state, 'unclaimed') AS state FROM shards s LEFT JOIN claims c ON s.shard = c.shard)"
ONE = f"""{STATUS},
  part AS (SELECT s.shard, max(least(p.shard_rows_done, s.n_rows)) AS rows_done FROM status s JOIN progress p ON p.current_shard = s.shard WHERE s.state = 'active' GROUP BY s.shard),
  t AS (SELECT count(*) AS total_shards, CAST(sum(n_rows) AS BIGINT) AS total_rows, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'active') AS active,
    count(*) FILTER (state = 'unclaimed') AS unclaimed, CAST(coalesce(sum(n_rows) FILTER (state = 'completed'), 0) AS BIGINT) AS rows_completed, CAST((SELECT coalesce(sum(rows_done), 0) FROM part) AS BIGINT) AS rows_active FROM status),
  w AS (SELECT CAST(coalesce(sum(throughput_mb_s) FILTER (status <> 'exiting'), 0) AS BIGINT) AS throughput_mb_s, sum(CASE WHEN started_utc < TIMESTAMP '{NOW}' THEN files_ok / date_diff('second', started_utc, TIMESTAMP '{NOW}') END) AS rate, CAST(sum(files_failed) AS BIGINT) AS files_failed FROM progress),
  one AS (SELECT t.*, rows_completed + rows_active AS rows_done, 100.0 * least(rows_completed + rows_active, total_rows) / total_rows AS percent, throughput_mb_s, rate AS rows_per_second,
    CASE WHEN rate > 0 AND rows_completed + rows_active < total_rows AND failed = 0 THEN CAST(ceil((total_rows - rows_completed - rows_active) / rate) AS BIGINT) END AS eta_seconds, completed + failed = total_shards AS terminal, files_failed FROM t, w)"""
HALF = "SELECT shard, n_rows, n_bytes + CASE WHEN shard_no % 13 = 0 THEN 1 ELSE 0 END AS n_bytes, CASE WHEN shard_no % 17 = 0 THEN 'other' ELSE etag END AS etag FROM shards WHERE shard_no % 3 <> 0 UNION ALL SELECT concat('x', shard), n_rows, n_bytes, etag FROM shards WHERE shard_no % 101 = 0"


def half(shards):
    some = shards.where("shard_no % 3 <> 0").select("shard", "n_rows", (F.col("n_bytes") + F.when(F.col("shard_no") % 13 == 0, 1).otherwise(0)).alias("n_bytes"), F.when(F.col("shard_no") % 17 == 0, "other").otherwise(F.col("etag")).alias("etag"))
    return some.unionByName(shards.where("shard_no % 101 = 0").select(F.concat(F.lit("x"), "shard").alias("shard"), "n_rows", "n_bytes", "etag"))


@query("src_build_manifest", "shards", sql="""h AS (SELECT n_rows, n_bytes, left(sha256(shard), 4) AS b, sha256(concat(length(shard), ':', shard, length(CAST(n_rows AS VARCHAR)), ':', n_rows, length(CAST(n_bytes AS VARCHAR)), ':', n_bytes, length(etag), ':', etag)) AS e FROM shards),
  g AS (SELECT b, count(*) AS n, sum(n_rows) AS r, sum(n_bytes) AS s, sha256(string_agg(e, '' ORDER BY e)) AS e FROM h GROUP BY b)
  SELECT 'run-7' AS run_id, CAST(sum(n) AS BIGINT) AS shards, CAST(sum(r) AS BIGINT) AS total_rows, CAST(sum(s) AS BIGINT) AS total_bytes, sha256(string_agg(e, '' ORDER BY b)) AS digest FROM g""")
def src_build_manifest(shards):
    return R.build_manifest(shards, "run-7")


@query("src_manifest_entries", "shards", sql="SELECT row_number() OVER (ORDER BY shard) AS place, shard AS key, n_rows AS rows, n_bytes AS bytes, etag FROM shards")
def src_manifest_entries(shards):
    return R.manifest_entries(shards)


@query("join_status", "shards", "claims", sql=f"{STATUS} SELECT shard, n_rows, state FROM status")
def join_status(shards, claims):
    return R.shard_status(shards, claims).select("shard", "n_rows", "state")


@query("agg_status", "shards", "claims", "progress", sql=f"{ONE} SELECT * REPLACE (round(percent, 6) AS percent, round(rows_per_second, 6) AS rows_per_second) FROM one")
def agg_status(shards, claims, progress):
    one = R.run_status(shards, claims, progress, NOW)
    return one.withColumns({"percent": F.round("percent", 6), "rows_per_second": F.round("rows_per_second", 6)})


@query("agg_worker_lines", "progress", sql=f"""aged AS (SELECT *, greatest(date_diff('second', heartbeat_utc, TIMESTAMP '{NOW}'), 0) AS age_seconds FROM progress)
  SELECT host, age_seconds, CASE WHEN status = 'exiting' THEN false WHEN heartbeat_sec > 0 THEN age_seconds > 2 * heartbeat_sec END AS stale, status = 'exiting' AS exited, files_ok, files_failed FROM aged""")
def agg_worker_lines(progress):
    return R.worker_lines(progress, NOW)


TALLY = """first AS (SELECT shard, arg_min(state, (claimed_utc, claim_etag)) AS state FROM claims GROUP BY shard), j AS (SELECT s.*, f.state FROM shards s LEFT JOIN first f ON s.shard = f.shard)"""


@query("join_claim_tally", "shards", "claims", sql=f"{TALLY} SELECT shard, state FROM j")
def join_claim_tally(shards, claims):
    first = claims.groupBy("shard").agg(F.min_by("state", F.struct("claimed_utc", "claim_etag")).alias("state"))
    return shards.select("shard").join(first, "shard", "left")


@query("agg_tally", "shards", "claims", sql=f"""{TALLY} SELECT count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'active') AS active,
  CAST(sum(n_rows) FILTER (state = 'completed') AS BIGINT) AS rows_completed, CAST(sum(n_bytes) FILTER (state = 'completed') AS BIGINT) AS bytes_completed, bool_and(coalesce(state IN ('completed', 'failed'), false)) AS all_terminal FROM j""")
def agg_tally(shards, claims):
    return R.tally(shards, claims)


@query("join_liveness", "claims", "progress", sql=f"""j AS (SELECT c.*, p.host IS NULL AS absent, p.heartbeat_sec, p.held_etag, date_diff('second', c.claimed_utc, TIMESTAMP '{NOW}') AS claim_age, date_diff('second', p.heartbeat_utc, TIMESTAMP '{NOW}') AS beat_age
    FROM claims c LEFT JOIN progress p ON c.host = p.host WHERE c.state = 'active'),
  r AS (SELECT shard, host, CASE WHEN absent THEN CASE WHEN claim_age > 60 THEN 'never_reported' ELSE 'grace' END WHEN heartbeat_sec = 0 THEN 'uncalibrated'
    WHEN held_etag IS DISTINCT FROM claim_etag THEN CASE WHEN claim_age > 2 * heartbeat_sec THEN 'not_held' ELSE 'grace' END WHEN beat_age > 2 * heartbeat_sec THEN 'dead' ELSE 'alive' END AS reason FROM j)
  SELECT *, reason IN ('never_reported', 'not_held', 'dead') AS reclaimable FROM r""")
def join_liveness(claims, progress):
    return R.reclaimable(claims, progress, NOW, 30)


@query("win_latest_progress", "heartbeats", sql="r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY heartbeat_utc DESC, files_ok DESC) AS n FROM heartbeats) SELECT host, files_ok, held_etag FROM r WHERE n = 1")
def win_latest_progress(heartbeats):
    return R.latest_progress(heartbeats).select("host", "files_ok", "held_etag")


@query("win_epoch_history", "sink_rows", sql="p AS (SELECT shard, host, epoch, count(*) AS n FROM sink_rows GROUP BY ALL) SELECT shard, host, max(epoch) AS last_epoch, count(*) AS attempts, arg_max(n, epoch) AS last_rows FROM p GROUP BY shard, host")
def win_epoch_history(sinks):
    return R.attempts(sinks)


@query("agg_sink_summary", "sink_rows", sql="k AS (SELECT *, CASE WHEN sink = 'failure' THEN phase ELSE downgrade END AS kind FROM sink_rows) SELECT sink, kind, host, count(*) AS n FROM k GROUP BY ROLLUP (sink, kind, host)")
def agg_sink_summary(sinks):
    return R.sink_summary(sinks)


@query("agg_run_gate", "shards", "claims", "progress", "sink_rows", sql=f"""{ONE}, f AS (SELECT count(*) AS failure_rows FROM sink_rows WHERE sink = 'failure'),
  p AS (SELECT array_to_string(list_filter([CASE WHEN NOT terminal THEN 'not_terminal' END, CASE WHEN failed > 0 THEN 'failed_shards' END, CASE WHEN completed <> total_shards THEN 'incomplete' END, CASE WHEN files_failed > 0 THEN 'failed_files' END, CASE WHEN failure_rows > 0 THEN 'failure_rows' END], lambda x: x IS NOT NULL), ',') AS problems FROM one, f)
  SELECT problems, problems = '' AS passed FROM p""")
def agg_run_gate(shards, claims, progress, sinks):
    return R.run_gate(R.run_status(shards, claims, progress, NOW), sinks.where("sink = 'failure'"))


@query("agg_partials", "odd_paths", "claims", sql=f"""p AS (SELECT count(*) AS partials, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM odd_paths WHERE file_type = 1 AND regexp_matches(regexp_extract(path, '[^/]*$'), '^\\..+\\.[^.]+\\.[0-9]+\\.partial$')),
  l AS (SELECT count(*) AS live_claims FROM claims WHERE state = 'active' AND NOT date_diff('second', claimed_utc, TIMESTAMP '{NOW}') > 900) SELECT partials, bytes, live_claims, live_claims > 0 AS blocked FROM p, l""")
def agg_partials(entries, claims):
    return R.partial_report(entries, claims, NOW)


@query("join_resume", "shards", sql=f"h AS ({HALF}) SELECT coalesce(s.shard, h.shard) AS shard, CASE WHEN s.shard IS NULL THEN 'stale' WHEN s.n_bytes = h.n_bytes AND s.etag = h.etag THEN 'done' ELSE 'pending' END AS state FROM shards s FULL OUTER JOIN h ON s.shard = h.shard")
def join_resume(shards):
    return R.pending_shards(shards, half(shards))


@query("join_upload_verify", "shards", sql=f"h AS ({HALF}), r AS (SELECT s.shard, CASE WHEN h.shard IS NULL THEN 'missing' WHEN h.n_bytes <> s.n_bytes THEN 'size' WHEN h.etag IS DISTINCT FROM s.etag THEN 'digest' END AS problem FROM shards s LEFT JOIN h ON s.shard = h.shard) SELECT shard, problem FROM r WHERE problem IS NOT NULL")
def join_upload_verify(shards):
    return R.unpublished(shards, half(shards))


@query("set_shard_diff", "shards", sql=f"h AS ({HALF}) SELECT shard, 'left' AS only_in FROM (SELECT shard FROM shards EXCEPT SELECT shard FROM h) UNION ALL SELECT shard, 'right' FROM (SELECT shard FROM h EXCEPT SELECT shard FROM shards)")
def set_shard_diff(shards):
    return R.shard_diff(shards, half(shards))


NAMED = "named AS (SELECT *, CASE WHEN host LIKE concat('%-', pid) THEN left(host, length(host) - length(concat('-', pid))) ELSE host END AS machine FROM registrations)"


@query("join_supersede", "registrations", sql=f"{NAMED}, r AS (SELECT a.worker_id, a.machine, b.worker_id AS later, row_number() OVER (PARTITION BY a.worker_id ORDER BY b.seq) AS n FROM named a JOIN named b ON a.job_id = b.job_id AND a.machine = b.machine AND b.seq > a.seq AND (a.pid <> b.pid OR a.start_time <> b.start_time)) SELECT worker_id, machine, later AS by FROM r WHERE n = 1")
def join_supersede(registrations):
    return R.superseded(registrations)


@query("join_worker_job", "registrations", sql=f"{NAMED}, n AS (SELECT * FROM named a WHERE NOT EXISTS (SELECT 1 FROM named b WHERE a.job_id = b.job_id AND a.machine = b.machine AND b.seq > a.seq AND (a.pid <> b.pid OR a.start_time <> b.start_time))) SELECT job_id, worker_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY seq) AS INTEGER) AS place FROM n")
def join_worker_job(registrations):
    return R.workers_of(registrations, R.superseded(registrations))


@query("top_jobs", "jobs", sql="SELECT job_id, phase, errors FROM jobs WHERE contains(lower(job_id), '12') OR contains(lower(name), '12') ORDER BY errors DESC, job_id LIMIT 50")
def top_jobs(jobs):
    return R.list_jobs(jobs, "12", "errors", 50).select("job_id", "phase", "errors")


@query("top_jobs_by_progress", "jobs", sql="SELECT job_id, files_done, files_total FROM jobs ORDER BY files_done / greatest(files_total, 1) DESC, job_id LIMIT 50")
def top_jobs_by_progress(jobs):
    return R.list_jobs(jobs, "", "progress", 50).select("job_id", "files_done", "files_total")


@query("top_workers", "progress", sql="SELECT host, files_failed FROM progress ORDER BY files_failed DESC, host LIMIT 10")
def top_workers(progress):
    return R.list_workers(progress, "files_failed", 10).select("host", "files_failed")


@query("agg_jobs", "jobs", sql="SELECT count(*) FILTER (phase NOT IN ('Completed', 'Failed', 'Cancelled', 'Paused')) AS running, count(*) FILTER (phase = 'Paused') AS paused, count(*) FILTER (phase IN ('Completed', 'Failed', 'Cancelled')) AS ended, CAST(sum(files_done) AS BIGINT) AS files_done, CAST(sum(errors) AS BIGINT) AS errors FROM jobs")
def agg_jobs(jobs):
    return R.job_counts(jobs)


@query("agg_run_summary", "jobs", sql=f"""t AS (SELECT *, greatest(date_diff('second', copy_start, coalesce(finished, TIMESTAMP '{NOW}')), 1) AS seconds FROM jobs),
  a AS (SELECT *, CASE WHEN finished IS NOT NULL AND files_total > 0 THEN files_total ELSE files_done END / seconds AS average, CASE WHEN finished IS NOT NULL AND files_total > 0 THEN greatest(files_done - files_total, 0) END AS replayed FROM t)
  SELECT job_id, seconds, round(average, 6) AS average, replayed, round(replayed * 100.0 / files_total, 6) AS replayed_percent, CASE WHEN finished IS NULL AND files_total > 0 AND average > 0 THEN CAST(floor(greatest(files_total - files_done, 0) / average) AS BIGINT) END AS eta_seconds FROM a""")
def agg_run_summary(jobs):
    return R.run_summary(jobs, NOW).withColumns({"average": F.round("average", 6), "replayed_percent": F.round("replayed_percent", 6)})


OUTCOMES = "o AS (SELECT shard_no, host, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'fenced') AS fenced, count(*) FILTER (outcome = 'ok' AND torn) AS torn, CAST(coalesce(sum(bytes) FILTER (outcome = 'ok'), 0) AS BIGINT) AS bytes FROM outcomes GROUP BY shard_no, host)"


@query("agg_shard_outcome", "outcomes", sql=f"{OUTCOMES} SELECT * FROM o")
def agg_shard_outcome(outcomes):
    return R.shard_outcomes(outcomes)


@query("agg_failure_pct", "outcomes", sql=f"{OUTCOMES}, p AS (SELECT *, CASE WHEN ok + failed > 0 THEN failed / (ok + failed) * 100 ELSE 0 END AS failure_pct FROM o) SELECT shard_no, host, round(failure_pct, 6) AS failure_pct, CASE WHEN failure_pct > 20 THEN 'failure_rate_high' WHEN bytes > 0 AND floor(bytes / 1000) < 10 THEN 'throughput_low' END AS degraded FROM p")
def agg_failure_pct(outcomes):
    return R.shard_health(R.shard_outcomes(outcomes), 20, 10, F.col("bytes") / 1000).select("shard_no", "host", F.round("failure_pct", 6).alias("failure_pct"), "degraded")


# One step of every host at a time: what is carried from a row to the next is in the row.
EPISODES = f"""RECURSIVE {OUTCOMES}, h AS MATERIALIZED (SELECT host, shard_no * 60 AS at_s, (ok + failed > 0 AND failed / (ok + failed) * 100 > 20) OR (bytes > 0 AND floor(bytes / 1000) < 10) AS bad, row_number() OVER (PARTITION BY host ORDER BY shard_no) AS rn FROM o),
  e AS (SELECT host, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS at_s, '' AS state, CAST(300 AS BIGINT) AS wait, CAST(NULL AS BIGINT) AS until, CAST(0 AS BIGINT) AS episode FROM (SELECT DISTINCT host FROM h) z
    UNION ALL SELECT e.host, h.rn, h.at_s, CASE WHEN NOT bad THEN CASE WHEN until IS NULL THEN 'healthy' ELSE 'recovered' END WHEN until IS NULL THEN 'tripped' WHEN h.at_s >= until THEN 'probe_failed' ELSE 'straggler' END,
      CASE WHEN NOT bad OR until IS NULL THEN 300 WHEN h.at_s >= until THEN least(2 * wait, 1800) ELSE wait END,
      CASE WHEN NOT bad THEN NULL WHEN until IS NULL THEN h.at_s + 300 WHEN h.at_s >= until THEN h.at_s + least(2 * wait, 1800) ELSE h.at_s + wait END, episode + CASE WHEN bad AND until IS NULL THEN 1 ELSE 0 END
    FROM e JOIN h ON h.host = e.host AND h.rn = e.rn + 1)"""


@query("win_backpressure", "outcomes", sql=f"{EPISODES} SELECT host, CAST(at_s AS BIGINT) AS \"at\", state, CASE WHEN until IS NULL THEN 0 ELSE wait END AS cooldown_seconds, episode FROM e WHERE rn > 0")
def win_backpressure(outcomes):
    health = R.shard_health(R.shard_outcomes(outcomes), 20, 10, F.col("bytes") / 1000)
    return R.backpressure(health.select("host", (F.col("shard_no") * 60).cast("long").alias("at"), F.col("shard_no").alias("seq"), "degraded"))


@query("win_throughput", "heartbeats", sql="""s AS (SELECT host, CAST(floor(epoch(heartbeat_utc)) AS BIGINT) AS at_s, CAST(sum(bytes_total) OVER (PARTITION BY host ORDER BY files_ok) AS BIGINT) AS b FROM heartbeats),
  w AS (SELECT host, at_s, b, arg_min(b, (at_s, b)) OVER r AS first, arg_max(b, (at_s, b)) OVER r AS last, max(at_s) OVER r - min(at_s) OVER r AS spent FROM s WINDOW r AS (PARTITION BY host ORDER BY at_s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW))
  SELECT host, at_s AS at, b AS bytes, round(CASE WHEN spent > 0 THEN greatest(last - first, 0) / spent / 1048576 ELSE 0 END, 9) AS mib_s FROM w""")
def win_throughput(heartbeats):
    from pyspark.sql import Window

    w = Window.partitionBy("host").orderBy("files_ok")
    samples = heartbeats.select("host", F.unix_seconds(F.col("heartbeat_utc").cast("timestamp")).alias("at"), F.sum("bytes_total").over(w).alias("bytes"))
    return R.throughput(samples, 3600).withColumn("mib_s", F.round("mib_s", 9))
