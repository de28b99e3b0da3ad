"""Queries that replay the driver's tables as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.eventlog import CREATED_PHASES, WINDOWS
from tidemark.plans.registry import query
from tidemark.scratch import materialise, scratch_path
from tidemark.sources.tables import MICROS, read_events
from tidemark.streaming import events as S
from tidemark.streaming import live


CHUNK_ROWS, CHUNK_FILES = 1_000_000, 4
SMALL = 8 * CHUNK_ROWS  # for streams that hold little of a micro-batch: each costs every partition of the state a start and a commit
AT = "unix_micros(CAST(event_at AS TIMESTAMP))"


def replay(events, least: int = 3, rows: int = CHUNK_ROWS, by: str = "seq"):
    """The events as a stream of JSON files, in micro-batches in order of `by`: `least`, or more of about `rows` events."""
    spark, path, staged = events.sparkSession, scratch_path(events.sparkSession, "replay"), scratch_path(events.sparkSession, "replay-staged")
    first, last, n = events.agg(F.min(F.expr(by)), F.max(F.expr(by)), F.count("*")).first()
    chunks = max(least, -(-n // rows))
    files = CHUNK_FILES * max(1, -(-n // chunks // CHUNK_ROWS))
    width = max(1, -(-((last or 0) - (first or 0) + 1) // chunks))
    # Dealt by chunk in one pass; then each chunk's own files are read, and put where the stream sees them in order.
    dealt = events.withColumn("_chunk", F.floor((F.expr(by) - (first or 0)) / width))
    dealt.repartition("_chunk", F.pmod("seq", F.lit(files))).write.partitionBy("_chunk").parquet(staged)
    for i in range(chunks):
        part = spark.read.schema(dealt.schema).parquet(staged).where(F.col("_chunk") == i).drop("_chunk")
        part.repartition(files).write.mode("append").options(**MICROS).json(path)
    return read_events(spark, path, streaming=True, files=files)


@query("st_ingest_repeats", "event_log", sql="SELECT worker_id, client_seq, CAST(CASE WHEN client_seq IS NULL THEN count(*) ELSE 1 END AS BIGINT) AS n FROM event_log GROUP BY worker_id, client_seq")
def st_ingest_repeats(events):
    # The log as it is: its repeats are far apart, so the lateness spans it.
    passed = S.run_available(S.ingest(replay(events), late="4000 days"), "ingest")
    return passed.groupBy("worker_id", "client_seq").agg(F.count("*").alias("n"))


@query("st_ingest", "event_log", sql="SELECT seq, worker_id FROM event_log WHERE client_seq IS NULL UNION ALL SELECT min(seq), worker_id FROM event_log WHERE client_seq IS NOT NULL GROUP BY worker_id, client_seq")
def st_ingest(events):
    firsts = events.where("client_seq is not null").groupBy("worker_id", "client_seq").agg(F.min("seq").alias("seq")).select("seq")
    once = events.join(firsts, "seq", "left_semi").unionByName(events.where("client_seq is null"))
    return S.run_available(S.ingest(replay(once.unionByName(once.where("seq % 4 = 0 and client_seq is not null")))), "ingest").select("seq", "worker_id")


@query("st_state", "event_log", sql="d AS (SELECT job_id, kind, sync_files, sum(coalesce(files_delta, 0)) OVER (PARTITION BY job_id ORDER BY seq) AS s FROM event_log) SELECT job_id, CAST(max(s) + greatest(0, max(CASE WHEN kind = 'ProgressSync' THEN sync_files - s END)) AS BIGINT) AS total FROM d GROUP BY job_id")
def st_state(events):
    updates = S.run_available(S.live_progress(replay(events)), "state", "update")
    return updates.groupBy("job_id").agg(F.max_by("total", "last_seq").alias("total"))


LIVE = f"""{CREATED_PHASES}, g AS (SELECT job_id, arg_max(phase, rn) AS phase, max(transitions) AS transitions FROM f GROUP BY job_id),
  c AS (SELECT job_id, max(seq) AS s FROM run_log WHERE kind = 'JobCreated' GROUP BY job_id), j AS (SELECT worker_id, max(seq) AS s FROM run_log WHERE kind = 'WorkerJoined' GROUP BY worker_id),
  jk AS (SELECT job_id AS key, count(*) FILTER (kind = 'ErrorEmitted') AS errors FROM run_log WHERE kind NOT LIKE 'Worker%' GROUP BY job_id),
  wk AS (SELECT DISTINCT worker_id AS key FROM run_log WHERE kind LIKE 'Worker%' OR kind IN ('ProgressDelta', 'ProgressSync')),
  jd AS (SELECT e.job_id AS key, kind, sync_files, sum(coalesce(files_delta, 0)) OVER (PARTITION BY e.job_id ORDER BY seq) AS d FROM run_log e JOIN c ON c.job_id = e.job_id WHERE seq > s AND kind NOT LIKE 'Worker%'),
  jt AS (SELECT key, CAST(max(d) + greatest(0, coalesce(max(sync_files - d), 0)) AS BIGINT) AS files, count(*) FILTER (kind = 'ClaimConflictResolved') AS conflicts FROM jd GROUP BY key),
  wd AS (SELECT e.worker_id AS key, seq, kind, to_state, reason, sync_files, sum(coalesce(files_delta, 0)) OVER (PARTITION BY e.worker_id ORDER BY seq) AS d FROM run_log e JOIN j ON j.worker_id = e.worker_id WHERE seq >= s AND (kind LIKE 'Worker%' OR kind IN ('ProgressDelta', 'ProgressSync'))),
  wt AS (SELECT key, CAST(max(d) + greatest(0, coalesce(max(sync_files - d), 0)) AS BIGINT) AS files, arg_max(CASE kind WHEN 'WorkerLeft' THEN 'Disconnected' WHEN 'WorkerFenced' THEN 'Fenced' WHEN 'WorkerStateChanged' THEN to_state ELSE 'Idle' END, seq) FILTER (kind LIKE 'Worker%' AND (kind <> 'WorkerStateChanged' OR to_state IS NOT NULL)) AS state,
      arg_max_null(CASE WHEN kind = 'WorkerFenced' THEN reason END, seq) FILTER (kind IN ('WorkerFenced', 'WorkerRecovered')) AS fence_reason, arg_max(reason, seq) FILTER (kind = 'WorkerLeft') AS last_error FROM wd GROUP BY key)
  SELECT 'job' AS entity, jk.key, CASE WHEN c.job_id IS NOT NULL THEN coalesce(phase, 'Planned') END AS phase, coalesce(transitions, 0) AS transitions, coalesce(files, 0) AS files, coalesce(conflicts, 0) AS conflicts, errors, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS fence_reason, CAST(NULL AS VARCHAR) AS last_error
  FROM jk LEFT JOIN c ON c.job_id = jk.key LEFT JOIN g ON g.job_id = jk.key LEFT JOIN jt ON jt.key = jk.key
  UNION ALL SELECT 'worker', wk.key, NULL, 0, coalesce(files, 0), 0, 0, state, fence_reason, last_error FROM wk LEFT JOIN wt ON wt.key = wk.key"""


def told(updates):
    """The last state of every job and worker, with its lists as counts."""
    errors = F.aggregate("buckets", F.lit(0).cast("long"), lambda n, b: n + b["count"])
    return live.state_of(updates).select("entity", "key", "phase", F.size("history").cast("long").alias("transitions"), "files", "conflicts", errors.alias("errors"), "state", "fence_reason", "last_error")


@query("st_live_state", "run_log", sql=LIVE)
def st_live_state(events):
    return told(S.run_available(live.live_state(replay(events)), "live", "update"))


@query("st_live_state_from_snapshot", "run_log", sql=LIVE)
def st_live_state_from_snapshot(events):
    # A snapshot of the first half, then the whole log again: what the snapshot has seen changes nothing.
    half = (events.agg(F.max("seq")).first()[0] or 0) // 2
    before = materialise(live.state_of(S.run_available(live.live_state(replay(events.where(F.col("seq") <= half), 1)), "live-half", "update")), "snapshot")
    after = S.run_available(live.live_state(replay(events), before), "live-rest", "update").drop("batch")
    return told(after.unionByName(before))


# The stream's clock is the latest event less the lateness; workers told before it are those that had been silent for longer then.
@query("st_liveness_live", "event_log", sql="""e AS (SELECT worker_id, epoch_ms(event_at) AS t FROM event_log), c AS (SELECT max(t) - 600000 AS now FROM e),
  n AS (SELECT worker_id, t, lead(t) OVER (PARTITION BY worker_id ORDER BY t) AS nxt FROM e) SELECT worker_id, max(t) AS last_ms, CAST(6 * 3600 AS BIGINT) AS silent_seconds FROM n, c WHERE nxt IS NULL AND t + 6 * 3600000 + 1 <= now GROUP BY worker_id""")
def st_liveness_live(events):
    # In order of time: what comes later than the watermark is dropped, and times may fall along seq.
    silent = S.run_available(live.liveness(replay(events, rows=SMALL, by=AT), 6 * 3600), "liveness")
    # A worker that came back is told again later, and not at all if it is there: of those still silent, the last word.
    last = events.groupBy("worker_id").agg(F.max(live.nearest_millis()).alias("last_ms"))
    return silent.join(last, ["worker_id", "last_ms"], "left_semi").select("worker_id", "last_ms", "silent_seconds")


@query("st_evict_live", "worker_events", sql="""e AS (SELECT worker_id, seq, kind, to_state, epoch_ms(event_at) AS t FROM worker_events), c AS (SELECT max(t) - 600000 AS now FROM e),
  s AS (SELECT worker_id, arg_max(kind, seq) FILTER (kind <> 'WorkerStateChanged' OR to_state IS NOT NULL) AS k, max(t) AS last_ms FROM e GROUP BY worker_id) SELECT worker_id, last_ms FROM s, c WHERE k = 'WorkerLeft' AND last_ms + 86400000 <= now""")
def st_evict_live(events):
    gone = S.run_available(live.evictions(replay(events, rows=SMALL, by=AT), 24), "evictions")
    last = events.groupBy("worker_id").agg(F.max(live.nearest_millis()).alias("last_ms"))
    return gone.join(last, ["worker_id", "last_ms"], "left_semi").select("worker_id", "last_ms")


@query("st_error_cap_live", "error_log", sql=WINDOWS)
def st_error_cap_live(events):
    return S.run_available(live.capped_errors(replay(events), 2, 5), "error-cap")


@query("st_gaps_live", "event_log", sql="n AS (SELECT job_id, seq, lead(seq) OVER (PARTITION BY job_id ORDER BY seq) AS nxt FROM (SELECT DISTINCT job_id, seq FROM event_log) t) SELECT job_id, seq + 1 AS first_missing, nxt - 1 AS last_missing FROM n WHERE nxt > seq + 1")
def st_gaps_live(events):
    # Some events come again, and some only with the last ones of the log.
    top = events.agg(F.max("seq")).first()[0] or 0
    again = events.where("seq % 9 = 0").withColumn("_at", F.lit(top))
    late = events.withColumn("_at", F.when(F.col("seq") % 13 == 0, F.lit(top)).otherwise(F.col("seq"))).unionByName(again)
    stream = replay(late.withColumnsRenamed({"seq": "client", "_at": "seq"}).withColumn("client_seq", F.col("client")))
    changes = S.run_available(live.gap_changes(stream.withColumn("seq", F.col("client_seq")), "job_id"), "gaps")
    return live.open_gaps(changes, "job_id")


@query("st_sync_live", "event_log", sql="p AS (SELECT job_id, CAST(floor(epoch(event_at) / 3600) AS BIGINT) * 3600 AS at_s, sum(files_delta) AS d FROM event_log WHERE kind = 'ProgressDelta' GROUP BY 1, 2), c AS (SELECT floor(epoch(max(event_at))) - 600 AS now FROM event_log WHERE kind = 'ProgressDelta'), s AS (SELECT job_id, at_s, d, lead(at_s) OVER (PARTITION BY job_id ORDER BY at_s) AS nxt, CAST(sum(d) OVER (PARTITION BY job_id ORDER BY at_s) AS BIGINT) AS files FROM p) SELECT job_id, at_s AS at, files FROM s, c WHERE d <> 0 AND (nxt IS NOT NULL OR at_s + 3600 <= now)")
def st_sync_live(events):
    return S.run_available(live.live_syncs(replay(events), 3600), "syncs")


@query("st_progress_cap", "event_log", sql="SELECT job_id, worker_id, CAST(sum(files_delta) AS BIGINT) AS files FROM event_log WHERE kind = 'ProgressDelta' GROUP BY job_id, worker_id")
def st_progress_cap(events):
    # Nothing is lost: a last event, days later, lets the timers release all that is held, and is not counted.
    last = events.agg(F.max("seq"), F.max("event_at")).first()
    end = events.sparkSession.range(1).select(F.lit(last[0] + 1).alias("seq"), (F.lit(last[1]) + F.expr("INTERVAL 2 DAYS")).cast(events.schema["event_at"].dataType).alias("event_at"), F.lit("end").alias("job_id"), F.lit("end").alias("worker_id"), F.lit("ProgressDelta").alias("kind"), F.lit(0).cast("long").alias("files_delta"))
    parts = S.run_available(live.capped_progress(replay(events.unionByName(end, allowMissingColumns=True)), 1.0), "capped")
    return parts.where("job_id <> 'end'").groupBy("job_id", "worker_id").agg(F.sum("files").alias("files"))


@query("st_rates_stream", "event_log", sql="s AS (SELECT job_id, files_delta, CAST(floor(epoch(event_at) / 60) AS BIGINT) * 60 AS m FROM event_log WHERE kind = 'ProgressDelta'), e AS (SELECT CAST(floor(epoch(max(event_at))) AS BIGINT) AS last FROM event_log WHERE kind = 'ProgressDelta'), w AS (SELECT job_id, m - 60 * k AS start, files_delta FROM s, range(0, 5) t(k)) SELECT job_id, start, CAST(sum(files_delta) AS BIGINT) AS files FROM w, e WHERE start + 300 <= last - 600 GROUP BY job_id, start")
def st_rates_stream(events):
    done = S.run_available(S.windowed_rates(replay(events)), "rates")
    return done.select("job_id", F.unix_seconds("start").alias("start"), "files")


def _reconciled(shards, claims):
    spark, path = shards.sparkSession, scratch_path(shards.sparkSession, "reconcile")
    done = claims.withColumn("state", F.when(F.col("state") == "active", "completed").otherwise(F.col("state"))).select("shard", "state", "claimed_utc", "claim_etag")
    # First the claims as they are, then those of workers that go on, and what nobody claimed comes last; some come again.
    rest = shards.join(claims.select("shard"), "shard", "left_anti").select("shard", F.lit("completed").alias("state"), F.lit(None).cast("timestamp").alias("claimed_utc"), F.lit("late").alias("claim_etag"))
    for part in (claims.select(*done.columns), done, rest.unionByName(done.where("state = 'completed'"))):
        part.repartition(CHUNK_FILES).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(done.schema).option("maxFilesPerTrigger", CHUNK_FILES).parquet(f"{path}/in")
    tell = live.reconcile(shards.count(), f"{path}/out")
    live.shard_changes(stream, shards).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(tell).start().awaitTermination()
    return live.reconciled(spark, f"{path}/out")


@query("st_reconcile", "shards", "claims", sql="SELECT 'JobFailed' AS kind, concat((SELECT count(*) FROM claims WHERE state = 'failed'), ' of ', (SELECT count(*) FROM shards), ' shards failed') AS reason")
def st_reconcile(shards, claims):
    return _reconciled(shards, claims).where("kind <> 'ProgressSync'").select("kind", "reason")


# What is told after the first claims, after those that went on, and after all shards: failed ones never count.
@query("st_reconcile_syncs", "shards", "claims", sql="""f AS (SELECT shard FROM claims WHERE state = 'failed'), c AS (SELECT shard FROM claims WHERE state = 'completed'), a AS (SELECT shard FROM claims)
  SELECT CAST(sum(n_rows) AS BIGINT) AS files, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM shards WHERE shard IN (SELECT shard FROM c)
  UNION ALL SELECT sum(n_rows), sum(n_bytes) FROM shards WHERE shard IN (SELECT shard FROM a) AND shard NOT IN (SELECT shard FROM f)
  UNION ALL SELECT sum(n_rows), sum(n_bytes) FROM shards WHERE shard NOT IN (SELECT shard FROM f)""")
def st_reconcile_syncs(shards, claims):
    return _reconciled(shards, claims).where("kind = 'ProgressSync'").select("files", "bytes")
