"""Queries over operators.eventlog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import eventlog as E
from tidemark.plans.registry import query

NOW = "2024-01-20 00:00:00"


@query("win_hwm_dedup", "event_log", sql="h AS (SELECT *, max(client_seq) OVER (PARTITION BY worker_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM event_log) SELECT seq, worker_id FROM h WHERE client_seq IS NULL OR high IS NULL OR client_seq > high")
def win_hwm_dedup(events):
    return E.dedup_client(events).select("seq", "worker_id")


@query("win_batch_monotonic", "event_log", sql="""b AS (SELECT *, CAST(floor(seq / 20) AS BIGINT) AS batch, CASE WHEN seq % 397 = 0 THEN 'w-x' ELSE worker_id END AS sender FROM event_log),
  m AS (SELECT *, client_seq <= last_value(client_seq IGNORE NULLS) OVER (PARTITION BY batch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS falls FROM b),
  p AS (SELECT batch, CASE WHEN bool_or(worker_id <> sender) THEN 'foreign_worker' WHEN bool_or(kind IN ('WorkerJoined') AND seq % 31 = 0) THEN 'forbidden_kind' WHEN bool_or(coalesce(falls, false)) THEN 'not_monotonic' END AS problem FROM m GROUP BY batch)
  SELECT batch, problem IS NULL AS accepted, problem FROM p""")
def win_batch_monotonic(events):
    kind = F.when((F.col("kind") == "WorkerJoined") & (F.col("seq") % 31 == 0), "JobCreated").otherwise(F.col("kind"))
    batches = events.withColumns({"batch": F.floor(F.col("seq") / 20), "sender": F.when(F.col("seq") % 397 == 0, "w-x").otherwise(F.col("worker_id")), "kind": kind})
    return E.validate_batches(batches, ("JobCreated",))


@query("win_progress_fold", "event_log", sql="d AS (SELECT job_id, kind, sync_files, sum(coalesce(files_delta, 0)) OVER (PARTITION BY job_id ORDER BY seq) AS s FROM event_log) SELECT job_id, CAST(max(s) + greatest(0, max(CASE WHEN kind = 'ProgressSync' THEN sync_files - s END)) AS BIGINT) AS total FROM d GROUP BY job_id")
def win_progress_fold(events):
    return E.progress(events, "job_id", "files_delta", "sync_files")


@query("win_progress_fold_workers", "event_log", sql="""j AS (SELECT worker_id, max(seq) AS j FROM event_log WHERE kind = 'WorkerJoined' GROUP BY worker_id),
  e AS (SELECT e.* FROM event_log e LEFT JOIN j ON e.worker_id = j.worker_id WHERE j IS NULL OR e.seq > j),
  d AS (SELECT worker_id, sync_files, sum(coalesce(files_delta, 0)) OVER (PARTITION BY worker_id ORDER BY seq) AS s FROM e WHERE files_delta IS NOT NULL OR sync_files IS NOT NULL)
  SELECT worker_id, CAST(max(s) + greatest(0, coalesce(max(sync_files - s), 0)) AS BIGINT) AS total FROM d GROUP BY worker_id""")
def win_progress_fold_workers(events):
    return E.progress(events, "worker_id", "files_delta", "sync_files", reset="WorkerJoined")


@query("win_worker_fold", "worker_events", sql="""j AS (SELECT worker_id, max(seq) AS j FROM worker_events WHERE kind = 'WorkerJoined' GROUP BY worker_id),
  e AS (SELECT e.* FROM worker_events e JOIN j ON e.worker_id = j.worker_id WHERE e.seq >= j),
  s AS (SELECT worker_id, arg_max(CASE kind WHEN 'WorkerLeft' THEN 'Disconnected' WHEN 'WorkerFenced' THEN 'Fenced' WHEN 'WorkerStateChanged' THEN to_state ELSE 'Idle' END, seq) AS state FROM e WHERE kind <> 'WorkerStateChanged' OR to_state IS NOT NULL GROUP BY worker_id),
  f AS (SELECT worker_id, arg_max_null(CASE WHEN kind = 'WorkerFenced' THEN reason END, seq) AS fence_reason FROM e WHERE kind IN ('WorkerFenced', 'WorkerRecovered') GROUP BY worker_id),
  l AS (SELECT worker_id, arg_max(reason, seq) AS last_error FROM e WHERE kind = 'WorkerLeft' GROUP BY worker_id)
  SELECT s.worker_id, state, fence_reason, last_error FROM s LEFT JOIN f ON s.worker_id = f.worker_id LEFT JOIN l ON s.worker_id = l.worker_id""")
def win_worker_fold(events):
    return E.worker_states(events)


# One event of every job at a time. back: the phase that a resumed job goes back to; fewer moves than the history keeps.
_PHASES = """RECURSIVE p(name, n) AS (VALUES ('Planned', 0), ('Scanning', 1), ('Copying', 2), ('Verifying', 3), ('Cutover', 4), ('Paused', 5), ('Completed', 6), ('Failed', 7), ('Cancelled', 8)),
  v AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS rn FROM {source}),
  f AS (SELECT job_id, CAST(0 AS BIGINT) AS rn, 'Planned' AS phase, 'Scanning' AS back, CAST(0 AS BIGINT) AS transitions, CAST(NULL AS BIGINT) AS first_copying, CAST(NULL AS BIGINT) AS ended FROM (SELECT DISTINCT job_id FROM v) z
    UNION ALL SELECT w.job_id, w.rn, CASE WHEN ok THEN target ELSE phase END, CASE WHEN ok AND phase <> 'Paused' THEN phase ELSE back END, transitions + CASE WHEN ok THEN 1 ELSE 0 END,
      CASE WHEN ok AND target = 'Copying' THEN coalesce(first_copying, seq) ELSE first_copying END, CASE WHEN ok AND a_n >= 6 THEN coalesce(ended, seq) ELSE ended END
    FROM (SELECT t.*, a.n AS a_n, coalesce(b.n <> a.n AND b.n < 6 AND (a.n >= 5 OR b.n = 5 OR b.n < a.n), FALSE) AS ok
      FROM (SELECT f.job_id, v.rn, v.seq, f.phase, f.back, f.transitions, f.first_copying, f.ended, CASE v.kind WHEN 'ProgressDelta' THEN CASE WHEN f.phase = 'Planned' THEN 'Copying' END WHEN 'JobResumed' THEN CASE WHEN f.phase = 'Paused' THEN f.back END
          WHEN 'JobPaused' THEN 'Paused' WHEN 'JobCompleted' THEN 'Completed' WHEN 'JobFailed' THEN 'Failed' WHEN 'JobCancelled' THEN 'Cancelled' WHEN 'VerifyStarted' THEN 'Verifying' ELSE v.to_phase END AS target
        FROM f JOIN v ON v.job_id = f.job_id AND v.rn = f.rn + 1) t LEFT JOIN p a ON a.name = t.target LEFT JOIN p b ON b.name = t.phase) w)"""
PHASES = _PHASES.replace("{source}", "phase_events")
# Jobs that were created, and what came after the last creation of each.
SINCE = """(SELECT e.job_id, e.seq, e.kind, CASE WHEN e.kind = 'VerifyCompleted' THEN CASE WHEN e.mismatches = 0 THEN 'Cutover' ELSE 'Failed' END ELSE e.to_phase END AS to_phase
    FROM run_log e JOIN (SELECT job_id, max(seq) AS s FROM run_log WHERE kind = 'JobCreated' GROUP BY job_id) c ON e.job_id = c.job_id WHERE e.seq > c.s AND e.kind IN ('JobPhaseChanged', 'JobPaused', 'JobResumed', 'JobCancelled', 'JobCompleted', 'JobFailed', 'ProgressDelta', 'VerifyStarted', 'VerifyCompleted'))"""
CREATED_PHASES = _PHASES.replace("{source}", f"{SINCE} z")


@query("win_phase_fold", "phase_events", sql=f"{PHASES} SELECT job_id, arg_max(phase, rn) AS phase, max(transitions) AS transitions, max(first_copying) AS first_copying, max(ended) AS ended FROM f GROUP BY job_id")
def win_phase_fold(events):
    return E.job_phases(events)


@query("win_phase_fold_created", "run_log", sql=f"""{CREATED_PHASES}, c AS (SELECT DISTINCT job_id FROM run_log WHERE kind = 'JobCreated'), g AS (SELECT job_id, arg_max(phase, rn) AS phase, max(transitions) AS transitions, max(first_copying) AS first_copying, max(ended) AS ended FROM f GROUP BY job_id)
  SELECT c.job_id, coalesce(phase, 'Planned') AS phase, coalesce(transitions, 0) AS transitions, first_copying, ended FROM c LEFT JOIN g ON c.job_id = g.job_id""")
def win_phase_fold_created(events):
    kinds = ("JobCreated", "JobPhaseChanged", "JobPaused", "JobResumed", "JobCancelled", "JobCompleted", "JobFailed", "ProgressDelta", "VerifyStarted", "VerifyCompleted")
    return E.job_phases(events.where(F.col("kind").isin(*kinds)), created=True)


@query("sc_phase_rules", "jobs", sql="""p(name, n) AS (VALUES ('Planned', 0), ('Scanning', 1), ('Copying', 2), ('Verifying', 3), ('Cutover', 4), ('Paused', 5), ('Completed', 6), ('Failed', 7), ('Cancelled', 8))
  SELECT j.phase AS before, a.name AS after, count(*) AS n FROM jobs j JOIN p b ON b.name = j.phase JOIN p a ON b.n <> a.n AND b.n < 6 AND (a.n >= 6 OR a.n = 5 OR b.n = 5 OR b.n < a.n) GROUP BY 1, 2""")
def sc_phase_rules(jobs):
    allowed = E.transition_table(jobs.sparkSession).where("allowed").select("before", "after")
    return jobs.join(F.broadcast(allowed), jobs["phase"] == allowed["before"]).groupBy("before", "after").agg(F.count("*").alias("n"))  # 81 rows are broadcast


BUCKETS = """c AS (SELECT job_id, class, min(seq) AS f FROM event_log WHERE kind = 'ErrorEmitted' GROUP BY job_id, class), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY f) AS place FROM c),
  e AS (SELECT e.job_id, CASE WHEN place <= 64 THEN e.class ELSE '(overflow)' END AS class, e.seq, e.retryable FROM event_log e JOIN r ON e.job_id = r.job_id AND e.class = r.class WHERE kind = 'ErrorEmitted')"""


@query("agg_error_buckets", "event_log", sql=f"{BUCKETS} SELECT job_id, class, count(*) AS count, min(seq) AS first_seq, max(seq) AS last_seq, arg_max(retryable, seq) AS retryable FROM e GROUP BY job_id, class")
def agg_error_buckets(events):
    return E.error_buckets(events)


# One error of every bucket at a time.
@query("agg_error_samples", "event_log", sql=f"""RECURSIVE {BUCKETS.replace('e.seq, e.retryable', 'e.seq, e.path')}, v AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY job_id, class ORDER BY seq) AS rn FROM e),
  f AS (SELECT DISTINCT job_id, class, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS paths FROM v UNION ALL SELECT f.job_id, f.class, v.rn, CASE WHEN list_contains(f.paths, v.path) THEN f.paths ELSE list_append(f.paths, v.path)[-10:] END FROM f JOIN v ON v.job_id = f.job_id AND v.class = f.class AND v.rn = f.rn + 1)
  SELECT job_id, class, arg_max(paths, rn) AS paths FROM f GROUP BY job_id, class""")
def agg_error_samples(events):
    return E.error_samples(events)


def _rate(seconds: int) -> None:
    @query(f"win_rate_delta_{seconds}", "event_log", sql=f"SELECT worker_id, round(coalesce(sum(files_delta) FILTER (event_at >= TIMESTAMP '{NOW}' - INTERVAL {seconds} SECOND), 0) / {seconds}, 9) AS files_s, round(coalesce(sum(bytes_delta) FILTER (event_at >= TIMESTAMP '{NOW}' - INTERVAL {seconds} SECOND), 0) / {seconds}, 6) AS bytes_s FROM event_log WHERE kind = 'ProgressDelta' GROUP BY worker_id")
    def win_rate_delta(events):
        return E.rates(events, "worker_id", NOW, seconds).withColumns({"files_s": F.round("files_s", 9), "bytes_s": F.round("bytes_s", 6)})


for _seconds in (1, 60, 300, 86400):
    _rate(_seconds)


@query("win_rate_rolling", "event_log", sql="d AS (SELECT job_id, seq, files_delta, CAST(floor(epoch(event_at)) AS BIGINT) AS t FROM event_log WHERE kind = 'ProgressDelta') SELECT job_id, seq, round(sum(files_delta) OVER (PARTITION BY job_id ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) / 3600, 9) AS files_s FROM d")
def win_rate_rolling(events):
    return E.rolling_rates(events, "job_id", 3600).withColumn("files_s", F.round("files_s", 9))


@query("win_rate_absolute", "event_log", sql=f"""w AS (SELECT *, CAST(floor(epoch(event_at)) AS BIGINT) AS t FROM event_log WHERE event_at >= TIMESTAMP '{NOW}' - INTERVAL 86400 SECOND AND sync_files IS NOT NULL),
  p AS (SELECT job_id, arg_min(sync_files, (event_at, seq)) AS first, arg_max(sync_files, (event_at, seq)) AS last, max(t) - min(t) AS spent FROM w GROUP BY job_id) SELECT job_id, round(CASE WHEN spent > 0 THEN (last - first) / spent END, 9) AS rate FROM p""")
def win_rate_absolute(events):
    return E.rates_absolute(events, "job_id", "sync_files", NOW, 86400).withColumn("rate", F.round("rate", 9))


@query("win_recent", "event_log", sql="r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS n FROM event_log WHERE kind = 'ErrorEmitted') SELECT job_id, seq, class, CAST(row_number() OVER (PARTITION BY job_id ORDER BY seq) AS INTEGER) AS place FROM r WHERE n <= 50")
def win_recent(events):
    return E.recent(events.where("kind = 'ErrorEmitted'"), "job_id", 50).select("job_id", "seq", "class", "place")


@query("win_recent_problems", "event_log", sql="""b AS (SELECT 'errors' AS list, job_id, seq, class AS detail FROM event_log WHERE kind = 'ErrorEmitted' UNION ALL SELECT 'mismatches', job_id, seq, worker_id FROM event_log WHERE kind = 'ClaimConflictResolved'),
  r AS (SELECT *, row_number() OVER (PARTITION BY list, job_id ORDER BY seq DESC) AS n FROM b) SELECT list, job_id, seq, detail, CAST(row_number() OVER (PARTITION BY list, job_id ORDER BY seq) AS INTEGER) AS place FROM r WHERE n <= 50""")
def win_recent_problems(events):
    return E.recent_problems(events.where("kind = 'ErrorEmitted'"), events.where("kind = 'ClaimConflictResolved'").withColumn("detail", F.col("worker_id")), 50)


@query("win_freshness", "event_log", sql="w AS (SELECT worker_id, min(event_at) + INTERVAL 10 DAY AS b FROM event_log GROUP BY worker_id), l AS (SELECT worker_id, max(event_at) AS l FROM event_log WHERE kind <> 'WorkerJoined' GROUP BY worker_id) SELECT w.worker_id, CAST(floor(epoch(greatest(b, l))) AS BIGINT) AS fresh_at FROM w LEFT JOIN l ON w.worker_id = l.worker_id")
def win_freshness(events):
    workers = events.groupBy("worker_id").agg((F.min("event_at") + F.expr("INTERVAL 10 DAYS")).alias("heartbeat_at"))
    fresh = E.freshness(workers, events.where("kind <> 'WorkerJoined'"))
    return fresh.select("worker_id", F.unix_seconds(F.col("fresh_at").cast("timestamp")).alias("fresh_at"))


@query("set_catchup", "event_log", sql="SELECT seq, kind FROM event_log WHERE seq > 5000 AND job_id = 'job-2'")
def set_catchup(events):
    return E.events_since(events.where("seq <= 8000"), events.where("seq > 7000"), 5000, "job-2").select("seq", "kind")


CHUNKS = "c AS (SELECT job_id AS route, CAST(floor(seq / 500) AS BIGINT) AS chunk, min(seq) AS start_seq, count(*) AS n FROM event_log GROUP BY 1, 2)"


@query("src_chunk_skip", "event_log", sql=f"{CHUNKS}, l AS (SELECT *, lead(start_seq) OVER (PARTITION BY route ORDER BY start_seq) AS nxt FROM c) SELECT route, start_seq, n FROM l WHERE nxt IS NULL OR nxt > 7777")
def src_chunk_skip(events):
    chunks = events.groupBy(F.col("job_id").alias("route"), F.floor(F.col("seq") / 500).alias("chunk")).agg(F.min("seq").alias("start_seq"), F.count("*").alias("n"))
    return E.prune_chunks(chunks, 7777).select("route", "start_seq", "n")


@query("st_gaps", "event_log", sql="n AS (SELECT job_id, seq, lead(seq) OVER (PARTITION BY job_id ORDER BY seq) AS nxt FROM (SELECT DISTINCT job_id, seq FROM event_log) t) SELECT job_id, seq + 1 AS first_missing, nxt - 1 AS last_missing FROM n WHERE nxt > seq + 1")
def st_gaps(events):
    return E.gaps(events.unionByName(events.where("seq % 9 = 0")), "job_id")


@query("st_unknown_kinds", "event_log", sql="SELECT concat('New', kind) AS kind, count(*) AS n FROM event_log WHERE seq % 50 = 0 GROUP BY 1")
def st_unknown_kinds(events):
    return E.unknown_kinds(events.withColumn("kind", F.when(F.col("seq") % 50 == 0, F.concat(F.lit("New"), "kind")).otherwise(F.col("kind"))))


# A window starts at the first error that is five seconds or more after the start of the one before.
WINDOWS = """RECURSIVE t AS MATERIALIZED (SELECT job_id, class, seq, epoch_ms(event_at) AS at_ms FROM error_log),
  w AS (SELECT job_id, min(at_ms) AS s FROM t GROUP BY job_id UNION ALL SELECT w.job_id, min(t.at_ms) FROM w JOIN t ON t.job_id = w.job_id AND t.at_ms >= w.s + 5000 GROUP BY w.job_id),
  r AS (SELECT t.job_id, t.class, t.seq, row_number() OVER (PARTITION BY t.job_id, t.class, (SELECT max(s) FROM w WHERE w.job_id = t.job_id AND w.s <= t.at_ms) ORDER BY t.seq) AS n FROM t)
  SELECT job_id, class, seq FROM r WHERE n <= 2"""


@query("st_error_cap", "error_log", sql=WINDOWS)
def st_error_cap(events):
    return E.cap_errors(events, 2, 5).select("job_id", "class", "seq")


@query("st_sync", "event_log", sql="p AS (SELECT job_id, CAST(floor(epoch(event_at) / 3600) AS BIGINT) * 3600 AS at_s, sum(files_delta) AS d FROM event_log WHERE kind = 'ProgressDelta' GROUP BY 1, 2) SELECT job_id, at_s AS at, CAST(sum(d) OVER (PARTITION BY job_id ORDER BY at_s) AS BIGINT) AS files FROM p WHERE d <> 0")
def st_sync(events):
    return E.syncs(events, 3600)


@query("st_liveness", "event_log", sql=f"l AS (SELECT worker_id, date_diff('second', date_trunc('second', max(event_at)), TIMESTAMP '{NOW}') AS silent_seconds FROM event_log WHERE event_at <= TIMESTAMP '{NOW}' GROUP BY worker_id) SELECT worker_id, silent_seconds FROM l WHERE silent_seconds > 90")
def st_liveness(events):
    return E.silent_workers(events.where(F.col("event_at") <= F.lit(NOW).cast("timestamp")), NOW)


@query("st_evict", "worker_events", sql="s AS (SELECT worker_id, arg_max(kind, seq) AS k, max(event_at) AS l FROM worker_events GROUP BY worker_id) SELECT worker_id FROM s WHERE k = 'WorkerLeft' AND date_diff('second', date_trunc('second', l), TIMESTAMP '2024-01-31 00:00:00') > 86399")
def st_evict(events):
    states = events.groupBy("worker_id").agg(F.when(F.max_by("kind", "seq") == "WorkerLeft", "Disconnected").otherwise("Idle").alias("state"))
    return E.evictable(states, events, "2024-01-31 00:00:00")


@query("st_rates", "event_log", sql="s AS (SELECT job_id, files_delta, CAST(floor(epoch(event_at) / 60) AS BIGINT) * 60 AS m FROM event_log WHERE kind = 'ProgressDelta'), w AS (SELECT job_id, m - 60 * k AS start, files_delta FROM s, range(0, 5) t(k)) SELECT job_id, start, CAST(sum(files_delta) AS BIGINT) AS files FROM w GROUP BY job_id, start")
def st_rates(events):
    windows = events.where("kind = 'ProgressDelta'").groupBy("job_id", F.window("event_at", "5 minutes", "1 minute").alias("w")).agg(F.sum("files_delta").alias("files"))
    return windows.select("job_id", F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start"), "files")


@query("sc_error_class", "event_log", sql="SELECT CASE WHEN seq % 2 = 0 THEN concat('Other(', class, ')') ELSE class END AS label, count(*) AS n FROM event_log WHERE class IS NOT NULL GROUP BY 1")
def sc_error_class(events):
    label = E.class_label(F.when(F.col("seq") % 2 == 0, "Other").otherwise(F.col("class")), F.when(F.col("seq") % 2 == 0, F.col("class")))
    return events.where("class is not null").groupBy(label.alias("label")).agg(F.count("*").alias("n"))
