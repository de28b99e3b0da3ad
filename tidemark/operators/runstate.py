"""What a run's manifest, claims, heartbeats, sinks and shard outcomes say about its state and health."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.reconcile import sort_raw_path

TERMINAL = ("completed", "failed")
EXITED = ("exiting", "exited", "finished")
LEASE_SECONDS = 900
MANIFEST_DIGITS = 4  # hex digits that tell the blocks of a manifest's digest apart


def age_seconds(at: Column, now: str) -> Column:
    return F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))


def build_manifest(shards: DataFrame, run_id: str) -> DataFrame:
    """One row: run_id, totals and a digest of the entries (key, rows, bytes, etag): the hex sha256 of their blocks' hashes in order.

    A block is the entries whose key's hash starts with the same bits, in order of the key, so no task holds all of them; the order in which
    shards were listed is of no matter, and every entry is, also one that is there twice.
    """
    text = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    entry = F.sha2(F.concat(*map(text, ("shard", "n_rows", "n_bytes", "etag"))), 256)
    named = shards.select("n_rows", "n_bytes", entry.alias("_entry"), F.substring(F.sha2(F.coalesce("shard", F.lit("")), 256), 1, MANIFEST_DIGITS).alias("_block"))
    blocks = named.groupBy("_block").agg(F.count("*").alias("n"), F.sum("n_rows").alias("rows"), F.sum("n_bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("_entry")), ""), 256).alias("hash"))
    top = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "hash"))), lambda b: b["hash"]), ""), 256)
    return blocks.agg(F.lit(run_id).alias("run_id"), F.coalesce(F.sum("n"), F.lit(0)).alias("shards"), F.sum("rows").alias("total_rows"), F.sum("bytes").alias("total_bytes"), top.alias("digest"))


def manifest_entries(shards: DataFrame) -> DataFrame:
    """place (from 1), key, rows, bytes, etag: the entries of a manifest in order of their key, by a range-partitioned sort."""
    entries = sort_raw_path(shards.select(F.col("shard").alias("path"), F.col("n_rows").alias("rows"), F.col("n_bytes").alias("bytes"), "etag"))
    return entries.select("place", F.col("path").alias("key"), "rows", "bytes", "etag")


def shard_status(shards: DataFrame, claims: DataFrame) -> DataFrame:
    """shard, n_rows, state: that of its claim, unclaimed without one. Claims of other shards are ignored."""
    return shards.join(claims.select("shard", "state", "host", "epoch"), "shard", "left").withColumn("state", F.coalesce("state", F.lit("unclaimed")))


def active_rows(shards: DataFrame, claims: DataFrame, progress: DataFrame) -> DataFrame:
    """shard, rows_done of active shards: what their worker reports, at most the shard's rows, the most if several report."""
    status = shard_status(shards, claims).where("state = 'active'")
    reported = progress.select(F.col("current_shard").alias("shard"), "shard_rows_done")
    return status.join(reported, "shard").groupBy("shard").agg(F.max(F.least("shard_rows_done", "n_rows")).alias("rows_done"))


def worker_lines(progress: DataFrame, now: str) -> DataFrame:
    """host, age_seconds, stale, exited: live workers first. Stale is null without a heartbeat interval, and false once exited."""
    exited = F.col("status").isin(*EXITED)
    age = F.greatest(age_seconds(F.col("heartbeat_utc"), now), F.lit(0))
    stale = F.when(exited, False).when(F.col("heartbeat_sec") > 0, age > 2 * F.col("heartbeat_sec"))
    return progress.select("host", age.alias("age_seconds"), stale.alias("stale"), exited.alias("exited"), "files_ok", "files_failed").orderBy("exited", "host")


def run_status(shards: DataFrame, claims: DataFrame, progress: DataFrame, now: str) -> DataFrame:
    """One row of counts, percent, throughput, rate and time left (null when a shard failed, or nothing moves)."""
    per = lambda s: F.count_if(F.col("state") == s)
    rows = lambda s: F.coalesce(F.sum(F.when(F.col("state") == s, F.col("n_rows"))), F.lit(0))
    totals = shard_status(shards, claims).agg(F.count("*").alias("total_shards"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows"), per("completed").alias("completed"), per("failed").alias("failed"), per("active").alias("active"), per("unclaimed").alias("unclaimed"), rows("completed").alias("rows_completed"))
    partial = active_rows(shards, claims, progress).agg(F.coalesce(F.sum("rows_done"), F.lit(0)).alias("rows_active"))
    live = ~F.col("status").isin(*EXITED)
    elapsed = age_seconds(F.col("started_utc"), now)
    workers = progress.agg(F.coalesce(F.sum(F.when(live, F.col("throughput_mb_s"))), F.lit(0)).alias("throughput_mb_s"), F.sum(F.when(elapsed > 0, F.col("files_ok") / elapsed)).alias("rate"), F.coalesce(F.sum("files_failed"), F.lit(0)).alias("files_failed"))
    one = totals.crossJoin(F.broadcast(partial)).crossJoin(F.broadcast(workers))  # one row each
    one = one.withColumn("rows_done", F.col("rows_completed") + F.col("rows_active"))
    percent = F.when(F.col("total_rows") == 0, 100.0).otherwise(100.0 * F.least("rows_done", "total_rows") / F.col("total_rows"))
    eta = F.when((F.col("rate") > 0) & (F.col("rows_done") < F.col("total_rows")) & (F.col("failed") == 0), F.ceil((F.col("total_rows") - F.col("rows_done")) / F.col("rate")))
    terminal = F.col("completed") + F.col("failed") == F.col("total_shards")
    return one.select("total_shards", "total_rows", "completed", "failed", "active", "unclaimed", "rows_completed", "rows_active", "rows_done", percent.alias("percent"), "throughput_mb_s", F.col("rate").alias("rows_per_second"), eta.alias("eta_seconds"), terminal.alias("terminal"), "files_failed")


def tally(shards: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: shards by state, rows and bytes of completed ones, whether all are terminal. A shard's first claim counts."""
    first = claims.groupBy("shard").agg(F.min_by("state", F.struct("claimed_utc", "claim_etag")).alias("state"))
    j = shards.join(first, "shard", "left")
    done = F.col("state") == "completed"
    return j.agg(F.count_if(done).alias("completed"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "active").alias("active"),
                 F.coalesce(F.sum(F.when(done, F.col("n_rows"))), F.lit(0)).alias("rows_completed"), F.coalesce(F.sum(F.when(done, F.col("n_bytes"))), F.lit(0)).alias("bytes_completed"),
                 F.every(F.coalesce(F.col("state").isin(*TERMINAL), F.lit(False))).alias("all_terminal"))


def reclaimable(claims: DataFrame, progress: DataFrame, now: str, scanner_heartbeat_sec: int) -> DataFrame:
    """shard, host, reason, reclaimable of active claims, judged by their owner's heartbeat.

    Until twice the heartbeat interval after a claim nothing is taken from an owner that has not reported it
    yet; an owner that reports it keeps it while its heartbeat is that fresh; without an interval nothing is said.
    """
    j = claims.where("state = 'active'").join(progress.select("host", "heartbeat_utc", "held_etag", "heartbeat_sec"), "host", "left")
    claim_age, beat_age = age_seconds(F.col("claimed_utc"), now), age_seconds(F.col("heartbeat_utc"), now)
    limit = 2 * F.col("heartbeat_sec")
    reason = (
        F.when(F.col("heartbeat_sec").isNull(), F.when(F.lit(scanner_heartbeat_sec > 0) & (claim_age > 2 * scanner_heartbeat_sec), "never_reported").otherwise("grace"))
        .when(F.col("heartbeat_sec") == 0, "uncalibrated")
        .when(~F.col("held_etag").eqNullSafe(F.col("claim_etag")), F.when(claim_age > limit, "not_held").otherwise("grace"))
        .when(beat_age > limit, "dead")
        .otherwise("alive")
    )
    return j.select("shard", "host", reason.alias("reason")).withColumn("reclaimable", F.col("reason").isin("never_reported", "not_held", "dead"))


def latest_progress(history: DataFrame) -> DataFrame:
    """The latest heartbeat of each host (ties to the higher files_ok)."""
    return history.groupBy("host").agg(F.max_by(F.struct("heartbeat_utc", "files_ok", "held_etag"), F.struct("heartbeat_utc", "files_ok")).alias("p")).select("host", "p.*")


def attempts(sinks: DataFrame) -> DataFrame:
    """shard, host, last_epoch, attempts, last_rows: which attempts wrote to a sink, and the rows of the latest."""
    per = sinks.groupBy("shard", "host", "epoch").agg(F.count("*").alias("n"))
    return per.groupBy("shard", "host").agg(F.max("epoch").alias("last_epoch"), F.count("*").alias("attempts"), F.max_by("n", "epoch").alias("last_rows"))


def sink_summary(sinks: DataFrame) -> DataFrame:
    """Rows of each sink and kind, by host and shard, by host, and in all (nulls)."""
    kind = F.when(F.col("sink") == "failure", F.col("phase")).otherwise(F.col("downgrade"))
    return sinks.withColumn("kind", kind).rollup("sink", "kind", "host").agg(F.count("*").alias("n"))


def run_gate(status: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: the problems that keep a run from being final."""
    one = status.crossJoin(F.broadcast(failures.agg(F.count("*").alias("failure_rows"))))
    problems = F.array_compact(F.array(
        F.when(~F.col("terminal"), "not_terminal"), F.when(F.col("failed") > 0, "failed_shards"), F.when(F.col("completed") != F.col("total_shards"), "incomplete"),
        F.when(F.col("files_failed") > 0, "failed_files"), F.when(F.col("failure_rows") > 0, "failure_rows"),
    ))
    return one.select(F.array_join(problems, ",").alias("problems"), (F.size(problems) == 0).alias("passed"))


def live_claims(claims: DataFrame, now: str, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """Active claims whose lease has not run out (a claim from the future is live)."""
    return claims.where((F.col("state") == "active") & ~(age_seconds(F.col("claimed_utc"), now) > lease_seconds))


def partial_report(entries: DataFrame, claims: DataFrame, now: str, forced: bool = False) -> DataFrame:
    """One row: partial files and their bytes, live claims, and whether these block a sweep."""
    from tidemark.functions.paths import basename, is_partial_name

    found = entries.where((F.col("file_type") == 1) & is_partial_name(basename(F.col("path")))).agg(F.count("*").alias("partials"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    live = live_claims(claims, now).agg(F.count("*").alias("live_claims"))
    return found.crossJoin(F.broadcast(live)).withColumn("blocked", (F.col("live_claims") > 0) & ~F.lit(forced))


def pending_shards(inputs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """shard, state of every input or checkpoint: done, pending (no valid checkpoint), or stale (a checkpoint of no input)."""
    j = inputs.select("shard", "n_bytes", "etag").join(checkpoints.select("shard", F.col("n_bytes").alias("_bytes"), F.col("etag").alias("_etag")), "shard", "full_outer")
    state = F.when(F.col("n_bytes").isNull(), "stale").when((F.col("n_bytes") == F.col("_bytes")) & (F.col("etag") == F.col("_etag")), "done").otherwise("pending")
    return j.select("shard", state.alias("state"))


def unpublished(plan: DataFrame, listing: DataFrame) -> DataFrame:
    """shard, problem of planned shards that the store lacks or holds with another size or digest."""
    j = plan.join(listing.select("shard", F.col("n_bytes").alias("_bytes"), F.col("etag").alias("_etag")), "shard", "left")
    problem = F.when(F.col("_bytes").isNull(), "missing").when(F.col("_bytes") != F.col("n_bytes"), "size").when(~F.col("_etag").eqNullSafe(F.col("etag")), "digest")
    return j.select("shard", problem.alias("problem")).where("problem is not null")


def shard_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """shard, only_in: shards that one list has and the other has not."""
    both = a.select("shard", F.lit(1).alias("bit")).union(b.select("shard", F.lit(2).alias("bit")))
    return both.groupBy("shard").agg(F.bit_or("bit").alias("bits")).where("bits < 3").select("shard", F.when(F.col("bits") == 1, "left").otherwise("right").alias("only_in"))


def machine_name(host: Column, pid: Column) -> Column:
    """The host without its own process id at the end."""
    suffix = F.concat(F.lit("-"), pid.cast("string"))
    return F.when(F.endswith(host, suffix), F.substring(host, F.lit(1), F.length(host) - F.length(suffix))).otherwise(host)


def superseded(registrations: DataFrame) -> DataFrame:
    """worker_id, machine, by: live workers that a later registration of their job and machine, of another process or start, replaced.

    By the first such one: registrations of one process in a row are a run, and all of them go when the next run begins.
    A worker that left before (`left_seq`, where the table has it) is not replaced.
    """
    w = Window.partitionBy("job_id", "machine").orderBy("seq")
    named = registrations.withColumn("machine", machine_name(F.col("host"), F.col("pid")))
    process = F.struct("pid", "start_time")
    starts = named.withColumn("_starts", F.coalesce(~process.eqNullSafe(F.lag(process).over(w)), F.lit(True)))
    # Of the next run its first row: the first start of a run after this row. Rows go backwards, as a frame to the end is read anew for every row.
    head = F.when(F.col("_starts"), F.struct("seq", "worker_id"))
    later = Window.partitionBy("job_id", "machine").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    found = starts.withColumn("_next", F.last(head, ignorenulls=True).over(later)).where("_next is not null")
    if "left_seq" in registrations.columns:
        found = found.where("left_seq is null or left_seq > _next.seq")
    return found.select("worker_id", "machine", F.col("_next.worker_id").alias("by"))


def workers_of(registrations: DataFrame, gone: DataFrame) -> DataFrame:
    """job_id, worker_id, place: the workers of a job in the order of joining, without the disconnected."""
    here = registrations.join(gone.select("worker_id").distinct(), "worker_id", "left_anti")
    return here.select("job_id", "worker_id", F.row_number().over(Window.partitionBy("job_id").orderBy("seq")).alias("place"))


PHASE_ORDER = ("Planned", "Scanning", "Copying", "Verifying", "Cutover", "Paused", "Completed", "Failed", "Cancelled")


def list_jobs(jobs: DataFrame, text: str, sort: str, limit: int) -> DataFrame:
    """Jobs whose id or name holds the text, in any case; sorted by id, phase, progress or errors, then id."""
    hit = F.contains(F.lower("job_id"), F.lit(text.lower())) | F.contains(F.lower("name"), F.lit(text.lower()))
    phase = F.array_position(F.array(*map(F.lit, PHASE_ORDER)), F.col("phase"))
    progress = F.col("files_done") / F.greatest("files_total", F.lit(1))
    keys = {"id": F.col("job_id"), "phase": phase, "progress": progress.desc(), "errors": F.col("errors").desc()}
    return jobs.where(hit).orderBy(keys[sort], "job_id").limit(limit)


def list_workers(workers: DataFrame, sort: str, limit: int) -> DataFrame:
    key = F.col("host") if sort == "host" else F.col(sort).desc()
    return workers.orderBy(key, "host").limit(limit)


def job_counts(jobs: DataFrame) -> DataFrame:
    ended = F.col("phase").isin("Completed", "Failed", "Cancelled")
    return jobs.agg(F.count_if(~ended & (F.col("phase") != "Paused")).alias("running"), F.count_if(F.col("phase") == "Paused").alias("paused"), F.count_if(ended).alias("ended"), F.sum("files_done").alias("files_done"), F.sum("errors").alias("errors"))


def run_summary(jobs: DataFrame, now: str) -> DataFrame:
    """job_id, seconds, average files a second, replayed rows and their percent, and seconds left of a running job."""
    start, end = F.unix_seconds(F.col("copy_start").cast("timestamp")), F.unix_seconds(F.col("finished").cast("timestamp"))
    over = F.col("finished").isNotNull()
    seconds = F.greatest(F.when(over, end).otherwise(F.unix_seconds(F.lit(now).cast("timestamp"))) - start, F.lit(1))
    useful = F.when(over & (F.col("files_total") > 0), F.col("files_total")).otherwise(F.col("files_done"))
    replayed = F.when(over & (F.col("files_total") > 0), F.greatest(F.col("files_done") - F.col("files_total"), F.lit(0)))
    eta = F.when(~over & (F.col("files_total") > 0) & (F.col("average") > 0), F.floor(F.greatest(F.col("files_total") - F.col("files_done"), F.lit(0)) / F.col("average")))
    timed = jobs.where("copy_start is not null").withColumn("seconds", seconds).withColumn("average", useful / F.col("seconds"))
    return timed.select("job_id", "seconds", "average", replayed.alias("replayed"), (replayed * 100.0 / F.col("files_total")).alias("replayed_percent"), eta.alias("eta_seconds"))


def shard_outcomes(rows: DataFrame) -> DataFrame:
    """Per shard and host: files ok, failed and fenced (no failure), torn ones among the ok, and bytes of the ok."""
    ok = F.col("outcome") == "ok"
    return rows.groupBy("shard_no", "host").agg(F.count_if(ok).alias("ok"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "fenced").alias("fenced"), F.count_if(ok & F.col("torn")).alias("torn"), F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("bytes"))


def failure_pct(ok: Column, failed: Column) -> Column:
    return F.when(ok + failed > 0, failed / (ok + failed) * 100).otherwise(0.0)


def shard_health(outcomes: DataFrame, max_failure_pct: float, floor_mb_s: int, mb_s: Column) -> DataFrame:
    """outcomes with failure_pct and why the shard counts as degraded, if it does; no throughput yet is not low throughput."""
    pct = failure_pct(F.col("ok"), F.col("failed"))
    reason = F.when(pct > max_failure_pct, "failure_rate_high").when((mb_s > 0) & (F.floor(mb_s) < floor_mb_s), "throughput_low")
    return outcomes.withColumn("failure_pct", pct).withColumn("degraded", reason)


def backpressure(history: DataFrame, cooldown: int = 300, longest: int = 1800) -> DataFrame:
    """host, at, state, cooldown_seconds, episode: health episodes in each worker's shard outcomes, in order of time.

    history: host, at (seconds), seq and degraded (a reason or null). A bad outcome opens an episode with a
    cooldown. The first outcome after the cooldown is a probe: a bad one doubles the cooldown, up to the
    longest; a bad straggler before that only starts it again. A good outcome ends the episode. Every host's
    history is folded by itself, in batches of a task, with what it carries from row to row.
    """

    def fold(pdfs):
        carried: tuple | None = None  # host, wait, until, episode
        for pdf in pdfs:
            rows = []
            for host, at, reason in zip(pdf["host"], pdf["at"], pdf["degraded"]):
                _, wait, until, episode = carried if carried and carried[0] == host else (host, cooldown, None, 0)
                if reason is None:
                    state, wait, until = ("recovered" if until is not None else "healthy"), cooldown, None
                elif until is None:
                    state, wait, until, episode = "tripped", cooldown, at + cooldown, episode + 1
                elif at >= until:
                    wait = min(2 * wait, longest)
                    state, until = "probe_failed", at + wait
                else:
                    state, until = "straggler", at + wait
                carried = (host, wait, until, episode)
                rows.append((host, at, state, wait if until is not None else 0, episode))
            yield pd.DataFrame(rows, columns=["host", "at", "state", "cooldown_seconds", "episode"])

    dealt = history.select("host", "at", "seq", "degraded").repartition("host").sortWithinPartitions("host", "at", "seq")
    return dealt.mapInPandas(fold, "host string, at long, state string, cooldown_seconds long, episode long")


def throughput(samples: DataFrame, seconds: int = 60) -> DataFrame:
    """host, at, mib_s over the last `seconds` from cumulative bytes; 0 with fewer than two samples or no time between them.

    samples: host, at (seconds), bytes (cumulative).
    """
    w = Window.partitionBy("host").orderBy("at").rangeBetween(-seconds, 0)
    first, last = F.min_by("bytes", F.struct("at", "bytes")).over(w), F.max_by("bytes", F.struct("at", "bytes")).over(w)
    spent = F.max("at").over(w) - F.min("at").over(w)
    rate = F.when(spent > 0, F.greatest(last - first, F.lit(0)) / spent / 1048576).otherwise(0.0)
    return samples.select("host", "at", "bytes", rate.alias("mib_s"))
