"""Folds of an append-only event log, as windows and aggregates where order allows, as ordered folds where not.

An event has seq (ascending, one writer), event_at, job_id, worker_id, kind and the kind's own columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import carried, entering, slice_of, with_carried
from tidemark.scratch import materialise

PIPELINE = ("Planned", "Scanning", "Copying", "Verifying", "Cutover")
ENDED = ("Completed", "Failed", "Cancelled")
KINDS = ("JobCreated", "JobPhaseChanged", "JobPaused", "JobResumed", "JobCancelled", "JobCompleted", "JobFailed", "WorkerJoined", "WorkerLeft", "WorkerStateChanged", "WorkerFenced", "WorkerRecovered", "ProgressSync", "ProgressDelta", "ErrorEmitted", "VerifyStarted", "VerifyCompleted", "VerifyFileMismatch", "ShardClaimed", "ShardCompleted", "ClaimConflictResolved")
CLASSES, SAMPLES, HISTORY = 64, 10, 256
OVERFLOW = "(overflow)"


def transition_allowed(before: str, after: str) -> bool:
    """Forward through the pipeline; to and from a pause; to an end from anywhere that is not one."""
    if before == after or before in ENDED:
        return False
    if after in ENDED:
        return True
    if "Paused" in (before, after):
        return True
    return PIPELINE.index(before) < PIPELINE.index(after)


def transition_table(spark) -> DataFrame:
    """before, after, allowed, and the control mode of workers in the phase `after`: all pairs of phases."""
    phases = (*PIPELINE, "Paused", *ENDED)
    rows = [(a, b, transition_allowed(a, b), "pause" if b == "Paused" else "cancel" if b in ENDED else "run") for a in phases for b in phases]
    return spark.createDataFrame(rows, "before string, after string, allowed boolean, control string")


def dedup_client(events: DataFrame) -> DataFrame:
    """Without stamped events whose client_seq does not exceed all earlier ones of their worker; unstamped ones stay.

    A worker's events are read in slices of seq, with the highest stamp of all slices before.
    """
    rows = events.withColumn("_slice", slice_of("seq"))
    per = rows.groupBy("worker_id", "_slice").agg(F.max("client_seq").alias("_stamp"))
    earlier = Window.partitionBy("worker_id", "_slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_high", F.max("client_seq").over(earlier))
    high = F.greatest("_high", "_before__stamp")
    both = with_carried(inside, carried(per, ["worker_id"], {"_stamp": "max"}), ["worker_id"])
    return both.where(F.col("client_seq").isNull() | high.isNull() | (F.col("client_seq") > high)).select(*events.columns)


def validate_batches(events: DataFrame, forbidden: tuple[str, ...]) -> DataFrame:
    """batch, accepted, problem: a batch whose stamps do not ascend, that names a foreign worker or has a forbidden kind is refused whole.

    events: with batch and sender.
    """
    stamped = Window.partitionBy("batch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    falls = F.col("client_seq") <= F.last("client_seq", ignorenulls=True).over(stamped)
    marked = events.withColumn("_falls", F.coalesce(falls, F.lit(False)))
    per = marked.groupBy("batch").agg(F.bool_or(F.col("worker_id") != F.col("sender")).alias("foreign"), F.bool_or(F.col("kind").isin(*forbidden)).alias("forbidden"), F.bool_or("_falls").alias("falls"))
    problem = F.when(F.col("foreign"), "foreign_worker").when(F.col("forbidden"), "forbidden_kind").when(F.col("falls"), "not_monotonic")
    return per.select("batch", problem.isNull().alias("accepted"), problem.alias("problem"))


def progress(events: DataFrame, key: str, delta: str, sync: str, reset: str | None = None) -> DataFrame:
    """key, total: deltas added up, raised to every absolute value that is higher when it comes.

    With S the sum of deltas so far, the result is S at the end + max(0, max over syncs of (value - S then)). After
    an event of the kind `reset` the key starts anew.
    """
    rows = events
    if reset:
        last = events.where(F.col("kind") == reset).groupBy(key).agg(F.max("seq").alias("_from"))
        rows = events.join(last, key, "left").where(F.col("_from").isNull() | (F.col("seq") > F.col("_from")))
    # Sums by slices of seq first, so that a key with a third of all events is summed in many tasks.
    slices = rows.where(F.col(delta).isNotNull() | F.col(sync).isNotNull()).withColumn("_slice", slice_of("seq"))
    in_slice = Window.partitionBy(key, "_slice").orderBy("seq")
    run = slices.withColumn("_s", F.sum(F.coalesce(F.col(delta), F.lit(0))).over(in_slice))
    per_slice = run.groupBy(key, "_slice").agg(F.sum(F.coalesce(F.col(delta), F.lit(0))).alias("_sum"), F.max(F.col(sync) - F.col("_s")).alias("_lift"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lifted = per_slice.withColumn("_lift", F.col("_lift") - before)
    return lifted.groupBy(key).agg((F.sum("_sum") + F.greatest(F.lit(0), F.coalesce(F.max("_lift"), F.lit(0)))).alias("total"))


def worker_states(events: DataFrame) -> DataFrame:
    """worker_id, state, fence_reason, last_error after the latest join; a recovery clears the fence's reason."""
    joins = events.where("kind = 'WorkerJoined'").groupBy("worker_id").agg(F.max("seq").alias("_from"))
    live = events.join(joins, "worker_id").where(F.col("seq") >= F.col("_from"))
    kind = F.col("kind")
    state = F.when(kind.isin("WorkerJoined", "WorkerRecovered"), "Idle").when(kind == "WorkerLeft", "Disconnected").when(kind == "WorkerFenced", "Fenced").when(kind == "WorkerStateChanged", F.col("to_state"))
    fence = F.when(kind == "WorkerFenced", F.col("reason"))
    fence_seq = F.when(kind.isin("WorkerFenced", "WorkerRecovered"), F.col("seq"))
    left_seq = F.when(kind == "WorkerLeft", F.col("seq"))
    # max_by skips rows whose order is null: only fences and recoveries decide the fence reason.
    return live.groupBy("worker_id").agg(F.max_by(state, F.when(state.isNotNull(), F.col("seq"))).alias("state"), F.max_by(fence, fence_seq).alias("fence_reason"), F.max_by(F.col("reason"), left_seq).alias("last_error"))


def error_buckets(events: DataFrame, classes: int = CLASSES) -> DataFrame:
    """job_id, class, count, first_seq, last_seq, retryable: the first classes of a job keep their name, later ones share one bucket."""
    errors = events.where("kind = 'ErrorEmitted'")
    per = errors.groupBy("job_id", "class").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("retryable", "seq").alias("retryable"))
    # One row a class from here: few next to the events.
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("first_seq"))
    named = per.withColumn("class", F.when(place <= classes, F.col("class")).otherwise(OVERFLOW))
    return named.groupBy("job_id", "class").agg(F.sum("n").alias("count"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.max_by("retryable", "last_seq").alias("retryable"))


def error_samples(events: DataFrame, keep: int = SAMPLES, classes: int = CLASSES) -> DataFrame:
    """job_id, class, paths: an error's path joins its bucket's list unless it is in it, and the oldest leaves when there are too many.

    A path that left may come back, and one that comes again does not move up, so what a stretch of errors leaves depends on every
    path of the list before it: there is nothing to merge, and this is a fold in order of seq. Each task streams its buckets'
    errors and holds one list; errors that repeat the path before them in a slice of seq are left out first.
    """
    buckets = error_buckets(events, classes).select("job_id", "class")
    errors = events.where("kind = 'ErrorEmitted'").select("job_id", "class", "path", "seq").join(buckets.select("job_id", "class", F.lit(True).alias("_own")), ["job_id", "class"], "left")
    errors = errors.withColumn("class", F.when(F.col("_own"), F.col("class")).otherwise(OVERFLOW))

    again = F.lag("path").over(Window.partitionBy("job_id", "class", "_slice").orderBy("seq"))
    errors = errors.withColumn("_slice", slice_of("seq")).withColumn("_again", F.col("path") == again).where("_again is null or not _again").drop("_slice", "_again")

    def fold(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, paths = None, []
        for pdf in pdfs:
            done = []
            for job, name, path in zip(pdf["job_id"], pdf["class"], pdf["path"]):
                if (job, name) != key:
                    if key is not None:
                        done.append((*key, paths))
                    key, paths = (job, name), []
                if path not in paths:
                    paths = [*paths, path][-keep:]
            yield pd.DataFrame(done, columns=["job_id", "class", "paths"])
        if key is not None:
            yield pd.DataFrame([(*key, paths)], columns=["job_id", "class", "paths"])

    return errors.repartition("job_id", "class").sortWithinPartitions("job_id", "class", "seq").mapInPandas(fold, "job_id string, class string, paths array<string>")


def target_of(kind: str, to: str | None, mismatches: int | None) -> str | None:
    """The phase that an event names; that of a finished verification follows from its mismatches, where they are known."""
    if kind == "VerifyCompleted" and mismatches is not None:
        return "Failed" if mismatches else "Cutover"
    return to


def phase_step(phase: str, history: list[tuple[int, str, str]], seq: int, kind: str, to: str | None) -> tuple[str, list[tuple[int, str, str]]]:
    """Phase and history (seq, before, after; the last HISTORY) after one more event."""
    if kind == "JobCreated":
        return "Planned", []
    if kind == "ProgressDelta":
        to = "Copying" if phase == "Planned" else None
    elif kind == "JobResumed":
        to = next((a for _, a, _ in reversed(history) if a != "Paused"), "Scanning") if phase == "Paused" else None
    else:
        to = {"JobPaused": "Paused", "JobCompleted": "Completed", "JobFailed": "Failed", "JobCancelled": "Cancelled", "VerifyStarted": "Verifying"}.get(kind, to if kind in ("JobPhaseChanged", "VerifyCompleted") else None)
    if to and transition_allowed(phase, to):
        return to, [*history, (seq, phase, to)][-HISTORY:]
    return phase, history


def fold_phases(events: list[tuple[int, str, str | None]]) -> tuple[str, list[tuple[int, str, str]]]:
    """Phase and history of one job from its (seq, kind, target) in order."""
    phase, history = "Planned", []
    for event in events:
        phase, history = phase_step(phase, history, *event)
    return phase, history


#: All that a job's phase depends on: its phase, and for a paused job the phase that it goes back to. The last stands for no job.
PHASE_STATES = (*((p, None) for p in PIPELINE), *(("Paused", p) for p in PIPELINE), *((p, None) for p in ENDED), (None, None))
NO_JOB = len(PHASE_STATES) - 1


def phase_map(kind: str, to: str | None) -> np.ndarray:
    """The state (a place in PHASE_STATES) that each state becomes by an event, as phase_step has it."""
    out = []
    for phase, back in PHASE_STATES:
        if phase is None and kind != "JobCreated":
            out.append(NO_JOB)
            continue
        after, _ = phase_step(phase, [(0, back, "Paused")] if back else [], 1, kind, to)
        out.append(PHASE_STATES.index((after, (back if phase == "Paused" else phase) if after == "Paused" else None)))
    return np.array(out)


def phase_relevant(events: DataFrame) -> DataFrame:
    """job_id, seq, kind, to_phase, _slice: phase events, and of each stretch of deltas in a slice the first: others cannot change a phase."""
    w = Window.partitionBy("job_id", "_slice").orderBy("seq")
    kind = F.col("kind")
    to = F.when((kind == "VerifyCompleted") & F.col("mismatches").isNotNull(), F.when(F.col("mismatches") == 0, "Cutover").otherwise("Failed")).otherwise(F.col("to_phase")) if "mismatches" in events.columns else F.col("to_phase")
    rows = events.select("job_id", "seq", "kind", to.alias("to_phase"), slice_of("seq").alias("_slice")).withColumn("_before", F.lag("kind").over(w))
    return rows.where((kind != "ProgressDelta") | F.col("_before").isNull() | (F.col("_before") != "ProgressDelta")).drop("_before")


def phase_moves(events: DataFrame, created: bool = False) -> DataFrame:
    """job_id, seq, before, after: every legal move of every job, and its creation (with a null `before`).

    A slice of a job's events becomes a map from the states in which it may be entered to those in which it is left; maps are
    composed in groups (operators.ordered), and with the state in which it is really entered a slice tells its moves. No task
    holds more than a slice. created: a job is none before JobCreated, and what comes before it is ignored; else jobs
    are there from the start, as Planned.
    """
    rows = phase_relevant(events)

    def maps(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps: dict[tuple, np.ndarray] = {}
        for key, state in _by_slice(pdfs, lambda: np.arange(len(PHASE_STATES)), lambda state, seq, kind, to: _step(steps, kind, to)[state]):
            yield pd.DataFrame({"job_id": [key[0]], "_slice": [key[1]], "leaves": [state], "counts": [np.zeros(len(state), dtype=np.int64)]})

    dealt = rows.repartition("job_id", "_slice").sortWithinPartitions("job_id", "_slice", "seq")
    slices = materialise(dealt.mapInPandas(maps, "job_id string, _slice long, leaves array<int>, counts array<long>"), "phase-maps")
    most = slices.agg(F.max("_slice")).first()[0] or 0
    states = entering(slices, "job_id", NO_JOB if created else 0, most).drop("count")

    def moves(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps: dict[tuple, np.ndarray] = {}
        key, state = None, NO_JOB
        for pdf in pdfs:
            out = []
            for job, at, seq, kind, to, entered in pdf[["job_id", "_slice", "seq", "kind", "to_phase", "state"]].itertuples(index=False):
                if (job, at) != key:
                    key, state = (job, at), entered
                after = int(_step(steps, kind, to)[state])
                if kind == "JobCreated":
                    out.append((job, seq, None, "Planned"))
                elif PHASE_STATES[after][0] != PHASE_STATES[state][0]:
                    out.append((job, seq, PHASE_STATES[state][0], PHASE_STATES[after][0]))
                state = after
            yield pd.DataFrame(out, columns=["job_id", "seq", "before", "after"])

    entered = with_carried(rows, states, ["job_id"]).repartition("job_id", "_slice").sortWithinPartitions("job_id", "_slice", "seq")
    return entered.mapInPandas(moves, "job_id string, seq long, before string, after string")


def _step(steps: dict[tuple, np.ndarray], kind: str, to: str | None) -> np.ndarray:
    if (kind, to) not in steps:
        steps[kind, to] = phase_map(kind, to)
    return steps[kind, to]


def _by_slice(pdfs: Iterator[pd.DataFrame], start, step) -> Iterator[tuple]:
    """(job_id, _slice) and what its events, which come in order, make of start()."""
    key, state = None, None
    for pdf in pdfs:
        for job, at, *event in pdf[["job_id", "_slice", "seq", "kind", "to_phase"]].itertuples(index=False):
            if (job, at) != key:
                if key is not None:
                    yield key, state
                key, state = (job, at), start()
            state = step(state, *event)
    if key is not None:
        yield key, state


def job_phases(events: DataFrame, created: bool = False) -> DataFrame:
    """job_id, phase, transitions, first_copying, ended: the phase machine of every job, illegal moves ignored; of the last HISTORY moves since it was created."""
    moves = materialise(phase_moves(events, created), "phase-moves")
    born = moves.where("before is null").groupBy("job_id").agg(F.max("seq").alias("_born"))
    # All moves in one table of the moves since creation: one row a move, few next to the events.
    since = moves.where("before is not null").join(born, "job_id", "left").where("_born is null or seq > _born")
    newest = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))
    kept = since.withColumn("_newest", newest).where(F.col("_newest") <= HISTORY)
    per = kept.groupBy("job_id").agg(F.max_by("after", "seq").alias("phase"), F.count("*").alias("transitions"), F.min(F.when(F.col("after") == "Copying", F.col("seq"))).alias("first_copying"), F.min(F.when(F.col("after").isin(*ENDED), F.col("seq"))).alias("ended"))
    jobs = born.select("job_id") if created else events.select("job_id").distinct()
    named = per.withColumnRenamed("job_id", "_job")
    return jobs.join(named, F.col("job_id").eqNullSafe(F.col("_job")), "left").select("job_id", F.coalesce("phase", F.lit("Planned")).alias("phase"), F.coalesce("transitions", F.lit(0)).alias("transitions"), "first_copying", "ended")


def rates(events: DataFrame, key: str, now: str, seconds: int) -> DataFrame:
    """key, files and bytes a second over the last `seconds`: always divided by all of them."""
    recent = F.col("event_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {seconds} SECONDS")
    return events.where("kind = 'ProgressDelta'").groupBy(key).agg((F.coalesce(F.sum(F.when(recent, F.col("files_delta"))), F.lit(0)) / seconds).alias("files_s"), (F.coalesce(F.sum(F.when(recent, F.col("bytes_delta"))), F.lit(0)) / seconds).alias("bytes_s"))


def rolling_rates(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Every delta with the rate of the window that it ends.

    Deltas are added up by the second. A window reaches into the block of `seconds` before its own at most, so each second is put
    into its block and the next: no task orders more than two blocks of a key.
    """
    deltas = events.where("kind = 'ProgressDelta'").select(key, "seq", "files_delta", F.unix_seconds(F.col("event_at").cast("timestamp")).alias("_at"))
    per = deltas.groupBy(key, "_at").agg(F.sum("files_delta").alias("_d"))
    block = F.floor(F.col("_at") / seconds)
    blocks = per.withColumn("_block", F.explode(F.array(block, block + 1)))
    w = Window.partitionBy(key, "_block").orderBy("_at").rangeBetween(-seconds, 0)
    sums = blocks.withColumn("_sum", F.sum("_d").over(w)).where(block == F.col("_block")).select(F.col(key).alias("_k"), F.col("_at").alias("_k_at"), "_sum")
    return deltas.join(sums, deltas[key].eqNullSafe(F.col("_k")) & (F.col("_at") == F.col("_k_at"))).select(key, "seq", (F.col("_sum") / seconds).alias("files_s"))


def rates_absolute(events: DataFrame, key: str, value: str, now: str, seconds: int) -> DataFrame:
    """key, rate: last minus first absolute value over the time between them, of the window; null if no time passed."""
    recent = F.col("event_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {seconds} SECONDS")
    at = F.unix_seconds(F.col("event_at").cast("timestamp"))
    order = F.struct("event_at", "seq")
    per = events.where(recent & F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), (F.max(at) - F.min(at)).alias("spent"))
    return per.select(key, F.when(F.col("spent") > 0, (F.col("last") - F.col("first")) / F.col("spent")).alias("rate"))


def recent_problems(errors: DataFrame, mismatches: DataFrame, n: int = 50) -> DataFrame:
    """list (errors or mismatches), job_id, seq, detail, place: the newest n of both lists of each job, oldest first."""
    both = errors.select(F.lit("errors").alias("list"), "job_id", "seq", F.col("class").alias("detail")).unionByName(mismatches.select(F.lit("mismatches").alias("list"), "job_id", "seq", "detail"))
    kept = recent(both.withColumn("_key", F.struct("list", "job_id")), "_key", n)
    return kept.drop("_key")


def recent(events: DataFrame, key: str, n: int = 50) -> DataFrame:
    """The newest n events of each key, numbered oldest first."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    kept = events.withColumn("_newest", newest).where(F.col("_newest") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).drop("_newest")


def freshness(workers: DataFrame, events: DataFrame) -> DataFrame:
    """worker_id, fresh_at: the later of a worker's heartbeat and its last event."""
    last = events.groupBy("worker_id").agg(F.max("event_at").alias("last_event"))
    return workers.join(last, "worker_id", "left").select("worker_id", F.greatest("heartbeat_at", "last_event").alias("fresh_at"))


def events_since(flushed: DataFrame, pending: DataFrame, seq: int, job_id: str | None = None) -> DataFrame:
    """Events after a cursor from what is stored and what is not yet, each once; with a job, only its own."""
    both = flushed.unionByName(pending).where(F.col("seq") > seq)
    if job_id is not None:
        both = both.where(F.col("job_id") == job_id)
    return both.dropDuplicates(["seq"])


def prune_chunks(chunks: DataFrame, since: int) -> DataFrame:
    """Chunks (route, start_seq) that may hold events after `since`: those whose next chunk starts beyond it, and each route's last."""
    after = F.lead("start_seq").over(Window.partitionBy("route").orderBy("start_seq"))
    return chunks.withColumn("_next", after).where(F.col("_next").isNull() | (F.col("_next") > since)).drop("_next")


def gaps(events: DataFrame, key: str) -> DataFrame:
    """key, first_missing, last_missing: ranges of seq that a key's events skip; repeats of a seq count once.

    Ranges inside a slice of seq, and those between a slice's first event and the last one of all slices before.
    """
    rows = events.select(key, "seq", slice_of("seq").alias("_slice")).distinct()
    after = F.lead("seq").over(Window.partitionBy(key, "_slice").orderBy("seq"))
    inside = rows.select(key, "seq", after.alias("_next"))
    per = rows.groupBy(key, "_slice").agg(F.min("seq").alias("_first"), F.max("seq").alias("_last"))
    between = carried(per, [key], {"_last": "last"}).select(key, F.col("_before__last").alias("seq"), F.col("_first").alias("_next"))
    return inside.unionByName(between).where(F.col("_next") > F.col("seq") + 1).select(key, (F.col("seq") + 1).alias("first_missing"), (F.col("_next") - 1).alias("last_missing"))


def unknown_kinds(events: DataFrame, known: tuple[str, ...] = KINDS) -> DataFrame:
    return events.where(~F.col("kind").isin(*known)).groupBy("kind").agg(F.count("*").alias("n"))


def pass_errors(errors: Iterable[tuple[str, int, int]], start: int | None, counts: dict[str, int], n: int, gap: int) -> tuple[list[tuple[str, int]], int | None, dict[str, int]]:
    """(class, seq) of the errors (class, seq, milliseconds; in order) that pass, and the open window: its start and what passed of each class."""
    out = []
    for name, seq, at in errors:
        if start is None or at - start >= gap:
            start, counts = at, {}
        if counts.get(name, 0) < n:
            counts[name] = counts.get(name, 0) + 1
            out.append((name, seq))
    return out, start, counts


def cap_errors(events: DataFrame, n: int = 10, seconds: float = 1.0) -> DataFrame:
    """events, of the errors those that pass: at most n of a job's class in a window of a second. A window starts at the first error
    after the last one has run out, and all classes share it.

    Errors with a second of silence before them start a window whatever came earlier, so they cut a job's errors into bursts that
    are folded each by itself.
    """
    gap = int(seconds * 1000)
    errors = events.where("kind = 'ErrorEmitted'")
    thin = errors.select("job_id", "class", "seq", F.unix_millis(F.col("event_at").cast("timestamp")).alias("at")).withColumn("_slice", slice_of("seq"))
    # The error before, in the slice or else in those before it; time does not fall along seq.
    per = thin.groupBy("job_id", "_slice").agg(F.max("at").alias("_at"))
    inside = thin.withColumn("_prev", F.lag("at").over(Window.partitionBy("job_id", "_slice").orderBy("at", "seq")))
    chained = with_carried(inside, carried(per, ["job_id"], {"_at": "max"}), ["job_id"]).drop("_at")
    first = F.coalesce(F.col("at") - F.coalesce("_prev", "_before__at") >= gap, F.lit(True))
    marked = chained.withColumn("_first", F.when(first, F.col("seq"))).drop("_prev", "_before__at")
    heads = marked.groupBy("job_id", "_slice").agg(F.max("_first").alias("_head"))
    within = F.max("_first").over(Window.partitionBy("job_id", "_slice").orderBy("at", "seq"))
    bursts = with_carried(marked.withColumn("_own", within), carried(heads, ["job_id"], {"_head": "max"}), ["job_id"])
    bursts = bursts.select("job_id", F.coalesce("_own", "_before__head").alias("_burst"), "class", "seq", "at")

    def fold(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, counts = None, None, {}
        for pdf in pdfs:
            out = []
            for job, burst, name, seq, at in pdf[["job_id", "_burst", "class", "seq", "at"]].itertuples(index=False):
                if (job, burst) != key:
                    key, start, counts = (job, burst), None, {}
                passed, start, counts = pass_errors([(name, seq, at)], start, counts, n, gap)
                out += [s for _, s in passed]
            yield pd.DataFrame({"seq": pd.Series(out, dtype="int64")})

    passed = bursts.repartition("job_id", "_burst").sortWithinPartitions("job_id", "_burst", "at", "seq").mapInPandas(fold, "seq long")
    return errors.join(passed, "seq", "left_semi")


def syncs(events: DataFrame, seconds: int = 1) -> DataFrame:
    """job_id, at (start, seconds), files: running totals at each tick, left out where nothing changed."""
    tick = F.floor(F.unix_seconds(F.col("event_at").cast("timestamp")) / seconds) * seconds
    per = events.where("kind = 'ProgressDelta'").groupBy("job_id", tick.alias("at")).agg(F.sum("files_delta").alias("d"))
    total = F.sum("d").over(Window.partitionBy("job_id").orderBy("at"))
    return per.where("d <> 0").select("job_id", "at", total.alias("files"))


def silent_workers(beats: DataFrame, now: str, seconds: int = 90) -> DataFrame:
    """worker_id, silent_seconds of workers whose last heartbeat is longer ago than that."""
    last = beats.groupBy("worker_id").agg(F.max("event_at").alias("last"))
    silent = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))
    return last.select("worker_id", silent.alias("silent_seconds")).where(F.col("silent_seconds") > seconds)


def evictable(states: DataFrame, beats: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """worker_id of disconnected workers that were idle so long; fenced ones stay."""
    idle = silent_workers(beats, now, hours * 3600 - 1).select("worker_id")
    return states.where("state = 'Disconnected'").select("worker_id").join(idle, "worker_id", "left_semi")


def class_label(name: Column, value: Column) -> Column:
    """An error class with its value, where it has one."""
    return F.when(value.isNull(), name).otherwise(F.concat(name, F.lit("("), value, F.lit(")")))
