"""Streams with state and timers: the same rows for any split of the log, equal to plain loops and to the batch folds."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import eventlog as E
from tidemark.plans.streams import replay
from tidemark.streaming import events as S
from tidemark.streaming import live

LOG = "seq long, event_at timestamp, job_id string, worker_id string, kind string, to_phase string, mismatches long, to_state string, reason string, files_delta long, bytes_delta long, sync_files long, class string, path string, retryable boolean, client_seq long"
NAMES = [f.split()[0] for f in LOG.split(", ")]


def log(spark, rows):
    """rows of dicts; at: milliseconds."""
    data = [tuple(r.get(n) for n in NAMES if n != "event_at") + (r["at"],) for r in rows]
    schema = ", ".join(f for f in LOG.split(", ") if not f.startswith("event_at")) + ", at long"
    return spark.createDataFrame(data, schema).select(*[F.timestamp_millis("at").alias(n) if n == "event_at" else n for n in NAMES])


def random_log(n, seed):
    rng, rows, at = random.Random(seed), [], 1_700_000_000_000
    kinds = ["ProgressDelta"] * 6 + ["ErrorEmitted"] * 4 + ["ProgressSync", "JobCreated", "JobPhaseChanged", "JobPhaseChanged", "JobPaused", "JobResumed", "VerifyStarted", "VerifyCompleted", "JobCompleted", "ClaimConflictResolved", "WorkerJoined", "WorkerLeft", "WorkerStateChanged", "WorkerFenced", "WorkerRecovered"]
    for seq in range(1, n + 1):
        at += rng.choice([1, 40, 300, 900, 2500])
        r = dict(seq=seq, at=at, job_id=f"j{rng.randrange(4)}", worker_id=f"w{rng.randrange(5)}", kind=rng.choice(kinds), to_phase=rng.choice(E.PIPELINE))
        if r["kind"].startswith("Worker"):
            r |= dict(job_id=None, to_state=rng.choice(["Busy", None]), reason=f"r{seq}")
        if r["kind"] == "VerifyCompleted":
            r |= dict(mismatches=rng.choice([0, 0, 2]))
        if r["kind"] == "ProgressDelta":
            r |= dict(files_delta=rng.randrange(5), bytes_delta=rng.randrange(100))
        if r["kind"] == "ProgressSync":
            r |= dict(sync_files=rng.randrange(60))
        if r["kind"] == "ErrorEmitted":
            r |= {"class": f"c{rng.randrange(70 if seq % 2 else 3)}", "path": f"/{rng.randrange(14)}", "retryable": rng.random() < 0.5}
        rows.append(r)
    return rows


def reduce_plainly(rows):
    """What every job and worker has come to, by one loop over the whole log."""
    jobs, workers, errors = {}, {}, {}
    for r in rows:
        kind, job, worker = r["kind"], r.get("job_id"), r.get("worker_id")
        if kind == "JobCreated":
            jobs[job] = dict(phase="Planned", history=[], files=0, bytes=0, conflicts=0)
        elif kind == "WorkerJoined":
            workers[worker] = dict(state="Idle", files=0, bytes=0, fence=None, error=None)
        elif kind == "ErrorEmitted":
            buckets = errors.setdefault(job, {})
            name = r["class"] if r["class"] in buckets or len(buckets) < 64 else "(overflow)"
            b = buckets.setdefault(name, dict(count=0, first=r["seq"], paths=[]))
            b |= dict(count=b["count"] + 1, last=r["seq"], retryable=r["retryable"])
            if r["path"] not in b["paths"]:
                b["paths"] = [*b["paths"], r["path"]][-10:]
        elif kind.startswith("Worker"):
            if worker in workers:
                w = workers[worker]
                if kind == "WorkerLeft":
                    w |= dict(state="Disconnected", error=r["reason"])
                elif kind == "WorkerStateChanged":
                    w["state"] = r["to_state"] or w["state"]
                elif kind == "WorkerFenced":
                    w |= dict(state="Fenced", fence=r["reason"])
                else:
                    w |= dict(state="Idle", fence=None)
        else:
            if job in jobs:
                j = jobs[job]
                to = r["to_phase"] if kind == "JobPhaseChanged" else None
                if kind == "VerifyCompleted":
                    to = "Failed" if r["mismatches"] else "Cutover"
                j["phase"], j["history"] = E.phase_step(j["phase"], j["history"], r["seq"], kind, to)
                j["conflicts"] += kind == "ClaimConflictResolved"
            for x in (jobs.get(job), workers.get(worker)):
                if x and kind == "ProgressDelta":
                    x["files"], x["bytes"] = x["files"] + r["files_delta"], x["bytes"] + r["bytes_delta"]
                if x and kind == "ProgressSync":
                    x["files"] = max(x["files"], r["sync_files"])
    return jobs, workers, errors


def check_state(rows, state):
    jobs, workers, errors = reduce_plainly(rows)
    got = {(r["entity"], r["key"]): r for r in state.collect()}
    for name in {r["job_id"] for r in rows if r.get("job_id")}:
        r, j = got["job", name], jobs.get(name, dict(phase=None, history=[], files=0, bytes=0, conflicts=0))
        assert (r["phase"], [tuple(h) for h in r["history"]], r["files"], r["bytes"], r["conflicts"]) == (j["phase"], j["history"], j["files"], j["bytes"], j["conflicts"])
        want = {k: (b["count"], b["first"], b["last"], b["retryable"], b["paths"]) for k, b in errors.get(name, {}).items()}
        assert {b["class"]: (b["count"], b["first_seq"], b["last_seq"], b["retryable"], b["paths"]) for b in r["buckets"]} == want
    for name, w in workers.items():
        r = got["worker", name]
        assert (r["state"], r["files"], r["bytes"], r["fence_reason"], r["last_error"]) == (w["state"], w["files"], w["bytes"], w["fence"], w["error"])


@pytest.mark.parametrize("splits", [1, 6])
def test_live_state_equals_a_loop(spark, splits):
    rows = random_log(1500, 4)
    check_state(rows, live.state_of(S.run_available(live.live_state(replay(log(spark, rows), splits)), "live", "update")))


def test_live_state_from_a_snapshot_and_replayed_twice(spark):
    rows = random_log(900, 5)
    part = live.state_of(S.run_available(live.live_state(replay(log(spark, rows[:500]), 2)), "live", "update"))
    # All of the log once more, and what is new: events that the snapshot has seen change nothing.
    rest = S.run_available(live.live_state(replay(log(spark, rows), 3), part), "live", "update").drop("batch")
    check_state(rows, live.state_of(rest.unionByName(part)))


def test_batch_folds_equal_the_loop(spark):
    rows = random_log(1200, 6)
    jobs, _, errors = reduce_plainly(rows)
    df = log(spark, rows)
    phases = {r["job_id"]: (r["phase"], r["transitions"]) for r in E.job_phases(df.where("job_id is not null"), created=True).collect()}
    assert phases == {k: (j["phase"], len(j["history"])) for k, j in jobs.items()}
    samples = {(r["job_id"], r["class"]): r["paths"] for r in E.error_samples(df).collect()}
    assert samples == {(j, c): b["paths"] for j, bs in errors.items() for c, b in bs.items()}


def beats(spark, pairs):
    return log(spark, [dict(seq=k + 1, at=1_700_000_000_000 + int(t * 1000), worker_id=w, kind="ProgressDelta") for k, (w, t) in enumerate(pairs)])


@pytest.mark.parametrize("splits", [1, 4])
def test_silent_workers_are_told_once(spark, splits):
    # a falls silent; b is late but back before the timer; c is silent, comes back, and is silent again; d is there to the end.
    pairs = [("a", 0), ("b", 0), ("c", 0), ("d", 1), ("b", 90), ("d", 95), ("b", 179), ("d", 180), ("c", 500), ("d", 510), ("d", 600), ("b", 601), ("d", 690), ("b", 690), ("d", 780), ("b", 781), ("d", 2000)]
    got = S.run_available(live.liveness(replay(beats(spark, pairs), splits), 90, "1 seconds"), "liveness").collect()
    told = sorted((r["worker_id"], r["last_ms"] // 1000 - 1_700_000_000, r["silent_seconds"]) for r in got)
    # Only what is certain at the time of the watermark: within one micro-batch, gaps that ended again are nobody's silence.
    last = {w: max(t for x, t in pairs if x == w) for w, _ in pairs}
    assert {(w, t) for w, t, _ in told} >= {("a", 0), ("c", 500), ("b", 781)} and len({(w, t) for w, t, _ in told}) == len(told)
    assert all(n == 90 for _, _, n in told) and ("d", last["d"]) not in {(w, t) for w, t, _ in told}
    silent = {r["worker_id"] for r in E.silent_workers(beats(spark, pairs), "2023-11-14 22:46:39", 90).collect()}  # 1999 s on
    assert {w for w, t, _ in told if t == last[w]} == silent - {"d"}


@pytest.mark.parametrize("splits", [1, 5])
def test_capped_progress_equals_a_loop(spark, splits):
    rng, rows, at = random.Random(6), [], 1_700_000_000_000
    for k in range(200):
        at += rng.choice([0, 100, 300, 700, 1000, 2500])
        rows.append(dict(seq=k + 1, at=at, job_id="j", worker_id=f"w{k % 2}", kind="ProgressDelta", files_delta=rng.randrange(1, 9)))
    want = []
    for w in ("w0", "w1"):
        led = since = None
        held = last = 0
        for r in [r for r in rows if r["worker_id"] == w]:
            if since is not None and r["at"] - since >= 1000:
                want.append((w, "drained", held, last, since + 1000))
                since, held = None, 0
            if led is None or r["at"] - led >= 1000:
                led = r["at"]
                want.append((w, "leading", r["files_delta"], r["seq"], r["at"]))
            else:
                since, held, last = since if since is not None else r["at"], held + r["files_delta"], r["seq"]
        if since is not None:
            want.append((w, "drained", held, last, since + 1000))
    rows.append(dict(seq=999, at=at + 3_600_000, job_id="end", worker_id="w", kind="ProgressDelta", files_delta=0))
    got = S.run_available(live.capped_progress(replay(log(spark, rows), splits), 1.0, "1 seconds"), "capped").where("job_id = 'j'").collect()
    assert sorted((r["worker_id"], r["part"], r["files"], r["seq"], r["at_ms"]) for r in got) == sorted(want)
    assert sum(w[2] for w in want) == sum(r["files_delta"] for r in rows)


def error_rows(seed):
    rng, rows, at = random.Random(seed), [], 1_700_000_000_000
    for k in range(1200):
        at += rng.choice([0, 1, 20, 60, 200, 999, 1000, 1001]) if k % 3 else 2
        rows.append({"seq": (k + 1) * 37, "at": at, "job_id": f"j{rng.randrange(2)}", "kind": "ErrorEmitted", "class": f"c{rng.randrange(3)}"})
    return rows


def cap_plainly(rows, n):
    out, windows = set(), {}
    for r in rows:
        start, counts = windows.get(r["job_id"], (None, {}))
        if start is None or r["at"] - start >= 1000:
            start, counts = r["at"], {}
        counts[r["class"]] = counts.get(r["class"], 0) + 1
        windows[r["job_id"]] = start, counts
        if counts[r["class"]] <= n:
            out.add(r["seq"])
    return out


def test_capped_errors_share_a_window(spark):
    rows = error_rows(7)
    df, want = log(spark, rows), cap_plainly(rows, 3)
    assert {r["seq"] for r in E.cap_errors(df, 3).collect()} == want
    assert {r["seq"] for r in S.run_available(live.capped_errors(replay(df, 4), 3), "capped").collect()} == want


@pytest.mark.parametrize("splits", [1, 5])
def test_gaps_with_late_events(spark, splits):
    rng = random.Random(8)
    come = [(s, f"j{s % 2}") for s in range(1, 900) if rng.random() < 0.7]
    late = [x for x in come if rng.random() < 0.1]
    order = [x for x in come if x not in late] + late + rng.sample(come, 50)
    rows = [dict(seq=k + 1, at=k, job_id=j, kind="ProgressDelta", client_seq=s) for k, (s, j) in enumerate(order)]
    stream = replay(log(spark, rows), splits).withColumn("seq", F.col("client_seq"))
    got = {(r["job_id"], r["first_missing"], r["last_missing"]) for r in live.open_gaps(S.run_available(live.gap_changes(stream, "job_id"), "gaps"), "job_id").collect()}
    want = set()
    for j in ("j0", "j1"):
        have = sorted({s for s, x in come if x == j})
        # The first of a key that comes opens nothing before it.
        first = next(s for s, x in order if x == j)
        have = [s for s in have if s >= first]
        want |= {(j, a + 1, b - 1) for a, b in zip(have, have[1:]) if b > a + 1}
    assert got == want
    batch = log(spark, [dict(seq=s, at=0, job_id=j, kind="x") for s, j in come])
    assert {(r["job_id"], r["first_missing"], r["last_missing"]) for r in E.gaps(batch, "job_id").collect()} >= want


@pytest.mark.parametrize("splits", [1, 4])
def test_syncs_equal_the_batch(spark, splits):
    rng, rows, at = random.Random(9), [], 1_700_000_000_000
    for k in range(300):
        at += rng.choice([0, 300, 900, 4000])
        rows.append(dict(seq=k + 1, at=at, job_id=f"j{k % 3}", kind="ProgressDelta", files_delta=rng.choice([0, 0, 1, 5])))
    want = {tuple(r) for r in E.syncs(log(spark, rows), 2).collect()}
    rows.append(dict(seq=999, at=at + 600_000, job_id="end", kind="ProgressDelta", files_delta=0))
    got = S.run_available(live.live_syncs(replay(log(spark, rows), splits), 2, "1 seconds"), "syncs").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("splits", [1, 4])
def test_evictions_equal_the_batch(spark, splits):
    hour = 3_600_000
    kinds = [("a", "WorkerJoined", 0), ("a", "WorkerLeft", 1), ("b", "WorkerJoined", 1), ("b", "WorkerFenced", 2), ("c", "WorkerJoined", 2), ("c", "WorkerLeft", 3), ("d", "WorkerLeft", 20), ("c", "WorkerJoined", 26), ("e", "WorkerJoined", 30), ("d", "ProgressDelta", 40), ("e", "WorkerLeft", 60), ("z", "WorkerJoined", 70), ("z", "ProgressDelta", 80)]
    df = log(spark, [dict(seq=k + 1, at=1_700_000_000_000 + t * hour, worker_id=w, kind=kind) for k, (w, kind, t) in enumerate(kinds)])
    got = S.run_available(live.evictions(replay(df, splits), 24, "1 seconds"), "evictions").collect()
    assert {(r["worker_id"], (r["last_ms"] - 1_700_000_000_000) // hour) for r in got} == {("a", 1), ("d", 40)}
