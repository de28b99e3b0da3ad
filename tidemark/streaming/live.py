"""Live state of a run over the event log: keyed state and event-time timers, the same rows for any split of the log.

Each processor orders a key's rows of a micro-batch by seq (or time), so what a trigger may read bounds what is held at once.
Timers fire when the watermark passes them, which needs no further event of their key.
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import eventlog as E

LATE = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKET = "class string, count long, first_seq long, last_seq long, retryable boolean, paths array<string>"
MOVE = "seq long, before string, after string"
STATE = f"entity string, key string, last_seq long, phase string, files long, bytes long, conflicts long, state string, fence_reason string, last_error string, history array<struct<{MOVE.replace(' ', ': ').replace(',:', ',')}>>, buckets array<struct<{BUCKET.replace(' ', ': ').replace(',:', ',')}>>"
WORKER_KINDS = ("WorkerJoined", "WorkerLeft", "WorkerStateChanged", "WorkerFenced", "WorkerRecovered")


def _keyed(df: DataFrame, *key: str):
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the one that keeps several states a key
    return df.groupBy(*key)


def _rows(rows: Iterator[pd.DataFrame], order: list[str]) -> list[Any]:
    """A key's rows of this micro-batch in order, nulls as None."""
    whole = pd.concat(rows).sort_values(order, kind="stable")
    return list(whole.astype(object).where(whole.notna(), None).itertuples(index=False))


def _millis(at: str = "event_at") -> Column:
    return F.unix_millis(F.col(at).cast("timestamp")).alias("at")


STATE_NAMES = ["entity", "key", "last_seq", "phase", "files", "bytes", "conflicts", "state", "fence_reason", "last_error", "history", "buckets"]
SLOTS = 512  # of small states: each is one value, so a micro-batch makes as many calls however many keys it has; a checkpoint holds for one number


def _slot(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SLOTS)).cast("string").alias("slot")


def _held(state: Any) -> dict:
    """The states of a slot by key."""
    return pickle.loads(state.get()[0]) if state.exists() else {}


def _unpacked(table: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(table).read_all().to_pandas()


def _packed(table: pd.DataFrame, schema: pa.Schema) -> bytes:
    """A slot's states as one value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_table(pa.Table.from_pandas(table, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _counted(r: Any, files: int, n_bytes: int) -> tuple[int, int]:
    files, n_bytes = files + int(r.files_delta or 0), n_bytes + int(r.bytes_delta or 0)
    return files if r.sync_files is None else max(files, int(r.sync_files)), n_bytes


def nearest_millis(at: str = "event_at") -> Column:
    """A time that is told, in milliseconds: rounded, a half upward. Ticks and seconds start where they start, so they use _millis."""
    return F.unix_millis(F.col(at).cast("timestamp") + F.expr("INTERVAL '0.0005' SECOND")).alias("at")


class Reducer(StatefulProcessor):
    """A job's or a worker's state after each micro-batch. A job starts with JobCreated, a worker with WorkerJoined, each time anew;
    events before are of nobody, but for errors, whose buckets outlive a job's new start. Events up to last_seq are ignored.
    A job has a slot of its own. Workers are many and their states small: those of a slot are one value, read and written once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.workers = handle.getValueState("workers", "states binary")
        self.core = handle.getValueState("core", "last_seq long, there boolean, phase string, files long, bytes long, conflicts long, state string, fence_reason string, last_error string")
        self.history = handle.getListState("history", MOVE)
        self.buckets = handle.getMapState("buckets", "class string", BUCKET.partition(", ")[2])

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        if key[0] == "worker":
            known = _held(self.workers)
            for r in initialState.astype(object).where(initialState.notna(), None).itertuples(index=False):
                known[r.key] = (int(r.last_seq), r.state is not None, int(r.files or 0), int(r.bytes or 0), r.state, r.fence_reason, r.last_error)
            self.workers.update((pickle.dumps(known),))
            return
        r = initialState.astype(object).where(initialState.notna(), None).iloc[0]
        there = r["phase"] is not None
        self.core.update((int(r["last_seq"]), there, r["phase"], int(r["files"] or 0), int(r["bytes"] or 0), int(r["conflicts"] or 0), r["state"], r["fence_reason"], r["last_error"]))
        if r["history"] is not None and len(r["history"]):
            self.history.put([(int(h["seq"]), h["before"], h["after"]) for h in r["history"]])
        for b in r["buckets"] if r["buckets"] is not None else ():
            self.buckets.updateValue((b["class"],), (int(b["count"]), int(b["first_seq"]), int(b["last_seq"]), bool(b["retryable"]), list(b["paths"])))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if key[0] == "worker":
            yield from self._workers(rows)
            return
        old = self.core.get() if self.core.exists() else (0, False, None, 0, 0, 0, None, None, None)
        last, there, phase, files, n_bytes, conflicts, state, fence, error = old
        history = [tuple(h) for h in self.history.get()] if self.history.exists() else []
        moves, touched = list(history), {}
        for r in _rows(rows, ["seq"]):
            if r.seq <= last:
                continue
            last, kind = int(r.seq), r.kind
            if kind == "JobCreated":
                there, phase, moves, files, n_bytes, conflicts = True, "Planned", [], 0, 0, 0
            elif kind == "ErrorEmitted":
                self._error(r, touched)
            elif there:
                phase, moves = E.phase_step(phase, moves, last, kind, E.target_of(kind, r.to_phase, r.mismatches))
                conflicts += kind == "ClaimConflictResolved"
            if there:
                files, n_bytes = _counted(r, files, n_bytes)
        if last == old[0]:
            return
        self.core.update((last, there, phase, files, n_bytes, conflicts, state, fence, error))
        if moves != history:
            self.history.put(moves) if moves else self.history.clear()
        for name, bucket in touched.items():
            self.buckets.updateValue((name,), bucket)
        found = sorted(((k[0], *v) for k, v in self.buckets.iterator()), key=lambda b: b[2])
        yield pd.DataFrame(
            [(*key, last, phase, files, n_bytes, conflicts, state, fence, error, [dict(zip(("seq", "before", "after"), m)) for m in moves], [dict(zip(("class", "count", "first_seq", "last_seq", "retryable", "paths"), b)) for b in found])],
            columns=STATE_NAMES,
        )

    def _workers(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, changed = _held(self.workers), set()
        for r in _rows(rows, ["seq"]):
            last, there, files, n_bytes, state, fence, error = known.get(r.key) or (0, False, 0, 0, None, None, None)
            if r.seq <= last:
                continue
            kind = r.kind
            if kind == "WorkerJoined":
                there, state, files, n_bytes, fence, error = True, "Idle", 0, 0, None, None
            elif there:
                if kind == "WorkerLeft":
                    state, error = "Disconnected", r.reason
                elif kind == "WorkerStateChanged":
                    state = r.to_state if r.to_state is not None else state
                elif kind == "WorkerFenced":
                    state, fence = "Fenced", r.reason
                elif kind == "WorkerRecovered":
                    state, fence = "Idle", None
            if there:
                files, n_bytes = _counted(r, files, n_bytes)
            known[r.key] = (int(r.seq), there, files, n_bytes, state, fence, error)
            changed.add(r.key)
        if changed:
            self.workers.update((pickle.dumps(known),))
            told = [("worker", w, last, None, files, n_bytes, 0, state, fence, error, [], []) for w in sorted(changed) for last, _, files, n_bytes, state, fence, error in (known[w],)]
            yield pd.DataFrame(told, columns=STATE_NAMES)

    def _error(self, r: Any, touched: dict) -> None:
        """The bucket of an error's class, or the common one when there are enough; touched holds this micro-batch's."""
        known = lambda name: touched.get(name) or (self.buckets.getValue((name,)) if self.buckets.containsKey((name,)) else None)
        name = r.class_
        bucket = known(name)
        if bucket is None and len({k[0] for k in self.buckets.keys()} | set(touched)) >= E.CLASSES:
            name = E.OVERFLOW
            bucket = known(name)
        count, first, _, _, paths = bucket or (0, int(r.seq), 0, False, [])
        paths = paths if r.path in paths else [*paths, r.path][-E.SAMPLES :]
        touched[name] = (count + 1, first, int(r.seq), bool(r.retryable), paths)


def live_state(events: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """entity (job or worker), key, last_seq, phase, files, bytes, conflicts, state, fence_reason, last_error, history and buckets after each micro-batch.

    snapshot: the last such row of every key, to start from (state_of()); a log that is read again from before it changes nothing.
    """
    columns = ["seq", "kind", "to_phase", "mismatches", "to_state", "reason", "files_delta", "bytes_delta", "sync_files", F.col("class").alias("class_"), "path", "retryable"]
    kind = F.col("kind")
    entities = F.array_compact(F.array(
        F.when(F.col("job_id").isNotNull() & ~kind.isin(*WORKER_KINDS), F.struct(F.lit("job").alias("entity"), F.col("job_id").alias("key"))),
        F.when(F.col("worker_id").isNotNull() & kind.isin(*WORKER_KINDS, "ProgressDelta", "ProgressSync"), F.struct(F.lit("worker").alias("entity"), F.col("worker_id").alias("key"))),
    ))
    keyed = events.select(F.explode(entities).alias("e"), *columns).select("e.*", *[c if isinstance(c, str) else "class_" for c in columns])
    slot = F.when(F.col("entity") == "worker", _slot("key")).otherwise(F.col("key")).alias("slot")
    start = snapshot.select("*", slot).groupBy("entity", "slot") if snapshot is not None else None
    return _keyed(keyed.select("*", slot), "entity", "slot").transformWithStateInPandas(statefulProcessor=Reducer(), outputStructType=STATE, outputMode="Update", timeMode="None", initialState=start)


def state_of(updates: DataFrame) -> DataFrame:
    """The last row of every key: a snapshot."""
    names = [f.partition(" ")[0] for f in ("last_seq", "phase", "files", "bytes", "conflicts", "state", "fence_reason", "last_error", "history", "buckets")]
    return updates.groupBy("entity", "key").agg(F.max_by(F.struct(*names), "last_seq").alias("s")).select("entity", "key", "s.*")


class Liveness(StatefulProcessor):
    """A worker that is silent for more than `seconds` is told once; what it sends before the timer fires sets it anew. The workers of
    a slot are one table, and its timer is that of the one that has been silent for longest."""

    def __init__(self, seconds: int):
        self.silence = seconds * 1000 + 1  # longer than, not as long as

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "armed long, workers binary")

    def _load(self) -> tuple[int | None, pd.Series]:
        armed, workers = self.last.get() if self.last.exists() else (None, None)
        return armed, _unpacked(workers).set_index("worker_id")["at"] if workers is not None else pd.Series(dtype="int64")

    def _keep(self, armed: int | None, last: pd.Series) -> None:
        """Store the slot; its timer is set for the worker that has been silent for longest."""
        oldest = int(last.min()) if len(last) else None
        if armed != oldest:
            if armed is not None:
                self.handle.deleteTimer(armed + self.silence)
            if oldest is not None:
                self.handle.registerTimer(oldest + self.silence)
        self.last.update((oldest, _packed(pd.DataFrame({"worker_id": last.index, "at": last.to_numpy()}), BEATS)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        armed, last = self._load()
        new = pd.concat(pdf.groupby("worker_id")["at"].max() for pdf in rows)
        self._keep(armed, pd.concat([last, new]).groupby(level=0).max())
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        armed, last = self._load()
        silent = last + self.silence <= timerValues.getCurrentWatermarkInMs()
        self._keep(None if armed is not None and armed + self.silence == expiredTimerInfo.getExpiryTimeInMs() else armed, last[~silent])
        told = last[silent]
        yield pd.DataFrame({"worker_id": told.index, "last_ms": told.to_numpy(), "silent_seconds": (self.silence - 1) // 1000})


BEATS = pa.schema([("worker_id", pa.string()), ("at", pa.int64())])


def liveness(events: DataFrame, seconds: int = 90, late: str = LATE) -> DataFrame:
    """worker_id, last_ms, silent_seconds: one row when a worker has sent nothing for so long; it is watched again from its next event."""
    beats = events.where("worker_id is not null").withWatermark("event_at", late).select("worker_id", "event_at", nearest_millis(), _slot("worker_id"))
    return _keyed(beats, "slot").transformWithStateInPandas(statefulProcessor=Liveness(seconds), outputStructType="worker_id string, last_ms long, silent_seconds long", outputMode="Append", timeMode="EventTime")


class CappedProgress(StatefulProcessor):
    """The first delta of a second passes (leading); later ones are summed and released (drained) when the oldest of them is a
    second old, by the next event or by the timer, whichever is first: both release the same. The keys of a slot are one value,
    and its timer is that of the oldest held."""

    def __init__(self, seconds: float):
        self.gap = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "armed long, states binary")

    def _load(self) -> tuple[int | None, dict]:
        armed, states = self.held.get() if self.held.exists() else (None, None)
        return armed, pickle.loads(states) if states is not None else {}

    def _keep(self, armed: int | None, held: dict) -> None:
        """Store the slot; its timer is set for the oldest that is held."""
        oldest = min((since for _, since, _, _ in held.values() if since is not None), default=None)
        if armed != oldest:
            if armed is not None:
                self.handle.deleteTimer(armed + self.gap)
            if oldest is not None:
                self.handle.registerTimer(oldest + self.gap)
        self.held.update((oldest, pickle.dumps(held)))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["job_id", "worker_id", "part", "files", "seq", "at_ms"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        armed, held = self._load()
        out = []
        for r in _rows(rows, ["at", "seq"]):
            own = (r.job_id, r.worker_id)
            led, since, files, last = held.get(own) or (None, None, 0, 0)
            at, seq, n = int(r.at), int(r.seq), int(r.files_delta)
            if since is not None and at - since >= self.gap:
                out.append((*own, "drained", files, last, since + self.gap))
                since, files = None, 0
            if led is None or at - led >= self.gap:
                led = at
                out.append((*own, "leading", n, seq, at))
            else:
                since, files, last = at if since is None else since, files + n, seq
            held[own] = (led, since, files, last)
        self._keep(armed, held)
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        armed, held = self._load()
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for own, (led, since, files, last) in held.items():
            if since is not None and since + self.gap <= now:
                held[own] = (led, None, 0, 0)
                out.append((*own, "drained", files, last, since + self.gap))
        self._keep(None if armed is not None and armed + self.gap == expiredTimerInfo.getExpiryTimeInMs() else armed, held)
        yield self._frame(out)


def capped_progress(events: DataFrame, seconds: float = 1.0, late: str = LATE) -> DataFrame:
    """job_id, worker_id, part (leading or drained), files, seq, at_ms: at most two rows a key and second; what a timer has not yet
    released is younger than the watermark."""
    deltas = events.where("kind = 'ProgressDelta' and files_delta is not null").withWatermark("event_at", late).select("job_id", "worker_id", "seq", "files_delta", "event_at", _millis(), _slot("job_id", "worker_id"))
    return _keyed(deltas, "slot").transformWithStateInPandas(statefulProcessor=CappedProgress(seconds), outputStructType="job_id string, worker_id string, part string, files long, seq long, at_ms long", outputMode="Append", timeMode="EventTime")


class CappedErrors(StatefulProcessor):
    """At most n errors a class in a second that starts at the first error after the one before has run out, for all classes alike."""

    def __init__(self, n: int, seconds: float):
        self.n, self.gap = n, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.start, self.counts = handle.getValueState("start", "at long"), handle.getMapState("counts", "class string", "n int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        start = self.start.get()[0] if self.start.exists() else None
        counts = {k[0]: v[0] for k, v in self.counts.iterator()} if self.counts.exists() else {}
        out, start, counts = E.pass_errors(((r.class_, int(r.seq), int(r.at)) for r in _rows(rows, ["at", "seq"])), start, counts, self.n, self.gap)
        self.start.update((start,))
        self.counts.clear()
        for name, k in counts.items():
            self.counts.updateValue((name,), (k,))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["job_id", "class", "seq"])


def capped_errors(events: DataFrame, n: int = 10, seconds: float = 1.0) -> DataFrame:
    """job_id, class, seq of the errors that pass; ordered like the log, so an error's time must not lie before an earlier micro-batch's."""
    errors = events.where("kind = 'ErrorEmitted'").select("job_id", F.col("class").alias("class_"), "seq", _millis())
    return _keyed(errors, "job_id").transformWithStateInPandas(statefulProcessor=CappedErrors(n, seconds), outputStructType="job_id string, class string, seq long", outputMode="Append", timeMode="None")


class Gaps(StatefulProcessor):
    """Open ranges of missing seq of a key, told as changes: opened ones as +1, those that a late event fills or splits as -1."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top, self.ranges = handle.getValueState("top", "seq long"), handle.getMapState("ranges", "first long", "last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        top = self.top.get()[0] if self.top.exists() else None
        open_, out, gone, new = None, [], set(), {}
        for seq in sorted({int(s) for pdf in rows for s in pdf["seq"]}):
            if top is None or seq > top:
                if top is not None and seq > top + 1:
                    new[top + 1] = seq - 1
                top = seq
                continue
            if open_ is None:  # ranges are read only when something late or repeated comes
                open_ = sorted((k[0], v[0]) for k, v in self.ranges.iterator())
            at = bisect.bisect_right(open_, (seq, 1 << 62)) - 1
            if at >= 0 and open_[at][0] <= seq <= open_[at][1]:
                first, last = open_[at]
                rest = [r for r in ((first, seq - 1), (seq + 1, last)) if r[0] <= r[1]]
                open_[at : at + 1] = rest
                if first in new and new[first] == last:
                    del new[first]
                else:
                    gone.add((first, last))
                new |= dict(rest)
        for first, last in gone:
            self.ranges.removeKey((first,))
            out.append((key[0], first, last, -1))
        for first, last in new.items():
            self.ranges.updateValue((first,), (last,))
            out.append((key[0], first, last, 1))
        self.top.update((top,))
        yield pd.DataFrame(out, columns=["key", "first_missing", "last_missing", "change"])


def gap_changes(events: DataFrame, key: str) -> DataFrame:
    """key, first_missing, last_missing, change: the changes of a key's open ranges; their sum is what is missing (open_gaps())."""
    return _keyed(events.select(F.col(key).alias("key"), "seq"), "key").transformWithStateInPandas(statefulProcessor=Gaps(), outputStructType="key string, first_missing long, last_missing long, change int", outputMode="Append", timeMode="None")


def open_gaps(changes: DataFrame, key: str) -> DataFrame:
    return changes.groupBy(F.col("key").alias(key), "first_missing", "last_missing").agg(F.sum("change").alias("n")).where("n > 0").drop("n")


class Syncs(StatefulProcessor):
    """A job's running total at the end of each tick in which it changed, when a later tick begins or the watermark passes the end."""

    def __init__(self, seconds: int):
        self.tick = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.sum = handle, handle.getValueState("sum", "at long, files long, told long")

    def _frame(self, key: Any, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], at // 1000, files) for at, files in out], columns=["job_id", "at", "files"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at, files, told = self.sum.get() if self.sum.exists() else (None, 0, 0)
        armed, out = at, []
        for r in _rows(rows, ["at", "seq"]):
            tick = int(r.at) // self.tick * self.tick
            if at is not None and tick > at:
                if files != told:
                    out.append((at, files))
                told, at = files, tick
            at, files = tick if at is None else at, files + int(r.files_delta)
        if armed != at:
            if armed is not None:
                self.handle.deleteTimer(armed + self.tick)
            self.handle.registerTimer(at + self.tick)
        self.sum.update((at, files, told))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at, files, told = self.sum.get()
        self.sum.update((None, files, files))
        if files != told:
            yield self._frame(key, [(at, files)])


def live_syncs(events: DataFrame, seconds: int = 1, late: str = LATE) -> DataFrame:
    """job_id, at (start of the tick, seconds), files: as operators.eventlog.syncs, each tick once it is over."""
    deltas = events.where("kind = 'ProgressDelta' and files_delta is not null").withWatermark("event_at", late).select("job_id", "seq", "files_delta", "event_at", _millis())
    return _keyed(deltas, "job_id").transformWithStateInPandas(statefulProcessor=Syncs(seconds), outputStructType="job_id string, at long, files long", outputMode="Append", timeMode="EventTime")


class ShardStates(StatefulProcessor):
    """The states of the claims on a bucket of shards, told as changes of the counts. A completed claim stays; else the later one counts,
    so that a failed shard may be cleared and tried again. A bucket's shards are one value: a state for each would be a call for each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claims = handle.getValueState("claims", "shards binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = _unpacked(self.claims.get()[0]) if self.claims.exists() else pd.DataFrame(columns=["shard", "state", "at"])
        whole = pd.concat(rows).sort_values(["shard", "at", "claim_etag"], kind="stable")
        whole["done"] = whole["state"] == "completed"
        new = whole.drop_duplicates("shard", keep="last").set_index("shard").assign(done=whole.groupby("shard")["done"].any())
        old = known.set_index("shard").reindex(new.index)
        was, at = old["state"], old["at"].fillna(-(1 << 62)).astype("int64")
        later = (was != "completed") & (new["at"] >= at)
        state = was.astype(object).mask(later, new["state"]).mask(new["done"], "completed")
        moved = [(state == s).astype("int64") - (was == s).astype("int64") for s in ("completed", "failed", "active")]
        now = pd.DataFrame({"shard": new.index, "state": state.to_numpy(), "at": at.where(~later, new["at"]).to_numpy()})
        kept = pd.concat([known[~known["shard"].isin(new.index)], now]) if len(known) else now
        self.claims.update((_packed(kept, CLAIMS),))
        if any(m.any() for m in moved):
            sums = [int(m.sum()) for m in moved] + [int((moved[0] * new[c]).sum()) for c in ("n_rows", "n_bytes")]
            yield pd.DataFrame([sums], columns=[f.partition(" ")[0] for f in TALLY.split(", ")])


TALLY = "completed long, failed long, active long, rows_completed long, bytes_completed long"
CLAIMS = pa.schema([("shard", pa.string()), ("state", pa.string()), ("at", pa.int64())])
BUCKET_SHARDS = 4096  # what a bucket holds on average; a checkpoint holds for one value and one table of shards


def shard_changes(claims: DataFrame, shards: DataFrame) -> DataFrame:
    """Changes of the tally by claims (shard, state, claimed_utc, claim_etag): one row for a bucket of shards that changed; claims of other shards are ignored."""
    buckets = max(1, -(-shards.count() // BUCKET_SHARDS))
    own = claims.join(shards.select("shard", "n_rows", "n_bytes"), "shard").select("shard", "state", _millis("claimed_utc"), "claim_etag", "n_rows", "n_bytes")
    own = own.withColumn("at", F.coalesce("at", F.lit(0))).withColumn("bucket", F.pmod(F.xxhash64("shard"), F.lit(buckets)))
    return _keyed(own, "bucket").transformWithStateInPandas(statefulProcessor=ShardStates(), outputStructType=TALLY, outputMode="Append", timeMode="None")


RECONCILED = "kind string, reason string, files long, bytes long, batch int"


def reconcile(total_shards: int, path: str):
    """For foreachBatch over shard_changes(): keeps the tally, one row a micro-batch, and tells what follows from it as events.

    A ProgressSync when rows or bytes of completed shards are more than was told, so that counters that missed something heal
    upward; JobCompleted or JobFailed when all shards are terminal, once. A micro-batch that runs again leaves the same rows.
    """

    def batch(changes: DataFrame, n: int) -> None:
        spark, names = changes.sparkSession, [f.partition(" ")[0] for f in TALLY.split(", ")]
        state = f"{TALLY}, told_rows long, told_bytes long, ended boolean"
        old = spark.read.schema(state).parquet(f"{path}/tally/batch={n - 1}").first() if n else None
        moved = changes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()  # one row
        now = {c: moved[c] + (old[c] if old else 0) for c in names}
        told, ended = ((old["told_rows"], old["told_bytes"]), old["ended"]) if old else ((0, 0), False)
        events = []
        if not ended and (now["rows_completed"] > told[0] or now["bytes_completed"] > told[1]):
            told = max(told[0], now["rows_completed"]), max(told[1], now["bytes_completed"])
            events.append(("ProgressSync", None, *told, n))
        if not ended and now["completed"] + now["failed"] == total_shards:
            ended = True
            events.append(("JobFailed", f"{now['failed']} of {total_shards} shards failed", None, None, n) if now["failed"] else ("JobCompleted", "ok", None, None, n))
        spark.createDataFrame([(*now.values(), *told, ended)], state).write.mode("overwrite").parquet(f"{path}/tally/batch={n}")
        spark.createDataFrame(events, RECONCILED).write.mode("overwrite").parquet(f"{path}/events/batch={n}")

    return batch


def reconciled(spark: Any, path: str) -> DataFrame:
    """The events that were told."""
    return spark.read.schema(RECONCILED.rpartition(",")[0]).option("recursiveFileLookup", True).parquet(f"{path}/events")


class Eviction(StatefulProcessor):
    """State of a worker goes when it has been disconnected and silent for so long; no other state ever goes by time. The workers of a
    slot are one value, and its timer is that of the disconnected one that has been silent for longest."""

    def __init__(self, hours: float):
        self.idle = int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "armed long, states binary")

    def _load(self) -> tuple[int | None, dict]:
        armed, states = self.state.get() if self.state.exists() else (None, None)
        return armed, pickle.loads(states) if states is not None else {}

    def _keep(self, armed: int | None, known: dict) -> None:
        """Store the slot; its timer is set for the disconnected worker that has been silent for longest."""
        oldest = min((at for state, at, _ in known.values() if state == "Disconnected"), default=None)
        if armed != oldest:
            if armed is not None:
                self.handle.deleteTimer(armed + self.idle)
            if oldest is not None:
                self.handle.registerTimer(oldest + self.idle)
        self.state.update((oldest, pickle.dumps(known)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        armed, known = self._load()
        for r in _rows(rows, ["seq"]):
            state, at, seq = known.get(r.worker_id) or (None, 0, -1)
            at = max(at, int(r.at))
            if r.seq > seq:
                seq = int(r.seq)
                state = {"WorkerLeft": "Disconnected", "WorkerFenced": "Fenced", "WorkerJoined": "Idle", "WorkerRecovered": "Idle"}.get(r.kind, r.to_state if r.kind == "WorkerStateChanged" and r.to_state else state)
            known[r.worker_id] = (state, at, seq)
        self._keep(armed, known)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        armed, known = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        gone = [(w, at) for w, (state, at, _) in known.items() if state == "Disconnected" and at + self.idle <= now]
        for w, _ in gone:
            del known[w]
        self._keep(None if armed is not None and armed + self.idle == expiredTimerInfo.getExpiryTimeInMs() else armed, known)
        yield pd.DataFrame(gone, columns=["worker_id", "last_ms"])


def evictions(events: DataFrame, hours: float = 24, late: str = LATE) -> DataFrame:
    """worker_id, last_ms: disconnected workers when they have been idle for so long; fenced ones stay."""
    rows = events.where("worker_id is not null").withWatermark("event_at", late).select("worker_id", "seq", "kind", "to_state", "event_at", nearest_millis(), _slot("worker_id"))
    return _keyed(rows, "slot").transformWithStateInPandas(statefulProcessor=Eviction(hours), outputStructType="worker_id string, last_ms long", outputMode="Append", timeMode="EventTime")
