import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import paths as P
from tidemark.operators import eventlog as E
from tidemark.operators import inventory as I
from tidemark.operators import latency as L
from tidemark.operators import runstate as R


def test_progress_fold_equals_a_loop(spark):
    rng = random.Random(3)
    events, want = [], {}
    for seq in range(1, 9000):
        key = rng.choice("abb")
        if rng.random() < 0.8:
            events.append((seq, key, 1, None))
            want[key] = want.get(key, 0) + 1
        else:
            sync = rng.randrange(0, 4000)
            events.append((seq, key, None, sync))
            want[key] = max(want.get(key, 0), sync)
    df = spark.createDataFrame(events, "seq long, job_id string, files_delta long, sync_files long").repartition(5)
    assert {r["job_id"]: r["total"] for r in E.progress(df, "job_id", "files_delta", "sync_files").collect()} == want


def test_phases():
    assert E.fold_phases([(1, "ProgressDelta", None), (2, "JobPaused", None), (3, "JobResumed", None)])[0] == "Copying"
    assert E.fold_phases([(1, "JobPaused", None), (2, "JobResumed", None)])[0] == "Planned"
    assert E.fold_phases([(1, "JobCompleted", None), (2, "JobPhaseChanged", "Copying")])[0] == "Completed"
    assert E.fold_phases([(1, "JobPhaseChanged", "Verifying"), (2, "JobPhaseChanged", "Scanning")])[0] == "Verifying"
    assert E.fold_phases([(1, "JobResumed", None)]) == ("Planned", [])
    long = [(i, "JobPaused" if i % 2 else "JobResumed", None) for i in range(1, 700)]
    assert len(E.fold_phases(long)[1]) == E.HISTORY


def test_streamed_phases_equal_the_fold(spark):
    rng = random.Random(5)
    kinds = ["ProgressDelta", "ProgressDelta", "JobPaused", "JobResumed", "JobPhaseChanged", "JobCompleted"]
    rows = [(s, f"j{rng.randrange(30)}", rng.choice(kinds), rng.choice(E.PIPELINE)) for s in range(600)]
    got = {r["job_id"]: r["phase"] for r in E.job_phases(spark.createDataFrame(rows, "seq long, job_id string, kind string, to_phase string")).collect()}
    for job in got:
        assert got[job] == E.fold_phases([(s, k, t) for s, j, k, t in rows if j == job])[0]


def test_error_samples_let_an_evicted_path_return(spark):
    order = [*range(11), 0]
    rows = [(s, "j", "ErrorEmitted", "c", f"/{p}", False) for s, p in enumerate(order)]
    df = spark.createDataFrame(rows, "seq long, job_id string, kind string, class string, path string, retryable boolean")
    assert E.error_samples(df).first()["paths"] == [f"/{p}" for p in (2, 3, 4, 5, 6, 7, 8, 9, 10, 0)]


def test_error_classes_beyond_the_cap_share_a_bucket(spark):
    rows = [(s, "j", "ErrorEmitted", f"c{s % 70}", "/p", s % 2 == 0) for s in range(140)]
    got = {r["class"]: r["count"] for r in E.error_buckets(spark.createDataFrame(rows, "seq long, job_id string, kind string, class string, path string, retryable boolean")).collect()}
    assert len(got) == 65 and got[E.OVERFLOW] == 12


@pytest.mark.parametrize("us, bucket", [(0, 0), (1, 0), (2, 4), (3, 6), (4, 8), (7, 11), (1 << 24, 99), ((1 << 24) - 1, 95)])
def test_latency_buckets(spark, us, bucket):
    b, top = spark.range(1).select(L.bucket(F.lit(us)), L.upper(L.bucket(F.lit(us)))).first()
    assert b == bucket and top >= min(us, 1 << 24)


def test_times_before_the_epoch(spark):
    a, b = I.split_us(F.lit(-1))
    assert tuple(spark.range(1).select(a, b).first()) == (-1, 999999000)


def test_row_ids_and_types(spark):
    df = spark.createDataFrame([(5, 9)], "s long, r long").select(I.row_id(F.col("s"), F.col("r")).alias("i"))
    assert tuple(df.select(I.split_row_id(F.col("i")).alias("p")).select("p.*").first()) == (5, 9)
    assert [spark.range(1).select(I.type_from_mode(F.lit(m))).first()[0] for m in (0o100644, 0o040755, 0o120777, 0o010000, 0)] == [1, 2, 3, 4, 0]


@pytest.mark.parametrize("path, root, want", [("/export/a", "/export", "/a"), ("/export", "/export/", "/"), ("/a", "/", "/a")])
def test_strip_root(spark, path, root, want):
    assert spark.createDataFrame([(path,)], "p string").select(P.strip_root(F.col("p"), root)).first()[0] == want


def test_outside_the_root_is_an_error(spark):
    with pytest.raises(Exception, match="outside the root"):
        spark.createDataFrame([("/exported/a",)], "p string").select(P.strip_root(F.col("p"), "/export")).collect()


def test_paths(spark):
    safe = {"/": True, "/a/b": True, "a": False, "/a//b": False, "/a/./b": False, "/..": False, "/a/": False, "/a\0": False, "/.a": True}
    df = spark.createDataFrame(list(safe.items()), "p string, want boolean").select("p", "want", P.is_safe_path(F.col("p")).alias("got"))
    assert [r["p"] for r in df.where("got <> want").collect()] == []
    names = {".b.h.12.partial": True, ".b.c.h.1.partial": True, ".h.1.partial": False, ".b.h.x.partial": False, "b.h.1.partial": False, ".b..1.partial": False}
    df = spark.createDataFrame(list(names.items()), "n string, want boolean")
    assert df.where(P.is_partial_name(F.col("n")) != F.col("want")).count() == 0


def test_greedy_batches_equal_a_loop(spark):
    rng = random.Random(1)
    rows = [(s, s * 1000 + i, rng.randrange(0, 60)) for s in range(3) for i in range(200)]
    want = {}
    for s in range(3):
        batch = files = held = 0
        for _, r, size in [x for x in rows if x[0] == s]:
            if files and (files >= 4 or held + size > 100):
                batch, files, held = batch + 1, 0, 0
            want[r], files, held = batch, files + 1, held + size
    got = I.assign_batches(spark.createDataFrame(rows, "shard_index int, row_id long, size long").orderBy(F.rand()), 100, 4).collect()
    assert {r["row_id"]: r["batch"] for r in got} == want


def test_backpressure_doubles_and_recovers(spark):
    history = [("h", 0, 0, "x"), ("h", 10, 1, "x"), ("h", 400, 2, "x"), ("h", 1200, 3, "x"), ("h", 2500, 4, None), ("h", 2600, 5, "x")]
    got = R.backpressure(spark.createDataFrame(history, "host string, at long, seq long, degraded string")).orderBy("at").collect()
    assert [r["state"] for r in got] == ["tripped", "straggler", "probe_failed", "probe_failed", "recovered", "tripped"]
    assert [r["cooldown_seconds"] for r in got] == [300, 300, 600, 1200, 0, 300]


LIVENESS = [  # claim age, held etag, heartbeat age, interval -> reclaimable
    (10, None, None, None, False), (100, None, None, None, True), (100, "c", 100, 0, False), (10, "x", 5, 30, False), (100, "x", 5, 30, True), (100, None, 5, 30, True), (100, "c", 50, 30, False), (100, "c", 61, 30, True), (100, "c", 60, 30, False),
]


@pytest.mark.parametrize("claim_age, held, beat_age, interval, want", LIVENESS)
def test_liveness(spark, claim_age, held, beat_age, interval, want):
    now = "2024-01-01 01:00:00"
    at = lambda age: F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(age))
    claims = spark.range(1).select(F.lit("s").alias("shard"), F.lit("h").alias("host"), at(claim_age).alias("claimed_utc"), F.lit("c").alias("claim_etag"), F.lit("active").alias("state"))
    progress = spark.range(1).select(F.lit("h").alias("host"), at(beat_age or 0).alias("heartbeat_utc"), F.lit(held).cast("string").alias("held_etag"), F.lit(interval or 0).alias("heartbeat_sec"))
    assert R.reclaimable(claims, progress if interval is not None else progress.limit(0), now, 30).first()["reclaimable"] is want


def spaced(rng, n, step):
    """Numbers far enough apart that slices, groups of slices and groups of groups are crossed."""
    seq, out = 0, []
    for _ in range(n):
        seq += rng.choice([1, 2, step])
        out.append(seq)
    return out


@pytest.mark.parametrize("step", [3, 5_000, 3_000_000_000])
def test_high_water_marks_and_gaps_across_slices(spark, step):
    rng = random.Random(11)
    rows = [(s, rng.choice(["w1", "w1", "w2", None]), rng.choice([None, rng.randrange(400), rng.randrange(400)])) for s in spaced(rng, 500, step)]
    df = spark.createDataFrame(rows, "seq long, worker_id string, client_seq long").repartition(5)
    high, want = {}, set()
    for s, w, c in rows:
        if c is None or c > high.get(w, -1):
            want.add(s)
        high[w] = max(high.get(w, -1), -1 if c is None else c)
    assert {r["seq"] for r in E.dedup_client(df).collect()} == want
    missing = set()
    for w in ("w1", "w2", None):
        own = [s for s, x, _ in rows if x == w]
        missing |= {(w, a + 1, b - 1) for a, b in zip(own, own[1:]) if b > a + 1}
    assert {tuple(r) for r in E.gaps(df.union(df.limit(50)), "worker_id").collect()} == missing


def test_rolling_rates_across_blocks(spark):
    rng, at, rows = random.Random(12), 0, []
    for s in range(400):
        at += rng.choice([0, 1, 5, 30, 61])
        rows.append((s, rng.choice("ab"), "ProgressDelta", rng.randrange(9), at))
    df = spark.createDataFrame(rows, "seq long, job_id string, kind string, files_delta long, at long").withColumn("event_at", F.timestamp_seconds("at"))
    got = {r["seq"]: r["files_s"] for r in E.rolling_rates(df, "job_id", 60).collect()}
    assert got == {s: sum(d for _, k, _, d, t in rows if k == j and u - 60 <= t <= u) / 60 for s, j, _, _, u in rows}


@pytest.mark.parametrize("step, created", [(3, False), (5_000, False), (5_000, True), (2_000_000, True)])
def test_phases_in_slices_equal_the_fold(spark, step, created):
    rng = random.Random(13)
    kinds = ["ProgressDelta", "ProgressDelta", "JobPaused", "JobResumed", "JobPhaseChanged", "VerifyStarted", "VerifyCompleted", *["JobCompleted"] * (step == 3), *["JobCreated"] * created]
    rows = [(s, rng.choice(["hot", "hot", "cold"]), rng.choice(kinds), rng.choice(E.PIPELINE)) for s in spaced(rng, 1500, step)]
    df = spark.createDataFrame(rows, "seq long, job_id string, kind string, to_phase string").repartition(4)
    got = {r["job_id"]: tuple(r)[1:] for r in E.job_phases(df, created).collect()}
    for job in ("hot", "cold"):
        own = [(s, k, t) for s, j, k, t in rows if j == job]
        if created:
            own = own[next(i for i, e in enumerate(own) if e[1] == "JobCreated") :]
        phase, history = E.fold_phases(own)
        first = lambda names: next((s for s, _, to in history if to in names), None)
        assert got[job] == (phase, len(history), first(["Copying"]), first(E.ENDED))


def test_phase_maps_follow_the_step():
    for kind in ("ProgressDelta", "JobPaused", "JobResumed", "JobCompleted", "JobCreated", "VerifyStarted"):
        assert E.phase_map(kind, None).shape == (len(E.PHASE_STATES),)
    paused = E.PHASE_STATES.index(("Paused", "Copying"))
    assert E.PHASE_STATES[E.phase_map("JobResumed", None)[paused]] == ("Copying", None)
    assert E.phase_map("JobPaused", None)[E.NO_JOB] == E.NO_JOB


def test_all_older_registrations_are_superseded(spark):
    rows = [(1, "A", "j", "h-1", 1, 10, None), (2, "B", "j", "h-1", 1, 10, None), (3, "C", "j", "h-2", 2, 20, None), (4, "D", "j", "h-1", 1, 10, None), (5, "E", "k", "h-2", 2, 30, None), (0, "Z", "j", "h-9", 9, 5, 1)]
    df = spark.createDataFrame(rows, "seq long, worker_id string, job_id string, host string, pid long, start_time long, left_seq long")
    assert {(r["worker_id"], r["by"]) for r in R.superseded(df).collect()} == {("A", "C"), ("B", "C"), ("C", "D")}


def test_a_manifest_digest_sees_every_entry(spark):
    rows = [(f"part-{i}", 10 + i, 100, None if i == 3 else f"e{i}") for i in range(40)]
    one = lambda r: tuple(R.build_manifest(spark.createDataFrame(r, "shard string, n_rows long, n_bytes long, etag string").repartition(3), "r").first())
    base = one(rows)
    assert base == one(rows[::-1]) and base[1:4] == (40, sum(r[1] for r in rows), 4000)
    digests = {base[4], one(rows + rows[:1])[4], one(rows + rows[:1] * 2)[4], one(rows[1:])[4], one([*rows[1:], ("part-0", 10, 100, "other")])[4]}
    assert len(digests) == 5


@pytest.mark.parametrize("max_bytes, max_files, block", [(300, 20, 64), (100, 4, 10), (50, 30, 40), (10_000, 7, 16)])
def test_batches_across_blocks_equal_a_loop(spark, max_bytes, max_files, block):
    rng = random.Random(max_files)
    rows = [(s, (s << 40) + k * rng.choice([1, 1, 3]), rng.choice([0, 1, 10, 49, 50, 51, 300, 500, None])) for s, n in ((0, 1500), (1, 3), (2, 64), (5, 400)) for k in range(n)]
    rows = sorted({r[1]: r for r in rows}.values())
    want, shard = {}, None
    for s, r, size in rows:
        if s != shard:
            shard, batch, files, held = s, 0, 0, 0
        elif files >= max_files or held + (size or 0) > max_bytes:
            batch, files, held = batch + 1, 0, 0
        want[r], files, held = batch, files + 1, held + (size or 0)
    df = spark.createDataFrame(rows, "shard_index int, row_id long, size long").withColumn("path", F.lit("/x")).repartition(6)
    got = I.assign_batches(df, max_bytes, max_files, block_rows=block)
    assert got.columns == [*df.columns, "batch"]
    assert {r["row_id"]: r["batch"] for r in got.collect()} == want


def test_exits_of_a_block():
    import numpy as np

    leaves, counts = I._exits(np.array([5, 5, 5, 5, 20, 1]), 4, 10, 3)
    # Starts at 0: 0-1, 2-3 and then beyond; at 1: 1-2, then 3 alone, as 20 does not fit; at 2: 2-3.
    assert leaves.tolist() == [0, 0, 0] and counts.tolist() == [2, 2, 1]
    leaves, counts = I._exits(np.array([1, 1, 1, 1]), 2, 10, 3)
    assert leaves.tolist() == [1, 2, 0] and counts.tolist() == [1, 1, 0]


def test_footers_are_read_by_their_ends(spark, tmp_path):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidemark.sources import footers
    from tidemark.sources import tables as S

    for k in range(70):
        table = pa.table({"a": pa.array([os.urandom(200) for _ in range(1000 if k else 0)])})
        stamps = {"shard_index": str(k), "pad": "x" * (100_000 if k == 3 else 1)} if k != 5 else {}
        pq.write_table(table.replace_schema_metadata(stamps), f"{tmp_path}/part-{k:03}.parquet")
    spark.dataSource.register(footers.FooterSource)
    read = spark.read.format("parquet_footers").load(str(tmp_path))
    rows = read.collect()
    assert read.rdd.getNumPartitions() == 2 and len({r["file"] for r in rows}) == 70
    assert max(r["bytes_read"] for r in rows if "part-003" not in r["file"]) <= footers.TAIL < max(r["bytes_read"] for r in rows)
    whole = spark.read.format("binaryFile").load(str(tmp_path)).select(F.sum("length")).first()[0]
    assert sum(r["bytes_read"] for r in {r["file"]: r for r in rows}.values()) < whole / 2
    assert {(r["file"][-16:], r["key"], r["value"], r["rows"]) for r in rows if r["key"] == "shard_index"} == {(f"part-{k:03}.parquet", "shard_index", str(k), 1000 if k else 0) for k in range(70) if k != 5}
    assert [r["key"] for r in rows if "part-005" in r["file"] and r["key"] not in (None, "ARROW:schema")] == []
    assert S.read_footers(spark, f"file://{tmp_path}").where("key = 'shard_index'").count() == 69
    assert not footers.reachable("viewfs://store/in/x")
    (tmp_path / "bad.parquet").write_bytes(b"not one")
    with pytest.raises(Exception, match="no Parquet file"):
        spark.read.format("parquet_footers").load(str(tmp_path)).collect()
