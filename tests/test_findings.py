"""What reviews found, one test a finding."""

from pyspark.sql import functions as F

from tidemark.plans.sources import src_legacy_scan
from tidemark.plans.streams import replay
from tidemark.streaming import events as S
from tidemark.streaming import live


def test_a_scan_of_uneven_shards_keeps_a_file_a_shard(spark):
    # A shard of half of all rows draws several bounds of a range partitioner to itself.
    uid = F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 8).cast("int")
    scan = spark.range(40_000).select(F.concat(F.lit("/export/"), F.col("id").cast("string")).alias("path"), F.lit("text/plain").alias("file_type"), F.lit(1).cast("long").alias("size"), uid.alias("uid"))
    scan = scan.unionByName(scan.where("uid = 5").withColumns({"uid": F.lit(6), "path": F.concat("path", F.lit("x"))}).limit(3)).unionByName(scan.limit(3).withColumn("uid", F.lit(2))).unionByName(scan.limit(2).withColumn("uid", F.lit(4))).unionByName(scan.limit(2).withColumn("uid", F.lit(0)))
    want = {(r["uid"], r["n"]) for r in scan.groupBy("uid").agg(F.count("*").alias("n")).collect()}
    found = src_legacy_scan(scan.withColumns({"shard_index": F.lit(0), "row_in_shard": F.lit(0)})).collect()
    assert {(r["shard_index"], r["n"]) for r in found} == want and all(r["last_row"] == r["n"] - 1 for r in found)


def at_micros(spark, rows):
    data = [(k + 1, w, kind, 1_700_000_000_000_000 + at) for k, (w, kind, at) in enumerate(rows)]
    df = spark.createDataFrame(data, "seq long, worker_id string, kind string, at long")
    return df.select("seq", "worker_id", "kind", F.timestamp_micros("at").cast("timestamp_ntz").alias("event_at"), F.lit(None).cast("string").alias("to_state"))


HOUR = 3_600_000_000


def test_a_replay_keeps_microseconds_and_silence_is_told_to_the_nearest_millisecond(spark):
    df = at_micros(spark, [("a", "ProgressDelta", 1_499), ("b", "ProgressDelta", 1_500), ("z", "ProgressDelta", HOUR)])
    told = S.run_available(live.liveness(replay(df, 2), 90, "1 seconds"), "liveness").collect()
    assert {(r["worker_id"], r["last_ms"] - 1_700_000_000_000) for r in told} == {("a", 1), ("b", 2)}


def test_evictions_are_told_to_the_nearest_millisecond(spark):
    df = at_micros(spark, [("a", "WorkerLeft", 1_499), ("b", "WorkerLeft", 1_500), ("z", "WorkerJoined", 30 * HOUR)])
    told = S.run_available(live.evictions(replay(df, 2), 24, "1 seconds"), "evictions").collect()
    assert {(r["worker_id"], r["last_ms"] - 1_700_000_000_000) for r in told} == {("a", 1), ("b", 2)}


def test_silence_is_told_whatever_the_order_of_times_along_seq(spark):
    from tidemark.plans import streams

    # Worker a's only event has the last seq and the first time: in order of seq it would come later than the watermark.
    df = at_micros(spark, [("y", "ProgressDelta", 29 * HOUR), ("z", "ProgressDelta", 30 * HOUR), ("a", "ProgressDelta", 0)])
    assert {r["worker_id"] for r in streams.st_liveness_live(df).collect()} == {"a"}
    left = at_micros(spark, [("y", "WorkerLeft", 29 * HOUR), ("z", "WorkerLeft", 30 * HOUR), ("a", "WorkerLeft", 0)])
    assert {r["worker_id"] for r in streams.st_evict_live(left).collect()} == {"a"}


def test_silent_and_gone_workers_are_kept_by_slots(spark, tmp_path):
    # One state a slot, and none a worker. When the timers fire 500 have come back, and are silent since then.
    rows = [(f"w{k}", "WorkerLeft", k * 1000) for k in range(2500)] + [(f"w{k}", "WorkerJoined", 20 * HOUR + k) for k in range(500)] + [("z", "WorkerJoined", 40 * HOUR)]
    for made, told in ((lambda s: live.liveness(s, 10 * 3600), 2500), (lambda s: live.evictions(s, 24), 2000)):
        out = str(tmp_path / str(told))
        stream = replay(at_micros(spark, rows), 4)
        query = made(stream).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}-checkpoint").format("parquet").option("path", out).start()
        query.awaitTermination()
        states = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)
        found = spark.read.parquet(out)
        assert found.count() == told == found.select("worker_id").distinct().count() and states <= live.SLOTS
        assert found.where(F.col("last_ms") >= 1_700_000_000_000 + 20 * HOUR // 1000).count() == told - 2000


def test_a_replay_of_larger_micro_batches_has_as_many_more_files(spark, monkeypatch):
    from tidemark.plans import streams

    monkeypatch.setattr(streams, "CHUNK_ROWS", 100)
    df = at_micros(spark, [(f"w{k}", "WorkerJoined", k) for k in range(2400)])
    for rows, batches in ((100, 24), (800, 3)):
        query = streams.replay(df, rows=rows).select("seq").writeStream.trigger(availableNow=True).format("noop").start()
        query.awaitTermination()
        sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
        assert len(sizes) == batches and sum(sizes) == 2400


def test_a_tally_of_claims_takes_a_row_a_bucket_and_not_a_row_a_shard(spark, tmp_path):
    shards = spark.range(9000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("shard"), F.lit(2).cast("long").alias("n_rows"), F.lit(3).cast("long").alias("n_bytes"))
    # First all fail or are active, then a third completes, later claims are cleared to active, and earlier ones change nothing.
    state = lambda *when: F.element_at(F.array(*map(F.lit, when)), F.pmod(F.xxhash64("shard"), F.lit(3)).cast("int") + 1)
    for at, names in ((10, ("failed", "failed", "active")), (20, ("completed", "active", "failed")), (5, ("failed", "failed", "completed"))):
        rows = shards.select("shard", state(*names).alias("state"), F.timestamp_seconds(F.lit(at)).alias("claimed_utc"), F.lit("e").alias("claim_etag"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path))
    of = {r["k"]: r["count"] for r in shards.groupBy(F.pmod(F.xxhash64("shard"), F.lit(3)).alias("k")).count().collect()}
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    found = S.run_available(live.shard_changes(stream, shards), "tally")
    sums = found.agg(*[F.sum(c) for c in found.columns]).first()
    assert tuple(sums) == (of[0] + of[2], 0, of[1], 2 * (of[0] + of[2]), 3 * (of[0] + of[2]))
    assert found.count() <= 3 * 3


def test_workers_of_a_slot_are_told_in_one_call(spark):
    # One call a slot of workers, and none a worker: what is told of them comes in as few pieces as there are slots.
    assert live.SLOTS == 512
    df = at_micros(spark, [(f"w{k}", "WorkerJoined", k * 1000) for k in range(3000)]).withColumns({"job_id": F.lit("j"), **{c: F.lit(None).cast(t) for c, t in dict(to_phase="string", mismatches="long", reason="string", files_delta="long", bytes_delta="long", sync_files="long", path="string", retryable="boolean").items()}, "class": F.lit(None).cast("string")})
    before = live.state_of(S.run_available(live.live_state(replay(df.where("seq <= 2000"), 1)), "half", "update")).localCheckpoint()
    after = S.run_available(live.live_state(replay(df, 2), before), "rest", "update").drop("batch")
    assert after.count() == 1000 and live.state_of(after.unionByName(before)).where("state = 'Idle'").count() == 3000


def test_rows_of_a_shard_are_numbered_without_one_task_a_shard(spark):
    from tidemark.plans import fixtures

    data = "/root/testdata/sf0.001"
    for name, window in (("scan", "row_in_shard"), ("catalog", "row_id")):
        frame = fixtures.frame(spark, data, name)
        want = spark.sql(fixtures.VIEWS[name], obs_source=fixtures.frame(spark, data, "obs_source"))
        assert frame.schema[window].dataType == want.schema[window].dataType and frame.columns == want.columns
        assert sorted(frame.select("path", window).collect()) == sorted(want.select("path", window).collect())
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "row_number" not in plan


def test_the_near_copies_of_the_pipeline_are_found_by_simhash(spark):
    import random

    import corpus_pipeline as P
    from tidemark.llm.simhash import drop_near_duplicates, fingerprint

    rng = random.Random(8)
    texts = []
    for i in range(60):
        w = [f"x{rng.randrange(50_000)}" for _ in range(300)]
        texts += [" ".join(w), " ".join([*w[:-1], "y"]) if i % 3 else " ".join(w[:-30]), " ".join(w).upper()]
    # A repeated line with one word between: the shingle sets have 13 of 18 (0.72) in common, and few of the repeats differ.
    unit = [f"z{i}" for i in range(13)]
    texts += [" ".join(unit * 60), " ".join([*unit * 30, "q", *unit * 30]), texts[0], None, "", " \n"]
    ids = [*range(1, len(texts)), None]
    fps = [fingerprint((t or "").encode()) for t in texts]
    root = list(range(len(texts)))  # of the smallest place, which is that of the smallest id
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    want = sorted(ids[r] for r in set(root))
    assert sorted(r["doc_id"] for r in drop_near_duplicates(docs.unionByName(docs)).collect()) == want and 60 < len(want) < 120
    kept = [r["doc_id"] for r in P.drop_near_copies(spark, docs.unionByName(docs), "").collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= set(want)
    odd = texts.index(" ".join([*unit * 30, "q", *unit * 30])) + 1
    assert root[odd - 1] == odd - 2 and odd not in kept  # only SimHash tells
    assert drop_near_duplicates(docs.limit(0)).count() == 0


def test_superseded_reads_no_frame_to_the_end_of_a_machine(spark):
    # A frame to the end is read anew for every row: the square of a machine's registrations.
    from tidemark.operators import runstate as R

    rows = [(k, f"w{k}", "j", f"h-{100 + p}", 100 + p, 7) for k, p in enumerate([0, 0, 1, 1, 1, 0, 2, 2])]
    found = R.superseded(spark.createDataFrame(rows, "seq long, worker_id string, job_id string, host string, pid long, start_time long"))
    assert {r["worker_id"]: r["by"] for r in found.collect()} == {"w0": "w2", "w1": "w2", "w2": "w5", "w3": "w5", "w4": "w5", "w5": "w6"}
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()


def test_the_source_view_shuffles_numbers_once_and_sorts_nothing_to_group(spark):
    from tidemark.plans import fixtures

    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    more = lineitem.withColumn("l_quantity", F.col("l_quantity") + F.col("l_partkey") % 3 - 1)
    lineitem = lineitem.unionByName(more)
    want = spark.sql(fixtures.VIEWS["obs_source"], lineitem=lineitem)
    found = fixtures._source_rows(lineitem, want.columns)
    assert [f.dataType for f in found.schema] == [f.dataType for f in want.schema]
    assert sorted(found.collect(), key=lambda r: r["path"]) == sorted(want.collect(), key=lambda r: r["path"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange ") == 1 and "SortAggregate" not in final


def test_a_batch_with_crowded_anchors_reads_its_words_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tidemark.llm import substring as S

    rng = np.random.default_rng(3)
    line = " ".join(f"c{i}" for i in range(14))
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 9_000, 30)), line, *(f"w{x}" for x in rng.integers(0, 9_000, 30))]) for _ in range(40)]
    data = pa.table({"__id": np.arange(40), "__key": np.arange(40), "__batch": np.zeros(40, dtype=np.int64), "text": texts})
    replies = S._reply(5)(S._ask(13, 1)(data))
    made, init = [], S.Batch.__init__

    def counted(self, *args):
        made.append(self)
        init(self, *args)

    monkeypatch.setattr(S.Batch, "__init__", counted)
    S._send(13, 1)(data, replies)
    assert len(made) == 1
    # As if it had been read anew with the crowded anchors.
    crowded = np.unique(made[0].source_anchor[made[0].source_anchor != made[0].anchor])
    fresh = S.Batch(np.arange(40), [t.encode() for t in texts], 13, crowded)
    assert len(crowded) and (fresh.anchor == made[0].anchor).all() and (fresh.run_at == made[0].run_at).all() and (fresh.distinct == made[0].distinct).all()


def test_a_copy_plan_in_blocks_looks_no_row_up_in_a_list_of_starts(spark):
    # Every row was compared with each start in its slice, one by one.
    from tidemark.operators import inventory as I
    from tidemark.plans import fixtures

    catalog = fixtures.frame(spark, "/root/testdata/sf0.001", "catalog")
    whole = I.copy_plan(catalog, 1 << 20, 10)
    blocks = I.copy_plan(catalog, 1 << 20, 10, block_rows=320)
    assert blocks.columns == whole.columns and sorted(map(str, blocks.collect())) == sorted(map(str, whole.collect()))
    plan = blocks._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(shard_index") == 1  # of the rows; what begins where comes from small tables


def test_pairs_with_groups_shuffle_whole_rows_once_and_equal_those_grouped_before(spark):
    import random

    from tidemark.operators import reconcile as R

    rng = random.Random(4)
    names = [*"abcdefghijklmnopqrst", *(f"d{k}" for k in range(300))]
    # Paths that come twice, on one inode or on two; inodes that other types, rows of one link and both sides have; nulls.
    rows = [(side, rng.choice(names), rng.choice([1, 1, 1, 2, 3, 4]), rng.choice([5, 6]), 0o644, 7, rng.choice([8, 9]), 10, rng.choice([11, 1012, 1013]), rng.choice([1, 2, None]), rng.choice([*range(40), None]), rng.choice([1, 2, 2, None]), rng.choice(["x", "y", None])) for side in (0, 1) for _ in range(200)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "side int, path string, file_type int, size long, mode int, uid long, gid long, mtime_sec long, mtime_nsec long, dev int, ino long, nlink long, symlink_target string")
    want, found = R.pair_sides(R.with_groups(df)), R.pair_sides(df, groups=True)
    assert sorted(found.columns) == sorted(want.columns)
    text = lambda pairs: sorted(map(str, pairs.select(*want.columns).collect()))
    assert text(found) == text(want) and found.where("src_group_root is not null").count() > 20
    assert sorted(map(str, R.compare_entries(df).collect())) == sorted(map(str, R.diff_pairs(want).collect()))
    # By inode go five columns of a file, by path its whole row.
    wide = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in line]
    assert len(wide) == 2 and all("mtime" not in line and "size" not in line for line in wide)


def test_the_source_view_shuffles_no_path_and_the_other_view_is_not_written(spark):
    from tidemark.plans import fixtures

    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    found = fixtures._source_rows(lineitem, spark.sql(fixtures.VIEWS["obs_source"], lineitem=lineitem).columns)
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Exchange rangepartitioning" in line)
    assert "concat" not in plan[at + 1] and "path" not in plan[at + 1]
    assert fixtures.frame(spark, "/root/testdata/sf0.001", "obs_destination").inputFiles() == fixtures.frame(spark, "/root/testdata/sf0.001", "obs_source").inputFiles()


def test_a_report_reads_its_pairs_once(spark):
    from tidemark.operators import reconcile as R
    from tidemark.plans import fixtures
    from tidemark.plans.reconcile import sink_report

    entries = fixtures.frame(spark, "/root/testdata/sf0.001", "entries")
    pairs, diffs = R.pair_sides(entries, groups=True), R.compare_entries(entries)
    here = {r["place"]: r["count"] for r in pairs.groupBy("place").count().collect()}
    found = sink_report(entries)
    assert tuple(found.first()) == (here["source"] + here["both"], here["destination"] + here["both"], here["both"], diffs.count(), diffs.select("path").distinct().count())
    assert tuple(sink_report(entries.limit(0)).first()) == (0, 0, 0, 0, 0)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join FullOuter") == 1
