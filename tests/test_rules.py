"""Rules of the estate and the run on small tables, against values worked out by hand or by plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.operators import inventory as I
from tidemark.operators import reconcile as R
from tidemark.sources import tables as S

CATALOG = "shard_index int, row_id long, path string, size long, mode long, file_type int, mtime_sec long, mtime_nsec long, atime_sec long, atime_nsec long, uid long, gid long, nlink long, inode long, fsid long, allocated_blocks long"


def catalog(spark, *rows):
    """Rows of (row_id, path, size, inode, fsid) and what else differs from a plain file."""
    plain = dict(shard_index=0, mode=0o100644, file_type=1, mtime_sec=5, mtime_nsec=123, atime_sec=None, atime_nsec=None, uid=1, gid=2, nlink=2, allocated_blocks=None)
    names = [f.split()[0] for f in CATALOG.split(", ")]
    full = [plain | dict(zip(("row_id", "path", "size", "inode", "fsid"), r)) | more for *r, more in rows]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in full], CATALOG)


def test_attribute_times_keep_their_nanoseconds(spark):
    df = catalog(spark, (0, "/a", 1, 1, 1, dict(atime_sec=5, atime_nsec=9)), (1, "/b", 1, 2, 1, dict(atime_sec=6)), (2, "/c", 1, 3, 1, {}), (3, "/d", 1, 4, 1, dict(mtime_sec=None, uid=None)))
    got = [r["a"] for r in df.orderBy("row_id").select(I.attr_plan().alias("a")).collect()]
    own = "chown:1:2;chmod:420;utimes:"
    assert got == [own + "5.000000009:5.000000123", own + "6.000000000:5.000000123", own + "5.000000123:5.000000123", "chmod:420"]


def test_profile_tells_file_systems_apart(spark):
    df = catalog(spark, (0, "/a", 100, 7, 1, {}), (1, "/b", 100, 7, 1, {}), (2, "/d/c", 50, 7, 2, dict(allocated_blocks=0)), (3, "/e", 30, None, 1, {}), (4, "/f", 30, None, 1, {}), (5, "/g", 9, 8, None, {}), (6, "/h", 9, 8, None, {}))
    rows = {(r["level"], r["depth"]): r for r in I.estate_profile(df).collect()}
    whole = rows[15, None]
    assert (whole["n"], whole["bytes"], whole["bytes_once"], whole["sparse_bytes"]) == (7, 328, 100 + 50 + 60 + 9, 50)
    assert (rows[13, 2]["bytes_once"], rows[13, 1]["n"]) == (50, 6)


def test_microseconds_of_far_dates(spark):
    values = [0, -1, -1_000_000, 9_007_199_254_740_993, -9_007_199_254_740_993, 253_402_300_799_999_999, None]
    got = spark.createDataFrame([(v,) for v in values], "us long").select(*I.split_us(F.col("us"))).collect()
    assert [tuple(r) for r in got] == [(v // 10**6, v % 10**6 * 1000) if v is not None else (None, None) for v in values]


def test_batches_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(s, (s << 40) + k, "/x", rng.choice([0, 1, 10, 99, 100, 101, 500, None])) for s in range(3) for k in range(700)]
    df = spark.createDataFrame(rows, "shard_index int, row_id long, path string, size long").repartition(5)
    want, shard = {}, None
    for s, i, _, size in rows:
        if s != shard:
            shard, batch, files, held = s, 0, 0, 0
        elif files >= 20 or held + (size or 0) > 300:
            batch, files, held = batch + 1, 0, 0
        files, held = files + 1, held + (size or 0)
        want[i] = batch
    assert {r["row_id"]: r["batch"] for r in I.assign_batches(df, 300, 20).collect()} == want


OBSERVED = "path string, file_type int, size long, mode int, uid long, gid long, mtime_sec long, mtime_nsec long, ctime_sec long, ctime_nsec long, dev int, ino long, nlink long"


def test_a_change_time_alone_is_seen(spark):
    row = ("/f", 1, 5, 420, 1, 1, 10, 2, 20, 3, 1, 7, 1)
    before = [row, ("/d", 2, *row[2:]), ("/same", *row[1:]), ("/moved", *row[1:])]
    after = [(*row[:8], 21, *row[9:]), ("/d", 2, *row[2:9], 4, *row[10:]), before[2], ("/moved", *row[1:11], 8, 1)]
    got = {r["path"]: (r["finding"], r["changes"]) for r in I.stability_audit(spark.createDataFrame(before, OBSERVED), spark.createDataFrame(after, OBSERVED)).collect()}
    assert got == {"/f": ("torn_copy", "ctime 20.000000003 -> 21.000000003"), "/d": ("unstable_directory", "ctime 20.000000003 -> 20.000000004"), "/moved": ("replaced", "identity 1:7 -> 1:8")}


def test_paths_that_are_no_text(spark):
    """Paths, targets and groups as bytes, through pairing, differences and the order of the report."""
    raw = [b"\xff/a", b"\xff/b", b"ok"]
    rows = [(side, p, 3 if p == b"ok" else 1, 1, 420, 1, None if side else 5, 10, 1500, side, 7, 2, (b"\xfe" + bytes([side])) if p == b"ok" else None) for side in (0, 1) for p in raw if (side, p) != (1, raw[1])]
    df = spark.createDataFrame(rows, "side int, path binary, file_type int, size long, mode int, uid long, gid long, mtime_sec long, mtime_nsec long, dev int, ino long, nlink long, symlink_target binary")
    got = sorted((bytes(r["path"]), r["kind"], r["expected"], r["observed"]) for r in R.compare_entries(df).collect())
    seen = '{"file_type":1,"size":1,"mode":420,"uid":1,"gid":5,"mtime_sec":10,"mtime_nsec":1500,"symlink_target_b64":null,"hardlink_group_b64":"/y9h"}'
    owner = ('{"uid":1,"gid":5}', '{"uid":1,"gid":null}')
    assert got == sorted([(raw[1], "missing_destination", seen, None), (raw[0], "owner", *owner), (raw[0], "hardlink_group", "/y9h", None), (b"ok", "owner", *owner), (b"ok", "symlink_target", "/gA=", "/gE=")])
    assert [bytes(r["path"]) for r in R.sort_raw_path(df.where("side = 0")).collect()] == [b"ok", *raw[:2]]


def events(spark, n, **columns):
    rows = [(k + 1, "j", "w", "ProgressDelta") for k in range(n)]
    df = spark.createDataFrame(rows, "seq long, job_id string, worker_id string, kind string").withColumn("event_at", F.timestamp_seconds("seq"))
    return df.withColumns({name: F.lit(v) for name, v in columns.items()})


def test_events_of_a_newer_schema_are_refused(spark, tmp_path):
    S.write_events(events(spark, 10, schema_version=S.SCHEMA_VERSION + 1), f"{tmp_path}/new")
    with pytest.raises(Exception, match="newer schema"):
        S.read_events(spark, f"{tmp_path}/new").collect()


def test_chunks_before_the_cursor_are_not_read(spark, tmp_path):
    S.write_events(events(spark, 100), f"{tmp_path}/e", chunk=10)
    for since, first in ((0, 1), (9, 10), (10, 11), (55, 56), (99, 100), (100, 101)):
        df = S.read_events(spark, f"{tmp_path}/e", since=since)
        assert sorted(r["seq"] for r in df.collect()) == list(range(first, 101))
    for f in (tmp_path / "e" / "start_seq=21").glob("part-*"):
        f.write_text("not json")
    assert S.read_events(spark, f"{tmp_path}/e", since=31).count() == 69
    with pytest.raises(Exception):
        S.read_events(spark, f"{tmp_path}/e", since=30).collect()


def test_snapshots_keep_their_last_versions(spark, tmp_path):
    for v in range(1, 6):
        S.write_state({"jobs": spark.range(v)}, str(tmp_path), v, keep=3)
    assert S.state_history(spark, str(tmp_path)) == [5, 4, 3] and S.read_state(spark, str(tmp_path), "jobs").count() == 5 and S.read_state(spark, str(tmp_path), "jobs", 3).columns == ["id"]
    spark.range(1).withColumn("_schema_version", F.lit(S.SCHEMA_VERSION + 1)).write.parquet(f"{tmp_path}/version=9/jobs")
    with pytest.raises(Exception, match="newer schema"):
        S.read_state(spark, str(tmp_path), "jobs").collect()


def test_scratch_tables_go_when_they_are_cleared(spark):
    at = scratch.mark()
    df = scratch.materialise(spark.range(5), "gone")
    assert df.count() == 5
    scratch.clear(spark, at)
    assert scratch.mark() == at
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0])


def test_a_copy_plan_deals_rows_twice(spark):
    """Once for the batches, once for all windows inside them."""
    df = catalog(spark, *[(k, f"/d{k % 3}/f{k}", 10 * k, k // 2, 1, {}) for k in range(40)])
    plan = I.copy_plan(df, 100, 5)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert sorted(r["spread_order"] for r in plan.where("batch = 0").collect()) == [1, 2, 3, 4, 5]
