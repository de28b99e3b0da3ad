from pyspark.sql import functions as F

from tidemark.operators import reconcile as R
from tidemark.operators import sampling as S

COLUMNS = "side int, path string, file_type int, size long, mode long, uid long, gid long, mtime_sec long, mtime_nsec long, dev long, ino decimal(20,0), nlink long, symlink_target string"
BASE = dict(file_type=1, size=10, mode=0o100644, uid=1, gid=2, mtime_sec=5, mtime_nsec=123456789, dev=1, ino=7, nlink=1, symlink_target=None)


def entries(spark, *rows):
    out = []
    for side, path, changes in rows:
        r = BASE | {"dev": side + 1} | changes
        out.append((side, path, *[r[c] for c in ("file_type", "size", "mode", "uid", "gid", "mtime_sec", "mtime_nsec", "dev")], __import__("decimal").Decimal(r["ino"]), r["nlink"], r["symlink_target"]))
    return spark.createDataFrame(out, COLUMNS)


def kinds(df, **preserve):
    return sorted((r["path"], r["kind"]) for r in R.compare_entries(df, R.Preserve(**preserve)).collect())


def test_equal_sides_have_no_differences(spark):
    assert kinds(entries(spark, (0, "a", {}), (1, "a", {}))) == []


def test_times_compare_in_microseconds(spark):
    df = entries(spark, (0, "a", {}), (1, "a", {"mtime_nsec": 123456789 + 210}), (0, "b", {}), (1, "b", {"mtime_nsec": 123456789 + 1000}))
    assert kinds(df) == [("b", "mtime")]


def test_missing_and_unsupported(spark):
    df = entries(spark, (0, "a", {"file_type": 4}), (1, "b", {}))
    assert kinds(df) == [("a", "missing_destination"), ("a", "unsupported_feature"), ("b", "unexpected_destination")]


def test_every_kind_of_a_pair(spark):
    df = entries(spark, (0, "a", {}), (1, "a", {"size": 11, "mode": 0o100600, "uid": 9}), (0, "l", {"file_type": 3, "symlink_target": "x"}), (1, "l", {"file_type": 3}), (0, "t", {}), (1, "t", {"file_type": 2}))
    assert kinds(df) == [("a", "mode"), ("a", "owner"), ("a", "size"), ("l", "symlink_target"), ("t", "type")]
    assert kinds(df, mode=False, owner=False, times=False) == [("a", "size"), ("l", "symlink_target"), ("t", "type")]


def test_hardlinks_compare_by_members_not_inodes(spark):
    wide = 2**64 - 1
    same = entries(spark, *[(s, p, {"nlink": 2, "ino": wide - s}) for s in (0, 1) for p in ("a", "b")])
    assert kinds(same) == []
    split = entries(spark, *[(0, p, {"nlink": 2, "ino": wide}) for p in ("a", "b")], (1, "a", {"ino": 1}), (1, "b", {"ino": 2}))
    assert kinds(split) == [("a", "hardlink_group"), ("b", "hardlink_group")]
    assert {r["group_root"] for r in R.hardlink_groups(split).collect()} == {"a"}


def test_members_of_a_group_need_no_second_link(spark):
    df = entries(spark, (0, "a", {"nlink": 2}), (0, "b", {"nlink": 2}), (0, "c", {"nlink": 1}))
    assert {r["path"] for r in R.with_groups(df).where("group_root = 'a'").collect()} == {"a", "b", "c"}


def test_verdict_order(spark):
    counts, none, some = spark.createDataFrame([("size", 2)], "kind string, n long"), spark.createDataFrame([], "side int, path string"), spark.createDataFrame([(0, "x")], "side int, path string")
    assert R.verdict(counts, none, none).first()["status"] == "mismatched"
    assert R.verdict(counts, some, none).first()["status"] == "inconclusive"
    assert R.verdict(counts, some, none, failed=True).first()["status"] == "failed"
    assert R.verdict(counts.limit(0), none, none).first()["status"] == "passed"


def test_rank_layout(spark):
    import hashlib

    path = b"dir/\xff"
    want = hashlib.sha256(S.DOMAIN + (3).to_bytes(8, "big") + b"run" + (9).to_bytes(8, "big") + len(path).to_bytes(8, "big") + path).hexdigest()
    assert spark.createDataFrame([(bytearray(path),)], "path binary").select(S.rank("run", 9, F.col("path"))).first()[0] == want


def test_risk_is_never_evicted_and_the_rest_fills_up(spark):
    df = entries(spark, *[(s, f"f{i}", {}) for s in (0, 1) for i in range(20)])
    risk = spark.createDataFrame([(f"f{i}", "retried_shard") for i in range(5)] + [("nowhere", "migration_failure")], "path string, reason string")
    for target, n in ((3, 5), (5, 5), (8, 8), (50, 20)):
        chosen = S.select_sample(df.repartition(7), risk, "r", 1, target).collect()
        assert len(chosen) == n and sum(c["reasons"] == S.BIT["retried_shard"] for c in chosen) == 5
    assert {r["path"] for r in S.ineligible(df, risk).collect()} == {"nowhere"}
    first = sorted(r["path"] for r in S.select_sample(df, risk, "r", 1, 8).collect())
    assert first == sorted(r["path"] for r in S.select_sample(df.orderBy(F.rand()), risk, "r", 1, 8).collect())
    assert first != sorted(r["path"] for r in S.select_sample(df, risk, "r", 2, 8).collect())


def test_sort_raw_path_keeps_every_path(spark):
    paths = [f"p{i * 7919 % 5003}/{c}" for i in range(1000) for c in ("a", "\u00e9", "\U0001f600", "\uffee")]
    df = spark.createDataFrame([(p,) for p in paths], "path string").repartition(7)
    got = [(r["path"], r["place"]) for r in R.sort_raw_path(df).collect()]
    assert got == [(p, i + 1) for i, p in enumerate(sorted(paths, key=lambda p: p.encode()))]


def test_manifests_hold_all_shards_in_documents_of_fixed_size(spark):
    from tidemark.plans import sources

    shards = spark.range(1, 20_001).selectExpr("concat('part-', id) AS shard", "1 AS n_rows", "2L AS n_bytes", "'e' AS etag", "id AS shard_no")
    bodies = sources._manifest_all(shards)
    found = sources.S.manifest_shards(bodies)
    assert found.count() == 20_000 == found.select("shard").distinct().count()
    assert found.groupBy("run_id").count().agg(F.max("count")).first()[0] == sources.RUN_KEYS
