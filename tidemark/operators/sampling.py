"""Deterministic samples of an estate that always hold its risky files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.reconcile import REGULAR, both_sides, differences, pair_sides, with_groups
from tidemark.scratch import materialise

# Bits of a reason mask, in the order in which reasons are listed.
REASONS = ("metadata_mismatch", "hardlink_group", "migration_failure", "migration_downgrade", "retried_shard", "bucket_boundary", "seeded")
BIT = {name: 1 << i for i, name in enumerate(REASONS)}
MIB, GIB = 1 << 20, 1 << 30
BOUNDARY_SIZES = (MIB - 1, MIB, MIB + 1, GIB - 1, GIB, GIB + 1)
DOMAIN = b"tidemark-sample-v1\x00"


def _u64(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def rank(run_id: str, seed: int, path: Column, domain: bytes = DOMAIN) -> Column:
    """Hex SHA-256 over domain, length and bytes of the run id, the seed, and length and bytes of the path."""
    run = run_id.encode()
    head = domain + len(run).to_bytes(8, "big") + run + seed.to_bytes(8, "big")
    raw = path.cast("binary")
    return F.sha2(F.concat(F.lit(bytearray(head)), _u64(F.octet_length(raw)), raw), 256)


def seeded(paths: DataFrame, k: int, run_id: str, seed: int) -> DataFrame:
    """path, rank of the k lowest ranks: a top-k that every task bounds to k rows."""
    return paths.select("path", rank(run_id, seed, F.col("path")).alias("rank")).orderBy("rank", "path").limit(k)


def is_boundary(size: Column) -> Column:
    return size.isin(*BOUNDARY_SIZES)


def evidence(*sources: DataFrame) -> DataFrame:
    """Union of evidence tables without exact repeats."""
    columns = ["path", "reason", "source", "source_etag"]
    out = sources[0].select(*columns)
    for s in sources[1:]:
        out = out.unionByName(s.select(*columns))
    return out.dropDuplicates(columns)


def reason_masks(rows: DataFrame) -> DataFrame:
    """path, reasons: the reasons of a path in one mask."""
    bit = F.coalesce(*[F.when(F.col("reason") == name, F.lit(b)) for name, b in BIT.items()])
    return rows.groupBy("path").agg(F.bit_or(bit).alias("reasons"))


def ineligible(entries: DataFrame, risk: DataFrame) -> DataFrame:
    """path of risk paths that are not regular on both sides, and roots of source hardlink groups without any eligible member."""
    good = both_sides(entries.where(F.col("file_type") == REGULAR))
    lone = risk.select("path").distinct().join(good, "path", "left_anti")
    return lone.unionByName(ineligible_groups(entries).select(F.col("group_root").alias("path"))).distinct()


def _source_members(entries: DataFrame) -> DataFrame:
    good = both_sides(entries.where(F.col("file_type") == REGULAR)).withColumn("good", F.lit(True))
    members = with_groups(entries.where("side = 0")).where("group_root is not null").select("path", "group_root")
    return members.join(good, "path", "left")


def ineligible_groups(entries: DataFrame) -> DataFrame:
    """group_root, members of source hardlink groups without any member that is regular on both sides."""
    members = _source_members(entries)
    return members.groupBy("group_root").agg(F.count("*").alias("members"), F.count("good").alias("eligible")).where("eligible = 0").select("group_root", "members")


def reasons_of(entries: DataFrame, risk: DataFrame) -> DataFrame:
    """path, reasons of every eligible path: evidence, a metadata difference, a boundary size, being its group's first; 0 for none.

    The paired sides are written once, as everything below reads them.
    """
    pairs = pair_sides(entries, groups=True)
    own = F.when(F.size(differences()) > 0, BIT["metadata_mismatch"]).otherwise(0).bitwiseOR(F.when(is_boundary(F.col("src_size")), BIT["bucket_boundary"]).otherwise(0))
    good = pairs.where((F.col("src_file_type") == REGULAR) & (F.col("dst_file_type") == REGULAR)).select("path", "src_group_root", own.alias("own"))
    good = materialise(good, "eligible")
    firsts = good.where("src_group_root is not null").groupBy("src_group_root").agg(F.min("path").alias("path")).select("path", F.lit("hardlink_group").alias("reason"))
    marks = reason_masks(firsts.unionByName(risk.select("path", "reason"))).withColumnRenamed("reasons", "marks")
    return good.join(marks, "path", "left").select("path", F.col("own").bitwiseOR(F.coalesce("marks", F.lit(0))).alias("reasons"))


def mandatory(entries: DataFrame, risk: DataFrame) -> DataFrame:
    """path, reasons of every eligible path that has a reason."""
    return reasons_of(entries, risk).where("reasons <> 0")


def select_sample(entries: DataFrame, risk: DataFrame, run_id: str, seed: int, target: int) -> DataFrame:
    """path, reasons, rank: every mandatory path, then the lowest ranks of other eligible paths up to the target.

    Mandatory paths are never dropped, so there may be more than the target.
    """
    found = reasons_of(entries, risk)
    must = found.where("reasons <> 0")
    rest = seeded(found.where("reasons = 0"), target, run_id, seed)  # at most `target` rows from here on
    room = F.lit(target) - F.col("taken")
    order = Window.orderBy("rank", "path")
    rest = rest.withColumn("place", F.row_number().over(order)).crossJoin(F.broadcast(must.agg(F.count("*").alias("taken")))).where(F.col("place") <= room)
    chosen = must.select("path", "reasons", rank(run_id, seed, F.col("path")).alias("rank"))
    return chosen.unionByName(rest.select("path", F.lit(BIT["seeded"]).alias("reasons"), "rank"))


def selection_summary(jobs: DataFrame) -> DataFrame:
    """One row a reason, counting a path once for each of its reasons, and rows for all, risky and seeded paths."""
    names = F.array(F.lit("selected"), F.when(F.col("reasons").bitwiseAND(~BIT["seeded"]) != 0, "risk").otherwise("only_seeded"), *[F.when(F.col("reasons").bitwiseAND(b) != 0, name) for name, b in BIT.items()])
    return jobs.select(F.explode(F.array_compact(names)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def spread_sample(index: DataFrame, n: int, seed: int, links: int = 32, block: int = 4096) -> DataFrame:
    """n rows spread over the blocks of all shards, up to `links` of them symlinks, chosen by a hash of row_id.

    Blocks take turns: the first of each in hash order, then the second of each, and so on.
    """
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("row_id").cast("string")))
    rows = index.withColumn("_key", key).withColumn("_block", F.floor(F.col("row_id").bitwiseAND((1 << 40) - 1) / block))
    turn = F.row_number().over(Window.partitionBy("shard_index", "_block").orderBy("_key"))
    symlinks = rows.where("file_type = 3").orderBy("_key").limit(links)
    others = rows.where("file_type <> 3").withColumn("_turn", turn).where(F.col("_turn") <= n)
    taken = symlinks.agg(F.count("*").alias("_taken"))
    place = F.row_number().over(Window.orderBy("_turn", "_key"))
    others = others.orderBy("_turn", "_key").limit(n).withColumn("_place", place).crossJoin(F.broadcast(taken)).where(F.col("_place") <= F.lit(n) - F.col("_taken"))
    return symlinks.select("row_id", "path", "file_type").unionByName(others.select("row_id", "path", "file_type"))


def retried_paths(claims: DataFrame, shards: DataFrame, index: DataFrame) -> DataFrame:
    """path, shard of regular files in shards that are completed, were claimed more than once, and whose index object is still the planned one."""
    again = claims.where("state = 'completed' and epoch > 1").select("shard")
    wanted = shards.join(again, "shard", "left_semi").select("shard", "etag")
    return index.where(F.col("file_type") == REGULAR).join(wanted, ["shard", "etag"], "left_semi").select("path", "shard")


def explain_failures(failures: DataFrame, index: DataFrame) -> DataFrame:
    """Failure rows with what the index knows of them, by row_id; rows of no known index row stay, with nulls."""
    return failures.join(index.select("row_id", F.col("path").alias("index_path"), "size", "file_type"), "row_id", "left")


def check_sample(sample: DataFrame, entries: DataFrame) -> DataFrame:
    """path, category: what is wrong with sampled scan rows on either side now.

    sample: path, file_type, size, mode, uid, gid, mtime_sec as scanned. A row may have several categories.
    """
    attributes = ["file_type", "size", "mode", "uid", "gid", "mtime_sec"]

    def side(n: int, prefix: str) -> DataFrame:
        return entries.where(F.col("side") == n).select("path", F.lit(True).alias(f"{prefix}_here"), *[F.col(a).alias(f"{prefix}_{a}") for a in attributes])

    j = sample.join(side(0, "src"), "path", "left").join(side(1, "dst"), "path", "left")
    changed = F.struct(*attributes) != F.struct(*[F.col(f"src_{a}").alias(a) for a in attributes])
    there = F.col("src_here") & F.col("dst_here")
    kinds = [F.when(F.col("src_here").isNull(), "source_missing"), F.when(F.col("dst_here").isNull(), "destination_missing"), F.when(F.col("src_here") & changed, "source_changed")]
    kinds += [F.when(there & (F.col(f"src_{a}") != F.col(f"dst_{a}")), name) for a, name in (("file_type", "file_type"), ("mode", "mode"), ("uid", "uid"), ("gid", "gid"), ("mtime_sec", "mtime"))]
    kinds.append(F.when(there & (F.col("src_file_type") == REGULAR) & (F.col("src_size") != F.col("dst_size")), "size"))
    return j.select("path", F.explode(F.array_compact(F.array(*kinds))).alias("category"))


def jobs_with_baselines(jobs: DataFrame, entries: DataFrame) -> DataFrame:
    """Selected paths with both sides' sizes and hardlink roots."""
    pairs = pair_sides(entries, groups=True).where("place = 'both'")
    return jobs.join(pairs.select("path", "src_size", "dst_size", F.col("src_group_root").alias("src_root"), F.col("dst_group_root").alias("dst_root")), "path")

