"""Compare two sides of a file estate: pair them by path, and explain every difference by kind.

An entries table has side (0 source, 1 destination), path, file_type (1 regular, 2 directory, 3 symlink, 4-7
and 0 unsupported), size, mode, uid, gid, mtime_sec, mtime_nsec, dev, ino, nlink, symlink_target.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.paths import path_b64
from tidemark.scratch import materialise

REGULAR, DIRECTORY, SYMLINK = 1, 2, 3
SUPPORTED = (REGULAR, DIRECTORY, SYMLINK)
ATTRIBUTES = ("file_type", "size", "mode", "uid", "gid", "mtime_sec", "mtime_nsec", "symlink_target")


@dataclass(frozen=True)
class Preserve:
    """Which attributes the run was asked to carry over; others are not compared."""

    mode: bool = True
    owner: bool = True
    times: bool = True


def is_unsupported(file_type: Column) -> Column:
    return ~file_type.isin(*SUPPORTED)


def hardlink_groups(entries: DataFrame) -> DataFrame:
    """side, dev, ino, group_root, members: inodes that several regular files with more than one link share."""
    linked = entries.where((F.col("file_type") == REGULAR) & (F.col("nlink") > 1))
    return linked.groupBy("side", "dev", "ino").agg(F.min("path").alias("group_root"), F.count("*").alias("members")).where("members > 1")


def with_groups(entries: DataFrame) -> DataFrame:
    """entries with group_root: set for every regular file of a group's inode, whatever its own link count says."""
    groups = hardlink_groups(entries).select("side", "dev", "ino", "group_root", F.lit(REGULAR).alias("file_type"))
    return entries.join(groups, ["side", "dev", "ino", "file_type"], "left")


def group_roots(entries: DataFrame) -> DataFrame:
    """side, path, dev, ino, group_root of the files for which with_groups() has one, each once. Nothing but these columns is shuffled."""
    files = entries.where((F.col("file_type") == REGULAR) & F.col("dev").isNotNull() & F.col("ino").isNotNull())
    thin = files.select("side", "path", "dev", "ino", F.when(F.col("nlink") > 1, F.col("path")).alias("_linked"))
    order = Window.partitionBy("side", "dev", "ino").orderBy("path")
    inode = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = thin.withColumns({"group_root": F.min("_linked").over(inode), "_members": F.count("_linked").over(inode), "_again": F.lag("path").over(order).eqNullSafe(F.col("path"))})
    return told.where("_members > 1 and not _again").select("side", "path", "dev", "ino", "group_root")


def pair_sides(entries: DataFrame, groups: bool = False) -> DataFrame:
    """One row a path of either side: src_* and dst_* columns, and `place`: both, source or destination.

    groups: with group_root, as of with_groups(); it is joined by path like the sides, so whole rows are shuffled once and not by inode too.
    """

    def of(number: int) -> DataFrame:
        own = entries.where(F.col("side") == number)
        if not groups:
            return own
        roots = group_roots(own).select(F.col("path").alias("_path"), F.col("dev").alias("_dev"), F.col("ino").alias("_ino"), "group_root")
        # Ranges, so that they are no keys: rows would be dealt by these too.
        inode = F.col("dev").between(F.col("_dev"), F.col("_dev")) & F.col("ino").between(F.col("_ino"), F.col("_ino"))
        return own.join(roots, (F.col("path") == F.col("_path")) & inode & (F.col("file_type") == REGULAR), "left").drop("_path", "_dev", "_ino")

    def side(number: int, prefix: str) -> DataFrame:
        own = of(number)
        return own.select("path", F.lit(True).alias(f"{prefix}_here"), *[F.col(c).alias(f"{prefix}_{c}") for c in own.columns if c not in ("side", "path")])

    pairs = side(0, "src").join(side(1, "dst"), "path", "full_outer")
    place = F.when(F.col("dst_here").isNull(), "source").when(F.col("src_here").isNull(), "destination").otherwise("both")
    return pairs.withColumn("place", place).drop("src_here", "dst_here")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"})


def observed(of: Callable[[str], Column] = F.col) -> Column:
    """What is known of an entry, as JSON: the mode's permission bits, and link targets and groups in base64, as their bytes may be no text."""
    plain = {c: of(c) for c in ("file_type", "size")}
    rest = {c: of(c) for c in ("uid", "gid", "mtime_sec", "mtime_nsec")}
    return _json(**plain, mode=of("mode").bitwiseAND(4095), **rest, symlink_target_b64=path_b64(of("symlink_target")), hardlink_group_b64=path_b64(of("group_root")))


SUPPORTED_TEXT = "a regular file, a directory or a symlink"


def differences(preserve: Preserve = Preserve()) -> Column:
    """The differences of a pair as an array of (kind, expected, observed), in the order of the rules: numbers as they are, JSON where there are several, base64 for bytes."""
    s, d = (lambda c: F.col(f"src_{c}")), (lambda c: F.col(f"dst_{c}"))
    both = F.col("place") == "both"

    def found(condition: Column, kind: str, expected: Column, observed: Column) -> Column:
        return F.when(condition, F.struct(F.lit(kind).alias("kind"), expected.cast("string").alias("expected"), observed.cast("string").alias("observed")))

    def differ(*columns: str) -> Column:
        return both & F.array_contains(F.array(*[~s(c).eqNullSafe(d(c)) for c in columns]), True)

    def usec(side) -> Column:
        return F.floor(side("mtime_nsec") / 1000)

    def either(c: str) -> tuple[Column, Column]:
        return s(c), d(c)

    odd = F.coalesce(is_unsupported(s("file_type")), F.lit(False)) | F.coalesce(is_unsupported(d("file_type")), F.lit(False))
    types = F.when(both, _json(source=s("file_type"), destination=d("file_type"))).otherwise(F.coalesce(s("file_type"), d("file_type")).cast("string"))
    rules = [
        found(F.col("place") == "source", "missing_destination", observed(s), F.lit(None)),
        found(F.col("place") == "destination", "unexpected_destination", F.lit(None), observed(d)),
        found(odd, "unsupported_feature", F.lit(SUPPORTED_TEXT), types),
        found(differ("file_type"), "type", *either("file_type")),
        found((s("file_type") == REGULAR) & (d("file_type") == REGULAR) & differ("size"), "size", *either("size")),
    ]
    if preserve.mode:
        masked = tuple(c.bitwiseAND(4095) for c in either("mode"))
        rules.append(found(both & ~masked[0].eqNullSafe(masked[1]), "mode", *masked))
    if preserve.owner:
        rules.append(found(differ("uid", "gid"), "owner", *[_json(uid=x("uid"), gid=x("gid")) for x in (s, d)]))
    if preserve.times:
        moved = differ("mtime_sec") | (both & ~usec(s).eqNullSafe(usec(d)))
        rules.append(found(moved, "mtime", *[_json(sec=x("mtime_sec"), usec=usec(x)) for x in (s, d)]))
    rules += [
        found((s("file_type") == SYMLINK) & (d("file_type") == SYMLINK) & differ("symlink_target"), "symlink_target", *map(path_b64, either("symlink_target"))),
        found(differ("group_root"), "hardlink_group", *map(path_b64, either("group_root"))),
    ]
    return F.array_compact(F.array(*rules))


def diff_pairs(pairs: DataFrame, preserve: Preserve = Preserve()) -> DataFrame:
    """path, kind, expected, observed: one row for every difference of a pair."""
    return pairs.select("path", F.explode(differences(preserve)).alias("d")).select("path", "d.kind", "d.expected", "d.observed")


def compare_entries(entries: DataFrame, preserve: Preserve = Preserve()) -> DataFrame:
    return diff_pairs(pair_sides(entries, groups=True), preserve)


def report_totals(pairs: DataFrame) -> DataFrame:
    """One row: entries of each side and of both, differences, and paths that have any; the pairs are read once."""
    n, place = F.size(differences()).alias("n"), F.col("place")
    counts = {"source_entries": F.count_if(place != "destination"), "destination_entries": F.count_if(place != "source"), "on_both": F.count_if(place == "both"), "mismatches": F.sum("n")}
    # Paths without differences are one group, added up before the shuffle.
    by = pairs.select("path", "place", n).groupBy(F.when(F.col("n") > 0, F.col("path")).alias("path")).agg(*[c.alias(name) for name, c in counts.items()])
    return by.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counts], F.count("path").alias("mismatched_paths"))


def mismatch_counts(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("kind").agg(F.count("*").alias("n"))


def observation_counts(entries: DataFrame) -> DataFrame:
    """Entries of each side and type."""
    return entries.groupBy("side", "file_type").agg(F.count("*").alias("n"))


def both_sides(entries: DataFrame) -> DataFrame:
    """path of every entry that both sides have: one aggregation instead of a join."""
    return entries.groupBy("path").agg(F.bit_or((F.col("side") + 1)).alias("sides")).where("sides = 3").select("path")


def eligible_paths(entries: DataFrame) -> DataFrame:
    """path of every file that is regular on both sides."""
    return both_sides(entries.where(F.col("file_type") == REGULAR))


def content_compare(source: DataFrame, destination: DataFrame) -> DataFrame:
    """path, outcome, digests and sizes of what both sides hold: (path, content) tables, hashed on the executors.

    A side that has the path and no content could not be read. unreadable comes before content and match.
    """

    def side(df: DataFrame, prefix: str) -> DataFrame:
        body = F.col("content").cast("binary")
        return df.select("path", F.lit(True).alias(f"{prefix}_here"), F.sha2(body, 256).alias(f"{prefix}_sha256"), F.octet_length(body).cast("long").alias(f"{prefix}_bytes"))

    j = side(source, "src").join(side(destination, "dst"), "path", "full_outer")
    missing = F.col("src_here").isNull() | F.col("dst_here").isNull()
    unreadable = F.col("src_sha256").isNull() | F.col("dst_sha256").isNull()
    differs = (F.col("src_sha256") != F.col("dst_sha256")) | (F.col("src_bytes") != F.col("dst_bytes"))
    outcome = F.when(missing, "missing").when(unreadable, "unreadable").when(differs, "content").otherwise("match")
    return j.select("path", outcome.alias("outcome"), "src_sha256", "dst_sha256", "src_bytes", "dst_bytes")


def content_totals(compared: DataFrame) -> DataFrame:
    one = lambda o: F.count_if(F.col("outcome") == o)
    hashed = F.col("outcome").isin("match", "content")
    return compared.agg(
        F.count("*").alias("checked"), one("match").alias("matched"), one("content").alias("differing"), one("unreadable").alias("unreadable"), one("missing").alias("missing"),
        F.coalesce(F.sum(F.when(hashed, F.col("src_bytes"))), F.lit(0)).alias("bytes_source"), F.coalesce(F.sum(F.when(hashed, F.col("dst_bytes"))), F.lit(0)).alias("bytes_destination"),
    )


def unique_bad(scan_rows: DataFrame, content_rows: DataFrame) -> DataFrame:
    """Distinct (side, path) of two lists of bad paths; a null side is the source."""
    both = scan_rows.select("side", "path").unionByName(content_rows.select("side", "path"))
    return both.select(F.coalesce("side", F.lit(0)).alias("side"), "path").distinct()


def verdict(counts: DataFrame, unreadable: DataFrame, unstable: DataFrame, failed: bool = False) -> DataFrame:
    """One row: failed before inconclusive (anything unreadable or unstable) before mismatched before passed."""
    one = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mismatches"))
    one = one.crossJoin(F.broadcast(unreadable.agg(F.count("*").alias("unreadable")))).crossJoin(F.broadcast(unstable.agg(F.count("*").alias("unstable"))))  # one row each
    status = F.when(F.lit(failed), "failed").when(F.col("unreadable") + F.col("unstable") > 0, "inconclusive").when(F.col("mismatches") > 0, "mismatched").otherwise("passed")
    return one.withColumn("status", status)


PHASES = {"issue": 0, "unstable": 1, "metadata": 2, "content": 3}


def ordered_mismatches(issues: DataFrame, unstable: DataFrame, diffs: DataFrame, contents: DataFrame) -> DataFrame:
    """phase, side, path, kind in the order a report lists them: issues, unstable directories, metadata, content."""
    side = F.coalesce(F.col("side"), F.lit(0)).cast("int").alias("side")
    rows = issues.select(F.lit(0).alias("phase"), side, "path", F.lit("unreadable").alias("kind"))
    rows = rows.unionByName(unstable.select(F.lit(1).alias("phase"), side, "path", F.lit("unstable").alias("kind")))
    rows = rows.unionByName(diffs.select(F.lit(2).alias("phase"), F.lit(-1).alias("side"), "path", "kind"))
    rows = rows.unionByName(contents.where("outcome = 'content'").select(F.lit(3).alias("phase"), F.lit(-1).alias("side"), "path", F.lit("content").alias("kind")))
    return rows.orderBy("phase", "path", "side", "kind")


def group_diff(entries: DataFrame) -> DataFrame:
    """Hardlink groups of one side that the other has not, as sets of paths: side, group_root, members.

    Inode numbers differ between sides, so groups compare by their members: count and an order-free digest of 128 bits.
    """
    members = with_groups(entries).where("group_root is not null")
    digest = [F.bit_xor(F.xxhash64(F.lit(seed), "path")).alias(f"digest{seed}") for seed in (1, 2)]
    sets = members.groupBy("side", "group_root").agg(F.count("*").alias("members"), *digest)
    here = sets.groupBy("group_root", "members", "digest1", "digest2").agg(F.min("side").alias("side"), F.count("*").alias("sides"))
    return here.where("sides = 1").select("side", "group_root", "members")


def sort_raw_path(df: DataFrame) -> DataFrame:
    """df in raw byte order of path, by a range-partitioned sort, with its place (from 1): the rows of all ranges before, and the row inside its own."""
    ranked = df.orderBy(F.col("path").cast("binary")).withColumn("_at", F.monotonically_increasing_id())
    ranked = materialise(ranked, "ranges").withColumn("_range", F.shiftright("_at", 33))
    before, rows = 0, []
    for r in ranked.groupBy("_range").count().orderBy("_range").collect():  # one row a partition
        rows.append((r["_range"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(rows, "_range long, _start long")
    placed = ranked.join(F.broadcast(starts), "_range").withColumn("place", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return placed.drop("_range", "_at", "_start").orderBy("place")
