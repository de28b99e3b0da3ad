"""Jobs over file inventories: normalise a scan, audit its paths, plan its copy, forecast its fidelity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.paths import SNAPSHOT_DIRS, basename, depth, is_partial_name, is_safe_path, parent, strip_root
from tidemark.operators.ordered import SLICE, carried, entering, slice_of, with_carried
from tidemark.operators.sampling import is_boundary
from tidemark.scratch import materialise

ROW_BITS = 40
BLOCK_ROWS = 1_000_000  # of a shard that one task reads in order
BLOCKS = 16  # that so many rows of a larger shard are cut into
S_IFMT = {1: 0o100000, 2: 0o040000, 3: 0o120000}
TYPE_BITS = {0o100000: 1, 0o040000: 2, 0o120000: 3, 0o010000: 4, 0o140000: 5, 0o060000: 6, 0o020000: 7}
MIB, GIB = 1 << 20, 1 << 30


def row_id(shard: Column, row: Column) -> Column:
    return F.shiftleft(shard.cast("long"), ROW_BITS) + row


def split_row_id(c: Column) -> Column:
    return F.struct(F.shiftrightunsigned(c, ROW_BITS).alias("shard"), c.bitwiseAND((1 << ROW_BITS) - 1).alias("row"))


def file_type_tag(kind: Column) -> Column:
    return F.when(kind == "directory", 2).when(kind == "symlink", 3).otherwise(1)


def full_mode(permissions: Column, tag: Column) -> Column:
    return permissions.bitwiseOR(F.when(tag == 2, S_IFMT[2]).when(tag == 3, S_IFMT[3]).otherwise(S_IFMT[1]))


def type_from_mode(mode: Column) -> Column:
    bits = mode.bitwiseAND(0o170000)
    return F.coalesce(*[F.when(bits == b, F.lit(t)) for b, t in TYPE_BITS.items()], F.lit(0))


def split_us(us: Column) -> tuple[Column, Column]:
    """Seconds and nanoseconds; nanoseconds are never negative."""
    below = F.pmod(us, F.lit(1000000))
    # Whole numbers throughout: a double has no room for the microseconds of far dates.
    return F.call_function("div", us - below, F.lit(1000000)).cast("long"), (below * 1000).cast("long")


def times(sec: Column, nsec: Column, us: Column) -> tuple[Column, Column]:
    """The pair if both are there, else what the microseconds say, else nulls."""
    exact = sec.isNotNull() & nsec.isNotNull()
    a, b = split_us(us)
    return F.when(exact, sec.cast("long")).otherwise(a), F.when(exact, nsec.cast("long")).otherwise(b)


def normalize(scan: DataFrame, root: str) -> DataFrame:
    """A scan as a canonical index: one projection, no shuffle. Needs shard_index and row_in_shard; other columns may be absent."""
    there = lambda c: F.col(c) if c in scan.columns else F.lit(None).cast("long")
    tag = file_type_tag(F.col("file_type"))
    m, a = times(there("mtime_sec"), there("mtime_nsec"), there("mtime_us")), times(there("atime_sec"), there("atime_nsec"), there("atime_us"))
    return scan.select(
        row_id(F.col("shard_index"), F.col("row_in_shard")).alias("row_id"), strip_root(F.col("path"), root).alias("path"), F.col("size").cast("long").alias("size"),
        full_mode(F.col("permissions"), tag).cast("long").alias("mode"), tag.alias("file_type"), m[0].alias("mtime_sec"), m[1].alias("mtime_nsec"), a[0].alias("atime_sec"), a[1].alias("atime_nsec"),
        F.col("uid").cast("long").alias("uid"), F.col("gid").cast("long").alias("gid"), F.col("nlink").cast("long").alias("nlink"), F.col("inode"), there("fsid").alias("fsid"),
        (F.col("symlink_target") if "symlink_target" in scan.columns else F.lit(None).cast("string")).alias("symlink_target"), F.col("shard_index"),
    )


def filter_inventory(entries: DataFrame, patterns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows in scope, and per pattern how many rows it excludes (a row counts for the first pattern that hits)."""
    text = F.concat(F.when(F.col("path").startswith("/"), "").otherwise("/"), F.col("path").cast("string"))
    first = F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()], F.lit(None).cast("string"))
    marked = entries.withColumn("_hit", first)
    return marked.where("_hit is null").drop("_hit"), marked.where("_hit is not null").groupBy(F.col("_hit").alias("pattern")).agg(F.count("*").alias("excluded"))


def exclude_snapshots(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("path").cast("string").rlike(SNAPSHOT_DIRS))


def findings() -> Column:
    """What is wrong with, or special about, an index row."""
    p, t = F.col("path"), F.col("file_type")
    return F.array_compact(F.array(
        F.when(~is_safe_path(p), "unsafe_path"), F.when((t == 1) & is_partial_name(basename(p)), "partial_file"), F.when(~t.between(1, 7), "bad_file_type"),
        F.when(t.between(4, 7), "unsupported_type"), F.when((t == 1) & is_boundary(F.col("size")), "boundary_size"),
    ))


def path_audit(index: DataFrame) -> DataFrame:
    """path, finding: one row for each finding."""
    return index.select("path", F.explode(findings()).alias("finding"))


def size_class(size: Column) -> Column:
    return F.when(size < MIB, "small").when(size < GIB, "medium").otherwise("large")


def link_roles(index: DataFrame, within: list[str]) -> DataFrame:
    """index with link_role: of rows that share an inode, the first copies and later ones link; null for rows without one."""
    keyed = F.col("inode").isNotNull() & (F.col("nlink") > 1) & (F.col("file_type") == 1)
    w = Window.partitionBy(*within, F.when(keyed, F.col("fsid")), F.when(keyed, F.col("inode")).alias("i"), F.when(~keyed, F.col("row_id"))).orderBy("row_id")
    return index.withColumn("link_role", F.when(keyed, F.when(F.row_number().over(w) == 1, "first").otherwise("link")))


def copy_action(role: Column) -> Column:
    t = F.col("file_type")
    return F.when(t == 3, "symlink").when(t == 2, "dir_attrs").when(t != 1, "skip").when(role == "link", "hardlink_existing").when(F.col("size") == 0, "empty").otherwise("copy")


def timestamp(sec: Column, nsec: Column) -> Column:
    """Seconds, a point, and nine digits of nanoseconds; no nanoseconds are zero."""
    return F.concat_ws(".", sec, F.lpad(F.coalesce(nsec, F.lit(0)).cast("string"), 9, "0"))


def attr_plan(owner: bool = True, mode: bool = True, utimes: bool = True) -> Column:
    """Attribute operations in order: owner, mode, times (no access time: the modification's; no nanoseconds: zero)."""
    ops = []
    if owner:
        ops.append(F.when(F.col("uid").isNotNull() & F.col("gid").isNotNull(), F.concat_ws(":", F.lit("chown"), F.col("uid"), F.col("gid"))))
    if mode:
        ops.append(F.concat(F.lit("chmod:"), F.col("mode").bitwiseAND(4095).cast("string")))
    if utimes:
        m = timestamp(F.col("mtime_sec"), F.col("mtime_nsec"))
        a = F.when(F.col("atime_sec").isNotNull(), timestamp(F.col("atime_sec"), F.col("atime_nsec"))).otherwise(m)
        ops.append(F.when(F.col("mtime_sec").isNotNull(), F.concat_ws(":", F.lit("utimes"), a, m)))
    return F.array_join(F.array_compact(F.array(*ops)), ";")


def _fill(sizes: np.ndarray, batch: int, files: int, held: int, max_bytes: int, max_files: int) -> tuple[np.ndarray, int, int, int]:
    """Batch numbers of some rows of a shard, going on from an open batch: from one end of a batch to the next."""
    cum, n, at = np.concatenate([[0], np.cumsum(sizes)]), len(sizes), 0
    out = np.empty(n, dtype=np.int64)
    while at < n:
        end = min(int(np.searchsorted(cum, cum[at] + max_bytes - held, side="right")) - 1, at + max_files - files, n)
        end = max(end, at + 1) if not files else max(end, at)
        out[at:end] = batch
        files, held, at = files + end - at, held + int(cum[end] - cum[at]), end
        if at < n:
            batch, files, held = batch + 1, 0, 0
    return out, batch, files, held


def assign_batches(index: DataFrame, max_bytes: int, max_files: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """index with `batch`: rows of a shard in order, a batch closing when it has max_files rows or the next row
    would take it over max_bytes; the first row of a batch always fits. A null size counts nothing.

    Where a batch ends depends on all before it in the shard. Shards of at most block_rows rows are each read in order, streaming, by
    one task; with a larger one among them shards are cut into blocks (_batch_starts), for the same batches.
    """
    return _batched(index, max_bytes, max_files, block_rows)[0].select(*index.columns, "batch")


def _batched(index: DataFrame, max_bytes: int, max_files: int, block_rows: int) -> tuple[DataFrame, list[str]]:
    """index with `batch`, and the columns by which it is dealt so that no batch is in two places: none if it isn't."""
    largest = index.groupBy("shard_index").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > block_rows:
        return _with_batches(index, *_batch_starts(index, max_bytes, max_files, max(block_rows // BLOCKS, 2 * max_files))), ["shard_index", "_block"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, state = None, (0, 0, 0)
        for rows in batches:
            shards = np.array(rows["shard_index"].to_numpy(zero_copy_only=False))
            sizes = rows["size"].fill_null(0).to_numpy()
            out = []
            for part in np.split(np.arange(len(shards)), np.flatnonzero(shards[1:] != shards[:-1]) + 1) if len(shards) else []:
                if shards[part[0]] != shard:
                    shard, state = shards[part[0]], (0, 0, 0)
                numbers, *state = _fill(sizes[part], *state, max_bytes, max_files)
                out.append(numbers)
            yield rows.append_column("batch", pa.array(np.concatenate(out) if out else np.zeros(0, dtype=np.int64)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return index.repartition("shard_index").sortWithinPartitions("shard_index", "row_id").mapInArrow(fold, f"{kinds}, batch long"), []


def _follow(sizes: np.ndarray, own: int, max_bytes: int, max_files: int) -> list[int]:
    """For each of the first `own` rows, where the batch that starts there ends."""
    cum = np.concatenate([[0], np.cumsum(sizes)])
    start = np.arange(own)
    ends = np.searchsorted(cum, cum[:own] + max_bytes, side="right") - 1
    return np.clip(np.minimum(ends, start + max_files), start + 1, len(sizes)).tolist()


def _exits(sizes: np.ndarray, own: int, max_bytes: int, max_files: int) -> tuple[np.ndarray, np.ndarray]:
    """For a block of `own` rows and the rows after it: where the first batch beyond the block starts (rows after its end), and how many
    batches start in it, if the first one in it starts at row 0, 1, and so on to max_files - 1."""
    follow, known = _follow(sizes, own, max_bytes, max_files), {}
    leaves, counts = np.empty(max_files, dtype=np.int32), np.empty(max_files, dtype=np.int64)
    for entry in range(max_files):
        at, way = entry, []
        while at < own and at not in known:
            way.append(at)
            at = follow[at]
        end, count = known.get(at, (at - own, 0))
        for row in reversed(way):
            count += 1
            known[row] = end, count
        leaves[entry], counts[entry] = min(end, max_files - 1), count
    return leaves, counts


def _batch_starts(index: DataFrame, max_bytes: int, max_files: int, block: int) -> tuple[DataFrame, DataFrame, int]:
    """shard_index, row_id, batch of the first row of every batch, and _block: the first such row in its block; the slices of row ids
    with the first row of the block that begins in each (_cut) and before it (_before__cut); and the size of slices.

    Slices of row ids are counted, and put into blocks by the rows before them: a block has `block` rows, a slice more or less. For every
    row of a block at which the first batch may start, the successors of batches tell where the first batch beyond it starts; a batch has at
    most max_files rows, so that is one of the next max_files. These maps of blocks are composed in groups (operators.ordered). No task holds
    more than a block, and what a batch may have of the next.
    """
    size = max(1, min(SLICE, block // 4))  # so that two blocks never begin in one slice
    thin = index.select("shard_index", "row_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"), slice_of("row_id", size).alias("_slice"))
    per = carried(thin.groupBy("shard_index", "_slice").agg(F.count("*").alias("_n")), ["shard_index"], {"_n": "sum"})
    lead = (F.col("_before__n") % block < max_files + size) & (F.col("_before__n") >= block)  # what the block before may need
    slices = materialise(per.select("shard_index", "_slice", F.floor(F.col("_before__n") / block).alias("_block"), lead.alias("_lead")), "slices")
    placed = with_carried(thin, slices, ["shard_index"]).drop("_slice")
    kind = index.schema["shard_index"].dataType.simpleString()
    halo = placed.select("shard_index", "row_id", "size", "_block", F.explode(F.when(F.col("_lead"), F.array(F.col("_block") - 1, "_block")).otherwise(F.array("_block"))).alias("_at"))

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        at = pdf["_at"].iloc[0]
        leaves, counts = _exits(pdf["size"].to_numpy(), int((pdf["_block"] == at).sum()), max_bytes, max_files)
        return pd.DataFrame({"shard_index": [pdf["shard_index"].iloc[0]], "_slice": [at], "leaves": [leaves], "counts": [counts]})

    found = materialise(halo.groupBy("shard_index", "_at").applyInPandas(maps, f"shard_index {kind}, _slice long, leaves array<int>, counts array<long>"), "batch-maps")
    most = found.agg(F.max("_slice")).first()[0] or 0
    entered = materialise(entering(found, "shard_index", 0, most), "entered")

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        at, follow, new = int(pdf["state"].iloc[0]), _follow(pdf["size"].to_numpy(), len(pdf), max_bytes, max_files), []
        while at < len(pdf):
            new.append(at)
            at = follow[at]
        rows = pdf["row_id"].to_numpy()[new]
        return pd.DataFrame({"shard_index": pdf["shard_index"].iloc[0], "row_id": rows, "batch": int(pdf["count"].iloc[0]) + np.arange(len(new)), "_block": rows[:1].repeat(len(new))})

    known = with_carried(placed.select("shard_index", "row_id", "size", F.col("_block").alias("_slice")), entered, ["shard_index"])
    begun = materialise(known.groupBy("shard_index", "_slice").applyInPandas(starts, f"shard_index {kind}, row_id long, batch long, _block long"), "batch-starts")
    cuts = begun.where("row_id = _block").select("shard_index", slice_of("row_id", size).alias("_slice"), F.col("row_id").alias("_cut")).distinct()
    cut = carried(with_carried(slices.select("shard_index", "_slice"), cuts, ["shard_index"]), ["shard_index"], {"_cut": "last"})
    return begun, materialise(cut.select("shard_index", "_slice", "_cut", "_before__cut"), "cuts"), size


def _with_batches(index: DataFrame, starts: DataFrame, cuts: DataFrame, size: int) -> DataFrame:
    """index with _block, by which it is dealt, and the batch of the last start at or before each row."""
    rows = with_carried(index.withColumn("_slice", slice_of("row_id", size)), cuts, ["shard_index"])
    block = F.when(F.col("row_id") >= F.col("_cut"), F.col("_cut")).otherwise(F.col("_before__cut"))
    both = rows.select(*index.columns, block.alias("_block")).unionByName(starts, allowMissingColumns=True)
    own = Window.partitionBy("shard_index", "_block").orderBy("row_id")  # a start counts for its own row too, which is its peer
    return both.withColumn("_batch", F.max("batch").over(own)).where("batch is null").select(*index.columns, "_block", F.col("_batch").alias("batch"))


def interleave(rows: DataFrame, within: list[str]) -> DataFrame:
    """rows with spread_order (from 1): parents take turns in the order in which they are first seen."""
    named = rows.withColumn("_parent", parent(F.col("path")))
    w = Window.partitionBy(*within, "_parent").orderBy("row_id")
    named = named.withColumns({"_turn": F.row_number().over(w), "_seen": F.first("row_id").over(w)})
    order = Window.partitionBy(*within).orderBy("_turn", "_seen", "row_id")
    return named.withColumn("spread_order", F.row_number().over(order)).drop("_parent", "_turn", "_seen")


def deepest_first(rows: DataFrame) -> DataFrame:
    return rows.where("file_type = 2").withColumn("depth", depth(F.col("path"))).orderBy(F.desc("depth"), "row_id")


def copy_plan(index: DataFrame, max_bytes: int = 1 << 30, max_files: int = 1000, block_rows: int = BLOCK_ROWS, **policy) -> DataFrame:
    """Batch, place in its spread order, action, link role, attributes and size class of every row; links are found inside their batch."""
    batched, dealt = _batched(index, max_bytes, max_files, block_rows)
    if not dealt:
        # The one exchange of all windows below, which all stay inside a batch.
        batched, dealt = batched.repartition("shard_index", "batch"), ["shard_index"]
    roles = interleave(link_roles(batched, [*dealt, "batch"]), [*dealt, "batch"])
    return roles.select("shard_index", "row_id", "batch", "spread_order", copy_action(F.col("link_role")).alias("action"), "link_role", attr_plan(**policy).alias("attributes"), F.when(F.col("file_type") == 1, size_class(F.col("size"))).alias("size_class"), "size")


def plan_rollup(plan: DataFrame) -> DataFrame:
    return plan.groupBy("shard_index", "action").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def expected_downgrades(index: DataFrame, keeps_symlink_mode: bool = False) -> DataFrame:
    """shard_index, downgrade, row_id that nulls and links imply; the missing file system id counts once a shard."""
    link = F.col("file_type") == 3
    kinds = [F.when(F.col("mtime_sec").isNull(), "NULL_MTIME"), F.when(F.col("atime_sec").isNull(), "NULL_ATIME"), F.when(F.col("uid").isNull() | F.col("gid").isNull(), "NULL_OWNER")]
    if not keeps_symlink_mode:
        kinds.append(F.when(link & (F.col("mode").bitwiseAND(511) != 511), "SYMLINK_MODE"))
    rows = index.select("shard_index", "row_id", F.explode(F.array_compact(F.array(*kinds))).alias("downgrade"))
    ungrouped = index.where("fsid is null and nlink > 1 and file_type = 1").groupBy("shard_index").agg(F.min("row_id").alias("row_id")).select("shard_index", "row_id", F.lit("FSID_UNGROUPED").alias("downgrade"))
    return rows.unionByName(ungrouped)


def fidelity_forecast(index: DataFrame, recorded: DataFrame) -> DataFrame:
    """shard_index, downgrade, expected, recorded: counts of both, for every shard and kind that either has."""
    e = expected_downgrades(index).groupBy("shard_index", "downgrade").agg(F.count("*").alias("expected"))
    r = recorded.groupBy("shard_index", "downgrade").agg(F.count("*").alias("recorded"))
    j = e.join(r, ["shard_index", "downgrade"], "full_outer")
    return j.select("shard_index", "downgrade", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("recorded", F.lit(0)).alias("recorded"))


DIRECTORY_ATTRIBUTES = ("file_type", "dev", "ino", "mode", "uid", "gid", "nlink", "size", "mtime_sec", "mtime_nsec", "ctime_sec", "ctime_nsec")


def identity_changes(before: Callable[[str], Column], after: Callable[[str], Column]) -> Column:
    """Which of type, size, mtime, ctime and device:inode differ, with both values, as text."""

    def change(name: str, *fields: str, show: Callable[..., Column] = lambda *c: F.concat_ws(":", *c)) -> Column:
        moved = F.array_contains(F.array(*[~before(c).eqNullSafe(after(c)) for c in fields]), True)
        return F.when(moved, F.concat(F.lit(f"{name} "), show(*map(before, fields)), F.lit(" -> "), show(*map(after, fields))))

    times = {"mtime": ("mtime_sec", "mtime_nsec"), "ctime": ("ctime_sec", "ctime_nsec")}
    found = [change("type", "file_type"), change("size", "size"), *[change(k, *v, show=timestamp) for k, v in times.items()], change("identity", "dev", "ino")]
    return F.array_join(F.array_compact(F.array(*found)), ", ")


def stability_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, finding, changes: directories of which any attribute changed while they were listed, and files torn or replaced meanwhile.

    A change time tells a file that was rewritten in place and had its modification time put back.
    """
    j = before.select("path", *[F.col(c).alias(f"a_{c}") for c in DIRECTORY_ATTRIBUTES]).join(after.select("path", *[F.col(c).alias(f"b_{c}") for c in DIRECTORY_ATTRIBUTES]), "path")
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))

    def moved(*fields: str) -> Column:
        return F.array_contains(F.array(*[~a(c).eqNullSafe(b(c)) for c in fields]), True)

    torn = moved("size", "mtime_sec", "mtime_nsec", "ctime_sec", "ctime_nsec")
    finding = F.when((a("file_type") == 2) & moved(*DIRECTORY_ATTRIBUTES), "unstable_directory").when((a("file_type") == 1) & torn, "torn_copy").when((a("file_type") == 1) & moved("dev", "ino"), "replaced")
    return j.select("path", finding.alias("finding"), identity_changes(a, b).alias("changes")).where("finding is not null")


BLOCK_BYTES = 512


def estate_profile(index: DataFrame) -> DataFrame:
    """Rows, bytes, bytes with every inode once, and bytes that sparse files don't allocate: by type and size class, by
    each, by depth, by owner, and in all. `level` tells the columns that are not grouped by, as bits.

    Inodes are told apart by file system; all without one are one. The first row of an inode carries its bytes.
    """
    blocks = F.col("allocated_blocks") if "allocated_blocks" in index.columns else F.lit(None).cast("long")
    keyed = F.coalesce((F.col("nlink") > 1) & F.col("inode").isNotNull() & (F.col("file_type") == 1), F.lit(False))
    kind = F.when(F.col("file_type") == 1, size_class(F.col("size"))).otherwise("none")
    by = ["file_type", "size_class", "depth", "uid"]
    rows = index.select("row_id", "fsid", "inode", "size", "file_type", kind.alias("size_class"), depth(F.col("path")).cast("long").alias("depth"), "uid", keyed.alias("keyed"), F.greatest(F.col("size") - blocks * BLOCK_BYTES, F.lit(0)).alias("sparse"))
    each = rows.select(*by, F.lit(1).alias("n"), "size", F.when(F.col("keyed"), 0).otherwise(F.col("size")).alias("once"), F.when(F.col("file_type") == 1, F.col("sparse")).alias("sparse"))
    first = rows.where("keyed").groupBy("fsid", "inode").agg(F.min(F.struct("row_id", *by, "size")).alias("f")).select("f.*")
    zero = F.lit(0).cast("long")
    both = each.unionByName(first.select(*by, F.lit(0).alias("n"), zero.alias("size"), F.col("size").alias("once"), zero.alias("sparse")))
    sets = [["file_type", "size_class"], ["file_type"], ["size_class"], ["depth"], ["uid"], []]
    sums = both.groupingSets([[F.col(c) for c in s] for s in sets], *by)
    return sums.agg(F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n"), F.sum("size").alias("bytes"), F.sum("once").alias("bytes_once"), F.coalesce(F.sum("sparse"), zero).alias("sparse_bytes"))
