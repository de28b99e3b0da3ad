"""Readers and writers of the estate's and the run's tables, with explicit schemas and checks."""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.paths import path_b64, path_from_b64, shard_of_claim, sink_of, start_seq
from tidemark.scratch import remove
from tidemark.sources import footers

FORMAT_VERSION = 1
SCHEMA_VERSION = 1  # of events and snapshots
SCAN_REQUIRED = {"path": "string", "file_type": "string", "size": "bigint", "permissions": "int", "uid": "bigint", "gid": "bigint", "nlink": "bigint", "inode": "bigint", "mtime_us": "bigint"}
SCAN_OPTIONAL = {"atime_us": "bigint", "mtime_sec": "bigint", "mtime_nsec": "bigint", "atime_sec": "bigint", "atime_nsec": "bigint", "symlink_target": "string"}
INDEX_REQUIRED = ("row_id", "path", "size", "mode", "file_type")
INDEX_OPTIONAL = {"mtime_sec": "bigint", "mtime_nsec": "bigint", "atime_sec": "bigint", "atime_nsec": "bigint", "uid": "bigint", "gid": "bigint", "nlink": "bigint", "inode": "bigint", "fsid": "bigint", "allocated_blocks": "bigint", "symlink_target": "string"}

MANIFEST = "run_id string, created_utc string, root string, exclusions array<string>, shards array<struct<key: string, rows: bigint, bytes: bigint, etag: string>>, format_version int"
CLAIM = "host string, claimed_utc timestamp, epoch int, state string"
PROGRESS = "host string, heartbeat_utc timestamp, current_shard string, shard_rows_done bigint, held_etag string, heartbeat_sec bigint, files_ok bigint, files_failed bigint, files_fenced bigint, latency struct<window_sec: bigint, ops: array<struct<side: string, op: string, count: bigint, total_us: bigint, p50_us: bigint, p95_us: bigint, p99_us: bigint, max_us: bigint>>>"
SINK = "row_id bigint, path_b64 string, error string, phase string, downgrade string"
EVENT = "seq bigint, event_at timestamp, schema_version int, job_id string, worker_id string, kind string, files_delta bigint, bytes_delta bigint, sync_files bigint, class string, path string, retryable boolean, client_seq bigint, to_phase string, mismatches bigint, to_state string, reason string"
# Spark's own formats for JSON cut times to milliseconds.
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
EVIDENCE = "path_b64 string, reason string, source string, source_etag string"


def contract_problems(df: DataFrame, required: dict[str, str] = SCAN_REQUIRED) -> dict[str, str]:
    """Required columns that are missing or have another type."""
    have = dict(df.dtypes)
    return {c: "missing" if c not in have else f"{have[c]} instead of {t}" for c, t in required.items() if have.get(c) != t}


def check_scan_contract(df: DataFrame, required: dict[str, str] = SCAN_REQUIRED, optional: dict[str, str] = SCAN_OPTIONAL) -> DataFrame:
    """df, with optional columns that are missing or mistyped as nulls; an error if required ones are."""
    if problems := contract_problems(df, required):
        raise ValueError(f"scan contract: {problems}")
    have = dict(df.dtypes)
    return df.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if have.get(c) != t})


def with_shard_rows(df: DataFrame) -> DataFrame:
    """A read of part files with shard_index, the place of its file's name among all, and row_in_shard."""
    rows = df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("row_in_shard"))
    names = rows.select("_file").distinct()  # one row a file
    names = names.withColumn("shard_index", F.row_number().over(Window.orderBy("_file")) - 1)
    # As many as 2^23 shards have a number: Spark broadcasts the names if they turn out small.
    return rows.join(names, "_file").drop("_file")


def read_scan(spark: SparkSession, path: str) -> DataFrame:
    """Part files of a folder, or of the one scan below its scans/ folder; several scans, or none, are an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select(F.regexp_extract("path", r"/scans/([^/]+)/[^/]+$", 1).alias("scan")).distinct().limit(3).collect()
    scans = [r["scan"] for r in files]
    if len(scans) != 1:
        raise ValueError(f"expected one scan, found {scans or 'none'}")
    return with_shard_rows(spark.read.parquet(f"{path}/scans/{scans[0]}" if scans[0] else path))


def write_index(index: DataFrame, path: str) -> None:
    """Canonical shards by shard_index, and beside them a table of what each should hold."""
    index.write.partitionBy("shard_index").option("compression", "zstd").parquet(f"{path}/index")
    stamps = index.groupBy("shard_index").agg(F.count("*").alias("rows")).withColumn("format_version", F.lit(FORMAT_VERSION))
    stamps.coalesce(1).write.parquet(f"{path}/_shards")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with absent optional columns as nulls and `problem`: a bad file type, or a row id of another shard."""
    stamps = spark.read.parquet(f"{path}/_shards")
    if stamps.where(F.col("format_version") != FORMAT_VERSION).limit(1).count():
        raise ValueError("index of another format version")
    df = spark.read.parquet(f"{path}/index")
    if missing := [c for c in INDEX_REQUIRED if c not in df.columns]:
        raise ValueError(f"index without {missing}")
    df = df.withColumns({c: F.lit(None).cast(t) for c, t in INDEX_OPTIONAL.items() if c not in df.columns})
    problem = F.when(~F.col("file_type").between(1, 7), "file_type").when(F.shiftrightunsigned("row_id", 40) != F.col("shard_index"), "shard")
    return df.withColumn("problem", problem)


def row_counts(spark: SparkSession, path: str) -> DataFrame:
    """shard_index, stamped, found: shards whose rows are not what was stamped have different numbers."""
    found = spark.read.parquet(f"{path}/index").groupBy("shard_index").agg(F.count("*").alias("found"))
    return spark.read.parquet(f"{path}/_shards").select("shard_index", F.col("rows").alias("stamped")).join(found, "shard_index", "full_outer")


def read_footers(spark: SparkSession, path: str) -> DataFrame:
    """file, rows, key, value: row counts and key/value stamps of Parquet footers.

    Where the store of the path is one that its files can be read from by range (sources.footers), only their ends are read;
    elsewhere, as in a store that only Spark's readers reach, whole files.
    """
    import pyarrow.parquet as pq

    if footers.reachable(path):
        spark.dataSource.register(footers.FooterSource)
        return spark.read.format(footers.FooterSource.name()).load(path).select("file", "rows", "key", "value")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for name, content in zip(pdf["path"], pdf["content"]):
                meta = pq.read_metadata(BytesIO(content))
                stamps = {k.decode(): v.decode(errors="replace") for k, v in (meta.metadata or {}).items() if not k.startswith(b"org.apache.spark")}
                out += [(name, meta.num_rows, k, v) for k, v in (stamps or {None: None}).items()]
            yield pd.DataFrame(out, columns=["file", "rows", "key", "value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", "content").mapInPandas(run, "file string, rows long, key string, value string")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """key, body of small text objects, one row an object."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("key"), F.col("value").alias("body"))


def manifest_run(bodies: DataFrame) -> DataFrame:
    """run_id, root, exclusions and totals of manifests (column body); an unknown version is an error."""
    m = F.from_json("body", MANIFEST)
    version = F.coalesce(F.col("m.format_version"), F.lit(FORMAT_VERSION))
    run = bodies.select(m.alias("m")).where(F.when(version == FORMAT_VERSION, True).otherwise(F.raise_error(F.lit("manifest of another version")).cast("boolean")))
    rows = F.aggregate("m.shards", F.lit(0).cast("long"), lambda a, s: a + s["rows"])
    return run.select("m.run_id", F.coalesce("m.root", F.lit("/")).alias("root"), F.coalesce("m.exclusions", F.array().cast("array<string>")).alias("exclusions"), F.size("m.shards").alias("shards"), rows.alias("total_rows"))


def manifest_shards(bodies: DataFrame) -> DataFrame:
    return bodies.select(F.from_json("body", MANIFEST).alias("m")).select("m.run_id", F.explode("m.shards").alias("s")).select("run_id", F.col("s.key").alias("shard"), F.col("s.rows").alias("n_rows"), F.col("s.bytes").alias("n_bytes"), F.col("s.etag").alias("etag"))


def claims(objects: DataFrame, shards: DataFrame, surface: bool = False) -> DataFrame:
    """shard, host, claimed_utc, epoch, state of claim objects of known shards. Bodies that don't parse are left out, or
    surfaced as state unparseable."""
    named = objects.withColumn("shard", shard_of_claim(F.col("key"))).where("shard <> ''").join(shards.select("shard"), "shard", "left_semi")
    parsed = named.withColumn("c", F.from_json("body", CLAIM))
    good = F.col("c.host").isNotNull() & F.col("c.state").isin("active", "completed", "failed")
    if not surface:
        parsed = parsed.where(good)
    return parsed.select("shard", "c.host", "c.claimed_utc", "c.epoch", F.when(good, F.col("c.state")).otherwise("unparseable").alias("state"))


def progress(bodies: DataFrame) -> DataFrame:
    """Heartbeat records; what old ones lack is null or zero."""
    p = bodies.select(F.from_json("body", PROGRESS).alias("p")).where("p.host is not null").select("p.*")
    return p.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("heartbeat_sec", "files_fenced", "shard_rows_done", "files_ok", "files_failed")})


def sink_lines(lines: DataFrame) -> DataFrame:
    """Failure and downgrade rows with sink, host, stem and epoch from their object's key; a line that doesn't parse is an error.

    A downgrade is a name, or an object with one field of that name.
    """
    raw = lines.select(sink_of(F.col("key")).alias("k"), F.from_json("line", SINK, {"mode": "FAILFAST"}).alias("r"))
    name = F.coalesce(F.regexp_extract("r.downgrade", r'^\{"([A-Z_]+)"', 1), F.lit(""))
    return raw.select("k.*", "r.row_id", path_from_b64(F.col("r.path_b64")).alias("path"), "r.error", "r.phase", F.when(name != "", name).otherwise(F.col("r.downgrade")).alias("downgrade"))


def _refuse_newer(version: Column, what: str) -> Column:
    """True, or an error where a version is above the one that this library knows."""
    return F.when(F.coalesce(version, F.lit(SCHEMA_VERSION)) <= SCHEMA_VERSION, True).otherwise(F.raise_error(F.lit(f"{what} of a newer schema")).cast("boolean"))


def write_events(events: DataFrame, path: str, chunk: int = 100_000) -> None:
    """Events as JSON lines in folders by the first seq that may stand in them, start_seq."""
    start = F.col("seq") - F.pmod(F.col("seq") - 1, F.lit(chunk))
    events.withColumn("start_seq", start).repartition("start_seq").sortWithinPartitions("start_seq", "seq").write.partitionBy("start_seq").options(**MICROS).json(path)


def read_events(spark: SparkSession, path: str, since: int | None = None, streaming: bool = False, files: int = 1) -> DataFrame:
    """Events of JSON lines; a line that doesn't parse, or is of a newer schema, is an error. since: only later ones.

    Chunks of write_events that end before `since` are not read. files: of a micro-batch, for a stream.
    """
    reader = (spark.readStream.option("maxFilesPerTrigger", files) if streaming else spark.read).option("mode", "FAILFAST")
    chunked = since is not None and not streaming
    if chunked:
        names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"/start_seq=(\d+)/", 1).try_cast("long").alias("start")).distinct()
        # The last chunk that starts at or before the cursor may hold later events; those before it can't.
        first = names.where(F.col("start") <= since).agg(F.max("start")).first()[0]
        chunked = first is not None
    df = reader.schema(EVENT + ", start_seq bigint" * chunked).json(path)
    if chunked:
        df = df.where(F.col("start_seq") >= first).drop("start_seq")
    df = df.where(_refuse_newer(F.col("schema_version"), "event"))
    return df if since is None else df.where(F.col("seq") > since)


def chunk_of(key: Column) -> Column:
    return start_seq(key)


def write_state(tables: dict[str, DataFrame], path: str, version: int, keep: int | None = None) -> None:
    """Each table of a snapshot under its version. keep: versions that stay, the newest ones."""
    for name, df in tables.items():
        df.withColumn("_schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").parquet(f"{path}/version={version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    for old in state_history(spark, path)[keep:] if keep is not None else []:
        remove(spark, f"{path}/version={old}")


def state_history(spark: SparkSession, path: str) -> list[int]:
    """Versions that are stored, newest first: one name a snapshot."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select(F.regexp_extract("path", r"/version=(\d+)/", 1).cast("int").alias("v")).distinct()
    return sorted((r["v"] for r in found.collect()), reverse=True)


def read_state(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a snapshot, the newest if no version is given; one of a newer schema is an error."""
    if version is None:
        version = state_history(spark, path)[0]
    df = spark.read.parquet(f"{path}/version={version}/{name}")
    return df.where(_refuse_newer(F.col("_schema_version"), "snapshot")).drop("_schema_version")


def write_partitioned(df: DataFrame, path: str, by: str, form: str = "parquet") -> None:
    df.write.partitionBy(by).format(form).save(path)


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(form).load(path)


def evidence_lines(evidence: DataFrame) -> DataFrame:
    """value: one JSON object a row, in order and without repeats."""
    rows = evidence.select(path_b64(F.col("path")).alias("path_b64"), "reason", "source", "source_etag").distinct()
    return rows.orderBy("path_b64", "reason", "source", "source_etag").select(F.to_json(F.struct("path_b64", "reason", "source", "source_etag")).alias("value"))


def read_evidence(lines: DataFrame) -> DataFrame:
    """Evidence rows of lines (column value); unknown or missing fields, carriage returns and bad lines are errors."""
    keys = F.array_sort(F.json_object_keys("value"))
    strict = (keys == F.array(*[F.lit(k) for k in ("path_b64", "reason", "source", "source_etag")])) & ~F.contains("value", F.lit("\r"))
    checked = lines.where(F.when(F.coalesce(strict, F.lit(False)), True).otherwise(F.raise_error(F.lit("bad evidence line")).cast("boolean")))
    r = checked.select(F.from_json("value", EVIDENCE, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return r.select(path_from_b64(F.col("path_b64")).cast("string").alias("path"), "reason", "source", "source_etag").distinct()


def rewrite_report(bodies: DataFrame) -> DataFrame:
    """shard, rows, bytes, sha256 of rewrite checkpoints."""
    schema = "shards array<struct<name: string, rows: bigint, bytes: bigint, sha256: string>>"
    return bodies.select(F.explode(F.from_json("body", schema)["shards"]).alias("s")).select(F.col("s.name").alias("shard"), "s.rows", "s.bytes", "s.sha256")
