"""Expressions over paths. Paths are raw bytes; text forms are for matching only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNAPSHOT_DIRS = r"(^|/)(\.snapshot|\.zfs/snapshot|~snapshot)(/|$)"
PARTIAL_NAME = r"(?s)^\..+\.[^.]+\.[0-9]+\.partial$"


def path_b64(path: Column) -> Column:
    """Base64 on one line (Spark wraps lines at 76 characters)."""
    return F.regexp_replace(F.base64(path.cast("binary")), "[\r\n]", "")


def path_from_b64(text: Column) -> Column:
    return F.unbase64(text)


def strip_root(path: Column, root: str) -> Column:
    """An absolute path below root, from the root on: '/' for the root itself, an error outside of it."""
    root = root.rstrip("/")
    inside = F.substring(path, len(root) + 1, 1 << 30)
    if not root:
        return F.when(path.startswith("/"), path).otherwise(F.raise_error(F.concat(F.lit("outside the root: "), path)).cast("string"))
    return F.when(path == root, F.lit("/")).when(path.startswith(root + "/"), inside).otherwise(F.raise_error(F.concat(F.lit("outside the root: "), path)).cast("string"))


def history_path(path: Column) -> Column:
    """Without the one leading slash that it must have."""
    return F.when(path.startswith("/"), F.substring(path, 2, 1 << 30)).otherwise(F.raise_error(F.lit("no leading slash")).cast("string"))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)$", 1)


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def is_safe_path(path: Column) -> Column:
    """Begins with a slash, holds no NUL, and no component is empty, '.' or '..'; the root alone is safe."""
    clean = path.startswith("/") & ~path.contains("\0") & ~path.rlike(r"(?s)/(/|\.{1,2}(/|$))") & ~path.rlike(r"(?s)./$")
    return (path == "/") | clean


def is_partial_name(name: Column) -> Column:
    """What a copy in progress is called: .<base>.<host>.<digits>.partial"""
    return name.rlike(PARTIAL_NAME)


def shard_of_claim(key: Column) -> Column:
    return F.regexp_extract(key, r"shards/([^/]+)\.claim$", 1)


def sink_of(key: Column) -> Column:
    """host, shard and epoch of a sink's object name."""
    pattern = r"(failures|downgrades)/host-([^/]+)/(.+)-e([0-9]+)\.jsonl$"
    return F.struct(F.regexp_extract(key, pattern, 1).alias("sink"), F.regexp_extract(key, pattern, 2).alias("host"), F.regexp_extract(key, pattern, 3).alias("stem"), F.regexp_extract(key, pattern, 4).try_cast("int").alias("epoch"))


def start_seq(key: Column) -> Column:
    """Route and first sequence number of an event chunk's name."""
    return F.struct(F.regexp_extract(key, r"events/([^/]+)/[0-9]{20}\.jsonl$", 1).alias("route"), F.regexp_extract(key, r"/([0-9]{20})\.jsonl$", 1).try_cast("long").alias("start_seq"))
