"""A data source of Parquet footers: what a file says of itself, read from its last bytes alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES = 64  # a partition
TAIL = 64 << 10  # bytes that are read first: footers of most files fit
MAGIC = b"PAR1"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def reachable(path: str) -> bool:
    """Whether the path's store can be read by range, outside Spark's own readers."""
    try:
        system, at = _opened(path)
        return system.get_file_info(at).type.name != "NotFound"
    except Exception:  # no such file system here, or no way to it
        return False


def footer(system, path: str) -> tuple[bytes, int]:
    """The end of a file with its whole footer, and how many bytes were read for it."""
    with system.open_input_file(path) as f:
        size = f.size()
        tail = f.read_at(min(size, TAIL), size - min(size, TAIL))
        if len(tail) < 12 or tail[-4:] != MAGIC:
            raise ValueError(f"no Parquet file: {path}")
        need = int.from_bytes(tail[-8:-4], "little") + 8
        if need > size:
            raise ValueError(f"no Parquet file: {path}")
        got = len(tail)
        if need > got:
            tail, got = f.read_at(need, size - need), got + need
        return tail, got


@dataclass
class Files(InputPartition):
    paths: list[str]


class FooterReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, at = _opened(self.path)
        one = system.get_file_info(at)
        found = [one.path] if one.is_file else sorted(i.path for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.is_file and i.path.endswith(".parquet"))
        return [Files(found[k : k + FILES]) for k in range(0, len(found), FILES)]

    def read(self, partition: Files) -> Iterator[tuple]:
        import pyarrow as pa
        import pyarrow.parquet as pq

        system, _ = _opened(self.path)
        for path in partition.paths:
            tail, got = footer(system, path)
            meta = pq.read_metadata(pa.BufferReader(tail))
            stamps = {k.decode(): v.decode(errors="replace") for k, v in (meta.metadata or {}).items() if not k.startswith(b"org.apache.spark")}
            for k, v in (stamps or {None: None}).items():
                yield path, meta.num_rows, meta.num_row_groups, got, k, v


class FooterSource(DataSource):
    """spark.read.format("parquet_footers").load(path): a row for each stamp of each file (one with nulls for a file without), and the bytes read."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return "file string, rows long, row_groups int, bytes_read long, key string, value string"

    def reader(self, schema) -> FooterReader:
        return FooterReader(self.options["path"])
