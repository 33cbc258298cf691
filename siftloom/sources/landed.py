"""A data source of landed payloads: files in folders named after their source, one row each, read by the executors.

Fetching is outside the engine. What fetches writes files; this reads them where a plain file format won't do, with filters on
the source pushed into the listing. The root may be on any store that pyarrow opens by its address; a path without a scheme is a folder that
every machine has mounted.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

SCHEMA = "source string, name string, body string"
#: Files that a task reads.
FILES = 256


class FilePartition(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


def _listed(root: str, source: str | None = None) -> list[tuple[int, str, str]]:
    """(time of change in nanoseconds, source, path) of the files one folder below the root."""
    from pyarrow import fs

    system, top = fs.FileSystem.from_uri(root)
    folders = [x for x in system.get_file_info(fs.FileSelector(top)) if x.type == fs.FileType.Directory and source in (None, x.base_name)]
    return sorted((f.mtime_ns or 0, d.base_name, f.path) for d in folders for f in system.get_file_info(fs.FileSelector(d.path)) if f.type == fs.FileType.File)


def _dealt(files: list[tuple[int, str, str]], at_once: int) -> list[InputPartition]:
    pairs = sorted((s, p) for _, s, p in files)
    return [FilePartition(pairs[i : i + at_once]) for i in range(0, len(pairs), at_once)]


def _bodies(root: str, partition: FilePartition) -> Iterator[tuple]:
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(root)
    for source, path in partition.files:
        with system.open_input_stream(path) as f:
            yield source, path.rpartition("/")[2], f.read().decode(errors="replace")


class LandedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.at_once, self.source = options["path"], int(options.get("filespertask", FILES)), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source",):
                self.source = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return _dealt(_listed(self.root, self.source), self.at_once) or [FilePartition([])]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        return _bodies(self.root, partition)


class LandedStream(DataSourceStreamReader):
    """Files in the order of their times: an offset is the last one's time and path. A file must not change once it is there."""

    def __init__(self, options: dict[str, str]):
        self.root, self.at_once = options["path"], int(options.get("filespertask", FILES))

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.root)
        last = max(((t, p) for t, _, p in files), default=(-1, ""))
        return {"at": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = (start["at"], start["path"]), (end["at"], end["path"])
        return _dealt([f for f in _listed(self.root) if after < (f[0], f[2]) <= upto], self.at_once)

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        return _bodies(self.root, partition)

    def commit(self, end: dict) -> None:
        pass


class Landed(DataSource):
    """spark.read.format("landed").load(folder), or spark.readStream; option filesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> LandedStream:
        return LandedStream({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Landed)
