"""Python data sources: a raw listing of a store, and documents that many tasks write and one commit publishes.

``object_listing`` lists by prefix: every folder under the path is a partition, so folders are walked in parallel, and a pushed-down filter on
``key`` leaves out folders that cannot match. Unlike file sources it keeps empty objects and hidden ones. As a stream
its offset is the greatest key seen: stores whose keys grow (by date, by number) deliver what came after it.

``json_document`` writes one JSON document: rows ``fragment`` come range-partitioned and sorted, each task writes its own fragments,
and the commit joins the files in partition order, piece by piece, between a head and a tail. It publishes only if the document is still
the one that was read (``expected``: its ``version_of``, empty for none), else the job fails with a ``Conflict`` and nothing is changed.

Paths are URIs that pyarrow's file systems open (local, hdfs, s3, gs), seen alike by all executors.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, StringStartsWith, WriterCommitMessage

from tessera.functions import names
from tessera.sources.tables import index_rows

LISTING = "key string, size long, last_modified string"
#: Bytes that a commit copies at once.
PIECE = 8 << 20


class Conflict(Exception):
    """Somebody else has published since the document was read."""


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else path.removeprefix("file:"))


def version_of(path: str) -> str:
    """What tells a document's versions apart: size and time of the file; empty if there is none."""
    system, at = opened(path)
    info = system.get_file_info(at)
    return "" if info.type == fs.FileType.NotFound else f"{info.size}-{info.mtime_ns}"


@dataclass
class KeyRange:
    """What pushed-down filters and a stream's offsets say of keys: a common start, and more than ``after`` up to ``upto``."""

    start: str = ""
    after: str = ""
    upto: str | None = None

    def may_hold(self, folder: str) -> bool:
        inside = folder.startswith(self.start) or self.start.startswith(folder)
        return inside and not (self.after and folder < self.after and not self.after.startswith(folder)) and not (self.upto is not None and folder > self.upto)

    def holds(self, key: str) -> bool:
        return key.startswith(self.start) and key > self.after and (self.upto is None or key <= self.upto)


@dataclass
class Prefix(InputPartition):
    """A folder with all below it, or the objects right under the path."""

    folder: str
    deep: bool
    keys: KeyRange


def _folders(path: str, keys: KeyRange) -> list[Prefix]:
    system, at = opened(path)
    found = system.get_file_info(fs.FileSelector(at))
    own = [Prefix(i.path, True, keys) for i in found if i.type == fs.FileType.Directory and keys.may_hold(i.path[len(at.rstrip("/")) + 1 :] + "/")]
    return [Prefix(at, False, keys), *sorted(own, key=lambda p: p.folder)]


def _objects(path: str, part: Prefix) -> Iterator[tuple]:
    system, at = opened(path)
    root = len(at.rstrip("/")) + 1
    for i in system.get_file_info(fs.FileSelector(part.folder, recursive=part.deep)):
        if i.type == fs.FileType.File and part.keys.holds(i.path[root:]):
            yield i.path[root:], i.size, i.mtime.strftime("%Y-%m-%dT%H:%M:%S")


class ListingReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.keys = path, KeyRange()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("key",):
                if isinstance(f, (StringStartsWith, EqualTo)) and len(f.value) > len(self.keys.start):
                    self.keys.start = f.value
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.keys.after = max(self.keys.after, f.value[:-1] if isinstance(f, GreaterThanOrEqual) else f.value)
            yield f  # Spark looks at the rows again, so a folder too many does no harm

    def partitions(self) -> list[Prefix]:
        return _folders(self.path, self.keys)

    def read(self, partition: Prefix) -> Iterator[tuple]:
        return _objects(self.path, partition)


class ListingStream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"key": ""}

    def latestOffset(self) -> dict:
        return {"key": max((key for part in _folders(self.path, KeyRange()) for key, *_ in _objects(self.path, part)), default="")}

    def partitions(self, start: dict, end: dict) -> list[Prefix]:
        return _folders(self.path, KeyRange(after=start["key"], upto=end["key"]))

    def read(self, partition: Prefix) -> Iterator[tuple]:
        return _objects(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "object_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"])

    def streamReader(self, schema) -> ListingStream:
        return ListingStream(self.options["path"])


def raw_listing(spark: SparkSession, path: str) -> DataFrame:
    """key, size, last_modified, extension, media_type of every object under a path, empty and unsupported ones too."""
    spark.dataSource.register(ListingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("object_listing").option("path", path).load()
    extension = names.extension(F.col("key"))
    return rows.withColumns({"extension": extension, "media_type": names.media_type(extension)})


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    rows: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.head, self.tail, self.expected = (options.get(k, "") for k in ("path", "head", "tail", "expected"))
        self.folder = f"{self.path}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        number, rows = TaskContext.get().partitionId(), 0
        system, folder = opened(self.folder)
        system.create_dir(folder, recursive=True)
        file = f"{folder}/{number}-{uuid.uuid4().hex}"  # a task that runs again writes another file
        with system.open_output_stream(file) as out:
            for row in iterator:
                out.write((b"," if rows else b"") + row[0].encode())
                rows += 1
        return Written(number, file, rows)

    def commit(self, messages: list) -> None:
        system, target = opened(self.path)
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.partition)
        whole = f"{opened(self.folder)[1]}.whole"
        try:
            with system.open_output_stream(whole) as out:
                out.write(self.head.replace("{count}", str(sum(m.rows for m in parts))).encode())
                for i, m in enumerate(parts):
                    out.write(b"," if i else b"")
                    with system.open_input_stream(m.file) as own:
                        while piece := own.read(PIECE):
                            out.write(piece)
                out.write(self.tail.encode())
            if version_of(self.path) != self.expected:
                raise Conflict(f"{self.path} is not the version that was read")
            system.move(whole, target)
        finally:
            self.abort(messages)
            if system.get_file_info(whole).type != fs.FileType.NotFound:
                system.delete_file(whole)

    def abort(self, messages: list) -> None:
        system, folder = opened(self.folder)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_document"

    def schema(self) -> str:
        return "fragment string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


def write_document(fragments: DataFrame, path: str, head: str, tail: str, expected: str) -> None:
    """Publishes ``head``, the fragments (column ``fragment``, sorted over the partitions) and ``tail``; ``{count}`` in the head is their number."""
    fragments.sparkSession.dataSource.register(DocumentSink)
    try:
        fragments.select("fragment").write.format("json_document").options(path=path, head=head, tail=tail, expected=expected).mode("append").save()
    except Exception as error:
        if "Conflict" in str(error):
            raise Conflict(f"{path} is not the version that was read") from error
        raise


def write_index(items: DataFrame, path: str, generated_at: int, expected: str, version: int = 1) -> None:
    """Publishes the index of items (ordinal, key, ext, size) in their order."""
    ordered = items.repartitionByRange("ordinal", "key").sortWithinPartitions("ordinal", "key")
    write_document(ordered.select(F.to_json(F.struct("key", "ext", "size")).alias("fragment")), path, f'{{"version":{version},"generated_at":{generated_at},"count":{{count}},"items":[', "]}", expected)


def update_index(spark: SparkSession, path: str, mutate: Callable[[DataFrame | None], DataFrame | None], generated_at: int, attempts: int = 8) -> str:
    """Reads the index rows, mutates them to items (or None for no change) and publishes; again if another writer came first. The version that stands."""
    for attempt in range(1, attempts + 1):
        seen = version_of(path)
        rows = index_rows(spark.read.text(path, wholetext=True).select(F.col("value").alias("body"))) if seen else None
        items = mutate(rows)
        if items is None:
            return seen
        try:
            write_index(items, path, generated_at, seen)
            return version_of(path)
        except Conflict:
            if attempt < attempts:
                time.sleep(min(1.0, 0.1 * attempt))
    raise RuntimeError(f"no publication in {attempts} attempts")
