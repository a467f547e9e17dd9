"""Landed record files as a data source: lines by byte ranges, as a batch or as a stream that follows growing files.

``spark.read.format("landed_records")`` cuts the files of a folder into ranges; a line belongs to the range it begins in,
so one large file is many tasks. ``spark.readStream`` of the same format remembers how far it has read each file: lines
that are appended to a file come with the next batch, and a line without its end waits until it has one. Other readers
of Spark take a file as it was when they first saw it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from runlore.session import ship_package

NAME = "landed_records"
SCHEMA = T.StructType([T.StructField("file", T.StringType()), T.StructField("position", T.LongType()), T.StructField("value", T.StringType())])
#: Bytes of a range, unless the option ``split_bytes`` says otherwise, and lines handed on at a time.
SPLIT_BYTES = 64 << 20
BATCH_LINES = 4096
BLOCK = 1 << 20


class Range(InputPartition):
    """Lines of a file that begin at ``start`` or later and before ``end``."""

    def __init__(self, path: str, name: str, start: int, end: int):
        super().__init__((path, name, start, end))
        self.path, self.name, self.start, self.end = path, name, start, end


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in any store that Arrow opens (local, HDFS, S3, GCS, Azure)."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    store, at = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store, at.rstrip("/")


class Folder:
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("pathglobfilter", options.get("pathGlobFilter", "*.jsonl"))
        self.split = max(1, int(options.get("split_bytes", SPLIT_BYTES)))

    def sizes(self) -> dict[str, int]:
        """Bytes of each file by its name in the folder; hidden ones are left out."""
        store, at = located(self.path)
        found = store.get_file_info(fs.FileSelector(at, recursive=True))
        names = {f.path[len(at) + 1 :]: f.size for f in found if f.type == fs.FileType.File}
        return {n: s for n, s in sorted(names.items()) if fnmatch(n.rsplit("/", 1)[-1], self.glob) and not any(p[0] in "._" for p in n.split("/"))}

    def ranges(self, name: str, start: int, end: int) -> list[Range]:
        return [Range(self.path, name, at, min(at + self.split, end)) for at in range(start, end, self.split)]


def lines(part: Range) -> Iterator[tuple[int, bytes]]:
    """(place, line without its end) of the range; the last line may go on beyond it. Blank lines are left out."""
    store, at = located(part.path)
    with store.open_input_file(f"{at}/{part.name}") as file:
        place = part.start
        if place:  # a line that began before this range belongs to the range before
            place -= 1
            while block := file.read_at(BLOCK, place):
                cut = block.find(b"\n")
                place += len(block) if cut < 0 else cut + 1
                if cut >= 0:
                    break
        read, held = place, b""
        while place < part.end:
            block = file.read_at(BLOCK, read)
            read += len(block)
            found = (held + block).split(b"\n")
            held = found.pop() if block else b""
            for line in found:
                if place >= part.end:
                    return
                if line.strip():
                    yield place, line.rstrip(b"\r")
                place += len(line) + 1
            if not block:
                return


def batches(part: Range) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, bytes]] = []

    def flush() -> pa.RecordBatch:
        columns = [pa.array([part.name] * len(held), pa.string()), pa.array([p for p, _ in held], pa.int64()),
                   pa.array([x.decode("utf-8", "replace") for _, x in held], pa.string())]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=SCHEMA.names)

    for line in lines(part):
        held.append(line)
        if len(held) >= BATCH_LINES:
            yield flush()
    if held:
        yield flush()


class BatchReader(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def partitions(self) -> list[Range]:
        found = [r for n, s in self.folder.sizes().items() for r in self.folder.ranges(n, 0, s)]
        return found or [Range(self.folder.path, "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(partition) if partition.name else iter(())


class StreamReader(DataSourceStreamReader):
    """An offset is the number of bytes read of each file. A file that is gone or has become shorter gives no more."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        return {"files": json.dumps({n: self._complete(n, s) for n, s in self.folder.sizes().items()})}

    def _complete(self, name: str, size: int) -> int:
        """Bytes up to the end of the last line that has one, read from the file's end backwards."""
        store, at = located(self.folder.path)
        with store.open_input_file(f"{at}/{name}") as file:
            end = size
            while end > 0:
                start = max(0, end - BLOCK)
                cut = file.read_at(end - start, start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        return [r for n, s in now.items() if s > before.get(n, 0) for r in self.folder.ranges(n, before.get(n, 0), s)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(partition)

    def commit(self, end: dict) -> None:
        pass


class LandedRecords(DataSource):
    """Options: ``path``, ``pathGlobFilter`` (``*.jsonl``), ``split_bytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> BatchReader:
        return BatchReader(Folder(self.options))

    def streamReader(self, schema: T.StructType) -> StreamReader:
        return StreamReader(Folder(self.options))


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(LandedRecords)


def read_records(spark: SparkSession, path: str, schema: T.StructType, stream: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(records with ``file`` and ``position``, lines that hold none) of the landed files of a folder."""
    register(spark)
    reader = spark.readStream if stream else spark.read
    rows = reader.format(NAME).options(**options).load(path)
    parsed = rows.withColumn("_record", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]),
                                                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_record").isNull() | F.col("_record._bad").isNotNull()
    good = parsed.where(~bad).select("file", "position", *[F.col(f"_record.`{c}`").alias(c) for c in schema.names])
    return good, parsed.where(bad).select("file", "position", "value")
