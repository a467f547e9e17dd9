"""Token ids in binary files of patched frame-of-reference blocks.

A block holds a fixed number of ids. Its least id is subtracted, the rest is packed at the width that a chosen share of
the block needs, and the high bits of the few ids beyond it stand in an exception list behind the packed bits. A file
ends with an index: where every block starts and how it is packed, and how many ids each document has. So a reader
decodes any span of ids from the blocks that hold it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from runlore.llm.common import give_back
from runlore.llm.packing import chunks, slices
from runlore.llm.unit_store import flat_places, word_encoder
from runlore.session import materialise

MAGIC = b"PFOR0001"
#: Ids that a writer or reader holds unpacked at a time, besides those of one document.
HELD = 1 << 20


@dataclass(frozen=True)
class Blocks:
    """Ids in a block (a multiple of 8, at most 65,536); the shares of a block's ids whose width may be the packed one,
    of which the one that makes the block smallest is taken; and ids after which a file ends with its document."""

    size: int = 512
    shares: tuple[float, ...] = (0.75, 0.9, 0.95, 0.98, 0.99, 1.0)
    file_ids: int = 1 << 25


#: What is known of a block: place of its first byte in the file, least id, bits per id, ids in the exception list.
INDEX = pa.schema([("start", pa.int64()), ("least", pa.uint32()), ("width", pa.uint8()), ("exceptions", pa.uint32())])


def pack(ids: np.ndarray, blocks: Blocks = Blocks()) -> tuple[bytes, pa.Table]:
    """(packed blocks, one after the other; their index). The last block is filled up with its last id."""
    size = blocks.size
    n = -(-len(ids) // size)
    if not n:
        return b"", INDEX.empty_table()
    values = np.concatenate([ids, np.full(n * size - len(ids), ids[-1])]).astype(np.uint32).reshape(n, size)
    least = values.min(1)
    rest = (values - least[:, None]).astype("<u4")
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)  # of each id
    ordered = np.sort(bits, 1)
    tried = ordered[:, [max(0, int(np.ceil(s * size)) - 1) for s in blocks.shares]]
    beyond = np.stack([(bits > t[:, None]).sum(1) for t in tried.T], 1)
    best = (tried.astype(np.int64) * (size // 8) + beyond * 6).argmin(1)
    at = np.arange(n)
    width, exceptions = tried[at, best], beyond[at, best]
    length = width.astype(np.int64) * (size // 8) + exceptions * 6
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        every = np.unpackbits(rest[of].view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :w]
        packed = np.packbits(every.reshape(len(of), size * w), axis=1, bitorder="little")
        out[start[of][:, None] + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(bits > width[:, None])
    if len(row):
        rank = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        first = (start + width.astype(np.int64) * (size // 8))[row]
        high = (rest[row, place] >> width[row]).astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(first + 2 * rank)[:, None] + np.arange(2)] = place.astype("<u2").view(np.uint8).reshape(-1, 2)
        out[(first + 2 * exceptions[row] + 4 * rank)[:, None] + np.arange(4)] = high
    return out.tobytes(), pa.table([pa.array(start), pa.array(least), pa.array(width), pa.array(exceptions.astype(np.uint32))], schema=INDEX)


def unpack(data: np.ndarray, start: np.ndarray, least: np.ndarray, width: np.ndarray, exceptions: np.ndarray, size: int) -> np.ndarray:
    """Ids of the blocks that begin at ``start`` in ``data``."""
    out = np.zeros((len(start), size), "<u4")
    width, exceptions = width.astype(np.int64), exceptions.astype(np.int64)
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        packed = data[start[of][:, None] + np.arange(w * size // 8)]
        bits = np.zeros((len(of) * size, 32), np.uint8)
        bits[:, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(-1, w)
        out[of] = np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(len(of), size)
    if exceptions.any():
        row = np.repeat(np.arange(len(start)), exceptions)
        first = start + width * (size // 8)
        place = data[flat_places(first, 2 * exceptions)].view("<u2")
        high = data[flat_places(first + 2 * exceptions, 4 * exceptions)].view("<u4")
        out[row, place] |= high << width[row].astype(np.uint32)
    return (out + least[:, None].astype(np.uint32)).reshape(-1)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path there of a folder or file in any store that Arrow opens (local, HDFS, S3, GCS, Azure)."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class FileWriter:
    """Writes one file: documents' ids go in blocks as they fill, the index last."""

    def __init__(self, folder: str, key: pa.DataType, blocks: Blocks):
        self.blocks, self.key = blocks, key
        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.pfor"
        store, path = located(self.path)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = store.open_output_stream(path)
        self.out.write(MAGIC)
        self.at, self.n, self.held, self.waiting = len(MAGIC), 0, [], 0
        self.index: list[pa.Table] = []
        self.keys: list[pa.Array] = []
        self.counts: list[np.ndarray] = []

    def add(self, keys: pa.Array, ids: list[np.ndarray]) -> None:
        self.keys.append(keys)
        self.counts.append(np.array([len(x) for x in ids], np.int64))
        self.held += ids
        self.waiting += int(self.counts[-1].sum())
        self.n += int(self.counts[-1].sum())
        if self.waiting >= HELD:
            self._write(self.waiting - self.waiting % self.blocks.size)

    def _write(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        self.held, self.waiting = [ids[n:].copy()], len(ids) - n
        data, index = pack(ids[:n], self.blocks)
        self.out.write(data)
        self.index.append(index.set_column(0, "start", pc.add(index["start"], self.at)))
        self.at += len(data)

    def close(self) -> tuple[str, int, int, int]:
        """(path, documents, ids, bytes)."""
        self._write(self.waiting)
        documents = pa.table({"key": pa.chunked_array(self.keys, self.key), "n": pa.array(np.concatenate(self.counts))})
        tail = []
        for table in (pa.concat_tables(self.index).combine_chunks(), documents.combine_chunks()):
            sink = pa.BufferOutputStream()
            meta = {b"ids": str(self.n).encode(), b"block": str(self.blocks.size).encode()}
            with pa.ipc.new_stream(sink, table.schema.with_metadata(meta)) as stream:
                stream.write_table(table.replace_schema_metadata(meta))
            tail.append(sink.getvalue().to_pybytes())
        sizes = np.array([len(x) for x in tail], "<u8").tobytes()
        self.out.write(b"".join(tail) + sizes + MAGIC)
        self.out.close()
        return self.path, len(documents), self.n, self.at + sum(map(len, tail)) + len(sizes) + len(MAGIC)


class FileReader:
    """Reads one file: its index at once, ids by span."""

    def __init__(self, path: str):
        store, at = located(path)
        self.file = store.open_input_file(at)
        size = self.file.size()
        foot = self.file.read_at(16 + len(MAGIC), size - 16 - len(MAGIC))
        if foot[16:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"no file of packed ids, or not whole: {path}")
        a, b = np.frombuffer(foot[:16], "<u8").tolist()
        self.end = size - 16 - len(MAGIC) - a - b  # of the blocks
        tail = self.file.read_at(a + b, self.end)
        index = pa.ipc.open_stream(tail[:a]).read_all()
        self.documents = pa.ipc.open_stream(tail[a:]).read_all()
        self.start, self.least, self.width, self.exceptions = (c.to_numpy() for c in index.columns)
        self.ids, self.block = int(index.schema.metadata[b"ids"]), int(index.schema.metadata[b"block"])

    def span(self, first: int, count: int) -> np.ndarray:
        """Ids ``first`` to ``first + count`` of the file, read from the blocks that hold them and no other."""
        if count <= 0:
            return np.empty(0, np.uint32)
        if first < 0 or first + count > self.ids:
            raise IndexError(f"ids {first} to {first + count} of {self.ids}")
        lo, hi = first // self.block, (first + count - 1) // self.block + 1
        begin = int(self.start[lo])
        end = int(self.start[hi]) if hi < len(self.start) else self.end
        data = np.frombuffer(self.file.read_at(end - begin, begin), np.uint8)
        ids = unpack(data, self.start[lo:hi] - begin, self.least[lo:hi], self.width[lo:hi], self.exceptions[lo:hi], self.block)
        return ids[first - lo * self.block :][:count]

    def each(self) -> Iterator[tuple[pa.Array, list[int], list[np.ndarray]]]:
        """(keys, places of the first ids, ids) of the documents, runs of about ``HELD`` ids at a time."""
        counts = self.documents["n"].to_numpy()
        keys = self.documents["key"].combine_chunks()
        past = np.append(0, np.cumsum(counts))
        i = 0
        while i < len(counts):
            j = max(i + 1, int(np.searchsorted(past, past[i] + HELD, side="right")) - 1)
            ids = self.span(int(past[i]), int(past[j] - past[i]))
            yield keys[i:j], past[i:j].tolist(), np.split(ids, past[i + 1 : j] - past[i])
            i = j


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int | None = 2, key: str = "doc_id", text: str = "text",
                 blocks: Blocks = Blocks()) -> DataFrame:
    """Write the ids of all texts to files in ``folder`` in ascending order of the key, nulls first. One row per file,
    (part, place, path, documents, ids, bytes): files in the order of (part, place) hold the documents in order.

    Rows are dealt by range and sorted there; rows of one key go by text, and equal rows by their number in the table,
    which lets a key with any share of the rows lie in several files. A task names its files itself and the returned
    table, written once by Spark, says which count: files of lost or repeated tasks are in no row of it. A null text is
    an empty one and has its end id alone. Other columns are not read; an empty table gives no file. ``tokenizer`` is a
    path that every worker sees, of a vocabulary that drops white space.
    """
    if not 0 < blocks.size <= 1 << 16 or blocks.size % 8:
        raise ValueError("a block holds a multiple of 8 ids, at most 65,536")
    kind = to_arrow_type(docs.schema[key].dataType)
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("key"), F.xxhash64("text"), F.col("row")]
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, writer, done = word_encoder(tokenizer, end), TaskContext.get().partitionId(), None, []
        for batch in batches:
            for keys, texts in slices([batch]):
                keys = pa.array(keys, kind)
                for at, n in chunks(texts):
                    ids = encode(texts[at : at + n])
                    past, first = np.cumsum([len(x) for x in ids]), 0
                    while first < n:
                        writer = writer or FileWriter(folder, kind, blocks)
                        before = past[first - 1] if first else 0
                        last = min(n, int(np.searchsorted(past, before + blocks.file_ids - writer.n)) + 1)
                        writer.add(keys[at + first : at + last], ids[first:last])
                        first = last
                        if writer.n >= blocks.file_ids:
                            done.append(writer.close())
                            writer = None
        if writer:
            done.append(writer.close())
        columns = list(zip(*done, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(done), pa.int64()), pa.array(range(len(done)), pa.int64()), pa.array(columns[0], pa.string()),
             *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["part", "place", "path", "documents", "ids", "bytes"])
        del encode, writer
        give_back()

    return materialise(dealt.mapInArrow(run, "part bigint, place bigint, path string, documents bigint, ids bigint, bytes bigint"))


def read_tokens(files: DataFrame, key: T.DataType, name: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document, from the files that ``write_tokens`` returned.

    ``start`` counts the ids of all documents before it, over all files; the checksum is of the ids as little-endian
    32-bit integers. A task reads a file; the driver sums up one number per file.
    """
    rows = files.select("path", "ids").orderBy("part", "place").collect()
    before = accumulate((r.ids for r in rows), initial=0)
    placed = files.sparkSession.createDataFrame([(r.path, b) for r, b in zip(rows, before)], "path string, before bigint")  # noqa: B905
    schema = T.StructType([T.StructField(name, key), *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")],
                           *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for keys, first, ids in FileReader(row["path"]).each():
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                    columns = [keys, *[pa.array(c, pa.int64()) for c in ([row["before"] + f for f in first], [len(x) for x in ids], crc)]]
                    if with_ids:
                        columns.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        give_back()

    return placed.repartition(max(1, len(rows))).mapInArrow(run, schema)
