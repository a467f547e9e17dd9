"""Versioned tables of chunks with their vectors.

Data goes into fresh folders; a small numbered commit file lists the folders that make up the table. It is written
aside and renamed to its number, which is the switch: readers resolve the newest commit once and are never shown half
a write, and a writer that lost a race finds its number taken.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CommitConflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Commit:
    number: int = 0
    version: int = 0
    folders: list[str] = field(default_factory=list)


def one_per_chunk(rows: DataFrame, order: str = "content_hash") -> DataFrame:
    """One row per chunk id, the smallest by ``order``, then by the other plain columns but the text. Tasks leave one row of an id
    each before anything moves, so an id with very many rows is no more than as many rows as tasks."""
    plain = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name not in ("chunk_id", "text", order)]
    least = Window.partitionBy("chunk_id").orderBy(order, *plain)
    return rows.withColumn("_n", F.row_number().over(least)).where(F.col("_n") == 1).drop("_n")


def new_chunks(existing: DataFrame, incoming: DataFrame, order: str = "content_hash") -> DataFrame:
    """Incoming rows whose chunk id is not in the table yet, one per id."""
    return one_per_chunk(incoming, order).join(existing.select("chunk_id"), "chunk_id", "left_anti")


def changed_chunks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose chunk id is there with another content."""
    old = existing.select("chunk_id", F.col("content_hash").alias("old_hash"))
    joined = one_per_chunk(incoming).join(old, "chunk_id")
    return joined.where(F.col("content_hash") != F.col("old_hash")).drop("old_hash")


class VectorTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | None = None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def commit(self) -> Commit:
        """The newest commit; number 0 is the empty table."""
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return Commit()
        numbers = [int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()]
        if not numbers:
            return Commit()
        text = self.spark.read.text(f"{self.root}/commits/{max(numbers):010d}", wholetext=True).first()[0]
        return Commit(**json.loads(text))

    def _publish(self, version: int, folders: list[str], after: Commit) -> Commit:
        commit = Commit(after.number + 1, version, folders)
        target = self._path(f"{self.root}/commits/{commit.number:010d}")
        aside = self._path(f"{self.root}/commits/_{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(commit.__dict__).encode()))
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        files = jvm.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)  # without OVERWRITE
        try:
            files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(target), keep)
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            raise CommitConflict(f"commit {commit.number} exists already") from e
        return commit

    def read(self, commit: Commit | None = None) -> DataFrame:
        """The table as of a commit, the newest by default."""
        commit = commit or self.commit()
        if not commit.folders:
            if self.schema is None:
                raise ValueError("the table is empty and no schema was given")
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return reader.parquet(*[f"{self.root}/{f}" for f in commit.folders])

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{folder}")

    def add(self, incoming: DataFrame, on_change: str = "skip", batch: str | None = None) -> Commit:
        """Append the chunks whose ids are new; chunks under known ids are skipped or, with ``on_change="replace"``,
        take the place of the old ones when their content differs. A named batch is added once however often it is
        sent."""
        if on_change not in ("skip", "replace"):
            raise ValueError(f"unknown on_change: {on_change}")
        before = self.commit()
        name = f"data/add-{batch or uuid.uuid4().hex}"
        if name in before.folders:
            return before
        if self.schema is not None:
            incoming = incoming.select(*self.schema.names)
        if not before.folders:
            self._write(one_per_chunk(incoming), name)
            return self._publish(before.version, [name], before)
        existing = self.read(before)
        if on_change == "replace":
            changed = changed_chunks(existing, incoming)
            if not changed.isEmpty():
                kept = existing.join(changed.select("chunk_id"), "chunk_id", "left_anti")
                everything = kept.unionByName(changed).unionByName(new_chunks(existing, incoming))
                return self._replace(everything, before)
        self._write(new_chunks(existing, incoming), name)
        return self._publish(before.version, [*before.folders, name], before)

    def rebuild(self, rows: DataFrame) -> Commit:
        """Write a whole new version beside the live one, check it, then switch to it. Duplicates are not removed."""
        return self._replace(rows.select(*self.schema.names) if self.schema is not None else rows, self.commit())

    def _replace(self, rows: DataFrame, before: Commit) -> Commit:
        folder = f"data/full-{uuid.uuid4().hex}"
        self._write(rows, folder)
        written = self.spark.read.parquet(f"{self.root}/{folder}")
        if written.where(F.col("chunk_id").isNull() | F.col("embedding").isNull()).limit(1).count():
            raise ValueError("a chunk without id or vector; the live version stays")
        return self._publish(before.version + 1, [folder], before)

    def stats(self) -> DataFrame:
        return index_stats(self.read())


def index_stats(vectors: DataFrame, index_type: str = "flat") -> DataFrame:
    """One row: vectors, chunks, documents, dimensions and index type."""
    return vectors.agg(
        F.count("embedding").alias("total_vectors"),
        F.count("chunk_id").alias("total_chunks"),
        F.count_distinct("document_id").alias("total_documents"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimensions"),
    ).withColumn("index_type", F.lit(index_type))
