"""A table of chunks in partitions by a hash of their document, so that additions and corrections touch few of them.

A version is a folder of rows and one of filters, both partitioned alike; a pointer file names the version in use. Each
partition has Bloom filters over its chunk ids: an addition asks the filters of the partitions its documents fall into,
and reads ids only of partitions that may hold one of them. A correction rewrites the partitions of the corrected
documents by dynamic overwrite and leaves the files of all others as they are. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlore.operators.vector_table import one_per_chunk
from runlore.session import materialise, remove_table

#: Bits of a partition's filter, and how many of them an id sets. Up to about 100,000 ids are told apart well; beyond,
#: ever more additions read the ids themselves.
FILTER_BITS, HASHES = 1 << 20, 3
#: Bits in one row of a filter, fixed by Spark's bitmap functions.
ROW_BITS = 32_768


def filter_positions(chunk_id: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(chunk_id, F.lit(i)), F.lit(FILTER_BITS)) for i in range(HASHES)])


def filter_rows(rows: DataFrame) -> DataFrame:
    """(part, segment, bits) of the chunk ids of (part, chunk_id): partial bitmaps are merged before they are shuffled."""
    at = rows.where("chunk_id IS NOT NULL").select("part", F.explode(filter_positions(F.col("chunk_id"))).alias("at"))
    return at.groupBy("part", F.bitmap_bucket_number("at").alias("segment")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def may_be_known(ids: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows of (part, chunk_id), unique, all of whose bits are set."""
    bits = filters.groupBy("part", "segment").agg(F.bitmap_or_agg("bits").alias("bits"))
    asked = ids.select("part", "chunk_id", F.explode(filter_positions(F.col("chunk_id"))).alias("at"))
    asked = asked.withColumn("segment", F.bitmap_bucket_number("at")).withColumn("at", F.bitmap_bit_position("at"))
    met = asked.join(bits, ["part", "segment"])
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, F.pmod("at", F.lit(8)).cast("int")) == 1
    return met.where(is_set).groupBy("part", "chunk_id").agg(F.count("*").alias("_set")).where(F.col("_set") == HASHES).drop("_set")


class PartitionedTable:
    """``schema`` has chunk_id, content_hash and ``key``, by whose hash rows are partitioned. The number of partitions is
    fixed by the first version."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, partitions: int = 64, key: str = "document_id"):
        self.spark, self.root, self.schema, self.partitions, self.key = spark, root.rstrip("/"), schema, partitions, key
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # versions

    def version(self) -> str | None:
        """Folder of the version in use; none yet is the empty table."""
        if not self._fs.exists(self._path(f"{self.root}/CURRENT")):
            return None
        return self.spark.read.text(f"{self.root}/CURRENT", wholetext=True).first()[0].strip()

    def _switch(self, version: str) -> None:
        """Put the pointer in place by a rename, so readers see the old version or the new one."""
        aside = self._path(f"{self.root}/_{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(version.encode()))
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        options[0] = jvm.Options.Rename.OVERWRITE
        files = jvm.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._path(f"{self.root}/CURRENT")), options)

    def _read(self, what: str, schema: T.StructType, parts: list[int] | None) -> DataFrame:
        version = self.version()
        schema = T.StructType([*schema.fields, T.StructField("part", T.IntegerType())])
        if version is None or not self._fs.exists(self._path(f"{self.root}/{version}/{what}")):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{version}/{what}")
        return rows if parts is None else rows.where(F.col("part").isin(parts))

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those of some partitions, whose folders alone are read."""
        return self._read("rows", self.schema, parts).select(*self.schema.names)

    def filters(self, parts: list[int] | None = None) -> DataFrame:
        return self._read("filters", T.StructType([T.StructField("segment", T.LongType()), T.StructField("bits", T.BinaryType())]), parts)

    # writes

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.partitions)).cast("int")

    def _write(self, rows: DataFrame, version: str, what: str, mode: str) -> None:
        dealt = rows.repartition("part") if what == "filters" else rows.repartition("part", F.pmod(F.xxhash64("chunk_id"), F.lit(4)))
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.root}/{version}/{what}")

    def parts_of(self, rows: DataFrame) -> list[int]:
        return sorted(r.part for r in rows.select("part").distinct().collect())  # at most as many as partitions

    def known(self, incoming: DataFrame) -> DataFrame:
        """(chunk_id, part, content_hash) of the ids of (chunk_id, part) that the table holds. Reads the filters of their
        partitions, and ids of those partitions only where the filters can't rule all of them out."""
        ids = incoming.select("chunk_id", "part").distinct()
        likely = materialise(may_be_known(ids, self.filters(self.parts_of(incoming))))
        parts = self.parts_of(likely)
        rows = self._read("rows", self.schema, parts).select("chunk_id", "part", "content_hash")
        return rows.join(likely, ["chunk_id", "part"], "left_semi") if parts else rows.limit(0)

    def add(self, incoming: DataFrame, on_change: str = "skip", batch: str | None = None) -> dict[str, int]:
        """Add the chunks whose ids are new; those under known ids are skipped or, with ``on_change="replace"``, take the
        place of the old ones when their content differs. Of several rows of an id the one with the least content hash
        counts. An addition that is sent again adds nothing. How many were added and replaced."""
        if on_change not in ("skip", "replace"):
            raise ValueError(f"unknown on_change: {on_change}")
        version = self.version()
        rows = materialise(one_per_chunk(incoming.select(*self.schema.names)).withColumn("part", self.part()))
        known = materialise(self.known(rows))
        new = rows.join(known.select("chunk_id", "part"), ["chunk_id", "part"], "left_anti")
        added, replaced = new.count(), 0
        if version is None:
            version = f"v-{uuid.uuid4().hex}"
        if added:
            # filters first: a bit too many only costs a read, a row without its bits would be added twice
            self._write(filter_rows(new), version, "filters", "append")
            self._write(new, version, "rows", "append")
            if self.version() is None:
                self._switch(version)
        if on_change == "replace":
            old = known.select("chunk_id", "part", F.col("content_hash").alias("_old"))
            changed = rows.join(old, ["chunk_id", "part"]).where(~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_old")
            changed = materialise(changed)
            replaced = changed.count()
            if replaced:
                self._overwrite(self.parts_of(changed), changed)
            remove_table(changed)
        remove_table(known)
        remove_table(rows)
        return {"added": added, "replaced": replaced}

    def replace_documents(self, rows: DataFrame, documents: DataFrame | None = None) -> dict[str, int]:
        """Put these chunks in the place of all chunks of their documents, and of ``documents`` (key), which may have none
        any more. Only the partitions of these documents are read and written. How many chunks went and came."""
        version = self.version()
        rows = materialise(one_per_chunk(rows.select(*self.schema.names)).withColumn("part", self.part()))
        named = rows.select(self.key, "part") if documents is None else rows.select(self.key, "part").unionByName(
            documents.select(self.key).withColumn("part", self.part()))
        named = materialise(named.distinct())
        parts = self.parts_of(named)
        if version is None:
            version = f"v-{uuid.uuid4().hex}"
            self._write(filter_rows(rows), version, "filters", "append")
            self._write(rows, version, "rows", "append")
            self._switch(version)
            return {"removed": 0, "added": rows.count()}
        before = self._read("rows", self.schema, parts)
        kept = materialise(before.join(named, [self.key, "part"], "left_anti").unionByName(rows))
        counts = {"removed": before.count() - kept.count() + rows.count(), "added": rows.count()}
        if parts:
            self._write(filter_rows(kept), version, "filters", "overwrite")
            self._write(kept, version, "rows", "overwrite")
            emptied = set(parts) - set(self.parts_of(kept))  # dynamic overwrite leaves folders that get no row
            for part in emptied:
                for what in ("rows", "filters"):
                    self._fs.delete(self._path(f"{self.root}/{version}/{what}/part={part}"), True)
        for t in (rows, named, kept):
            remove_table(t)
        return counts

    def _overwrite(self, parts: list[int], changed: DataFrame | None) -> None:
        """Write these partitions anew, with the changed rows in the place of the old ones."""
        rows = self._read("rows", self.schema, parts)
        if changed is not None:
            rows = rows.join(changed.select("chunk_id", "part"), ["chunk_id", "part"], "left_anti").unionByName(changed)
        rows = materialise(rows)  # they are read from the folders that they go to
        self._write(filter_rows(rows), self.version(), "filters", "overwrite")
        self._write(rows, self.version(), "rows", "overwrite")
        remove_table(rows)

    def compact(self, most_files: int = 16) -> list[int]:
        """Write anew the partitions that have gathered more than so many files; their numbers."""
        files = self._read("rows", self.schema, None).select("part", F.col("_metadata.file_path").alias("file")).distinct()
        parts = self.parts_of(files.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > most_files))
        if parts:
            self._overwrite(parts, None)
        return parts

    def rebuild(self, rows: DataFrame) -> None:
        """Write a whole new version beside the live one, check it, then switch to it."""
        version = f"v-{uuid.uuid4().hex}"
        placed = rows.select(*self.schema.names).withColumn("part", self.part())
        self._write(placed, version, "rows", "append")
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("part", T.IntegerType())])).parquet(f"{self.root}/{version}/rows")
        if not written.where("chunk_id IS NULL").isEmpty():
            raise ValueError("a chunk without id; the live version stays")
        self._write(filter_rows(written), version, "filters", "append")
        self._switch(version)
