"""What several corpus operators share: global order without one big task, connected components, small checks."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlore.session import materialise, remove_table, small_table

#: Tables up to this many bytes, by a count of their rows, travel to every task.
BROADCAST_BYTES = 64 << 20
#: Bytes of rows that go to a Python worker at a time, about.
BATCH_BYTES = 1 << 20
#: Bits that ``monotonically_increasing_id`` gives to the place within a partition.
PLACE_BITS = 33


def give_back() -> None:
    """At the end of a task: memory that a Python worker has freed goes back to the system, as the worker may idle for
    long beside tasks that need none."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def small_batches(spark: SparkSession) -> None:
    """Batches to and from Python workers end at ``BATCH_BYTES`` of rows. By their default of 10,000 rows, batches of whole
    texts are tens of megabytes, of which an executor's two sides hold several a task and keep what they have freed."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_side(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """Broadcast hint for a table whose counted rows prove that it is small, else the table as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def in_order(df: DataFrame, *keys: Column, index: str = "row_index") -> tuple[DataFrame, int]:
    """The rows with their place (from 0) in the order of ``keys``, and the number of rows.

    The rows are range-partitioned and sorted where they are; only the row count of each partition is summed up, so no
    task sees more than its own range. The sorted rows are a written table: a lost executor can't change a place.
    Rows that tie in all keys get places in any order.
    """
    at = F.monotonically_increasing_id()
    rows = materialise(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at))
    part, place = F.shiftright("_at", PLACE_BITS), F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    counts = {r.part: r.n for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    offsets = small_table(df.sparkSession, starts, "part bigint, start bigint")
    placed = rows.withColumn("part", part).join(F.broadcast(offsets), "part")
    return placed.withColumn(index, F.col("start") + place).drop("part", "start", "_at"), total


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, root), root being the smallest node; nodes without an edge to others are left out.

    Alternating large and small stars: every round hangs each node's larger neighbours, then its smaller ones, on the
    smallest. Rounds grow with the logarithm of the longest path. A node with very many neighbours is one row of the
    aggregated side and a skewed key of the other, which the adaptive join splits. Each round is a written table and
    the one before is removed. Null ends are ignored.
    """
    x, y = F.col(a), F.col(b)
    links = materialise(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    )
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(hung)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u")
        small = materialise(
            down.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        )
        remove_table(links)
        remove_table(large)
        links = small
        sign = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        now = links.agg(F.count("*").alias("n"), sign.alias("sign")).first()
        if before == now:
            roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        before = now


def window(*keys: str):
    return Window.partitionBy(*keys)
