"""Spark session and the shared working folder."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import weakref
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_runs: dict[str, str] = {}
_tables: dict[int, str] = {}
_shipped: set[str] = set()


def get_spark(app: str = "runlore", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the package is written for; a cluster's own settings win where it has them."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees: ``spark.checkpoint.dir``; where that is unset, a folder in the warehouse."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/runlore-scratch"


def run_dir(spark: SparkSession) -> str:
    """This application's folder under the shared one. Its tables go when the job says so or the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
        atexit.register(clean_scratch, spark)
    return _runs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder of this run."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def clean_scratch(spark: SparkSession) -> None:
    """Remove every table this run wrote aside. Results that still read them must be written out before."""
    if spark._jsc is None or spark.sparkContext._jsc is None:
        return
    path = _runs.pop(spark.sparkContext.applicationId, None)
    if path:
        _delete(spark, path)


def remove_table(df: DataFrame) -> None:
    """Remove a table that ``materialise`` wrote and nothing reads any more."""
    path = _tables.pop(id(df), None)
    if path:
        _delete(df.sparkSession, path)


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder, so a lost executor costs a re-read and not the upstream jobs.

    A written table is computed once, where an eager checkpoint computes its last stage twice, and its readers prune
    columns and know its size.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables[id(written)] = path
    weakref.finalize(written, _tables.pop, id(written), None)
    return written


def release_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs removed. Spark does so when the driver's JVM collects its garbage, which
    a driver with little to hold may not do for long, while executors' disks fill."""
    gc.collect()
    spark._jvm.System.gc()


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table. They go as Arrow: from a list Spark would make them by Python workers of their
    own on the executors, which then stay beside those of the functions."""
    kind = T.StructType.fromDDL(schema)
    columns = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows) if rows else [[]] * len(kind), kind, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=kind.names), kind)


SMALL_PARTITION_BYTES = 32 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core work when a small input would come in as one row group and so as one task.

    Large inputs have more splits than cores and pass through unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *keys) if size < cores * SMALL_PARTITION_BYTES else df


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers import this package wherever the driver found it; once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="runlore-package-")) / package.name
        sc.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
        _shipped.add(sc.applicationId)
