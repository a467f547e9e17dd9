"""Vector search for many queries at once: exact top-k, metadata filters before or after, late chunk lookup."""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlore.operators.topk import BROADCAST_BYTES, DenseScorer, topk

METRICS = ("cosine", "ip", "l2")


def filter_columns(queries: DataFrame, rows: DataFrame) -> tuple[str, ...]:
    """The keys of all filter columns ``f_<key>`` of the queries; a key the rows lack is an error."""
    keys = tuple(c[2:] for c in queries.columns if c.startswith("f_"))
    unknown = [k for k in keys if k not in rows.columns]
    if unknown:
        raise ValueError(f"nothing to filter by: {', '.join(unknown)}")
    return keys


def matches(value: Column, wanted: Column, is_list: bool, missing_passes: bool = False) -> Column:
    """Whether a metadata value satisfies a filter: null filter accepts all, a scalar must be equal, a list must
    hold the value. A missing value equals nothing but a null in the list, unless ``missing_passes``."""
    if is_list:
        has_null = F.exists(wanted, lambda x: x.isNull())
        inside = F.when(value.isNull(), has_null).otherwise(F.coalesce(F.array_contains(wanted, value), F.lit(False)))
    else:
        inside = value.eqNullSafe(wanted)
    if missing_passes:
        inside = inside | value.isNull()
    return wanted.isNull() | inside


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    mode: str = "pre",
    overfetch: int = 3,
    metric: str = "cosine",
    id_col: str = "chunk_id",
    missing_passes: bool = False,
    carry: Iterable[str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(query_id, id, score, rank, ..) of the k nearest rows per query.

    ``queries``: query_id, embedding and filter columns ``f_<key>``, each of which counts. ``mode="post"`` takes the best
    ``overfetch * k`` of a query that has a filter, filters those and keeps k, so a selective filter may return fewer
    than k, even none; ``mode="pre"`` filters first and is exact.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    if mode not in ("post", "pre"):
        raise ValueError(f"unknown filter mode: {mode}")
    keys = filter_columns(queries, vectors)
    payload = list(dict.fromkeys([id_col, *keys, *carry]))
    rows = vectors.where(F.col("embedding").isNotNull()).select(*payload, "embedding")
    wanted = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding", *[f"f_{c}" for c in keys])
    scorer = partial(DenseScorer, metric=metric)
    if not keys or mode == "pre":
        found = topk(rows, wanted, scorer, k, payload, keys, missing_passes, broadcast_bytes=broadcast_bytes)
    else:
        found = topk(rows, wanted, scorer, overfetch * k, payload, broadcast_bytes=broadcast_bytes)
        found = post_filter(found, queries, keys, k, id_col, missing_passes)
    return found.select("query_id", *payload, "score", "rank")


def post_filter(
    found: DataFrame, queries: DataFrame, keys: tuple[str, ...], k: int, id_col: str, missing_passes: bool = False
) -> DataFrame:
    """Keep the candidates that match their query's filters, first k by score; rank counts the survivors.

    A query without any filter only ever had k candidates, so its later ones are cut before filtering.
    """
    filters = queries.select("query_id", *[f"f_{c}" for c in keys])
    joined = found.join(filters, "query_id")
    unfiltered = F.lit(True)
    keep = F.lit(True)
    for c in keys:
        wanted = F.col(f"f_{c}")
        is_list = isinstance(queries.schema[f"f_{c}"].dataType, T.ArrayType)
        unfiltered = unfiltered & wanted.isNull()
        keep = keep & matches(F.col(c), wanted, is_list, missing_passes)
    kept = joined.where(keep & (~unfiltered | (F.col("rank") <= k)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def check_dimensions(vectors: DataFrame, dimensions: int) -> DataFrame:
    """One row: vectors, smallest and largest length, and whether all have the wanted one."""
    return vectors.agg(
        F.count("*").alias("vectors"),
        F.min(F.size("embedding")).alias("min_dimensions"),
        F.max(F.size("embedding")).alias("max_dimensions"),
    ).withColumn(
        "ok",
        F.coalesce(
            (F.col("min_dimensions") == dimensions) & (F.col("max_dimensions") == dimensions), F.col("vectors") == 0
        ),
    )
