"""Centroids and code books for stored vector tables, fitted on a bounded sample of the vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.operators.topk import list_matrix

#: Vectors that a fit looks at, chosen by a hash of their id. Every vector is indexed whatever the sample.
SAMPLE = 16_384
#: Bytes of distances at a time.
DISTANCE_CELLS = 1 << 23


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(length > 0, length, 1.0)


def sample(vectors: DataFrame, id_col: str, rows: int = SAMPLE) -> np.ndarray:
    """At most about ``rows`` vectors as unit rows, the same ones each time."""
    known = vectors.where(F.col("embedding").isNotNull()).select(F.xxhash64(id_col).alias("_u"), "embedding")
    n = known.count()
    share = min(1.0, rows / max(1, n))
    chosen = known.where(F.pmod("_u", F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0)).toArrow()
    chosen = chosen.sort_by("_u")
    return unit(list_matrix(chosen["embedding"])) if chosen.num_rows else np.zeros((0, 0))


def nearest(points: np.ndarray, centres: np.ndarray, count: int = 1) -> np.ndarray:
    """Numbers of the ``count`` nearest centres of each point, the nearest first, equal ones in their order."""
    out = np.empty((len(points), count), np.int64)
    step, half = max(1, DISTANCE_CELLS // max(1, len(centres))), (centres * centres).sum(1) / 2
    for i in range(0, len(points), step):
        distance = half[None, :] - points[i : i + step] @ centres.T
        if count == 1:
            out[i : i + step, 0] = distance.argmin(1)
        else:
            out[i : i + step] = np.argsort(distance, axis=1, kind="stable")[:, :count]
    return out


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of at most ``k`` groups of the points; a group that loses all its points starts again at the point that
    is furthest from its centre."""
    if not len(points):
        return np.zeros((0, points.shape[1] if points.ndim == 2 else 0))
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[: min(k, len(distinct))]].astype(np.float64)
    for _ in range(rounds):
        of = nearest(points, centres)[:, 0]
        n = np.bincount(of, minlength=len(centres))
        sums = np.stack([np.bincount(of, weights=points[:, d], minlength=len(centres)) for d in range(points.shape[1])], 1)
        empty = np.flatnonzero(n == 0)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if len(empty):
            off = ((points - centres[of]) ** 2).sum(1)
            centres[empty] = points[np.argsort(-off, kind="stable")[: len(empty)]]
    return centres


def columns_of(batch: pa.RecordBatch, names: list[str], rows: np.ndarray) -> list[pa.Array]:
    return [batch.column(c).take(pa.array(rows, pa.int64())) for c in names]
