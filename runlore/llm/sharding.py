"""Sharding along a Hilbert curve: rows near each other in several metadata dimensions share a shard.

Each dimension is quantised at its quantiles, the cells get their place on the curve, the rows are put in that order
and the order is cut into runs of equal length. A filter on any of the dimensions then meets few shards, and within
them few files. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import in_order
from runlore.operators.skew import join_hot
from runlore.session import materialise

#: Bits of a dimension: 2**6 cells, cut at as many quantiles.
BITS = 6


def quantised(value: Column, cuts: list) -> Column:
    """Number of cuts below the value, from 0 to len(cuts); null is 0."""
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < value)), F.lit(0))


def hilbert_index(cell: Column, dims: int, bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a cell given as an array of ``dims`` integers of ``bits`` bits.

    The coordinates are turned level by level from the highest bit, then Gray-coded, and their bits are interleaved.
    """
    steps = F.array(*[F.struct(F.lit(1 << q).alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, 0, -1) for i in range(dims)])

    def turn(x: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        first, own = x[0], F.get(x, i)
        high = own.bitwiseAND(q) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(q - 1)
        return F.transform(x, lambda v, j: v.bitwiseXOR(
            F.when(high, F.when(j == 0, q - 1).otherwise(0)).otherwise(F.when((j == 0) | (j == i), swap).otherwise(0))))

    turned = F.aggregate(steps, cell, turn)
    gray = F.aggregate(turned, F.array().cast("array<int>"), lambda acc, v: F.concat(
        acc, F.array(F.when(F.size(acc) == 0, v).otherwise(v.bitwiseXOR(F.element_at(acc, -1))))))

    def flipped(x: Column) -> Column:
        last = F.element_at(x, -1)
        flip = F.lit(0)
        for q in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << q)) != 0, F.lit((1 << q) - 1)).otherwise(0))
        return F.transform(F.array(flip), lambda f: F.transform(x, lambda v: v.bitwiseXOR(f)))[0]

    def woven(x: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(dims):
                out = out * 2 + F.shiftright(x[i], b).bitwiseAND(F.lit(1))
        return out

    return F.transform(F.transform(F.array(gray), flipped), woven)[0]


def with_curve(df: DataFrame, dims: dict[str, Column], bits: int = BITS, name: str = "curve") -> DataFrame:
    """The rows with their place on the curve of the named numeric dimensions. One pass finds all quantiles."""
    shares = [(k + 1) / (1 << bits) for k in range((1 << bits) - 1)]
    found = df.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"q{i}") for i, c in enumerate(dims.values())]).first()
    cuts = [sorted(set(found[i] or [])) for i in range(len(dims))]
    # few distinct values are spread over all cells, so they too tell the curve's long stretches apart
    cells = [F.floor(quantised(c, q) * (1 << bits) / (len(q) + 1)) for c, q in zip(dims.values(), cuts, strict=True)]
    return df.withColumn(name, hilbert_index(F.array(*[c.cast("int") for c in cells]), len(dims), bits))


def shard_rows(df: DataFrame, dims: dict[str, Column], shards: int, ties: list[str], bits: int = BITS) -> DataFrame:
    """The rows with ``curve``, ``shard`` (0 up to shards - 1) and ``slot`` (from 0, without gaps, in curve order).

    The law is ``rows``: counts of any two shards differ by one at most, whatever the sizes. A cell with a third of
    all rows is cut by ``ties``, which follow the curve in the order, and rows equal in those by their number. Null dimensions come first; repeated rows each
    take a slot of their own; an empty table gives no shard. Existing columns named curve, shard or slot are replaced.
    """
    plain = df.drop("curve", "shard", "slot", "row_index", "_own").withColumn("_own", F.monotonically_increasing_id())
    placed, n = in_order(with_curve(plain, dims, bits), F.col("curve"), *[F.col(t) for t in ties], F.col("_own"))
    placed = placed.drop("_own")
    if n == 0:
        return placed.select("*", F.lit(0).cast("int").alias("shard"), F.lit(0).cast("long").alias("slot")).drop("row_index")
    shard = F.expr(f"row_index * {shards} div {n}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("row_index") - first).withColumn(
        "shard", F.col("shard").cast("int")).drop("row_index")


def write_shards(rows: DataFrame, path: str) -> None:
    """Write sharded rows as one folder a shard; files hold runs of slots, so their min and max prune well."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def with_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """The rows with the place of their value among the distinct values of a column; null stays null. Values that share
    a long beginning are as far apart as any others, and a value with very many rows is joined apart."""
    values, _ = in_order(df.select(F.col(f"`{column}`").alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")), F.col("value"))
    ranks = materialise(values.select(F.col("value").alias("_value"), F.col("row_index").alias(name)))
    return join_hot(df.withColumn("_value", F.col(f"`{column}`")), ranks, "_value", "left").drop("_value")


def ranked_documents(sized: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """(rows, dimensions) of sized documents: language, source and size."""
    rows = with_rank(with_rank(sized, "lang", "_lang"), "source", "_source")
    return rows, {"lang": F.col("_lang"), "source": F.col("_source"), "size": F.col("size")}
