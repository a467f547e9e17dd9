"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash. Tokens are summed by source and hash bucket; the bucket in which a source's budget runs out
is cut into finer buckets, until it holds one hash value. What lies below that threshold is taken: a filter, no sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlore.llm.common import in_order, small_side
from runlore.session import materialise

#: What a word is: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash bits, in levels of so many bits. One level's histogram has at most 2**12 rows for a source.
LEVEL_BITS, LEVELS = 12, 5


@dataclass(frozen=True)
class Mix:
    """weights go round over the sources in code-point order, null last; the targets together are ``share`` times all
    sizes, and none is above ``repeats`` times its source's size."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    repeats: int = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column) -> Column:
    """60 bits of the key's MD5; a null key counts as an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, what a full source can't hold goes
    to the others by weight, until none is above its cap. Each round sends three sums to the driver."""
    placed, n = in_order(sizes, F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.col("row_index") % len(mix.weights) + 1).cast("int"))
    rows = materialise(placed.select("source", "source_size", weight.alias("w"), (F.col("source_size") * mix.repeats).alias("cap")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    budget, level = float(total) * mix.share, None
    full = F.lit(False)
    while n:
        got = rows.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)).alias("w"), F.count(F.when(full, 1)).alias("n"),
        ).first()
        if level is not None and got.n == level[2] or got.w == 0:
            level = (float(got.held), got.w, got.n)
            break
        level = (float(got.held), got.w, got.n)
        full = F.col("w") * (budget - level[0]) / level[1] > F.col("cap")
    if level is None:
        return rows.select("source", "source_size", F.lit(0.0).alias("target"))
    share = F.col("w") * (budget - level[0]) / F.lit(level[1] or 1.0)
    target = F.when(full, F.col("cap").cast("double")).otherwise(share) if level[1] else F.col("cap").cast("double")
    return rows.select("source", "source_size", target.alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame, sources: int) -> DataFrame:
    """(source, threshold): the largest hash of each source up to which documents fit into its ``budget``.

    docs: (source, size, u); budgets: (source, budget), the budget under the source's size. Documents of one hash go
    together, and go in while that brings the sum nearer to the budget: sum before + sum after <= 2 * budget. A source
    whose budget nothing reaches has no row.
    """
    bounds = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    done = None
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        b = small_side(bounds.withColumnRenamed("source", "s"), sources)
        inside = docs.join(b, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("u", shift + LEVEL_BITS) == F.col("prefix")))
        sums = inside.groupBy("source", F.shiftright("u", shift).alias("prefix")).agg(
            F.sum("size").alias("size"), F.first("budget").alias("budget"), F.first("before").alias("before"),
            F.min("u").alias("low"), F.max("u").alias("high"),
        )
        run = Window.partitionBy("source").orderBy("prefix")
        after = F.col("before") + F.sum("size").over(run)
        found = materialise(
            sums.withColumn("after", after).withColumn("start", F.col("after") - F.col("size"))
            .where("start <= budget AND budget < after")
            .select("source", "budget", "prefix", F.col("start").alias("before"), "after", "low", "high")
        )
        single = (F.col("low") == F.col("high")) if level < LEVELS else F.lit(True)
        fits = F.col("before") + F.col("after") <= 2 * F.col("budget")
        ended = found.where(single).select("source", F.when(fits, F.col("high")).otherwise(F.col("low") - 1).alias("threshold"))
        done = ended if done is None else done.union(ended)
        bounds = found.where(~single).select("source", "budget", "prefix", "before")
        if bounds.isEmpty():
            break
    return done


def mix_plan(sized: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, int]:
    """(s, source_size, target, full, threshold) of every source of (source, size, u), and the number of sources."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = materialise(
        targets(sizes, mix)
        .withColumn("full", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
        .withColumn("budget", F.col("target") - F.col("full") * F.col("source_size"))
    )
    n = aims.count()
    cuts = thresholds(sized.select("source", "size", "u"), aims.select("source", "budget"), n).withColumnRenamed("source", "s")
    plan = aims.join(small_side(cuts, n), F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("s"), "source_size", "target", "full", F.coalesce("threshold", F.lit(-1)).alias("threshold"))
    return materialise(plan), n


def mix_documents(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, taken, copies) of every row: how many copies of it the mix takes.

    A null text has size 0, a null source is a source of its own, null keys hash alike, repeated rows hash alike and
    go together. An empty table gives an empty result. Only the columns named are read, whatever others are called.
    A source whose target is r times its size takes every document floor(r) times, and once more those under the
    hash threshold of the rest. Results depend on keys, sizes and sources alone, so reruns agree.
    """
    sized = materialise(docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), unit_hash(F.col(key)).alias("u")
    ))
    plan, n = mix_plan(sized, mix)
    copies = F.col("full") + (F.col("u") <= F.col("threshold")).cast("long")
    out = sized.join(small_side(plan, n), F.col("source").eqNullSafe(F.col("s")))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_rows(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns as they are. One filter over the rows
    does it: a row needs its source's plan and its own hash, no sort and no join by key."""
    sized = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), unit_hash(F.col(key)).alias("u"))
    plan, n = mix_plan(materialise(sized), mix)
    at = plan.select(F.col("s").alias("_s"), F.col("full").alias("_full"), F.col("threshold").alias("_threshold"))
    copies = F.col("_full") + (unit_hash(F.col(key)) <= F.col("_threshold")).cast("long")
    taken = docs.join(small_side(at, n), F.col(source).eqNullSafe(F.col("_s"))).withColumn("_copies", copies).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
