"""Near duplicates among embeddings by NN-descent.

A graph of near neighbours starts from windows over several random orders of the vectors and is refined by comparing
the neighbours of each vector with each other, until little changes. A list that is full of links may lack some, so its
component is dense: it is compared in blocks of bounded size, and all vectors outside of it are compared with its members,
which joins components that are linked. A sample audited against all vectors measures the recall; below the wanted one,
further orders and rounds follow, and at last, or at once where vectors are so few that this costs less, all are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlore.llm.common import components, in_order
from runlore.session import materialise, release_shuffles, remove_table

CODE_BITS = 24


@dataclass(frozen=True)
class Descent:
    """Least cosine of a link; length of a neighbour list; random orders, rows of a window over one, neighbours it
    proposes; rows of a vicinity compared at once; rounds of refinement and the share of new entries that ends them;
    rows of a block of a saturated component; numbers of the vectors that travel to the tasks at a time; audited vectors,
    the recall wanted, tries to reach it, and vectors up to which comparing all costs less than another try."""

    threshold: float = 0.95
    neighbours: int = 12
    orders: int = 6
    window: int = 64
    proposed: int = 6
    vicinity: int = 48
    rounds: int = 3
    change: float = 0.02
    block: int = 2048
    sent: int = 1 << 20
    audited: int = 512
    recall: float = 0.98
    tries: int = 3
    few: int = 1 << 17
    seed: int = 11


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision from a list column without nulls whose lists have one length."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector, cls): cls numbers vectors with equal components; null where a vector can't link."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fit = v.isNotNull() & (F.size(v) > 0) & finite
    fit = F.coalesce(fit & F.when(fit, (length > 0) & (length < float("inf"))), F.lit(False))
    zero = F.transform(v, lambda x: F.when(x == 0, F.abs(x)).otherwise(x))  # -0.0 is 0.0
    return vectors.select(F.col(key).alias("key"), v.alias("v"), F.when(fit, F.xxhash64(zero)).alias("cls"))


def proposals(units: DataFrame, d: Descent) -> DataFrame:
    """(src, dst, sim) of neighbours in windows over random orders: vectors on one side of many random planes are near
    each other in an order by the planes. Sorted runs are cut as they come, so equal codes need no group."""
    span = d.window // 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"))
            for t in range(d.orders):
                rng = np.random.default_rng([d.seed, t, x.shape[1]])
                side = x @ rng.standard_normal((x.shape[1], CODE_BITS + 1))
                code = (side[:, :-1] > 0) @ (1 << np.arange(CODE_BITS - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(code), pa.array(side[:, -1]), batch.column("cls"), batch.column("v"),
                     batch.column("dim")], names=["t", "code", "side", "cls", "v", "dim"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            whole = (held.num_rows - span) // span * span
            if whole >= span:
                yield windows(held.slice(0, whole + span))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield windows(held)

    def windows(run: pa.RecordBatch) -> pa.RecordBatch:
        ids, order = run.column("cls").to_numpy(), run.column("t").to_numpy()
        dims = run.column("dim").to_numpy()
        out = []
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            x = matrix(run.column("v").take(pa.array(rows)))
            for i in range(0, max(1, len(rows) - span), span):
                some = slice(i, i + d.window)
                out.append(best(ids[rows][some], x[some], order[rows][some], d.proposed))
        return edges(out)

    def best(ids, x, order, most):
        sims = x @ x.T
        sims[order[:, None] != order[None, :]] = -2
        np.fill_diagonal(sims, -2)
        return top(ids, sims, most)

    with_dim = units.select("cls", "v", F.size("v").alias("dim"))
    kind = units.schema["v"].dataType.simpleString()
    coded = with_dim.mapInArrow(one_dim(spread), f"t int, code bigint, side double, cls bigint, v {kind}, dim int")
    ordered = coded.repartitionByRange("t", "dim", "code", "side").sortWithinPartitions("t", "dim", "code", "side")
    return ordered.mapInArrow(near, EDGES)


EDGES = "src bigint, dst bigint, sim double"


def one_dim(run):
    """The task's function on batches whose vectors have one length."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    yield batch.filter(pa.array(dims == dim))

        return run(parts())

    return split


def top(ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` largest of each row; what is below -1 is no similarity."""
    n = min(most, sims.shape[1])
    at = np.argpartition(-sims, n - 1, axis=1)[:, :n]
    value = np.take_along_axis(sims, at, 1)
    keep = value >= -1.5
    return np.repeat(ids, n)[keep.ravel()], ids[at][keep], value[keep]


def edges(parts: list) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["src", "dst", "sim"])


def nearest(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best (src, dst) of each src, once each; an entry is fresh if all its rows are."""
    rank = F.dense_rank().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    ranked = found.select("*", rank.alias("r")).where(F.col("r") <= most)
    return ranked.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))


def refined(units: DataFrame, graph: DataFrame, d: Descent) -> DataFrame:
    """Candidates (src, dst, sim) from neighbours of neighbours: the neighbours of a vector, to it and from it, are
    compared with each other and with it where one of the two is new to it. Vicinities come as sorted runs cut at a
    bounded number of rows, so a vector that very many are near to takes several cuts and no group."""
    floor = graph.groupBy("src").agg(F.when(F.count("*") >= d.neighbours, F.min("sim")).otherwise(-2.0).alias("floor")).withColumnRenamed("src", "cls")
    known = units.join(floor, "cls", "left").select(F.col("cls").alias("id"), "v", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    own = graph.groupBy("src").agg(F.max("fresh").alias("fresh")).where("fresh")
    around = graph.select(F.col("src").alias("hub"), F.col("dst").alias("id"), "fresh").union(
        graph.select(F.col("dst").alias("hub"), F.col("src").alias("id"), "fresh")).groupBy("hub", "id").agg(F.max("fresh").alias("fresh"))
    around = around.union(own.select(F.col("src").alias("hub"), F.col("src").alias("id"), F.lit(False)))
    rows = around.join(known, "id").withColumn("mix", F.xxhash64("id", F.lit(d.seed)))
    ordered = rows.select("hub", "mix", "id", "fresh", "floor", "v").repartitionByRange("hub", "mix").sortWithinPartitions("hub", "mix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs, ids = batch.column("hub").to_numpy(), batch.column("id").to_numpy()
            fresh, floor_ = batch.column("fresh").to_numpy(zero_copy_only=False), batch.column("floor").to_numpy()
            cuts = np.flatnonzero(np.diff(hubs, prepend=hubs[0] - 1)) if len(hubs) else []
            x, out = None, []
            for i, j in zip(cuts, np.append(cuts[1:], len(hubs)), strict=True):
                for a in range(i, j, d.vicinity):
                    b = min(j, a + d.vicinity)
                    new = fresh[a:b]
                    if b - a < 2 or not new.any():
                        continue
                    x = matrix(batch.column("v")) if x is None else x
                    sims = x[a:b] @ x[a:b].T
                    sims[~(new[:, None] | new[None, :])] = -2
                    np.fill_diagonal(sims, -2)
                    sims[sims <= floor_[a:b, None]] = -2
                    if (sims > -1.5).any():
                        out.append(top(ids[a:b], sims, d.proposed))
            yield edges(out)

    return ordered.mapInArrow(run, EDGES)


def graph_of(units: DataFrame, d: Descent, graph: DataFrame | None = None) -> DataFrame:
    """(src, dst, sim, fresh): neighbour lists after the rounds, added to those of ``graph``."""
    fresh = proposals(units, d).withColumn("fresh", F.lit(True))
    start = fresh if graph is None else fresh.unionByName(graph.withColumn("fresh", F.lit(False)))
    now = materialise(nearest(start, d.neighbours))
    entries = max(1, now.count())
    for _ in range(d.rounds):
        found = refined(units, now, d).withColumn("fresh", F.lit(True))
        after = materialise(nearest(found.unionByName(now.withColumn("fresh", F.lit(False))), d.neighbours))
        remove_table(now)
        now = after
        release_shuffles(units.sparkSession)
        if now.where("fresh").count() < d.change * entries:
            break
    return now


def block_counts(units: DataFrame, members: DataFrame, d: Descent) -> DataFrame:
    """(cls, links): how many vectors each member of (cls, root) links with in its component, classes counted by size.

    Members are numbered in the order of their components and cut into blocks; every pair of blocks that hold members
    of one component is a group of bounded size, in which similarities are summed up to one count a member.
    """
    placed, _ = in_order(members.join(units, "cls").select("root", "cls", "v", "n"), F.col("root"), F.col("cls"))
    placed = placed.withColumn("block", F.expr(f"row_index div {d.block}"))
    ends = placed.groupBy("root").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    each = placed.join(ends, "root")
    other = F.explode(F.sequence("low", "high"))
    work = each.select("root", "cls", "v", "n", "block", other.alias("with")).select(
        "root", "cls", "v", "n", "block", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["v"].to_numpy()).astype(np.float64)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        n, block = group["n"].to_numpy(), group["block"].to_numpy()
        p, q = group["p"].iloc[0], group["q"].iloc[0]
        links = np.zeros(len(x), np.int64)
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            hit = x[rows] @ x[right].T >= d.threshold
            if p == q:
                hit[rows[:, None] == right[None, :]] = False
            links[rows] += hit @ n[right]
            if p != q:
                links[right] += n[rows] @ hit
        return pd.DataFrame({"cls": group["cls"], "links": links})

    # dealt by pair of blocks: by component alone, all pairs of a large one would be one task
    dealt = work.repartition("root", "p", "q")
    counted = dealt.groupBy("root", "p", "q").applyInPandas(run, "cls bigint, links bigint")
    return counted.groupBy("cls").agg(F.sum("links").alias("links"))


def across(placed: DataFrame, d: Descent) -> DataFrame:
    """(cls, links, a, b) from (cls, root, dense, v, n): how many vectors a class links with outside of its component, where
    the class or the other is in a dense one, in parts to be summed up; and the roots a, b of components that are linked.

    Members of dense components travel to the tasks, a bounded number at a time and whole components together where they
    fit; a component that is farther from all of a batch's vectors than its radius and the angle of a link is passed over.
    """
    schema = "cls bigint, links bigint, a bigint, b bigint"
    rows = placed.withColumn("dim", F.size("v"))
    sent, total = in_order(rows.where("dense").select("cls", "root", "v", "n", "dim"), F.col("dim"), F.col("root"), F.col("cls"))
    widest = sent.agg(F.max("dim")).first()[0] or 1
    step, limit, spark = max(1, d.sent // widest), np.arccos(d.threshold) + 1e-6, placed.sparkSession
    parts = []
    for at in range(0, total, step):
        some = sent.where(F.col("row_index").between(at, at + step - 1)).orderBy("row_index").toPandas()
        by_dim = {}
        for dim, g in some.groupby("dim"):
            y = np.stack(g["v"].to_numpy()).astype(np.float64)
            y /= np.sqrt((y * y).sum(1, keepdims=True))
            root, starts, where = np.unique(g["root"].to_numpy(), return_index=True, return_inverse=True)
            centre = np.add.reduceat(y, starts, axis=0)
            centre /= np.maximum(np.sqrt((centre * centre).sum(1, keepdims=True)), 1e-300)
            radius = np.maximum.reduceat(np.arccos(np.clip((y * centre[where]).sum(1), -1, 1)), starts)
            by_dim[dim] = g["cls"].to_numpy(), g["n"].to_numpy(), y, root, where, centre, radius
        shared = spark.sparkContext.broadcast(by_dim)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dim = batch.column("dim")[0].as_py()
                if dim in shared.value:
                    x = matrix(batch.column("v"))
                    own, n, dense = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("root", "n", "dense"))
                    ids = batch.column("cls").to_numpy()
                    for i in range(0, len(x), 512):
                        rows = slice(i, i + 512)
                        yield from met(shared.value[dim], ids[rows], own[rows], n[rows], dense[rows], x[rows])

        def met(members, ids, own, n, dense, x) -> Iterator[pa.RecordBatch]:
            cls, times, y, root, where, centre, radius = members
            near = np.zeros(len(root), bool)
            for j in range(0, len(root), 8192):
                c = slice(j, j + 8192)
                reach = np.arccos(np.clip(x @ centre[c].T, -1, 1)) <= radius[c] + limit
                near[c] = (reach & (own[:, None] != root[c][None, :])).any(0)
            columns = np.flatnonzero(near[where])
            links = np.zeros(len(x), np.int64)
            for j in range(0, len(columns), 8192):
                c = columns[j : j + 8192]
                hit = (x @ y[c].T >= d.threshold) & (own[:, None] != root[where[c]][None, :])
                if not hit.any():
                    continue
                links += hit @ times[c]
                back = (n * ~dense) @ hit  # rows of dense components are sent too and count for themselves
                yield record(cls[c][back > 0], back[back > 0], [], [])
                r, k = np.nonzero(hit)
                pairs = np.unique(np.stack([own[r], root[where[c[k]]]]), axis=1)
                yield record([], [], *pairs)
            yield record(ids[links > 0], links[links > 0], [], [])

        def record(cls, links, a, b) -> pa.RecordBatch:
            empty = lambda m: pa.nulls(len(m), pa.int64())
            columns = [[pa.array(cls, pa.int64()), empty(a)], [pa.array(links, pa.int64()), empty(a)],
                       [empty(cls), pa.array(a, pa.int64())], [empty(cls), pa.array(b, pa.int64())]]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["cls", "links", "a", "b"])

        found = rows.select("cls", "root", "dense", "v", "n", "dim").mapInArrow(one_dim(run), schema)
        parts.append(materialise(found))
        shared.unpersist()
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def linked(units: DataFrame, graph: DataFrame, d: Descent) -> DataFrame:
    """(cls, root, links, dense) of classes with a link to another: component, how many vectors of other classes, and
    whether all links of its component were counted."""
    over = materialise(graph.where(F.col("sim") >= d.threshold).select("src", "dst"))
    both = over.union(over.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    roots = materialise(components(over, "src", "dst").select(F.col("node").alias("cls"), "root"))
    full = over.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= d.neighbours).select(F.col("src").alias("cls"))
    dense = full.join(roots, "cls").select("root").distinct()
    sizes = units.select(F.col("cls").alias("dst"), "n")
    sparse = both.join(sizes, "dst").groupBy(F.col("src").alias("cls")).agg(F.sum("n").alias("links"))
    return completed(units, roots.join(sparse, "cls", "left"), dense, d)


def completed(units: DataFrame, known: DataFrame, dense: DataFrame | None, d: Descent) -> DataFrame:
    """``linked`` from (cls, root, links) of linked classes and the roots of dense components; without these, all
    components are dense, those of a single class too, and every vector is compared with all."""
    placed = units.select("cls", "v", "n").join(known.select("cls", "root", "links"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    if dense is not None:
        placed = placed.join(dense.withColumn("dense", F.lit(True)), "root", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
    else:
        placed = placed.withColumn("dense", F.lit(True))
    placed = materialise(placed)
    enlarged = block_counts(units, placed.where("dense AND links IS NOT NULL").select("cls", "root"), d).withColumnRenamed("links", "all_links")
    met = materialise(across(placed, d))
    more = met.where("cls IS NOT NULL").groupBy("cls").agg(F.sum("links").alias("more"))
    joined = components(met.where("a IS NOT NULL").select("a", "b")).select(F.col("node").alias("root"), F.col("root").alias("least"))
    counted = placed.select("cls", "root", "dense", "links").join(enlarged, "cls", "left").join(more, "cls", "left")
    within = F.when(F.col("dense"), F.col("all_links")).otherwise(F.col("links"))
    links = F.coalesce(within, F.lit(0)) + F.coalesce("more", F.lit(0))
    return counted.join(joined, "root", "left").select(
        "cls", F.coalesce("least", "root").alias("root"), links.alias("links"), "dense").where("links > 0")


def audit(units: DataFrame, found: DataFrame, d: Descent) -> float:
    """Share of the links of audited vectors that were found: of all, of a vector on average, or of those outside of dense
    components, whichever is least; the sample is chosen by a hash and compared with all."""
    total = max(1, units.count())
    share = min(1 << 20, max(1, int(d.audited / total * (1 << 20))))
    some = units.where(F.pmod(F.xxhash64("cls", F.lit(d.seed)), F.lit(1 << 20)) < share).select("cls", "v").limit(4 * d.audited).toPandas()
    if some.empty:
        return 1.0
    by_dim = {dim: (g["cls"].to_numpy(), np.stack(g["v"].to_numpy()).astype(np.float64)) for dim, g in some.groupby(some["v"].map(len))}
    sent = units.sparkSession.sparkContext.broadcast({k: (i, x / np.sqrt((x * x).sum(1, keepdims=True))) for k, (i, x) in by_dim.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column("dim")[0].as_py()
            if dim in sent.value:
                ids, y = sent.value[dim]
                hit = matrix(batch.column("v")) @ y.T >= d.threshold
                hit &= batch.column("cls").to_numpy()[:, None] != ids[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(batch.column("n").to_numpy() @ hit)], names=["cls", "truth"])

    truth = units.select("cls", "v", "n", F.size("v").alias("dim")).mapInArrow(one_dim(count), "cls bigint, truth bigint")
    sums = truth.groupBy("cls").agg(F.sum("truth").alias("truth")).where("truth > 0").join(found, "cls", "left")
    got = F.least("truth", F.coalesce("links", F.lit(0)))
    sparse = ~F.coalesce("dense", F.lit(False))
    parts = sums.agg(F.try_divide(F.sum(got), F.sum("truth")), F.avg(got / F.col("truth")),
                     F.try_divide(F.sum(F.when(sparse, got)), F.sum(F.when(sparse, F.col("truth"))))).first()
    return min([p for p in parts if p is not None], default=1.0)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", descent: Descent = Descent()) -> DataFrame:
    """(key, n_links, component_id, kept, audit_recall) of every row.

    Vectors that are null, empty, of length zero, or hold null or non-finite components link with nothing, and so do
    vectors of different lengths with each other. Equal vectors are one class in all comparisons and link with each
    other. Repeated rows are rows like others; null keys are the least known only where a component has no other; an
    empty table gives no rows; other columns are not read.
    """
    rows = materialise(usable(vectors, key, vector))
    units = materialise(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.first("v").alias("v"), F.count("*").alias("n")))
    graph, recall, few = None, 0.0, units.count() <= descent.few
    for attempt in range(descent.tries):
        step = replace(descent, seed=descent.seed + attempt)
        graph = graph_of(units, step, graph)
        found = materialise(linked(units, graph, step))
        recall = audit(units, found, step)
        if recall >= descent.recall or few:
            break
    if recall < descent.recall:
        release_shuffles(units.sparkSession)
        found = materialise(completed(units, found, None, descent))
        recall = audit(units, found, descent)
    placed = rows.join(found, "cls", "left").join(units.select("cls", "n"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("key").alias("least"))
    out = placed.join(least, "root", "left").withColumn("component_id", F.coalesce("least", "key"))
    return out.select(
        F.col("key").alias(key), (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).cast("long").alias("n_links"),
        "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).alias("audit_recall"))
