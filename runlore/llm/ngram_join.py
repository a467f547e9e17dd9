"""Jaccard join of word n-gram sets by grouped prefixes.

Documents of one set are one class. A class's n-grams are ordered rarest first; two similar sets share an n-gram among
the first few, their prefix. Classes with equal prefix and size form a group, and only groups meet: first each with one
leader per shared n-gram, then, of groups that aren't connected yet, all that share one and pass the filters of size
and position. Group pairs are expanded to their members, and members are verified on their whole sets. What is
connected already needs no further pair, so a group of near copies isn't compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlore.llm.common import components, give_back, small_side
from runlore.llm.packing import chunks
from runlore.llm.spans import mixed, span_hashes, word_spans
from runlore.session import materialise, release_shuffles, remove_table

#: Odd factors that tell the words of an n-gram apart by their place.
FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(64)], np.uint64)
#: n-grams of so many documents' sets are counted at a time in a task; those seen twice or more are reported.
COUNTED = 2_000_000
#: Rows of a batch that are texts in memory at a time.
SLICE = 256
#: The most frequent n-grams, which every task knows; the rest count as rare. This orders prefixes and loses nothing.
FREQUENT = 1 << 18


@dataclass(frozen=True)
class Join:
    """Words in an n-gram, and the least similarity in percent: 100 * shared >= percent * united."""

    words: int = 5
    percent: int = 80
    star_rounds: int = 2

    def least_share(self, n: int) -> int:
        """Fewest n-grams of a set of ``n`` that a similar set shares."""
        return -(-self.percent * n // 100)


def ngram_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-grams, A-Z lower-cased; the whole sequence where it is shorter."""
    data = [t.encode("utf-8", "replace").lower() + b" " for t in texts]
    buffer = np.frombuffer(b"".join(data), np.uint8)
    starts, ends = word_spans(buffer)
    if not len(starts):
        return [np.empty(0, np.uint64) for _ in texts]
    h = span_hashes(buffer, starts, ends)
    cuts = np.searchsorted(starts, np.append(0, np.cumsum([len(x) for x in data])))
    full = max(0, len(h) - words + 1)
    runs = mixed(sum(h[k : k + full] * FACTORS[k] for k in range(words)) + np.uint64(words)) if full else h[:0]
    out = []
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if j - i >= words:
            out.append(np.unique(runs[i : j - words + 1]))
        else:
            out.append(mixed((h[i:j] * FACTORS[: j - i]).sum(keepdims=True) + np.uint64(j - i)) if j > i else h[:0])
    return out


def class_of(grams: np.ndarray) -> int:
    """A 64-bit number of the set, as a signed long."""
    return int(mixed(grams).sum(dtype=np.uint64).astype(np.int64))


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of a batch's texts, a part of the batch at a time."""
    column = batch.column("text")
    for start in range(0, len(column), SLICE):
        texts = [t or "" for t in column.slice(start, SLICE).to_pylist()]
        for at, n in chunks(texts):
            yield from zip(range(start + at, start + at + n), ngram_sets(texts[at : at + n], words), strict=True)
    pa.default_memory_pool().release_unused()


def classes(docs: DataFrame, join: Join) -> tuple[DataFrame, np.ndarray]:
    """((key, tid, n, cls) of every row of (key, text, tid), and the hashes of the most frequent n-grams, the least first).

    One pass: tasks report, next to the rows, n-grams that several of the sets they hold share."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return record(None, None, [], [], [], grams[n > 1].astype(np.int64), n[n > 1])

        def record(keys, tids, rows, n, cls, gram, times) -> pa.RecordBatch:
            m = len(gram)
            none = pa.nulls(m, keys.type if keys is not None else key_type)
            key = pa.concat_arrays([keys.take(pa.array(rows, pa.int64())), none]) if keys is not None else none
            tid = pa.concat_arrays([tids.take(pa.array(rows, pa.int64())), pa.nulls(m, pa.int64())]) if tids is not None else pa.nulls(m, pa.int64())
            columns = [key, tid, pa.array([*n, *[None] * m], pa.int64()), pa.array([*cls, *[None] * m], pa.int64()),
                       pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(gram, pa.int64())]),
                       pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(times, pa.int64())])]
            return pa.RecordBatch.from_arrays(columns, names=["key", "tid", "n", "cls", "gram", "times"])

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.column("key").type
            rows, n, cls = [], [], []
            for i, s in _sets(batch, join.words):
                rows.append(i)
                n.append(len(s))
                cls.append(class_of(s) if len(s) else 0)
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield counted()
                    size = 0
            yield record(batch.column("key"), batch.column("tid"), rows, n, cls, [], [])
        if size:
            yield counted()
        give_back()

    table = materialise(docs.select("key", "text", "tid").mapInArrow(run, f"key {kind}, tid bigint, n bigint, cls bigint, gram bigint, times bigint"))
    common = materialise(table.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("times").alias("times")))
    level = F.floor(F.log2("times") * 16)
    left, least = FREQUENT, None
    for r in common.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        left -= r.n
        if left < 0:
            break
        least = r.level
    top = common.where(level >= F.lit(least)).toPandas() if least is not None else common.limit(0).toPandas()
    top = top.sort_values(["times", "gram"])
    return table.where("gram IS NULL").select("key", "tid", "n", "cls"), top["gram"].to_numpy(np.int64).astype(np.uint64)


def prefixes(docs: DataFrame, frequent: np.ndarray, join: Join) -> DataFrame:
    """(cls, n, same, prefix) of every row with n-grams: hash of its prefix, and the prefix in order."""
    order = np.argsort(frequent)
    sent = docs.sparkSession.sparkContext.broadcast((frequent[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = sent.value
        for batch in batches:
            rows = []
            for _, s in _sets(batch, join.words):
                if len(s):
                    at = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
                    place = np.where(known[at] == s, rank[at] + 1, 0) if len(known) else np.zeros(len(s))
                    first = s[np.argsort(place, kind="stable")][: len(s) - join.least_share(len(s)) + 1]
                    signed = first.astype(np.int64)
                    rows.append((class_of(s), len(s), class_of(first), signed))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)] + [pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                names=["cls", "n", "same", "prefix"])
        give_back()

    return docs.select("text").mapInArrow(run, "cls bigint, n bigint, same bigint, prefix array<bigint>")


class Verifier:
    """Whole sets of the classes that take part in pairs, read from the texts once each, and the test of pairs on them."""

    def __init__(self, docs: DataFrame, rows: DataFrame, join: Join):
        self.docs, self.join, self.sets = docs, join, None
        # one key and text of each class stand for it, with a key that isn't null where there is one
        first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "tid")).alias("first")
        self.stands = rows.where("n > 0").groupBy("cls").agg(first).select("cls", "first.key", "first.tid")

    def fetch(self, wanted: DataFrame) -> None:
        """Add the sets of these classes (cls) that aren't there yet."""
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("cls"), "cls", "left_anti")
        wanted = materialise(self.stands.join(wanted, "cls").select(F.col("key").alias("at"), F.col("tid").alias("of"), F.col("cls").alias("want")))
        n = wanted.count()
        if n == 0 and self.sets is not None:
            return
        words = self.join.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()  # copies under one key, null too, are read once a task
            for batch in batches:
                new = [i for i, w in enumerate(batch.column("want").to_pylist()) if w not in seen and not seen.add(w)]
                batch = batch.take(pa.array(new, pa.int64()))
                want = batch.column("want").to_pylist()
                rows = [(want[i], s.tobytes()) for i, s in _sets(batch, words) if len(s) and class_of(s) == want[i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["cls", "grams"])
            give_back()

        same = F.col("key").eqNullSafe(F.col("at")) & (F.col("tid") == F.col("of"))
        texts = self.docs.join(small_side(wanted, n), same).select("text", "want")
        read = materialise(texts.mapInArrow(run, "cls bigint, grams binary").withColumn("task", F.spark_partition_id()))
        new = first_of_tasks(read)
        remove_table(wanted)
        self.sets = new if self.sets is None else self.sets.unionByName(new)

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that are similar."""
        percent = self.join.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                    s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(100 * both >= percent * (len(s) + len(t) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            give_back()

        of = lambda end, name: self.sets.select(F.col("cls").alias(end), F.col("grams").alias(name))
        return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def first_of_tasks(read: DataFrame) -> DataFrame:
    """(cls, grams) of each class once, of a written table (cls, grams, task) in which a task has a class once. Only classes
    and tasks are shuffled to tell which stand twice; the sets are rewritten if any does."""
    twice = materialise(read.groupBy("cls").agg(F.count("*").alias("times"), F.min("task").alias("first")).where("times > 1"))
    n = twice.count()
    if n == 0:
        remove_table(twice)
        return read.drop("task")
    once = materialise(read.join(small_side(twice, n), "cls", "left").where("first IS NULL OR task = first").select("cls", "grams"))
    remove_table(read)
    remove_table(twice)
    return once


def similar_components(docs: DataFrame, rows: DataFrame, frequent: np.ndarray, join: Join) -> DataFrame:
    """(cls, component) of classes that are connected with others; the component's number is that of a class."""
    raw = materialise(prefixes(docs, frequent, join).withColumn("group", F.xxhash64("n", "same")))
    members = raw.select("cls", "group").distinct()
    groups = materialise(members.groupBy("group").agg(F.min("cls").alias("gid"), F.count("*").alias("members")))
    grouped = materialise(members.join(groups, "group").select("cls", "gid", "members"))
    # all of a group have its prefix, so any row's will do
    heads = materialise(raw.groupBy("group").agg(F.first("n").cast("int").alias("n"), F.first("prefix").alias("prefix")))
    remove_table(raw)
    release_shuffles(docs.sparkSession)
    grams = heads.select("group", "n", F.posexplode("prefix").alias("pos", "gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("groups")).where("groups > 1")
    met = materialise(grams.join(shared, "gram").join(groups.select("group", "gid"), "group").drop("group"))
    remove_table(heads)
    release_shuffles(docs.sparkSession)

    verifier = Verifier(docs, rows, join)
    links = None
    found = grouped.select("cls", F.col("cls").alias("component")).limit(0)

    def extend(pairs: DataFrame) -> bool:
        """Verify pairs of classes; whether any is similar."""
        nonlocal links, found
        pairs = materialise(pairs.select("a", "b").distinct())
        release_shuffles(docs.sparkSession)  # sets are moved next, which takes the most room
        verifier.fetch(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        release_shuffles(docs.sparkSession)
        new = materialise(verifier.similar(pairs))
        remove_table(pairs)
        if new.isEmpty():
            return False
        release_shuffles(docs.sparkSession)
        links = new if links is None else links.union(new)
        found = components(links).select(F.col("node").alias("cls"), F.col("root").alias("component"))
        return True

    def placed(table: DataFrame, column: str) -> DataFrame:
        at = found.select(F.col("cls").alias(column), F.col("component"))
        return table.join(at, column, "left").withColumn("component", F.coalesce("component", column))

    p = join.percent
    sizes_fit = f"{{0}}.n * 100 >= {{1}}.n * {p} AND {{1}}.n * 100 >= {{0}}.n * {p}"
    # if this is the first shared n-gram, it and all behind it must suffice: shared >= p / (100 + p) * both sizes
    rest_fits = f"least({{0}}.n - {{0}}.pos, {{1}}.n - {{1}}.pos) * {100 + p} >= {p} * ({{0}}.n + {{1}}.n)"
    for star in range(join.star_rounds):
        now = placed(met, "gid")
        rank = F.col("groups") if star == 0 else F.pmod(F.xxhash64("gid", F.lit(star)), F.lit(1 << 20))
        popular = now.groupBy("gid").agg(F.sum(rank).alias("weight"))
        now = now.join(popular, "gid")
        lead = now.groupBy("gram").agg(
            F.max(F.struct("weight", "gid", "n", "pos", "component")).alias("lead"),
            F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("gram", "lead.*")
        near = now.alias("s").join(lead.alias("l"), "gram").where(
            "s.component != l.component AND " + sizes_fit.format("s", "l") + " AND " + rest_fits.format("s", "l"))
        counted = near.groupBy(F.col("s.gid").alias("a"), F.col("l.gid").alias("b")).agg(F.count("*").alias("grams"))
        best = counted.groupBy("a").agg(F.max(F.struct("grams", "b")).alias("best")).select("a", "best.b")
        inner = grouped.where("members > 1 AND cls != gid").select(F.col("cls").alias("a"), F.col("gid").alias("b"))
        if not extend(best.union(inner) if star == 0 else best):
            break

    # all pairs of groups that share an n-gram and aren't one component
    whole = placed(grouped, "cls").groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    now = met.join(whole, "gid")
    mixed_up = now.groupBy("gram").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l < h").select("gram")
    now = now.join(mixed_up, "gram").select("gram", "gid", "n", "pos", "low", "high")
    pairs = now.alias("s").join(now.alias("t"), "gram").where(
        "s.gid < t.gid AND (s.low != t.low OR s.high != t.high OR s.low != s.high) AND "
        + sizes_fit.format("s", "t") + " AND " + rest_fits.format("s", "t")
    ).select(F.col("s.gid").alias("g"), F.col("t.gid").alias("h")).distinct()
    inside = whole.where("low < high").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
    at = placed(grouped.select("cls", "gid"), "cls")
    a, b = (at.select(F.col("gid").alias(g), F.col("cls").alias(c), F.col("component").alias(f"of_{c}")) for g, c in (("g", "a"), ("h", "b")))
    spread = pairs.union(inside).join(a, "g").join(b, "h").where("of_a != of_b AND (g != h OR a < b)")
    extend(spread)
    return found


def placed_rows(docs: DataFrame, join: Join, key: str, text: str) -> DataFrame:
    """(key, tid, n, cls, component, first) of every row: hash of its text, size and class of its set, number of its
    component, and of that the least key, null only where all are, with the least text under it."""
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), text_id(F.col(text)).alias("tid"))
    rows, frequent = classes(named, join)
    found = similar_components(named, rows, frequent, join)
    placed = rows.join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "tid")).alias("first")
    least = placed.where("n > 0").groupBy("component").agg(first)
    return placed.join(least, "component", "left")


def text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def ngram_components(docs: DataFrame, join: Join = Join(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, cls, component_id) of every row: the size of its set, the class of equal sets, and the least key
    of the rows reachable by links.

    A null text is empty; a text without words has no set and is its own component. Equal sets are linked. Repeated
    rows give repeated results; null keys are only named where all keys of a component are
    null. An empty table gives no rows; other columns are not read; texts are read whole.
    """
    own = F.when(F.col("n") > 0, F.col("first.key")).otherwise(F.col("key"))
    return placed_rows(docs, join, key, text).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "cls", own.alias("component_id"))


def one_of_each(docs: DataFrame, join: Join = Join(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: the one with the least key, and of its
    texts the one with the least hash. Rows go by key and text, so another text under the key of a copy, null too, stays.
    Rows without words stay; of rows that share the key and the text the least stays, its columns compared as JSON. An
    empty table gives no rows; columns of any name are kept as they are."""
    placed = materialise(placed_rows(docs, join, key, text).select("key", "tid", "n", "first"))
    stays = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("tid") == F.col("first.tid"))
    at, of, place = (free_name(docs, n) for n in ("gone", "text", "place"))

    def named(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("key").alias(at), F.col("tid").alias(of)).distinct()

    same = F.col(key).eqNullSafe(F.col(at)) & (text_id(F.col(text)) == F.col(of))
    kept = docs.join(named(placed.where((F.col("n") > 0) & ~stays)), same, "left_anti")
    twice = materialise(named(placed.groupBy("key", "tid").agg(F.count("*").alias("rows")).where("rows > 1")))
    if twice.isEmpty():
        return kept
    # only rows of a key and text that stand several times are compared; the least of them stays, whatever comes first
    order = Window.partitionBy(key, text).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    one = kept.join(twice, same, "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return kept.join(twice, same, "left_anti").unionByName(one)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
