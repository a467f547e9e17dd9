"""How filters interact: what each removes first, again, or alone, in every order, from sorted posting lists.

Rows are numbered, and runs of numbers are ranges of bounded size. Of each part and range every filter has the sorted
list of rows that fail it. A task merges a range's lists, galloping over the stretches in which only one list has rows:
the union of every set of filters, and of each further filter what it adds to that union. Only sizes leave the task, and
they add up over ranges. An order of filters is a chain of such sets, so all orders come from the same sums.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlore.llm.common import give_back
from runlore.operators.skew import join_hot
from runlore.session import materialise

#: Bits of a row's number that count within a range; ranges hold at most so many rows.
RANGE_BITS = 16
#: More filters than this have too many orders to report them all.
MOST_FILTERS = 7
#: Parts whose sums a task holds at a time.
PARTS_HELD = 1_000
#: Keys with more rows than this, and more than a 256th of all, are joined apart.
HOT_ROWS = 2_000

WORD = r"[^\x20\x09-\x0D]+"


def gallop(rows: list[int], value: int, at: int) -> int:
    """First place from ``at`` on whose row is not less than ``value``: steps that double, then a binary search."""
    step, n = 1, len(rows)
    while at + step < n and rows[at + step] < value:
        step *= 2
    return bisect_left(rows, value, at + step // 2, min(n, at + step + 1))


def union(lists: list[list[int]]) -> list[int]:
    """Merge of sorted lists, each row once; a stretch that only one list has is taken whole."""
    heads = [(rows[0], i, 0) for i, rows in enumerate(lists) if rows]
    heapq.heapify(heads)
    out: list[int] = []
    while heads:
        value, i, at = heads[0]
        rows = lists[i]
        if len(heads) == 1:
            out += rows[at:]
            break
        other = min(heads[1][0], heads[2][0]) if len(heads) > 2 else heads[1][0]
        if value == other:  # another list will give it
            stop = at + 1
        else:
            stop = gallop(rows, other, at)
            out += rows[at:stop]
        if stop < len(rows):
            heapq.heapreplace(heads, (rows[stop], i, stop))
        else:
            heapq.heappop(heads)
    return out


def both(a: list[int], b: list[int]) -> list[int]:
    """Rows of two sorted lists that are in both."""
    out, i, j, n, m = [], 0, 0, len(a), len(b)
    while i < n and j < m:
        x, y = a[i], b[j]
        if x == y:
            out.append(x)
            i, j = i + 1, j + 1
        elif x < y:
            i = gallop(a, y, i)
        else:
            j = gallop(b, x, j)
    return out


def interactions(fails: list[list[int]], marks: list[list[int]]) -> np.ndarray:
    """[set, filter] -> rows that the filters of the set (a bit each) remove, rows that fail the filter, rows it removes
    after that set, and how many of these bear each mark. Filters of the set itself are zeros."""
    k = len(fails)
    out = np.zeros((1 << k, k, 3 + len(marks)), np.int64)
    wanted = [[own, *(both(own, m) for m in marks)] for own in fails]
    unions: list[list[int]] = [[] for _ in range(1 << k)]
    for s in range(1 << k):
        if s:
            last = s.bit_length() - 1
            unions[s] = union([unions[s ^ (1 << last)], fails[last]])
        for f in range(k):
            if not s >> f & 1:
                left = [len(rows) - len(both(rows, unions[s])) for rows in wanted[f]]
                out[s, f] = [len(unions[s]), len(fails[f]), *left]
    return out


def posting_lists(rows: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """(part, range, n, a list per filter and mark) from (id, part, a boolean per filter and mark): rows of a part and
    range, and the sorted numbers, within the range, of those that fail the filter or bear the mark. Null is false."""
    place = F.col("id").bitwiseAND(F.lit((1 << RANGE_BITS) - 1)).cast("int")
    lists = [F.array_sort(F.collect_list(F.when(F.col(c), place))).alias(c) for c in [*filters, *marks]]
    return rows.groupBy("part", F.shiftright("id", RANGE_BITS).alias("range")).agg(F.count("*").alias("n"), *lists)


def set_sizes(postings: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """(part, set, filter, n, before, fails, removed, a count per mark): ``interactions`` of every range, summed up."""
    k, columns = len(filters), ["n", "before", "fails", "removed", *marks]
    kind = postings.schema["part"].dataType
    schema = T.StructType([T.StructField("part", kind), T.StructField("set", T.IntegerType()), T.StructField("filter", T.IntegerType()),
                           *[T.StructField(c, T.LongType()) for c in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for part, sums in held.items():
                at = [(s, f) for s in range(1 << k) for f in range(k) if not s >> f & 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(at), batch.schema.field("part").type), pa.array([s for s, _ in at], pa.int32()),
                     pa.array([f for _, f in at], pa.int32()), *[pa.array([int(sums[s, f, c]) for s, f in at], pa.int64()) for c in range(len(columns))]],
                    names=schema.names)
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = interactions([row[c] for c in filters], [row[c] for c in marks])
                found = np.concatenate([np.full((1 << k, k, 1), row["n"]), found], 2)
                part = row["part"]
                held[part] = held[part] + found if part in held else found
                if len(held) > PARTS_HELD:
                    yield from flush()
        if held:
            yield from flush()
        give_back()

    sums = [F.sum(c).alias(c) for c in columns]
    return postings.mapInArrow(run, schema).groupBy("part", "set", "filter").agg(*sums)


def audit_orders(sizes: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """One row per part, order of the filters and step of it, from ``set_sizes``. An order is its filters' names, one
    after the other; ``removed`` summed over all orders is a filter's ``shapley``."""
    k, spark = len(filters), sizes.sparkSession
    steps = []
    for order in permutations(range(k)):
        done = 0
        for i, f in enumerate(order):
            steps.append(("".join(filters[j] for j in order), i + 1, done, f))
            done |= 1 << f
    orders = spark.createDataFrame(steps, "filter_order string, step int, set int, filter int")  # k! * k rows
    weights = spark.createDataFrame(
        [(s, f, factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()), s.bit_count() == k - 1)
         for s in range(1 << k) for f in range(k) if not s >> f & 1], "set int, filter int, orders bigint, last boolean")
    sizes = materialise(sizes)
    whole = sizes.join(F.broadcast(weights), ["set", "filter"]).groupBy("part", "filter").agg(
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"), F.sum(F.when(F.col("last"), F.col("removed"))).alias("unique_fails"))
    rows = sizes.join(whole, ["part", "filter"]).join(F.broadcast(orders), ["set", "filter"])
    return rows.select(
        "part", "filter_order", "step", (F.col("n") - F.col("before") - F.col("removed")).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *[F.col(m).alias(f"{m}_lost") for m in marks], "shapley")


def audit_filters(rows: DataFrame, part: Column, fails: dict[str, Column], marks: dict[str, Column]) -> DataFrame:
    """Audit of filters given as boolean columns over ``rows``, by ``part``; ``marks`` name rows whose loss is counted.

    Null in ``part`` is the empty string, null in a filter or mark is false. Repeated rows count as often as they stand,
    other columns are not read, and no rows give no parts. A part or a copied row may hold any share of all rows: ranges
    are cut by row number.
    """
    filters, bears = list(fails), list(marks)
    if not 1 <= len(filters) <= MOST_FILTERS or len({*filters, *bears}) < len(filters) + len(bears):
        raise ValueError(f"need 1 to {MOST_FILTERS} filters, and marks of other names")
    named = rows.select(F.monotonically_increasing_id().alias("id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"),
                        *[c.alias(n) for n, c in {**fails, **marks}.items()])
    return audit_orders(set_sizes(posting_lists(materialise(named), filters, bears), filters, bears), filters, bears)


def text_filters(text: Column) -> dict[str, Column]:
    """Filters A to D, a name and whether a text fails it each: short, repetitive, many capitals, marks. Whole texts."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def audit_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Audit of ``text_filters`` and E, a text identical to that of a smaller key anywhere in the table, by ``part``, with
    the good and the toxic documents that each order loses at each step.

    A null text is an empty one. A null key is neither smaller nor greater than another and has no label; of several
    labels of a key any that is 1 counts. Texts are compared by SHA-256.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = materialise(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{part}`").alias("part"), F.sha2(body, 256).alias("hash"),
                                   *[c.alias(n) for n, c in text_filters(body).items()]))
    copies = rows.groupBy("hash").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("hash", "least")
    bears = labels.select(F.col(f"`{key}`").alias("key"), "quality", "toxic").where("key IS NOT NULL").groupBy("key").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = join_hot(rows, materialise(copies), "hash", "left", min_rows=HOT_ROWS)
    rows = join_hot(rows, materialise(bears.where("good OR toxic")), "key", "left", min_rows=HOT_ROWS)
    fails = {n: F.col(n) for n in "ABCD"} | {"E": F.col("key") > F.col("least")}
    return audit_filters(rows, F.col("part"), fails, {"good": F.col("good"), "toxic": F.col("toxic")})
