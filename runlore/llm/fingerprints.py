"""Document fingerprints: one-permutation MinHash of word shingles in column expressions.

The shingle hashes of a text are spread over bins once; a bin keeps its least value. Empty bins take the value of a
bin that is not empty, found by a fixed random probing of their own (optimal densification), and of each value the
low bits are kept, packed as hexadecimal digits. Equal bins of two fingerprints estimate the Jaccard similarity of the
shingle sets, less what equal low bits alone would give.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlore.functions.text import bind

DIGITS = "0123456789abcdef"


@dataclass(frozen=True)
class Sketch:
    """Words in a shingle, bins (a power of two), digits of four bits kept of a bin, probes before a bin's own order."""

    shingle: int = 5
    bins: int = 128
    digits: int = 2

    @property
    def bin_bits(self) -> int:
        return int(math.log2(self.bins))

    @property
    def by_chance(self) -> float:
        return 16.0**-self.digits

    def probes(self, bin_: int) -> list[int]:
        """Bins in which an empty bin looks for a value: all others in an order of its own."""
        others = [b for b in range(self.bins) if b != bin_]
        random.Random(bin_).shuffle(others)
        return others


def shingle_hashes(text: Column, n: int) -> Column:
    """Hashes of the shingles of ``n`` words; of fewer words, one of them all; none of no words. Null counts as empty."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingled(h: Column) -> Column:
        several = F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(n)]))
        return F.when(F.size(h) >= n, several).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return bind(hashed, shingled)


def bin_values(hashes: Column, sketch: Sketch) -> Column:
    """The least value of each bin, null where it is empty: all bins, in order. A hash is its bin's number above, its
    value below; an end mark for each bin sorts last in it."""
    keep = 62 - sketch.bin_bits
    empty = (1 << keep) - 1
    folded = F.transform(hashes, lambda h: h.bitwiseAND(F.lit((1 << 62) - 1)))
    marks = F.transform(F.sequence(F.lit(0), F.lit(sketch.bins - 1)), lambda b: b.cast("long") * (1 << keep) + empty)
    rows = F.array_sort(F.concat(folded, marks))

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, keep) != F.shiftright(F.get(s, i - 1), keep)))

    value = F.lit(empty)
    return F.transform(bind(rows, firsts), lambda x: F.nullif(x.bitwiseAND(value), value))


def densified(values: Column, sketch: Sketch) -> Column:
    """Empty bins filled from their first probe that isn't empty; a sketch of nothing stays without values."""
    probes = F.array(*[F.array(*[F.lit(p) for p in sketch.probes(b)]) for b in range(sketch.bins)])

    def filled(v: Column) -> Column:
        return F.transform(v, lambda x, i: F.coalesce(x, F.aggregate(
            F.get(probes, i), F.lit(None).cast("long"), lambda found, p: F.coalesce(found, F.get(v, p)))))

    return bind(values, filled)


def fingerprint(text: Column, sketch: Sketch = Sketch()) -> Column:
    """Hexadecimal digits of all bins; the empty string for a text without words. Equal texts have equal ones."""
    values = densified(bin_values(shingle_hashes(text, sketch.shingle), sketch), sketch)
    mask = (1 << 4 * sketch.digits) - 1
    digits = F.transform(values, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(mask))), sketch.digits, "0")))
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, "").otherwise(F.array_join(digits, ""))


def likeness(a: Column, b: Column, sketch: Sketch = Sketch()) -> Column:
    """Estimated Jaccard similarity from two fingerprints, 0 to 1: the share of equal bins, less the chance of equal
    low bits. Two fingerprints of nothing are alike, one of nothing and one of something are not; null stays null."""
    step = sketch.digits
    places = F.sequence(F.lit(1), F.lit(sketch.bins * step), F.lit(step))

    def compared(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        equal = F.filter(places, lambda i: F.substring(x, i, F.lit(step)) == F.substring(y, i, F.lit(step)))
        share = F.size(equal) / F.lit(float(sketch.bins))
        corrected = F.greatest(F.lit(0.0), (share - sketch.by_chance) / (1 - sketch.by_chance))
        known = x.isNotNull() & y.isNotNull()
        return F.when(known, F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).otherwise(corrected))

    return bind(F.struct(a.alias("x"), b.alias("y")), compared)


#: Groups of neighbouring keys: so many at most; a larger table has larger groups, which sort on disk.
GROUPS = 4096


def group_number(key: Column, cuts: list) -> Column:
    """How many of the ascending cuts lie below the key, by a run of cuts first and then within it; null is 0."""
    if not cuts:
        return F.lit(0)
    runs = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
    below = lambda values: F.size(F.filter(values, lambda c: c < key))
    run = below(F.array(*[F.lit(r[-1]) for r in runs]))
    within = F.coalesce(F.get(F.array(*[F.array(*[F.lit(c) for c in r]) for r in runs]), run), F.array().cast("array<bigint>"))
    return F.when(key.isNull(), 0).otherwise(F.when(run == len(runs), len(cuts)).otherwise(64 * run + below(within)))


def with_next(df: DataFrame, key: str, columns: dict[str, Column], per_group: int) -> DataFrame:
    """key, the columns, and ``next_<column>`` of the row that follows in ascending ``key``; after the last, the first.

    Rows are cut at quantiles of the key into groups of about ``per_group`` rows, each sorted by itself. The last row
    of a group needs the first of the next: one row a group, joined by the group's number. Rows of one key follow each
    other in the order of the columns; null keys come first.
    """
    rows = df.count()
    wanted = min(GROUPS, -(-rows // per_group))
    cuts = []
    if wanted > 1:
        shares = [k / wanted for k in range(1, wanted)]
        cuts = sorted(set(df.agg(F.percentile_approx(key, shares, 100 * wanted)).first()[0] or []))
    number = group_number(F.col(key), cuts).alias("_group")
    names = list(columns)
    order = Window.partitionBy("_group").orderBy(F.asc_nulls_first(key), *[F.asc_nulls_first(c) for c in names])
    grouped = df.select(key, *[c.alias(n) for n, c in columns.items()], number)
    led = grouped.select("*", F.lead(F.struct(*names)).over(order).alias("_next"))
    if not cuts:  # one group: its first row is within it
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        joined = led.withColumn("_next", F.coalesce("_next", F.first(F.struct(*names)).over(whole)))
        return joined.select(key, *names, *[F.col(f"_next.{n}").alias(f"next_{n}") for n in names])
    least = df.groupBy(number).agg(F.min(F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("key"))).alias("least"))
    groups = least.count()
    # one key a group, so at most GROUPS rows to send: the texts stay where they are
    heads = df.withColumn("_group", number).join(F.broadcast(least), "_group").where(F.col(key).eqNullSafe(F.col("least.key")))
    first = heads.select("_group", F.struct(*[c.alias(n) for n, c in columns.items()]).alias("row")).groupBy("_group").agg(F.min("row").alias("_head"))
    after = first.select(F.pmod(F.col("_group") - 1, F.lit(max(groups, 1))).alias("_group"), "_head")
    joined = led.join(after, "_group").withColumn("_next", F.coalesce("_next", "_head"))
    return joined.select(key, *names, *[F.col(f"_next.{n}").alias(f"next_{n}") for n in names])


def fingerprint_documents(docs: DataFrame, sketch: Sketch = Sketch(), key: str = "doc_id", text: str = "text",
                          per_group: int = 8192) -> DataFrame:
    """Fingerprints of every row's text and of its edit, and their likeness.

    The edit replaces the last half (rounded down) of the code points by as many first ones of the next document, or by
    all where it has fewer. (key, text, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next). A
    null text is empty; an empty one has the empty fingerprint, which is alike only to itself; a single row is its own
    next; null keys come first and rows of one key in the order of their texts; other columns are not read.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = with_next(docs.select(F.col(key), F.col(text)), key, {"text": plain, "fingerprint": fingerprint(F.col(text), sketch)}, per_group)
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    marked = rows.select("*", n.alias("n_chars"), edited.alias("edited")).withColumn("edited_fingerprint", fingerprint(F.col("edited"), sketch))
    return marked.select(
        key, "text", "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), sketch).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), sketch).alias("near_next"),
    )
