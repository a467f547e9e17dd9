"""Filter interactions against plain sets, and the audit of documents against every order played through."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlore.llm import filter_audit
from runlore.llm.filter_audit import audit_documents, audit_filters, both, gallop, interactions, union

SORTED = st.lists(st.integers(0, 300), unique=True).map(sorted)


@settings(max_examples=200, deadline=None)
@given(SORTED, SORTED, SORTED, st.integers(0, 300))
def test_merges_are_those_of_sets(a, b, c, value):
    assert union([a, b, c]) == sorted({*a, *b, *c}) and union([a]) == a and union([]) == []
    assert both(a, b) == sorted({*a} & {*b})
    for at in (0, len(a) // 2):
        assert gallop(a, value, at) == max(at, sum(x < value for x in a))


def test_a_stretch_of_one_list_takes_few_steps():
    class Counted(list):
        looks = 0

        def __getitem__(self, i):
            Counted.looks += 1
            return super().__getitem__(i)

    rows = Counted(range(100_000))
    assert both(rows, [99_999]) == [99_999] and Counted.looks < 60


@settings(max_examples=30, deadline=None)
@given(st.lists(SORTED, min_size=1, max_size=4), SORTED)
def test_interactions_are_those_of_sets(fails, mark):
    got = interactions(fails, [mark])
    for s in range(1 << len(fails)):
        before = set().union(*[fails[f] for f in range(len(fails)) if s >> f & 1])
        for f, rows in enumerate(fails):
            new = set(rows) - before
            want = [0] * 4 if s >> f & 1 else [len(before), len(rows), len(new), len(new & set(mark))]
            assert got[s, f].tolist() == want


def by_hand(docs, labels):
    """Rows of the audit as a set of tuples, from (key, text, part) and (key, quality, toxic)."""
    least = {}
    for key, text, _ in docs:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    good = {k for k, q, _ in labels if q == 1}
    toxic = {k for k, _, t in labels if t == 1}
    rows = []
    for key, text, part in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {n for n, x in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)),
                                ("D", re.search("[#$%&*|]", text)), ("E", key is not None and key > least[text])) if x}
        rows.append((part or "", fails, key in good and key is not None, key in toxic and key is not None))
    out = set()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley, steps = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for i, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                steps.append((order, i + 1, len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine),
                              sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out |= {(part, *s, shapley[s[0][s[1] - 1]]) for s in steps}
    return out


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def random_docs(seed=3, n=300):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["word", "Word", "WORD", "a", "b$", "ß", f"w{i}"]) if rng.random() < 0.3 else f"u{rng.randint(0, 400)}"
                     for _ in range(rng.choice([0, 3, 199, 200, 260]))) for i in range(60)] + [None, "", " \t"]
    docs = [(rng.choice([None, rng.randint(0, 400)]) if i % 10 == 0 else 1000 + i, rng.choice(pool), rng.choice(["en", "en", "de", None, ""])) for i in range(n)]
    labels = [(rng.choice([d[0] for d in docs]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    return docs, labels


@pytest.mark.parametrize("bits", [16, 2])
def test_against_every_order_played_through(spark, monkeypatch, bits):
    monkeypatch.setattr(filter_audit, "RANGE_BITS", bits)
    docs, labels = random_docs()
    got = audit_documents(spark.createDataFrame(docs, "doc_id int, text string, lang string").repartition(6),
                          spark.createDataFrame(labels, "doc_id int, quality int, toxic int"))
    rows = [tuple(r[c] for c in COLUMNS) for r in got.collect()]
    assert got.columns == COLUMNS and len(rows) == 3 * 600 and set(rows) == by_hand(docs, labels)


def test_hot_copies_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT_ROWS", 10)
    docs, labels = random_docs(5, 120)
    docs += [(5000 + i, "the same text again", "en") for i in range(60)]
    got = audit_documents(spark.createDataFrame(docs, "doc_id int, text string, lang string").repartition(3),
                          spark.createDataFrame(labels, "doc_id int, quality int, toxic int"))
    assert {tuple(r[c] for c in COLUMNS) for r in got.collect()} == by_hand(docs, labels)


def test_odd_documents(spark, odd_docs, no_docs):
    labels = [(1, 1, None), (1, 0, 1), (9, 1, 1), (None, 1, 1), (77, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {tuple(r[c] for c in COLUMNS) for r in audit_documents(odd_docs, table).collect()}
    assert got == by_hand([(r.doc_id, r.text, r.lang) for r in odd_docs.collect()], labels)
    assert audit_documents(no_docs, table).count() == 0
    assert audit_documents(odd_docs, table.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_filters_of_any_names(spark):
    rows = spark.range(100).withColumn("p", F.col("id") % 2)
    got = audit_filters(rows, F.col("p"), {"x": F.col("id") < 10, "y": F.when(F.col("id") > 4, F.col("id") < 20)}, {"m": F.col("id") == 6})
    by = {(r.part, r.filter_order, r.step): r for r in got.collect()}
    assert len(by) == 8 and by["0", "yx", 1].removed == 7 and by["0", "yx", 2].removed == 3 and by["0", "yx", 1].m_lost == 1
    assert by["0", "xy", 2].redundant == 2 and by["0", "xy", 1].shapley == 5 + 3 and by["1", "xy", 2].kept == 40
    with pytest.raises(ValueError):
        audit_filters(rows, F.col("p"), {"m": F.lit(True)}, {"m": F.lit(True)})
    assert np.all(interactions([[1, 2]], [])[1] == 0)
