"""Edge cases and brute-force versions of the corpus operators."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runlore.llm import common, fingerprints, html_text, languages, mixing, neighbours, ngram_join, packing, quality, sharding, urls

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    return WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_nulls(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(None, 3), (7, None), (4, 4)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 40)}}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_order_of_all_rows(spark):
    rows, n = common.in_order(spark.range(1000).withColumn("k", F.col("id") % 7), F.col("k"), F.col("id"))
    want = sorted((i % 7, i) for i in range(1000))
    assert n == 1000 and [(r.k, r.id) for r in rows.orderBy("row_index").collect()] == want


# 1 embeddings

def clustered(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for size in (1, 2, 3, 13, 40, 90):
        for _ in range(3):
            centre = rng.standard_normal(16)
            rows += [centre * s + rng.standard_normal(16) * 0.03 for s in rng.uniform(0.5, 2, size)]
    rows += list(rng.standard_normal((500, 16)))
    rows += [rows[5], rows[5], rows[-1]]
    return [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(rows)]


def test_near_duplicates_against_all_pairs(spark):
    rows = clustered()
    descent = neighbours.Descent(block=32)
    got = {r.vec_id: r for r in neighbours.near_duplicates(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4), descent=descent).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    root = roots(range(len(rows)), zip(*np.nonzero(hit), strict=True))
    assert {i: got[i].n_links for i in got} == dict(enumerate(hit.sum(1).tolist()))
    assert {i: got[i].component_id for i in got} == root
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vectors_that_cannot_link(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 1.0]), (8, [2.0, 2.0]),
            (9, [1.0, 1.0, 0.0]), (10, [1.0, 1.0]), (10, [1.0, 1.0]), (None, [-1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, sim string")
    got = [(r.vec_id, r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect()]
    want = [(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 9, None)] + [(i, 3, 7) for i in (7, 8, 10, 10)]
    assert Counter(got) == Counter(want)
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_links_between_dense_groups(spark):
    rng = np.random.default_rng(6)
    rows = list(rng.standard_normal((200, 16)))
    for size in (30, 60):
        for _ in range(3):
            one, two = np.linalg.qr(rng.standard_normal((16, 2)))[0].T
            for angle in (0.0, 0.31):  # cosine 0.952 between the centres of two groups
                rows += list(np.cos(angle) * one + np.sin(angle) * two + rng.standard_normal((size, 16)) * 0.008)
            rows.append(np.cos(0.6) * one + np.sin(0.6) * two)  # links with the second group only
    x = np.array(rows, np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(4)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    root = roots(range(len(rows)), zip(*np.nonzero(hit), strict=True))
    for descent in (neighbours.Descent(), neighbours.Descent(block=16, sent=1000), neighbours.Descent(orders=1, rounds=0, window=4, tries=1, recall=1.1)):
        got = {r.vec_id: r for r in neighbours.near_duplicates(df, descent=descent).collect()}
        assert {i: got[i].n_links for i in got} == dict(enumerate(hit.sum(1).tolist()))
        assert {i: got[i].component_id for i in got} == root


# 2 urls

def test_rules_classes_and_precedence(spark):
    pages = [
        (1, "https://A.Example.com/en/x?q=1#f", None), (2, "http://www.example.com/en/x", ""), (3, "ftp://example.net/es", None),
        (4, "http://example.net/es/1", None), (5, "no scheme", None), (6, None, None),
        (7, "http://x.org/a", '<link rel="canonical" href="http://example.net/es/1">'),
        (8, "https://x.org/a/?utm_source=f#t", None),
        (9, "http://y.org/b", "<META HTTP-EQUIV=refresh content='0; url=http://example.net/fr/2'><link rel=canonical href=http://www.example.com/q>"),
        (10, "http://z.org/", '<link rel=canonical href="/a">'), (10, "http://z.org/", None), (11, "notexample.com://net/fr/", None),
    ]
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
                                   ("net", "/es/", "block"), ("net", "/fr/", "block")], "host string, path string, verdict string")
    df = spark.createDataFrame([(*p, "h") for p in pages], "page_id bigint, url string, html string, host string")
    got = {r.page_id: r[1:] for r in urls.judge_urls(df, rules, urls.page_links(df)).collect()}
    assert got == {
        1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        3: ("example.net", "/es", None, "allow"), 4: ("example.net", "/es/1", "net/es/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("x.org", "/a", None, "block"), 8: ("x.org", "/a/", None, "block"), 9: ("y.org", "/b", None, "allow"),
        10: ("z.org", "/", None, "allow"), 11: ("net", "/fr/", "net/fr/", "block"),
    }
    assert urls.judge_urls(df.limit(0), rules, urls.page_links(df)).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, rules.limit(0), urls.page_links(df).limit(0)).collect()} == {"allow"}


def test_links_in_every_form(spark):
    link = lambda href, rel="canonical": f'<link rel="{rel}" href="{href}">'
    pages = [
        ("http://h/x/y", link("http://h/p?a=1&amp;b=2"), {"http://h/p?a=1&b=2"}), ("http://h/x/y", link("http&#58;//h/p?c=&#x41;&#38;amp;$"), {"http://h/p?c=A&amp;$"}),
        ("http://h/x/y?q", link("p.html"), {"http://h/x/p.html"}), ("http://h/x/y", link("../p?u=http://a/../b"), {"http://h/p?u=http://a/../b"}),
        ("http://h/x/y?q", link("?id=3"), {"http://h/x/y?id=3"}), ("http://h", link("p"), {"http://h/p"}), ("http://h/x/y/", link(".."), {"http://h/x/"}),
        ("http://h/x", link("/a", "alternate canonical") + link("/b") + link("/c", "noncanonical") + link("/d", "alternate"), {"http://h/a", "http://h/b"}),
        ("http://h/x", "<meta http-equiv=refresh content='0; url=/r?a=1&amp;b=2;c'><meta content=\"1;URL='s'\" http-equiv=\"Refresh\">", {"http://h/r?a=1&b=2;c", "http://h/s"}),
        ("http://h/x", link("mailto:a@b") + link("#top") + link("//o/p"), {"http://h/x#top", "http://o/p"}), ("none", link("p"), set()), ("http://h/x", None, set()),
    ]
    df = spark.createDataFrame([p[:2] for p in pages], "url string, html string")
    for url, html, want in pages:
        got = urls.page_links(df.where(F.col("url").eqNullSafe(url) & F.col("html").eqNullSafe(html)))
        assert {r.target for r in got.collect()} == want, html


# 3 quality

def test_quality_of_odd_texts(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (5, 1), (7, 0), (8, None), (99, 1), (1, 1)], "doc_id bigint, quality int")
    got = quality.score_documents(odd_docs, labels, languages.fold("doc_id", 5) == 0).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    scores = defaultdict(set)
    for r in got:
        scores[r.text or ""].add(r.score)
    assert all(len(s) == 1 for s in scores.values())
    assert quality.score_documents(no_docs, labels, F.lit(False)).count() == 0
    assert quality.score_documents(odd_docs, labels.limit(0), F.lit(False)).count() == 11


def test_gradient_by_differences():
    fit = quality.Fit(hidden=5, gate=3)
    net, rng = quality.Network(fit), np.random.default_rng(1)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    x, count = rng.random((7, quality.WIDTH)), np.array([3, 1, 3])
    y, weight = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        p, _ = net.forward(x, count)
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    for k, g in net.gradient(x, count, y, weight).items():
        w = getattr(net, k)
        at = tuple(int(rng.integers(s)) for s in w.shape)
        before, w[at] = w[at], w[at] + 1e-6
        up, w[at] = loss(), before - 1e-6
        down, w[at] = loss(), before
        assert (up - down) / 2e-6 == pytest.approx(g[at], abs=1e-5)


def test_attention_finds_the_bad_passage(spark):
    rng = random.Random(5)
    clean = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(n))
    docs = [(i, clean(300) if i % 2 else clean(100) + " " + " ".join(["BUY!!"] * 50) + " " + clean(150)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    held = [r for r in quality.score_documents(df, labels, F.col("doc_id") >= 200).collect() if r.held_out]
    assert len(held) == 100 and sum((r.score >= 0.3) == bool(r.doc_id % 2) for r in held) >= 95


def naive_score(net, text, words=50):
    """Every passage weighed by itself, one number after the other."""
    e, h = [], []
    passages, _ = quality.encode([text], words)
    assert len(passages) == max(1, -(-len(text.split()) // words))
    for x in passages.astype(float):
        h.append(np.tanh(x @ net.encode))
        e.append(sum(np.tanh(h[-1] @ net.turn[:, j]) / (1 + np.exp(-h[-1] @ net.gate[:, j])) * net.attend[j] for j in range(len(net.attend))))
    a = np.exp(np.array(e)) / np.exp(np.array(e)).sum()
    return 1 / (1 + np.exp(-(sum(w * x for w, x in zip(a, h, strict=True)) @ net.score + net.bias[0])))


def test_scores_against_one_passage_at_a_time(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Red,", "fox", "9", "jumps", "ÖL"]) for _ in range(n)) for n in (1, 49, 50, 51, 700)]
    net = quality.Network(quality.Fit())
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64) * 3)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.withColumn("s", quality.scored(df, net)).collect():
        assert r.s == pytest.approx(naive_score(net, r.text), abs=1e-4), r.i


def test_training_sees_whole_texts(spark):
    clean = "lorem ipsum dolor sit amet " * 10
    docs = [(i, clean * 500 + ("BUY!! " * 50 if i % 2 else "")) for i in range(24)]  # 500 passages, the last one tells
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(24)], "doc_id bigint, quality int")
    whole = quality.learn(df, labels)
    few = quality.learn(df, labels, fit=quality.Fit(passages=3 * 501))
    assert not np.array_equal(whole.encode, few.encode)
    assert quality.learn(df, labels, fit=quality.Fit(passages=3)).encode == pytest.approx(quality.Network(quality.Fit()).encode)


# 4 languages

def test_numerals_are_no_letters(spark):
    texts = ["½ ² ①", "٣ Ⅷ", "x²y", "_", "eins", None]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(9, "eins zwei drei x y", "de"), (10, "one two three", "en")]
    got = {r.doc_id: r for r in languages.identify_documents(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(False)).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und", "und", "de", "und", "de", "und"]
    assert languages.letter_runs("x²y½z") == ["x", "y", "z"]


def test_a_rare_language_is_learned(spark):
    rows = spark.range(50_000).selectExpr("id AS doc_id", "concat('the cat number ', id, ' sat down') AS text", "'en' AS lang")
    rare = spark.createDataFrame([(-1, "kissa istui matolla", "fi"), (-2, "kissa matolla", None)], "doc_id bigint, text string, lang string")
    got = languages.identify_documents(rows.union(rare), F.lit(False)).where("doc_id < 0").collect()
    assert [r.lang_pred for r in got] == ["fi", "fi"]


def scored_by_hand(rows, text):
    """Word first, then shorter n-grams, from plain counters."""
    langs = sorted({g for _, g in rows})
    seen = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    counts = {n: {g: Counter() for g in langs} for n in range(5)}
    for t, g in rows:
        for w in seen(t):
            counts[0][g][w] += 1
            for n in range(1, 5):
                counts[n][g].update(languages.grams(w, n))

    def rates(n, x):
        r = np.array([counts[n][g][x] / max(1, sum(counts[n][g].values())) for g in langs])
        return np.log(0.99 * r + 0.01 * r.mean()) if r.any() else None

    total, words = np.zeros(len(langs)), seen(text)
    for w in words:
        for n, keys in [(0, [w])] + [(n, languages.grams(w, n)) for n in (4, 3, 2, 1)]:
            found = [r for r in (rates(n, k) for k in keys) if r is not None]
            if found:
                total += np.mean(found, 0)
                break
    mean = total / max(1, len(words))
    best = [g for g, m in zip(langs, mean, strict=True) if m >= mean.max() - 1e-12]
    return best, 1 / np.exp((mean - mean.max()) * np.sqrt(len(words))).sum()


def test_languages_against_plain_counters(spark):
    rng = random.Random(4)
    letters = {"a": "abcdefgh", "b": "efghijkl", "c": "aeiouxyz"}
    word = lambda g: "".join(rng.choice(letters[g]) for _ in range(rng.randint(1, 6)))
    learned = [(" ".join(word(g) for _ in range(20)), g) for g in letters for _ in range(15)]
    asked = [" ".join(word(rng.choice("abc")) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    rows = [(i, t, g) for i, (t, g) in enumerate(learned)] + [(100 + i, t, None) for i, t in enumerate(asked)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    for r in languages.identify_documents(df, F.lit(False)).where("doc_id >= 100").collect():
        best, score = scored_by_hand(learned, r.text)
        assert r.lang_pred in best and r.score == pytest.approx(score, rel=1e-9)


def test_languages_of_odd_texts(odd_docs, no_docs):
    got = languages.identify_documents(odd_docs, F.lit(False)).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert {i: by[i].lang_pred for i in (5, 8, 9)} == {5: "en", 8: "de", 9: "de"} and by[1].lang_pred == by[6].lang_pred
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 4, 7))
    assert all(0 <= r.score <= 1 for r in got)
    assert languages.identify_documents(no_docs, F.lit(False)).count() == 0
    assert {r.lang_pred for r in languages.identify_documents(odd_docs, F.lit(True)).collect()} == {"und"}


def test_backoff_goes_to_shorter_grams():
    one = lambda *v: np.array(v)
    model = languages.Model(["a", "b"], {"known": one(-1.0, -2.0)},
                            {4: {"<abc": one(-3.0, -4.0)}, 3: {"xyz": one(-5.0, -6.0)}, 2: {"q>": one(-7.0, -8.0)}, 1: {"ß": one(-9.0, -8.0)}})
    assert [model.word(w).tolist() for w in ("known", "abcd", "wxyz", "qq", "ßß", "!")] == [
        [-1, -2], [-3, -4], [-5, -6], [-7, -8], [-9, -8], [0, 0]]
    assert languages.Scorer(model)(["ßß", "", "12"])[0][0] == "b"


# 5 mixing

def mixed_by_hand(rows, mix=mixing.Mix()):
    size = lambda t: len(WORDS.findall(t or ""))
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(names)}
    budget, capped = sum(total.values()) * mix.share, set()
    while True:
        rest = [s for s in names if s not in capped]
        left = budget - sum(mix.repeats * total[s] for s in capped)
        goal = {s: weight[s] * left / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if goal[s] > mix.repeats * total[s]}
        if not over:
            break
        capped |= over
    goal |= {s: float(mix.repeats * total[s]) for s in capped}
    return total, goal


def test_mix_against_a_sorted_pass(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "a", "a", "b", "c", None, "d"])) for i in range(3000)]
    got = {r.doc_id: r for r in mixing.mix_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)).collect()}
    total, goal = mixed_by_hand(rows)
    unit = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    for s in total:
        own = sorted((unit(i), len(WORDS.findall(t)), i) for i, t, x in rows if x == s)
        full = int(goal[s] // total[s])
        budget, run = goal[s] - full * total[s], 0
        for _, n, i in own:
            assert got[i].target == pytest.approx(goal[s]) and got[i].source_size == total[s]
            extra = run + run + n <= 2 * budget and budget < total[s]
            run += n
            assert got[i].taken == n * (full + extra)


def test_mix_of_odd_rows(odd_docs, no_docs):
    got = mixing.mix_documents(odd_docs).collect()
    assert len(got) == 11 and all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.mix_documents(no_docs).count() == 0 and mixing.mixed_rows(no_docs).count() == 0
    taken = Counter((r.doc_id, r.text) for r in mixing.mixed_rows(odd_docs).collect())
    assert sum(taken.values()) == sum(r.copies for r in got)
    assert mixing.mixed_rows(odd_docs).columns == odd_docs.columns


# 6 n-grams

def near_copies(seed=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs, passage = [], [word() for _ in range(60)]
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(3, 200))]
        if rng.random() < 0.5:
            base[1:1] = passage
        for _ in range(rng.choice([1, 1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    docs += [docs[0].upper(), docs[1], "a b", "a b", "a  B", "a", "", None, " \n"]
    return list(enumerate(docs))


@pytest.mark.parametrize("rounds", [0, 2])
def test_components_against_all_pairs(spark, rounds):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, ngram_join.Join(star_rounds=rounds)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(sets, links)
    assert len(links) > 50 and got == {i: (len(sets[i]), root[i]) for i in sets}


def test_one_of_each_component(odd_docs, no_docs):
    kept = ngram_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter([1, 2, 3, 4, 5, 7, 8, 9, None])
    assert ngram_join.one_of_each(no_docs).count() == 0 and ngram_join.ngram_components(no_docs).count() == 0


def test_the_least_of_equal_rows_stays(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text, s, g) for s, g in (("b", "x"), ("a", "y"), (None, "z"), ("a", "x"))] + [(2, "other " + text, "c", "q"), (3, "own words", "d", "r")]
    for seed in (1, 2):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, _gone string, text_ string").repartition(1 + seed)
        kept = sorted(tuple(r) for r in ngram_join.one_of_each(df).collect())
        assert kept == [(1, text, "a", "x"), (3, "own words", "d", "r")]


def test_rows_without_a_key_and_shared_keys(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    one, two, three, four = ([word() for _ in range(80)] for _ in range(4))
    near = lambda w, i: " ".join([*w[:i], "changed", *w[i + 1 :]])
    rows = [(1, " ".join(one)), (None, near(one, 79)), (None, " ".join(two)), (None, near(two, 0)), (None, " ".join(two)), (None, None), (None, "  "),
            (7, near(one, 0)), (7, " ".join(three)), (8, " ".join(four)), (8, near(four, 79))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in ngram_join.one_of_each(df).collect()]
    clean = [(1, " ".join(one)), (None, None), (None, "  "), (7, " ".join(three))]
    assert all(kept.count(r) == 1 for r in clean) and len(kept) == 6
    assert sum(k is None and (t or "").split()[2:70] == two[2:70] for k, t in kept) == 1 and sum(k == 8 for k, _ in kept) == 1


def test_sets_are_read_without_moving_them(spark, monkeypatch):
    rng, written = random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(60)] for _ in range(8)]
    rows = [(None, " ".join(b)) for b in base for _ in range(5)] + [(i, " ".join(b[:-1] + ["x"])) for i, b in enumerate(base)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)

    def noted(table, write=ngram_join.materialise):
        if "grams" in table.columns:
            written.append(table._jdf.queryExecution().executedPlan().toString())
        out = write(table)
        if "grams" in table.columns:
            written.append(Counter(r.cls for r in out.select("cls").collect()))
        return out

    monkeypatch.setattr(ngram_join, "materialise", noted)
    got = ngram_join.ngram_components(df).collect()
    assert len(got) == 48 and {r.component_id for r in got} == set(range(8))
    # tasks read the sets where the texts are; copies under no key, read by several tasks, are told by numbers alone
    reading, _, _, once = written[:4]
    assert "MapInArrow" in reading and "Exchange hashpartitioning(cls" not in reading and "Aggregate(key=[cls" not in reading.split("MapInArrow")[0]
    assert len(once) == 16 and set(once.values()) == {1}


# 7 packing

ODD = ["", "a", " a", "a ", "  a b", "a  b c", "a\nb", "a \nb, c", "x y z", "<|endoftext|> a  b", "x<|endoftext|> y.", "don't 'tis can't",
       "ñ, é. ß", "日本語 テキスト。 a", "1 2,3 4.5. 6,", "a.. b,, c", "a .b ,c", " ", "\n\n", "a\x0bb \x0c c", "Hello, World. a.b, c\nd. e,"]


def test_encoder_equals_the_tokenizer():
    encode, plain = packing.Encoder(TOKENIZER, 0), Tokenizer.from_file(TOKENIZER)
    want = [plain.encode(t, add_special_tokens=False).ids + [0] for t in ODD]
    assert [x.tolist() for x in encode(ODD)] == want and [encode([t])[0].tolist() for t in ODD] == want


def test_pack_holds_every_constraint():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 400, 900)
    for measure in ("norm", "dot"):
        bins = packing.Bins(tokens=1000, documents=6, attention=300_000.0, measure=measure, weights=(1, 1, 1))
        where, offset = packing.pack(lengths, bins)
        for b in np.unique(where):
            own = np.flatnonzero(where == b)
            assert lengths[own].sum() <= 1000 and len(own) <= 6 and (lengths[own].astype(float) ** 2).sum() <= 300_000
            at = own[np.argsort(offset[own])]
            assert offset[at].tolist() == (np.cumsum(lengths[at]) - lengths[at]).tolist()
    where, _ = packing.pack(lengths, packing.Bins(tokens=1000))
    assert where.max() + 1 <= np.ceil(lengths.sum() / 1000) * 1.02 + 1
    with pytest.raises(ValueError):
        packing.pack(np.array([1001]), packing.Bins(tokens=1000))


def test_packed_documents(odd_docs, no_docs):
    got = packing.pack_documents(odd_docs, TOKENIZER, with_ids=True).collect()
    plain, texts = Tokenizer.from_file(TOKENIZER), {(r.doc_id, r.text) for r in odd_docs.collect()}
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter([1, 2, 3, 4, 5, 6, 7, 8, 9, 9, None])
    for key, text in texts:
        want = plain.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted((r.piece, r) for r in got if r.doc_id == key)
        if key != 9:
            assert sum((r.ids for _, r in own), []) == want
            assert [r.start for _, r in own] == np.cumsum([0, *[r.length for _, r in own]])[:-1].tolist()
            assert all(r.length == 2048 for _, r in own[1:])
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 2048
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for own in fill.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert packing.pack_documents(no_docs, TOKENIZER).count() == 0


# 8 fingerprints

def test_fingerprints_against_sets(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(120):
        text = " ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 9, 40, 300, 900])))
        rows.append((3 * i, text + rng.choice(["", "é", "\n", "😀"])))
    rows += [(1, rows[4][1]), (7, ""), (8, None), (10, rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(df, per_group=16).collect()}
    order = sorted((i, t or "") for i, t in rows)
    errors = []
    for (i, t), (j, u) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        r = got[i]
        assert (r.text, r.n_chars, r.edited) == (t, len(t), edited)
        a, b, c = shingles(t), shingles(edited), shingles(u)
        errors.append(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0))
        errors.append(r.near_next - (len(a & c) / len(a | c) if a | c else 1.0))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.2
    assert got[1].fingerprint == got[10].fingerprint == got[12].fingerprint and got[7].fingerprint == got[8].fingerprint == ""


def test_fingerprints_of_odd_rows(odd_docs, no_docs):
    got = fingerprints.fingerprint_documents(odd_docs).collect()
    assert len(got) == 11 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.fingerprint_documents(no_docs).count() == 0
    alone = fingerprints.fingerprint_documents(odd_docs.where("doc_id = 1")).first()
    assert alone.near_next == 1.0


def test_empty_bins_are_filled(spark):
    sketch = fingerprints.Sketch(bins=16)
    values = fingerprints.bin_values(fingerprints.shingle_hashes(F.lit("one two three four five six seven"), 5), sketch)
    row = spark.range(1).select(values.alias("v"), fingerprints.densified(values, sketch).alias("d")).first()
    assert sum(x is not None for x in row.v) == 3 and None not in row.d and set(row.d) == {x for x in row.v if x is not None}
    assert [d for d, v in zip(row.d, row.v, strict=True) if v is not None] == [v for v in row.v if v is not None]


# 9 pages

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="ad banner">Buy now now now</div>
<div id="cookie-notice"><p>We use cookies to be bad to you and others</p></div>
<article><h1>A  title</h1><p>First &lt;b&gt; para&shy;graph <b>bold</b>text<br>line &#233; &amp;c.</p><!-- <p>no</p> -->
<aside>Related things to read</aside><form><input><button>Send</button> me</form><ul><li>point one</li><li>point two</li></ul>
<p>Last one</p><section class="comments"><p>I disagree with all of it strongly</p></section></article>
<footer>&copy; all</footer></body></html>"""


def test_main_text_of_a_page():
    costs = {"p": 0.6, "h1": 0.6, "ul": 5.0, "li": 5.0}
    want = "A title First <b> para\xadgraph boldtext line é &c. point one point two Last one"
    assert html_text.extract(PAGE, costs | {"ul": 0.2, "li": 0.2, "section": 0.2}) == want
    assert html_text.extract(PAGE, costs) in (want, want.replace(" point one point two Last one", ""))
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert "First" in html_text.extract(plain, costs) and "Buy" not in html_text.extract(plain, costs)
    assert [html_text.extract(p, costs) for p in ("", "<", "&amp;", "no tags at all", "<p>open <b", "<p class='x>unclosed", "</p></div>")] == [
        "", "<", "&", "no tags at all", "open <b", "<p class='x>unclosed", ""]


def test_marks_on_the_whole_page(spark):
    inner = "<h1>A title</h1><p>The text of the page goes on and on for some words</p>"
    rest = "<nav><a>Menu one</a></nav>{}<div class='sidebar'><p>Buy now</p></div><footer>all rights</footer>"
    want, costs = "A title The text of the page goes on and on for some words", {"p": 0.2, "h1": 0.2, "div": 5.0}
    for around in ('<body class="has-sidebar"><article>{}</article>', '<body><article class="post comments-open">{}</article>',
                   '<body><div class="content with-sidebar"><article>{}</article></div>', '<body><main id="main-header-fixed">{}</main>',
                   '<body class="nav"><div class="content with-sidebar">{}</div>'):
        page = "<html class='header'>" + rest.format(around.format(inner)) + "</body></html>"
        assert html_text.extract(page, costs) == want, page
        assert bool(html_text.tag_counts(page)) == ("<article" in page or "<main" in page)
    kept = ("<article><p>One two</p><figure><img><figcaption>The caption</figcaption></figure><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn>"
            "<annotation>\\x</annotation></math> and <object>shown</object></p><div class='comments'><article class='comment'><p>no</p></article></div></article>")
    assert html_text.extract(kept, costs | {"figure": 0.2, "figcaption": 0.2}) == "One two The caption so x=1 and shown"


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in html_text.extract_pages(pages).collect()}
    import html as h
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(h.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(br|p|/p|h1|/h1)>", " ", inner))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    odd = spark.createDataFrame([(1, None, None, "t"), (None, "u", "", "t"), (2, "u", PAGE, "t"), (2, "u", PAGE, "t")],
                                "page_id bigint, url string, html string, text string")
    rows = html_text.extract_pages(odd).collect()
    assert sorted(r.n_chars for r in rows)[:2] == [0, 0] and len({r.text for r in rows}) == 2
    assert html_text.extract_pages(odd.limit(0)).count() == 0


# 10 shards

def test_hilbert_steps_are_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2)):
        cells = [[(i >> (bits * d)) & ((1 << bits) - 1) for d in range(dims)] for i in range(1 << bits * dims)]
        df = spark.createDataFrame([(c,) for c in cells], "c array<int>").select("c", sharding.hilbert_index(F.col("c"), dims, bits).alias("h"))
        order = [r.c for r in df.orderBy("h").collect()]
        assert sorted(r.h for r in df.collect()) == list(range(len(cells)))
        assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(order, order[1:], strict=False))


def test_shards_differ_by_one_row(spark, odd_docs, no_docs, tmp_path):
    sized = odd_docs.select("doc_id", "lang", "source", F.length("text").cast("long").alias("size"), "shard", "curve")
    for rows, shards in ((sized, 4), (sized, 40), (sized.limit(0), 3), (spark.range(1000).select(
            F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("size")), 7)):
        placed = sharding.shard_rows(*sharding.ranked_documents(rows), shards, ["doc_id", "size"])
        got = placed.collect()
        counts = Counter(r.shard for r in got)
        assert len(got) == rows.count() and (not got or max(counts.values()) - min([counts[s] for s in range(shards)]) <= 1)
        for s in counts:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    path = str(tmp_path / "shards")
    sharding.write_shards(placed, path)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 7


def test_sources_of_one_beginning_prune(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), (F.col("id") % 97).alias("size"),
                                    F.concat(F.lit("https://example.com/archive/"), F.col("id") % 4).alias("source"))
    rows, dims = sharding.ranked_documents(rows)
    placed = sharding.shard_rows(rows, dims, 16, ["doc_id"])
    assert rows.select("source", "_source").distinct().count() == 4 and {r._source for r in rows.select("_source").distinct().collect()} == {0, 1, 2, 3}
    assert all(r.n <= 8 for r in placed.groupBy("source").agg(F.count_distinct("shard").alias("n")).collect())


def test_equal_rows_lie_in_many_ranges(spark):
    rows = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(5).cast("long").alias("size"))
    got = sharding.shard_rows(*sharding.ranked_documents(rows), 7, ["doc_id", "size"]).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("m")).collect()
    assert sorted(r.n for r in got) == [428] * 3 + [429] * 4 and all(r.n == r.m for r in got)


def test_a_dimension_meets_few_shards(spark):
    rows = spark.range(4096).select(F.col("id").alias("doc_id"), (F.col("id") % 16).alias("x"), F.expr("id div 16 % 16").alias("y"), F.expr("id div 256").alias("z"))
    placed = sharding.shard_rows(rows, {c: F.col(c) for c in "xyz"}, 64, ["doc_id"])
    met = [placed.where(f"{c} = 3").select("shard").distinct().count() for c in "xyz"]
    assert max(met) <= 32
