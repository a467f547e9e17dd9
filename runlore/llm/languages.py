"""Language identification by words first, then by ever shorter character n-grams.

A word that was counted in training scores its log frequency in each language. A word that wasn't scores by its longest
character n-grams that were: those of four letters, else of three, of two, of one. The language with the best mean wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlore.llm.common import give_back
from runlore.session import materialise, remove_table, small_table

#: Runs of letters, and numerals such as ``½``, which are told apart afterwards: the usual text has none.
WORD = re.compile(r"[^\W\d_]+")
LETTERS = regex.compile(r"\p{L}+")
#: Longest and shortest n-gram, with a mark for each end of the word.
LONGEST, SHORTEST = 4, 1
#: Scores of new words kept by a worker; a full store is emptied.
STORE_WORDS = 150_000
UNDETERMINED = "und"


@dataclass(frozen=True)
class Fit:
    """Bounds of the training: about so many labelled rows of each language, and how many words, and n-grams of each
    length, are kept. Languages share these evenly and each keeps its own most frequent ones; what a language loses as a
    word it still has in its n-grams."""

    rows: int = 2_500
    words: int = 50_000
    grams: int = 50_000


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Rates:
    """Log frequencies of strings, a row of one number per language each, in one array."""

    def __init__(self, rows: dict[str, np.ndarray]):
        self.place = {k: i for i, k in enumerate(rows)}
        self.table = np.array(list(rows.values()), np.float64)

    def find(self, keys: list[str]) -> np.ndarray:
        """Row of each, -1 where it isn't known."""
        get = self.place.get
        return np.array([get(k, -1) for k in keys], np.int64)


@dataclass
class Model:
    """Languages; log frequencies of words and, by length, of n-grams."""

    languages: list[str]
    words: Rates | dict[str, np.ndarray]
    grams: dict[int, Rates | dict[str, np.ndarray]]

    def __post_init__(self):
        as_rates = lambda x: x if isinstance(x, Rates) else Rates(x)
        self.words, self.grams = as_rates(self.words), {n: as_rates(t) for n, t in self.grams.items()}

    def score(self, words: list[str]) -> np.ndarray:
        """Scores of words by language, a row each; zeros if nothing of a word is known."""
        out = np.zeros((len(words), len(self.languages)))
        at = self.words.find(words)
        if (at >= 0).any():
            out[at >= 0] = self.words.table[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n in range(LONGEST, SHORTEST - 1, -1):
            if not len(left) or n not in self.grams or not len(self.grams[n].table):
                continue
            each = [grams(words[i], n) for i in left.tolist()]
            at = self.grams[n].find([g for gs in each for g in gs])
            of = np.repeat(np.arange(len(left)), [len(gs) for gs in each])[at >= 0]
            rows = self.grams[n].table[at[at >= 0]]
            count = np.bincount(of, minlength=len(left))
            sums = np.stack([np.bincount(of, weights=x, minlength=len(left)) for x in rows.T], 1)
            has = count > 0
            out[left[has]] = sums[has] / count[has, None]
            left = left[~has]
        return out

    def word(self, word: str) -> np.ndarray:
        return self.score([word])[0]


def letter_runs(text: str) -> list[str]:
    found = WORD.findall(text)
    return found if not found or "".join(found).isalpha() else LETTERS.findall(text)


class Scorer:
    """Scores whole texts, each distinct word once."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.empty((0, len(self.model.languages)))

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        if len(self.place) > STORE_WORDS:
            self.clear()
        found = [letter_runs(t.lower()) for t in texts]
        new = list({w for ws in found for w in ws if w not in self.place})
        if new:
            self.place.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.model.score(new)])
        return [self.text([self.place[w] for w in ws]) for ws in found]

    def text(self, places: list[int]) -> tuple[str, float]:
        if not places or not self.model.languages:
            return UNDETERMINED, 0.0
        mean = self.table[places].mean(0)
        best = int(mean.argmax())  # of equal ones the first in code-point order
        # evidence grows with the square root of the words, as words that follow each other aren't independent
        return self.model.languages[best], float(1 / np.exp((mean - mean[best]) * np.sqrt(len(places))).sum())


def log_rates(counts: pd.DataFrame, key: str, languages: list[str], known: float = 0.99) -> dict[str, np.ndarray]:
    """Log frequency in each language, mixed with the mean one of all, so that a language with few texts neither gains
    nor loses by what it hasn't seen."""
    table = counts.pivot_table(index=key, columns="lang", values="n", aggfunc="sum", fill_value=0).reindex(columns=languages, fill_value=0)
    if table.empty:
        return {}
    rates = (table / table.sum().clip(lower=1)).to_numpy()
    rates = np.log(known * rates + (1 - known) * rates.mean(1, keepdims=True))
    return dict(zip(table.index, rates, strict=True))


def gram_column(word: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", bounds: Fit = Fit()) -> Model:
    """Learn from rows with a language and a text: of each language about ``bounds.rows``, chosen by a hash of key and
    text, so a language with few rows keeps them all. Words and n-grams are counted by Spark; the driver gets those that
    ``bounds`` names. No rows give a model without languages."""
    known = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(key, text), F.lit(1 << 20)).alias("u"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    cuts = [(k, -(-min(bounds.rows, n) * (1 << 20) // n)) for k, n in sizes.items()]
    cut = small_table(rows.sparkSession, cuts, "lang string, cut bigint")  # a row per language
    chosen = known.join(F.broadcast(cut), "lang").where("u < cut")
    words = F.explode(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"\p{L}+"), F.lit(0)))
    counts = chosen.select("lang", words.alias("word")).groupBy("word", "lang").agg(F.count("*").alias("n"))
    counts = materialise(counts)

    def most(table: DataFrame, limit: int) -> pd.DataFrame:
        order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
        best = table.withColumn("at", F.row_number().over(order)).where(F.col("at") <= max(1, limit // max(1, len(sizes))))
        return table.join(F.broadcast(best.select("word").distinct()), "word", "left_semi").toPandas()

    marked = F.concat(F.lit("<"), "word", F.lit(">"))
    tables = {}
    for n in range(LONGEST, SHORTEST - 1, -1):
        source = marked if n > 1 else F.col("word")
        of_word = counts.where(F.length(source) >= n).select(F.explode(gram_column(source, n)).alias("word"), "lang", "n")
        tables[n] = most(of_word.groupBy("word", "lang").agg(F.sum("n").alias("n")), bounds.grams)
    top = most(counts, bounds.words)
    languages = sorted(set(top["lang"]) | set(tables[SHORTEST]["lang"]))
    remove_table(counts)
    give_back()
    return Model(languages, log_rates(top, "word", languages), {n: log_rates(t, "word", languages) for n, t in tables.items()})


def identify(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Struct (lang_pred, score) of every whole text: ``und`` and 0 for null and for texts without a letter."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for batch in batches:
            out = [r for i in range(0, len(batch), 256) for r in scorer(batch.iloc[i : i + 256].fillna("").tolist())]
            yield pd.DataFrame(out, columns=["lang_pred", "score"])
        del scorer
        give_back()

    return F.pandas_udf(run, "lang_pred string, score double")(F.col(text))


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo the folds; a null key counts as an empty one."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % folds


def identify_documents(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
                       bounds: Fit = Fit()) -> DataFrame:
    """All columns of ``docs`` with ``held_out``, ``lang_pred`` and ``score`` (replaced if there were such).

    Learns from the rows that aren't held out and have a language. Neither language, key nor any other column enters a
    prediction, so equal texts get equal ones and repeated rows stay repeated. Among equally good languages the first
    by code point wins. Without labelled rows, and in texts without letters (numerals such as ``½`` are none), the
    language is ``und``. An empty table gives no rows.
    """
    plain = docs.drop("held_out", "lang_pred", "score")
    model = fit(plain.where(~held_out), text, lang, key, bounds)
    found = plain.withColumn("held_out", held_out).withColumn("_found", identify(plain, model, text))
    return found.select(*[F.col(f"`{c}`") for c in plain.columns], "held_out", "_found.lang_pred", "_found.score")
