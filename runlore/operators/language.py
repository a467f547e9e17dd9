"""Language of a text by its character trigrams.

Trigrams are counted by hash bucket for each labelled language; a text gets the language under which its trigrams are
likeliest. A text stays one row throughout: its trigrams are hashed and summed inside Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.functions import text as tx
from runlore.session import materialise

BUCKETS = 1 << 14
DEFAULT = "en"


def flat_text(c: Column) -> Column:
    """The lower-cased words between single spaces, with one at either end."""
    return F.concat(F.lit(" "), F.lower(tx.clean_text(c)), F.lit(" "))


def trigram_buckets(text: str) -> np.ndarray:
    """Bucket of each overlapping trigram: its three code points as digits of base 31."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    return (points[:-2] * 961 + points[1:-1] * 31 + points[2:]) % BUCKETS


def language_profiles(labelled: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, bucket, n) over all trigrams of all labelled texts: at most languages x ``BUCKETS`` rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                n = np.zeros(BUCKETS, np.int64)
                for text in group["flat"]:
                    n += np.bincount(trigram_buckets(text), minlength=BUCKETS)
                found = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "bucket": found, "n": n[found]})

    rows = labelled.select("lang", flat_text(F.col(text_col)).alias("flat")).where("lang IS NOT NULL AND flat IS NOT NULL")
    counted = rows.mapInPandas(count, "lang string, bucket bigint, n bigint")
    return materialise(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def detect_languages(texts: DataFrame, profiles: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, language) for every whole text, English where there is nothing to go by. Of equally likely languages the
    last in the alphabet wins."""
    counts = profiles.toPandas()
    languages = sorted(set(counts["lang"]), reverse=True)
    table = np.zeros((len(languages), BUCKETS))
    table[[languages.index(x) for x in counts["lang"]], counts["bucket"].to_numpy(np.int64)] = counts["n"]
    rates = np.log((table + 1) / (table.sum(1, keepdims=True) + BUCKETS))
    shared = texts.sparkSession.sparkContext.broadcast((languages, rates))

    @F.pandas_udf("string")
    def language(flat: pd.Series) -> pd.Series:
        names, gains = shared.value

        def of(text: str | None) -> str:
            if text is None or len(text) < 3 or not names:
                return DEFAULT
            return names[int(np.round(gains[:, trigram_buckets(text)].sum(1), 6).argmax())]

        return flat.map(of, na_action=None)

    return texts.select(id_col, language(flat_text(F.col(text_col))).alias("language"))


def agreement(detected: DataFrame, labelled: DataFrame, id_col: str, *by: str) -> DataFrame:
    """Rows and agreeing rows per labelled language, and per further columns."""
    joined = labelled.select(id_col, "lang", *by).join(detected, id_col)
    return joined.groupBy("lang", *by).agg(
        F.count("*").alias("texts"), F.count_if(F.col("lang") == F.col("language")).alias("agree")
    )
