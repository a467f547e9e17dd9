"""Vector and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlore.functions.text import bind


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in array order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""

    def divided(n: Column) -> Column:
        return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))

    return bind(norm(a), divided)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
