"""Vector functions on array columns, as JVM higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length; null elements count as 0, null vectors give null."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.when(a.isNull() | b.isNull(), None).when(n < 1, F.lit(0.0)).otherwise(F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    """Euclidean length; 0 for an empty vector."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double") * x.cast("double"), F.lit(0.0))))


def unit(a: Column) -> Column:
    """a over its length; a (nearly) zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 1e-12, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def encode(a: Column) -> Column:
    """A vector as JSON text; null stays null."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ", "), F.lit("]"))


def decode(text: Column) -> Column:
    """JSON text as a vector of floats: an unreadable element becomes 0, blank or 'null' text null, '[]' an empty vector."""
    body = F.trim(F.regexp_replace(text, "[\\[\\]]", ""))
    values = F.transform(F.split(body, ","), lambda x: F.coalesce(F.trim(x).try_cast("float"), F.lit(0.0).cast("float")))
    blank = text.isNull() | F.trim(text).isin("", "null")
    return F.when(blank, None).when(body == "", F.array().cast("array<float>")).otherwise(values)
