"""Vector expressions on ARRAY<FLOAT|DOUBLE> columns (computed in double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col


def as_double(v: str | Column) -> Column:
    return col(v).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(as_double(a), lambda x: x * x), F.lit(0.0),
                              lambda acc, x: acc + x))


def cosine(a: str | Column, b: str | Column, b_norm: Column | None = None) -> Column:
    nb = b_norm if b_norm is not None else norm(b)
    return dot(a, b) / (norm(a) * nb)


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda acc, x: acc + x))


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")
