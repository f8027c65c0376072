"""Scans in the order of a key's rows when one key may hold most of them.

A window over a key is one task, however long. Here the few keys with very many rows are
cut into stretches by what orders them (approximate percentiles, so that stretches hold
about as many rows), a window runs over each stretch by itself, and what a stretch
needs of those before it is carried over: an aggregate of each stretch, a row for each, summed
up over at most PIECES of them. Rows with equal order stay in one stretch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows from which a key is cut, and stretches that it is cut into.
MOST, PIECES = 2_000_000, 64


def cuts(df: DataFrame, by: list[str], at: str, most: int | None = None, pieces: int = PIECES) -> DataFrame | None:
    """(by, _cuts) for keys of more than ``most`` rows: the values of ``at`` that end their stretches. None if no key is that large."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (MOST if most is None else most)).drop("_n")
    if sizes.isEmpty():
        return None
    named = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in by])
    own = df.join(named, _same(by), "left_semi") if by else df
    shares = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    return own.groupBy(*by).agg(F.array_distinct(F.percentile_approx(at, shares, F.lit(pieces * 20))).alias("_cuts"))


def _same(by: list[str]) -> Column:
    test = F.lit(True)
    for k in by:
        test = test & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return test


def with_stretch(df: DataFrame, by: list[str], at: str, found: DataFrame | None) -> DataFrame:
    """``df`` with _stretch: the number of its key's cuts that lie before ``at``; 0 for keys without any."""
    if found is None:
        return df.withColumn("_stretch", F.lit(0))
    named = found.select(*[F.col(k).alias(f"_k_{k}") for k in by], "_cuts")
    joined = df.join(named, _same(by), "left") if by else df.crossJoin(F.broadcast(named))  # of no key there is one row
    number = F.size(F.filter("_cuts", lambda c: c < F.col(at)))
    return joined.withColumn("_stretch", F.when(F.col("_cuts").isNull(), 0).otherwise(F.coalesce(number, F.lit(0)))).drop("_cuts", *[f"_k_{k}" for k in by])


def with_carry(df: DataFrame, by: list[str], value: Column, fold: Callable[[Column], Column], name: str, found: DataFrame | None, later: bool = False) -> DataFrame:
    """``df`` (with _stretch) and ``name``: ``fold`` (an aggregate like F.sum) of ``value`` over all earlier stretches of the key, or all ``later`` ones."""
    if found is None:
        return df.withColumn(name, F.lit(None).cast(df.select(fold(value).alias("v")).schema["v"].dataType))
    each = df.where(F.col("_stretch").isNotNull()).groupBy(*by, "_stretch").agg(fold(value).alias("_v"))
    order = W.partitionBy(*by).orderBy("_stretch")
    w = order.rowsBetween(1, W.unboundedFollowing) if later else order.rowsBetween(W.unboundedPreceding, -1)
    # Only keys with stretches have more than one row here.
    carried = each.withColumn(name, fold(F.col("_v")).over(w)).where(F.col(name).isNotNull()).select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col("_stretch").alias("_s"), name)
    return df.join(carried, _same(by) & (F.col("_stretch") == F.col("_s")), "left").drop("_s", *[f"_k_{k}" for k in by])
