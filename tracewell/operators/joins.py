"""Joins that Spark has no keyword for: as-of, nearest, band, OR of keys, containment."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from . import scans


def asof(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, take: list[str], direction: str = "backward", within: int | None = None, prefix: str = "r_", most: int | None = None) -> DataFrame:
    """``left`` with columns of the last right row at or before its time (``forward``: the first at or after).

    Both sides are laid in one order by key and time, and the last known right row
    is carried along: one shuffle by key, no pairs. A right row at the same time
    counts in both directions; ties of right rows go to the greatest ``take``, forward to the least.
    A key of more than ``most`` rows (``scans.MOST``) is laid out in stretches of time, and the last
    right row of a stretch is carried into the next ones.
    """
    back = direction == "backward"
    carried = F.struct(F.col(right_ts).alias("t"), *[F.col(c).alias(c) for c in take])
    lefts = left.select(*on, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(carried.alias("c")).schema[0].dataType).alias("_right"))
    rights = right.where(F.col(right_ts).isNotNull()).select(*on, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), carried.alias("_right"))
    # Forward is backward in descending order. Rows with a null key find nothing and needn't meet in one place.
    alone = F.when(reduce(operator.or_, [F.col(k).isNull() for k in on]), F.xxhash64("_t", "_row")).otherwise(F.lit(0)) if on else F.lit(0)
    every, by = lefts.unionByName(rights).withColumn("_alone", alone), [*on, "_alone"]
    cut = scans.cuts(every, by, "_t", most)
    every = scans.with_carry(scans.with_stretch(every, by, "_t", cut), by, F.col("_right"), F.max if back else F.min, "_carried", cut, later=not back)
    w = W.partitionBy(*by, "_stretch").orderBy(F.col("_t") if back else F.col("_t").desc(), "_side", F.col("_right") if back else F.col("_right").desc())
    seen = F.last("_right", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = every.withColumn("_found", F.coalesce(seen, F.col("_carried"))).where("_row is not null")
    distance = F.abs(F.col("_found.t") - F.col("_t"))
    found = F.col("_found") if within is None else F.when(distance <= within, F.col("_found"))
    # A key or time that is null has no neighbour.
    known = F.col("_t").isNotNull()
    for k in on:
        known = known & F.col(k).isNotNull()
    found = F.when(known, found)
    return out.withColumn("_found", found).select("_row.*", F.col("_found.t").alias(f"{prefix}{right_ts}"), *[F.col(f"_found.{c}").alias(f"{prefix}{c}") for c in take])


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, take: list[str], within: int | None = None) -> DataFrame:
    """``left`` with the right row nearest in time, the earlier one of two as near."""
    before = asof(left, right, on, left_ts, right_ts, take, "backward", within, "b_")
    both = asof(before, right, on, left_ts, right_ts, take, "forward", within, "f_")
    b, f = F.col(left_ts) - F.col(f"b_{right_ts}"), F.col(f"f_{right_ts}") - F.col(left_ts)
    use_f = f.isNotNull() & (b.isNull() | (f < b))
    return both.select(*left.columns, *[F.when(use_f, F.col(f"f_{c}")).otherwise(F.col(f"b_{c}")).alias(f"n_{c}") for c in [right_ts, *take]])


def nearest_distance(df: DataFrame, times: DataFrame, ts: str, name: str, width: int = 86_400_000) -> DataFrame:
    """``df`` with ``name``: how far the nearest of ``times`` (at) is; null if there is none.

    Time is cut into stretches, and each has its own times, the last one before it and the first
    one after it, so rows and times meet by stretch however far a row's nearest time is.
    The stretches themselves, a row for each that has rows or times, are laid in one order.
    """
    cut = lambda t: F.floor(t / width).cast("long")
    marks = times.where("at is not null").select("at").distinct().withColumn("_cut", cut(F.col("at")))
    rows = df.withColumn("_cut", cut(F.col(ts)))
    ends = marks.groupBy("_cut").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    every = rows.where("_cut is not null").select("_cut").distinct().join(ends, "_cut", "full")
    w = W.orderBy("_cut")
    beside = every.select("_cut", F.array_compact(F.array(F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1)), F.min("a").over(W.orderBy(F.desc("_cut")).rowsBetween(W.unboundedPreceding, -1)))).alias("ats"))
    near = nearest(rows, marks.select("at", "_cut").unionByName(beside.select(F.explode("ats").alias("at"), "_cut")), ["_cut"], ts, "at", [])
    return near.withColumn(name, F.abs(F.col("n_at") - F.col(ts))).drop("_cut", "n_at")


def band(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, before: int, after: int, how: str = "inner") -> DataFrame:
    """Pairs with equal keys and the right time from ``before`` ms before the left one to ``after`` ms after.

    Time is cut into stretches as long as the band. A left row goes into each
    stretch its band touches and a right row into its own, so the join is on key and
    stretch and a hot key is spread over its stretches. Right columns get ``r_``.
    """
    if how not in ("inner", "left"):
        raise ValueError("inner or left; use first_in_band for existence")
    width = max(1, before + after)
    low, high = F.col(left_ts) - before, F.col(left_ts) + after
    cut = lambda t: F.floor(t / width).cast("long")
    rights = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("r__cut", cut(F.col(f"r_{right_ts}")))
    test = (F.col("_cut") == F.col("r__cut")) & F.col(f"r_{right_ts}").between(low, high)
    for k in on:
        test = test & (F.col(k) == F.col(f"r_{k}"))
    spread = left.withColumn("_cut", F.explode_outer(F.when(F.col(left_ts).isNotNull(), F.sequence(cut(low), cut(high)))))
    if how == "inner":
        return spread.join(rights, test).drop("_cut", "r__cut")
    # A row is laid out once for each stretch: without any partner only its first copy stays.
    names = [c for c in rights.columns if c != "r__cut"]
    numbered = written(left.withColumn("_lid", F.monotonically_increasing_id()), "band")
    pairs = numbered.withColumn("_cut", F.explode_outer(F.when(F.col(left_ts).isNotNull(), F.sequence(cut(low), cut(high))))).join(rights, test).select("_lid", F.struct(*names).alias("_pair"))
    return numbered.join(pairs, "_lid", "left").select(*left.columns, *[F.col(f"_pair.{c}").alias(c) for c in names])


def first_in_band(left: DataFrame, right: DataFrame, on: list[str], key: list[str], start: str, end: str, right_ts: str, take: list[str], within: int | Column) -> DataFrame:
    """For each left row the first right row by (time, take) from ``start`` to ``within`` ms after ``end``: key, and r_ columns.

    The least is aggregated over the pairs, partly before the shuffle, so no
    ordered list of a row's partners is built. ``within`` may be an expression of the keys ``on``.
    """
    width = F.greatest(F.lit(1), within if isinstance(within, Column) else F.lit(within))
    cut = lambda t: F.floor(t / width).cast("long")
    spread = left.withColumn("_cut", F.explode(F.sequence(cut(F.col(start)), cut(F.col(end) + within)))).select(*key, *[k for k in on if k not in key], F.col(start).alias("_from"), (F.col(end) + within).alias("_to"), "_cut")
    rights = right.select(*[F.col(k).alias(f"_k_{k}") for k in on], F.col(right_ts).alias("_t"), cut(F.col(right_ts)).alias("_rcut"), *[F.col(c).alias(f"_r_{c}") for c in take])
    test = (F.col("_cut") == F.col("_rcut")) & F.col("_t").between(F.col("_from"), F.col("_to"))
    for k in on:
        test = test & (F.col(k) == F.col(f"_k_{k}"))
    least = F.min(F.struct("_t", *[f"_r_{c}" for c in take])).alias("_first")
    return spread.join(rights, test).groupBy(*key).agg(least).select(*key, F.col("_first._t").alias(f"r_{right_ts}"), *[F.col(f"_first._r_{c}").alias(f"r_{c}") for c in take])


def union_of_keys(left: DataFrame, right: DataFrame, pairs: list[tuple[Column, Column]], key: str, best: Column, name: str) -> DataFrame:
    """The greatest ``best`` of right rows that match by any pair of keys: an OR of equalities as a union of equi-joins."""
    parts = []
    for a, b in pairs:
        parts.append(left.select(F.col(key), a.alias("_a")).join(right.select(b.alias("_b"), best.alias(name)), F.col("_a") == F.col("_b")).select(key, name))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).agg(F.max(name).alias(name))


def contained(sets: DataFrame, holders: DataFrame, set_key: str, holder_key: str, item: str, score: str) -> DataFrame:
    """For each set the holder, best score first, that has every one of its items: (set_key, holder_key)."""
    size = sets.groupBy(set_key).agg(F.count_distinct(item).alias("_size"))
    hits = sets.select(set_key, item).distinct().join(holders.select(holder_key, item, score).distinct(), item).groupBy(set_key, holder_key).agg(F.count(F.lit(1)).alias("_hit"), F.max(score).alias("_score"))
    whole = hits.join(size, set_key).where("_hit = _size")
    return whole.groupBy(set_key).agg(F.max(F.struct("_score", holder_key)).alias("b")).select(set_key, F.col(f"b.{holder_key}").alias(holder_key))


def overlapping(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def in_ranges(df: DataFrame, value: str, ranges: DataFrame, low: str, high: str, take: list[str]) -> DataFrame:
    """``df`` with the columns of the range that holds its value, of ranges that don't overlap.

    Values and ranges are cut by their upper bits, a range once for each cut it touches, and
    within a cut the last range that begins at or before the value is carried along.
    """
    bits = 16
    cut = lambda c: F.shiftright(c.cast("long"), bits)
    spread = ranges.select(F.explode(F.sequence(cut(F.col(low)), cut(F.col(high)))).alias("_cut"), F.col(low).cast("long").alias("_low"), F.col(high).cast("long").alias("_high"), *take)
    found = asof(df.withColumn("_cut", cut(F.col(value))).withColumn("_v", F.col(value).cast("long")), spread, ["_cut"], "_v", "_low", ["_high", *take])
    inside = F.col("_v") <= F.col("r__high")
    return found.select(*df.columns, *[F.when(inside, F.col(f"r_{c}")).alias(c) for c in take])
