"""Operators over rows in time order: sessions, bursts, merged intervals, holes, greedy campaigns, accrual."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..session import written
from . import scans


def gap_sessions(df: DataFrame, by: list[str], ts: str, gap: int | Column, name: str = "session", most: int | None = None) -> DataFrame:
    """``df`` with the number of its session: a new one starts more than ``gap`` ms after the row before.

    A key of more than ``most`` rows (``scans.MOST``) is numbered in stretches.
    """
    found = scans.cuts(df, by, ts, most)
    rows = scans.with_stretch(df, by, ts, found)
    return _sessions(rows, by, ts, gap, name, found).drop("_stretch")


def _sessions(rows: DataFrame, by: list[str], ts: str, gap: int | Column, name: str, found: DataFrame | None) -> DataFrame:
    """The same for rows with _stretch."""
    order = [ts, "id"] if "id" in rows.columns else [ts]
    w = W.partitionBy(*by, "_stretch").orderBy(*order)
    rows = scans.with_carry(rows, by, F.col(ts), F.max, "_before", found)
    cut = (F.col(ts) - F.coalesce(F.lag(ts).over(w), F.col("_before")) > gap).cast("int")
    rows = rows.withColumn("_cut", F.coalesce(cut, F.lit(0)))
    rows = scans.with_carry(rows, by, F.col("_cut"), F.sum, "_cuts_before", found)
    return rows.withColumn(name, F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce("_cuts_before", F.lit(0))).drop("_cut", "_before", "_cuts_before")


def trailing_sizes(rows: DataFrame, by: list[str], ts: str, window: Column, what: str | None, most: int | None = None) -> DataFrame:
    """``rows`` with _size: how many rows of the group, or different values of ``what``, lie in the window that ends at the row.

    A row counts from its own time until the window has passed, a value until it comes
    again; the size is the running sum of such beginnings and ends, so its cost doesn't
    grow with what the window holds. A group of more than ``most`` rows is summed in stretches.
    """
    passed = F.col(ts) + window + 1
    if what is not None:
        again = F.lead(ts).over(W.partitionBy(*by, what).orderBy(ts, "id"))
        rows = rows.withColumn("_ends", F.when(F.col(what).isNotNull(), F.least(again, passed)))
    else:
        rows = rows.withColumn("_ends", passed)
    found = scans.cuts(rows, by, ts, most)
    marks = F.array(F.struct(F.col(ts).alias("at"), F.when(F.col("_ends").isNotNull(), 1).otherwise(0).alias("d"), F.lit(True).alias("own")), F.struct(F.col("_ends").alias("at"), F.lit(-1).alias("d"), F.lit(False).alias("own")))
    events = rows.withColumn("_mark", F.explode(F.filter(marks, lambda m: m["at"].isNotNull()))).withColumn("_at", F.col("_mark.at"))
    events = scans.with_stretch(events, by, "_at", found)
    events = scans.with_carry(events, by, F.col("_mark.d"), F.sum, "_sum_before", found)
    upto = W.partitionBy(*by, "_stretch").orderBy("_mark.at").rangeBetween(W.unboundedPreceding, 0)
    return events.withColumn("_size", F.sum("_mark.d").over(upto) + F.coalesce("_sum_before", F.lit(0))).where("_mark.own").drop("_mark", "_ends", "_at", "_stretch", "_sum_before")


def bursts(df: DataFrame, by: list[str], ts: str, window: int | Column, comparator: str, n: int, distinct: Column | None = None, keep: list[str] | None = None, refs: int = 5000, met: Callable[[Column], Column] | None = None, most: int | None = None) -> DataFrame:
    """Per group and session the rows from a window before the first row at which the trailing window meets the threshold (or ``met`` says so of its size).

    A session ends where the next row is more than ``window`` (a number or an expression of the group) away, so it has one
    burst at most. Columns: ``by``, start, end, count, distinct_values, refs (the first by time), and the first
    row's ``keep`` columns. A group of more than ``most`` rows (``scans.MOST``) is worked in stretches, with the same result.
    """
    met = met or (lambda size: V.meets(size, comparator, n))
    rows = df.where(F.col(ts).isNotNull()).withColumn("_w", window if isinstance(window, Column) else F.lit(window))
    rows = rows.withColumn("_what", F.nullif(F.lower(distinct.cast("string")), F.lit("")) if distinct is not None else F.lit(None).cast("string"))
    found = scans.cuts(rows, by, ts, most)
    rows = scans.with_stretch(rows, by, ts, found)
    rows = _sessions(rows, by, ts, F.col("_w"), "session", found)
    group = [*by, "session"]
    if found is None:
        rows = trailing_sizes(rows.drop("_stretch"), group, ts, F.col("_w"), "_what" if distinct is not None else None, 2**62)
        rows = rows.withColumn("_trigger", F.min(F.when(met(F.col("_size")), F.col(ts))).over(W.partitionBy(*group))).where(F.col(ts) >= F.col("_trigger") - F.col("_w"))
        rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy(*group).orderBy(ts, "id")))
    else:
        # Tables, so that joins may split a group among tasks and windows are computed once.
        rows = written(trailing_sizes(written(rows.withColumnRenamed("_stretch", "_piece"), "sessions"), group, ts, F.col("_w"), "_what" if distinct is not None else None, most), "sizes").withColumnRenamed("_piece", "_stretch")
        triggers = written(rows.where(met(F.col("_size"))).groupBy(*group).agg(F.min(ts).alias("_trigger")).select(*[F.col(k).alias(f"_g_{k}") for k in group], "_trigger"), "triggers")
        same = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in group])
        rows = rows.join(triggers, same).drop(*[f"_g_{k}" for k in group]).where(F.col(ts) >= F.col("_trigger") - F.col("_w"))
        rows = scans.with_carry(rows, group, F.lit(1), lambda c: F.sum(c), "_rows_before", found)
        rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy(*group, "_stretch").orderBy(ts, "id")) + F.coalesce("_rows_before", F.lit(0)))
    first = [F.col(f"_first.{c}").alias(c) for c in keep or []]
    out = rows.groupBy(*group).agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("count"), F.count_distinct("_what").alias("distinct_values"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_nth") <= refs, F.struct(ts, "id")))), lambda r: r["id"]).alias("refs"), F.min(F.struct(ts, "id", *(keep or []))).alias("_first"),
    )
    return out.select(*by, "start", "end", "count", "distinct_values", "refs", *first)


def merged_intervals(df: DataFrame, by: list[str], start: str, end: str, most: int | None = None) -> DataFrame:
    """The union of intervals of each group; a group left with more than ``most`` becomes one."""
    w = W.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).withColumn("_n", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = rows.groupBy(*by, "_n").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"))
    if most is not None:
        many = F.count(F.lit(1)).over(W.partitionBy(*by)) > most
        out = out.withColumn("_n", F.when(many, 0).otherwise(F.col("_n"))).groupBy(*by, "_n").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n"))
    return out.drop("_n")


def _with_next(df: DataFrame, by: list[str], record: str, name: str, most: int | None) -> DataFrame:
    """``df`` with the next greater or equal record number of its key."""
    found = scans.cuts(df, by, record, most)
    rows = scans.with_carry(scans.with_stretch(df, by, record, found), by, F.col(record), F.min, "_later", found, later=True)
    following = F.lead(record).over(W.partitionBy(*by, "_stretch").orderBy(record))
    return rows.withColumn(name, F.coalesce(following, F.col("_later"))).drop("_later", "_stretch")


def record_holes(df: DataFrame, by: list[str], record: str, most: int | None = None) -> DataFrame:
    """Where record numbers skip: (by, after, before, missing). A key of more than ``most`` rows is read in stretches."""
    rows = _with_next(df.where(F.col(record).isNotNull()).select(*by, record), by, record, "before", most)
    return rows.select(*by, F.col(record).alias("after"), "before").where(F.col("before") - F.col("after") > 1).withColumn("missing", F.col("before") - F.col("after") - 1)


def record_runs(df: DataFrame, by: list[str], record: str) -> DataFrame:
    """(by, from, to, n): stretches of record numbers without a gap; repeated numbers count once."""
    w = W.partitionBy(*by).orderBy(record)
    rows = df.where(F.col(record).isNotNull()).select(*by, record).distinct().withColumn("_run", F.col(record) - F.row_number().over(w))
    return rows.groupBy(*by, "_run").agg(F.min(record).alias("from"), F.max(record).alias("to"), F.count(F.lit(1)).alias("n")).drop("_run")


def backward_steps(df: DataFrame, by: list[str], record: str, ts: str, least: int = 1000, most: int | None = None) -> DataFrame:
    """Where time runs back from one record to the next: (by, record, step). A key of more than ``most`` rows is read in stretches."""
    rows = df.where(F.col(record).isNotNull()).select(*by, F.col(record).alias("record"), F.col(ts).alias("_t"))
    found = scans.cuts(rows, by, "record", most)
    here = F.struct("record", F.col("_t").alias("t"))
    rows = scans.with_carry(scans.with_stretch(rows, by, "record", found), by, here, F.max, "_before", found)
    before = F.coalesce(F.lag(here).over(W.partitionBy(*by, "_stretch").orderBy("record")), F.col("_before"))
    rows = rows.withColumn("_b", before).withColumn("step", F.col("_b.t") - F.col("_t"))
    return rows.where((F.col("step") > least) & (F.col("record") - F.col("_b.record") == 1)).select(*by, "record", "step")


def filled_forward(df: DataFrame, by: list[str], order: list[str], value: str, name: str, most: int | None = None) -> DataFrame:
    """``df`` with the last value known so far. A key of more than ``most`` rows is filled in stretches of ``order``'s first column."""
    found = scans.cuts(df, by, order[0], most)
    known = F.when(F.col(value).isNotNull(), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v")))
    rows = scans.with_carry(scans.with_stretch(df, by, order[0], found), by, known, F.max, "_known", found)
    last = F.last(value, ignorenulls=True).over(W.partitionBy(*by, "_stretch").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(last, F.col("_known.v"))).drop("_known", "_stretch")


def accrued(df: DataFrame, by: list[str], ts: str, rule: str, tactic: str, window: int = 604_800_000, rules: int = 3, tactics: int = 2, rules_alone: int = 4) -> DataFrame:
    """Rows in some window that has enough different rules and tactics, or enough rules alone."""
    wide = F.lit(window)
    rows = df.where(F.col(ts).isNotNull()).withColumn("_rule", F.col(rule)).withColumn("_tactic", F.col(tactic))
    rows = trailing_sizes(rows, by, ts, wide, "_rule").withColumnRenamed("_size", "_rules")
    rows = trailing_sizes(rows, by, ts, wide, "_tactic")
    met = ((F.col("_rules") >= rules) & (F.col("_size") >= tactics)) | (F.col("_rules") >= rules_alone)
    # The next row that meets it, carried back from later to earlier times.
    later = W.partitionBy(*by).orderBy(F.col(ts).desc()).rangeBetween(W.unboundedPreceding, 0)
    ahead = F.min(F.when(met, F.col(ts))).over(later)
    return rows.withColumn("_next", ahead).where(F.col("_next") <= F.col(ts) + window).drop("_rule", "_tactic", "_rules", "_size", "_next")


def _campaigns(window: int, least: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "id"])
        times = rows["ts"].tolist()
        failed = [i for i, ok in enumerate(rows["failed"]) if ok]
        good = [i for i, ok in enumerate(rows["succeeded"]) if ok]
        out, at = [], 0
        while at < len(failed):
            upto = at
            while upto < len(failed) and times[failed[upto]] - times[failed[at]] <= window:
                upto += 1
            if upto - at >= least:
                tenth = failed[at + least - 1]
                end = times[failed[at]] + window
                hit = next((times[g] for g in good if g > tenth and times[g] <= end), None)
                out.append((*key, times[failed[at]], times[failed[upto - 1]], upto - at, hit))
                at = upto
            else:
                at += 1
        return pd.DataFrame(out, columns=[*[f"k{i}" for i in range(len(key))], "start", "end", "failures", "success_ts"]).astype({"success_ts": "Int64"})

    return run


def auth_campaigns(df: DataFrame, by: str, failed: Column, succeeded: Column, window: int = 1_800_000, least: int = 10) -> DataFrame:
    """Runs of at least ``least`` failures within ``window`` ms of the first, taken greedily and not overlapping: (by, start, end, failures, success_ts).

    The choice of a run depends on the one before, so each session, cut where
    failures are more than a window apart and so where no run can cross, is one
    group for pandas; a busy key is split into its sessions.
    """
    rows = df.select(F.col(by), "ts", "id", V.truth(failed).alias("failed"), V.truth(succeeded).alias("succeeded")).where("(failed or succeeded) and ts is not null")
    rows = gap_sessions(rows, [by], "ts", window)
    kind = df.schema[by].dataType.simpleString()
    busy = rows.withColumn("_n", F.sum(F.col("failed").cast("int")).over(W.partitionBy(by, "session"))).where(F.col("_n") >= least).drop("_n")
    return busy.groupBy(by, "session").applyInPandas(_campaigns(window, least), f"k0 {kind}, k1 long, start long, end long, failures long, success_ts long").select(F.col("k0").alias(by), "start", "end", "failures", "success_ts")


def heaviest_run(steps: Column) -> Column:
    """The greatest weight of steps whose phases rise, one of each phase: steps is array<struct<phase, weight>> in time order, 15 phases.

    A fold over the array keeps the best total that ends in each phase. Steps without a phase are passed over.
    """
    start = F.array_repeat(F.lit(0.0), 15)
    steps = F.filter(steps, lambda s: s["phase"].isNotNull() & s["weight"].isNotNull())

    def take(best: Column, s: Column) -> Column:
        upto = F.coalesce(F.array_max(F.slice(best, F.lit(1), s["phase"])), F.lit(0.0)) + s["weight"]
        return F.transform(best, lambda b, i: F.when(i == s["phase"], F.greatest(b, upto)).otherwise(b))

    return F.array_max(F.aggregate(steps, start, take))
