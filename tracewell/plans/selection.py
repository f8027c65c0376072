"""What of a case is read around its flags: windows of time, keys, and the rows nearest to a flag.

Flags are rows that findings are about. Their times, widened and merged, are windows;
the accounts, hosts and outside addresses that they name are keys. A row is selected if it
lies in a window and has a key: a band join with the windows, a semi join with the keys.
Of more rows than are wanted the weighty ones go first, then those nearest to a flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import joins, sequences

HOUR = 3_600_000
# How far a flag's window reaches back and ahead, from how many windows on they are one, and how many keys of each kind are read by.
BEFORE, AFTER, MOST_WINDOWS = 24 * HOUR, 72 * HOUR, 40
MOST_KEYS = {"names": 2_000, "hosts": 500, "addresses": 500}


def windows(flags: DataFrame, ts: str = "ts", before: int = BEFORE, after: int = AFTER, most: int | None = MOST_WINDOWS) -> DataFrame:
    """(start, end): the flags' times widened and merged; more than ``most`` become one. Times of null or 0 have no window."""
    # Flags of one stretch as long as a window share one anyway.
    stretch = F.floor(F.col(ts) / max(1, before + after))
    some = flags.where(F.col(ts).isNotNull() & (F.col(ts) != 0)).groupBy(stretch.alias("_h")).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    spans = some.select(F.lit(0).alias("_k"), (F.col("_a") - before).alias("start"), (F.col("_b") + after).alias("end"))
    return sequences.merged_intervals(spans, ["_k"], "start", "end", most).select("start", "end")


def keys(flags: DataFrame, forms: dict[str, Column], most: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kind, key) that most flags name, and (kind, cut) whether a kind has more keys than it may.

    ``forms`` gives for each kind the array of a flag's keys; a flag counts a key as often as it names it. Of equally frequent keys the least go first.
    """
    most = MOST_KEYS | (most or {})
    named = None
    for kind, values in forms.items():
        own = flags.select(F.lit(kind).alias("kind"), F.explode(values).alias("key")).where("key <> ''")
        named = own if named is None else named.unionByName(own)
    counts = named.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    limit = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])[F.col("kind")]
    # The first of each slice first, so that no kind's keys are all sorted in one task.
    placed = counts.withColumn("_slice", F.pmod(F.xxhash64("key"), F.lit(32)))
    for by in (["kind", "_slice"], ["kind"]):
        placed = placed.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "key"))).where(F.col("_place") <= limit)
    cut = counts.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", (F.col("n") > limit).alias("cut"))
    return placed.select("kind", "key"), cut


def in_windows(df: DataFrame, spans: DataFrame, ts: str = "ts") -> DataFrame:
    """``df`` within windows that don't overlap: each row meets the last window that begins before it."""
    # Windows are few by their cap; Spark checks their size before it broadcasts them.
    ranged = spans.select(F.col("start").alias("_start"), F.col("end").alias("_end"))
    return df.join(ranged, F.col(ts).between(F.col("_start"), F.col("_end")), "left_semi")


def selected(df: DataFrame, flags: DataFrame, chosen: DataFrame, forms: dict[str, Column], weighty: Column, most: int, ts: str = "ts", before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """(id, kind, away): rows of ``df`` in the flags' windows that have a key, at most ``most`` of each kind.

    Weighty rows go first, then those nearest to a flag's time (``away`` ms), then by time and id. Only the first of
    each slice are sorted together.
    """
    inside = in_windows(df, windows(flags, ts, before, after), ts)
    named = None
    for kind, values in forms.items():
        own = inside.select("id", F.col(ts).alias("ts"), V.truth(weighty).alias("weighty"), F.lit(kind).alias("kind"), F.explode(F.array_distinct(values)).alias("key"))
        named = own if named is None else named.unionByName(own)
    hits = named.join(chosen, ["kind", "key"], "left_semi").select("id", "ts", "weighty", "kind").distinct()
    near = joins.nearest_distance(hits, flags.where(F.col(ts) != 0).select(F.col(ts).alias("at")), "ts", "away", max(1, before + after))
    placed = near.withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(64)))
    for by in (["kind", "_slice"], ["kind"]):
        placed = placed.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("weighty"), F.col("away").asc_nulls_last(), "ts", "id"))).where(F.col("_place") <= most)
    return placed.select("id", "kind", "away")
