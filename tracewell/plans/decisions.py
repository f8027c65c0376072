"""An analyst's decisions on stories, replayed on every build: records taken out, stories merged and split.

A decision doesn't name a story but its anchor, the values that the story was about, so
it finds the story again after a rebuild or an import that names stories anew: the one that
shares most of them. What the log says last of a story counts, whatever order its rows are read in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph


def _fit(wanted: DataFrame, anchors: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, story): of each row of ``wanted`` (key, and ``value``, an array) the story that shares most of its values, of equals the least."""
    parts = wanted.select(*key, F.explode(F.array_distinct(value)).alias("anchor"))
    shared = parts.join(anchors.select("story", "anchor").distinct(), "anchor").groupBy(*key, "story").agg(F.count(F.lit(1)).alias("_c"))
    return shared.groupBy(*key).agg(F.min(F.struct(-F.col("_c"), F.col("story")))["story"].alias("story"))


def resolved(log: DataFrame, anchors: DataFrame) -> DataFrame:
    """``log`` with the story of each decision, null for one that no story fits any more."""
    return log.join(_fit(log, anchors, ["n"], "anchor"), "n", "left")


def replayed(steps: DataFrame, anchors: DataFrame, log: DataFrame) -> DataFrame:
    """(story, part, step, ts, refs): the steps of the stories as the decisions leave them; part is 1 from where a story is split.

    ``steps`` have story, step, ts and refs; ``anchors`` story and anchor; ``log`` n (its number), at, kind, anchor, and
    for ``out`` the refs taken out, for ``merge`` the other story's anchor (into), for ``split`` the ref of the step that
    begins the second part. All that is taken out stays out; of merges and splits of a story the last counts (by at, then n). Merges are
    followed to their end; those that go round merge nothing, nor does what leads there. A story keeps the first of steps of one name. A
    split at the first step, or at a record that the story doesn't hold, splits nothing.
    """
    known = resolved(log, anchors).where("story is not null")
    last = W.partitionBy("story", "kind").orderBy(F.desc("at"), F.desc("n"))
    calls = known.where("kind <> 'out'").withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")

    gone = known.where("kind = 'out'").select("story", F.explode("refs").alias("_ref")).distinct()
    held = steps.select("story", "step", "ts", F.explode_outer("refs").alias("_ref")).withColumn("_had", F.col("_ref").isNotNull())
    held = held.join(gone, ["story", "_ref"], "left_anti")
    # A step all of whose records are taken out goes with them; one that never had any stays.
    left = held.groupBy("story", "step", "ts").agg(F.array_sort(F.collect_set("_ref")).alias("refs"))

    merges = calls.where("kind = 'merge'")
    # The story that is merged is no target of its own.
    others = merges.select("n", "story", F.explode(F.array_distinct("into")).alias("anchor")).join(anchors.select(F.col("story").alias("_to"), "anchor").distinct(), "anchor").where("story <> _to")
    targets = others.groupBy("n", "story", "_to").agg(F.count(F.lit(1)).alias("_c")).groupBy("n", "story").agg(F.min(F.struct(-F.col("_c"), F.col("_to")))["_to"].alias("into"))
    names = steps.select("story").distinct().join(targets.select("story", "into"), "story", "left")
    roots = graph.trees(names, "story", "into").select("story", F.coalesce("root", "story").alias("_root"))

    merged = left.join(roots, "story").withColumn("_first", F.row_number().over(W.partitionBy("_root", "step").orderBy((F.col("story") != F.col("_root")).cast("int"), "story"))).where("_first = 1")
    merged = merged.select(F.col("_root").alias("story"), "step", "ts", "refs")

    splits = calls.where("kind = 'split'").select("story", F.col("ref").alias("_ref"))
    at = merged.join(splits, "story").where(F.array_contains("refs", F.col("_ref"))).groupBy("story").agg(F.min(F.struct("ts", "step")).alias("_at"))
    place = F.struct("ts", "step")
    whole = merged.join(at, "story", "left").withColumn("_begins", F.min(place).over(W.partitionBy("story")))
    part = F.when((F.col("_at") > F.col("_begins")) & (place >= F.col("_at")), 1).otherwise(0)
    return whole.select("story", part.alias("part"), "step", "ts", "refs")
