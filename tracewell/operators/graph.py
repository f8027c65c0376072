"""Edges from rows, connected components, and cuts of trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard, written


def node_id(kind: str, *parts: Column) -> Column:
    """A node's name from what identifies it."""
    return F.concat(F.lit(kind + ":"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(kind), *[F.lower(p.cast("string")) for p in parts]), 256), 1, 24))


def edges(df: DataFrame, spec: list[tuple[str, Column, Column]], ts: Column, ref: Column, refs: int = 30) -> DataFrame:
    """(relation, a, b, count, first, last, refs): an edge for each relation whose ends are both known, the first references kept."""
    made = F.explode(F.array(*[F.struct(F.lit(r).alias("relation"), a.cast("string").alias("a"), b.cast("string").alias("b")) for r, a, b in spec])).alias("e")
    rows = df.select(ts.alias("ts"), ref.alias("ref"), made).where("e.a is not null and e.b is not null and e.a <> '' and e.b <> ''").select("e.*", "ts", "ref").distinct()
    # The first few of each edge: least of each hash slice first, so that a busy edge's list is never gathered whole.
    sliced = rows.withColumn("_s", F.pmod(F.xxhash64("ref"), F.lit(64))).withColumn("_nth", F.row_number().over(W.partitionBy("relation", "a", "b", "_s").orderBy("ts", "ref")))
    sliced = sliced.groupBy("relation", "a", "b", "_s").agg(F.count(F.lit(1)).alias("count"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.collect_list(F.when(F.col("_nth") <= refs, F.struct("ts", "ref"))).alias("r"))
    out = sliced.groupBy("relation", "a", "b").agg(F.sum("count").alias("count"), F.min("first").alias("first"), F.max("last").alias("last"), F.slice(F.array_sort(F.flatten(F.collect_list("r"))), 1, refs).alias("r"))
    return out.select("relation", "a", "b", "count", "first", "last", F.transform("r", lambda x: x["ref"]).alias("refs"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of ``edges`` (a, b) that has a neighbour: the root is the least id of the component.

    Each round every vertex picks the neighbour with the least hash, another hash each
    round, and moves to its pick's pick; two that picked each other move to the lesser
    of them. No vertex stays alone, so at least half of them are gone after a round and mostly two
    thirds, whatever the shape: a path of n takes about log(n) rounds, a star two.
    The moves of all rounds are put together backwards at the end, when their number
    has become small. Tables are written each round, so joins read plain tables and a
    vertex with many edges can be split among tasks, and are deleted once they have
    been used; nothing but an emptiness test comes to the driver.
    """
    lesser = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    edges = written(edges.where("a <> b").select(*lesser(F.col("a"), F.col("b"))).distinct(), "edges")
    rounds = []
    while not rounds or not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        picks = written(both.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit(len(rounds)), "b").alias("h"), "b"))["b"].alias("b")), "picks")
        of_picks = picks.select(F.col("a").alias("p"), F.col("b").alias("next"))
        to = F.when(F.col("next") == F.col("a"), F.least("a", "b")).otherwise(F.col("next"))
        moved = written(picks.join(of_picks, F.col("b") == F.col("p")).select(F.col("a").alias("was"), to.alias("now")), "moved")
        over = edges.join(moved, F.col("a") == F.col("was")).select(F.col("now").alias("a"), "b")
        over = over.join(moved, F.col("b") == F.col("was")).select(*lesser(F.col("a"), F.col("now"))).where("a <> b").distinct()
        last, edges = edges, written(over, "edges")
        discard(last, picks)
        rounds.append(moved)
    at = rounds.pop()
    while rounds:
        moved = rounds.pop()
        later = at.select(F.col("was").alias("_was"), F.col("now").alias("_now"))
        last, at = at, written(moved.join(later, F.col("now") == F.col("_was"), "left").select("was", F.coalesce("_now", "now").alias("now")), "moved")
        discard(last, moved)
    # What a component is called so far is any of its ids.
    least = written(at.groupBy(F.col("now").alias("_now")).agg(F.min("was").alias("_was"), F.min("now").alias("_own")).select("_now", F.least("_was", "_own").alias("root")), "roots")
    named = written(at.join(least, F.col("now") == F.col("_now")).select(F.col("was").alias("id"), "root"), "components")
    discard(at, least, edges)
    return named


def ancestors(df: DataFrame, key: str, parent: str, depth: int = 6) -> DataFrame:
    """(key, ancestor, level): parents up to ``depth`` levels, without going round."""
    link = df.select(F.col(key).alias("_k"), F.col(parent).alias("_p")).where("_p is not null").distinct()
    found = link.select(F.col("_k").alias(key), F.col("_p").alias("ancestor"), F.lit(1).alias("level"), F.array("_k", "_p").alias("path"))
    every, last = found, found
    for level in range(2, depth + 1):
        last = written(last, "ancestors")  # each level is computed once
        last = last.join(link, F.col("ancestor") == F.col("_k")).where(~F.array_contains("path", F.col("_p"))).select(key, F.col("_p").alias("ancestor"), F.lit(level).alias("level"), F.array_append("path", F.col("_p")).alias("path"))
        every = every.unionByName(last)
    return every.drop("path")


def trees(df: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, root, depth) of every row of a forest: the ancestor without a parent among the keys, and how many steps it is away.

    Pointers are doubled: each round a row that hasn't reached its root takes over where its
    pointer points to, so a tree of depth d takes about log2(d) rounds. What lies on or below a
    circle never reaches a root: it has neither root nor depth. Keys are distinct; a row whose parent is itself is a root.
    """
    rows = df.select(F.col(key).alias("id"), F.col(parent).alias("p")).where("id is not null")
    known = rows.select(F.col("id").alias("_id"))
    start = rows.join(known, F.col("p") == F.col("_id"), "left").select("id", F.when(F.col("_id") == F.col("id"), None).otherwise(F.col("_id")).alias("up"))
    # up is null once the row stands for itself: at first the roots. done says that ``at`` is a root.
    state = written(start.select("id", F.coalesce("up", "id").alias("at"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("up").isNull().alias("done")), "trees")
    left = most = state.where("not done").count()
    reach = 1
    while left and reach <= 2 * most:  # a row that is open after so many rounds is below a circle, as every path is shorter
        of = state.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        moved = state.where("not done").join(of, F.col("at") == F.col("_id")).select("id", F.col("_at").alias("at"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        last, state = state, written(state.where("done").unionByName(moved), "trees")
        discard(last)
        left, reach = state.where("not done").count(), reach * 2
    return state.select(F.col("id").alias(key), F.when(F.col("done"), F.col("at")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))
