"""Best-fit packing of documents into bins of bounded length, with conflicts.

Documents are dealt by hash into groups of bounded size, which are packed apart from
each other. Within a group the bins are ordered by what is left in them; each carries
a bitmap of its sources and one of its duplicate clusters. A piece takes the successor
of its length in that order, and the next one, until it meets the tightest bin that
has neither its source nor its cluster. Longer documents are cut into full bins and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, whole, written

CAPACITY = 2048
#: Rows in a packing group, on average.
ROWS_A_GROUP = 2048


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[list[tuple[int, int, int]]]:
    """For each item its pieces (bin, offset, length); items come in the order given, whole bins first.

    A source or cluster that is None is in conflict with nothing. A piece that fills
    a bin alone opens one without a search.
    """
    bits: dict = {}
    bit = lambda kind, v: 0 if v is None else 1 << bits.setdefault((kind, v), len(bits))
    order: list[tuple[int, int]] = []  # (what is left, bin), ascending: the successor of a length is the tightest fit
    left: list[int] = []
    held_sources: list[int] = []
    held_clusters: list[int] = []

    def opened(s: int, c: int) -> int:
        left.append(capacity)
        held_sources.append(s)
        held_clusters.append(c)
        return len(left) - 1

    out = []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = bit("source", source), bit("cluster", cluster)
        pieces = []
        for _ in range(length // capacity):
            b = opened(s, c)
            left[b] = 0
            pieces.append((b, 0, capacity))
        rest = length % capacity
        if rest or not pieces:
            at = bisect_left(order, (rest, -1))
            while at < len(order) and (held_sources[order[at][1]] & s or held_clusters[order[at][1]] & c):
                at += 1
            if at < len(order):
                _, b = order.pop(at)
            else:
                b = opened(0, 0)
            pieces.append((b, capacity - left[b], rest))
            held_sources[b] |= s
            held_clusters[b] |= c
            left[b] -= rest
            if left[b]:
                insort(order, (left[b], b))
        out.append(pieces)
    return out


def _pack(capacity: int):
    columns = ["row", "doc_id", "source", "cluster", "grp", "piece", "bin", "offset", "words"]

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["words", "row"], ascending=[False, True], kind="stable")
        value = lambda c: [None if pd.isna(x) else x for x in group[c]]
        sources, clusters = value("source"), value("cluster")
        found = best_fit(group["words"].tolist(), sources, clusters, capacity)
        rows = [(r, d, s, c, g, i, b, o, n) for r, d, s, c, g, pieces in zip(group["row"], group["doc_id"], sources, clusters, group["grp"], found, strict=True) for i, (b, o, n) in enumerate(pieces)]
        return pd.DataFrame(rows, columns=columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Sorted by group: a group is packed when the next one begins.
        held: list[pd.DataFrame] = []
        for frame in frames:
            cuts = np.flatnonzero(frame["grp"].to_numpy()[1:] != frame["grp"].to_numpy()[:-1]) + 1
            for part in (frame.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True)):
                if held and len(part) and held[0]["grp"].iloc[0] != part["grp"].iloc[0]:
                    yield packed(pd.concat(held))
                    held = []
                if len(part):
                    held.append(part)
        if held:
            yield packed(pd.concat(held))

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, rows_a_group: int = ROWS_A_GROUP, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, words, grp, bin, offset, source, cluster, row (a number that no other row has).

    A document's piece ``piece`` is its words from ``start`` on, put into the bin
    (``grp``, ``bin``) at ``offset``. No bin holds more than ``capacity`` words, two
    pieces of one source, or two of one duplicate cluster: the column
    ``cluster_col``, or else texts equal but for the case of A-Z. A null source
    conflicts with nothing; null and empty texts and texts without words give one
    piece of no words. Repeated rows are rows of their own, in conflict with each
    other. An empty table gives no rows; other columns are not read.
    """
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.md5(F.translate(whole(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    # Written, so that row numbers and groups are the same for every task that reads them.
    sized = written(sized, "packing")
    groups = max(1, -(-sized.count() // rows_a_group))
    # Ids only decide the group; the row number breaks ties of repeated rows and of null ids.
    grouped = sized.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "cluster", "row"), F.lit(groups)))
    id_type = sized.schema["doc_id"].dataType.simpleString()
    dealt = grouped.repartition("grp").sortWithinPartitions("grp")
    placed = dealt.select("row", "doc_id", "grp", "source", "cluster", "words").mapInPandas(_pack(capacity), f"row long, doc_id {id_type}, source string, cluster string, grp long, piece int, bin int, offset long, words long")
    return placed.select("doc_id", "piece", (F.col("piece") * F.lit(capacity)).cast("long").alias("start"), "words", "grp", "bin", "offset", "source", "cluster", "row")
