"""Sharding by a Feistel permutation, with cycle walking, of global row numbers.

Row numbers come from the rows alone: a bucket by hash, the row's place in its bucket
by id, and the rows in the buckets before. The permutation of 0..n-1 puts each row at a
position; the position's remainder by the number of shards is the shard and its
quotient the slot, so counts are at most one apart and slots have no gaps. Anyone who
has n and the seed computes shard and slot of a row number, and back, without the data.
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import whole, written

#: Modulus of the round function; products of two residues stay within a long.
PRIME = 2**31 - 1
ROUNDS = 6
ROWS_A_BUCKET, MOST_BUCKETS = 4096, 65_536


class Feistel:
    """A permutation of 0..n-1: an alternating Feistel network on a x b >= n cells, walked until it is below n."""

    def __init__(self, n: int, seed: int = 0):
        self.n = n
        self.a = isqrt(max(n, 1) - 1) + 1
        self.b = max(1, -(-n // self.a))
        digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).digest()
        self.keys = [tuple(int.from_bytes(digest(i)[j : j + 4]) % (PRIME - 1) + 1 for j in (0, 4, 8)) for i in range(ROUNDS)]
        self.walks = 0  # the most steps any cell from n on needs to come below n; there are fewer than a of them
        for cell in range(n, self.a * self.b) if n else ():
            steps = 0
            while cell >= n:
                cell, steps = self._once(cell), steps + 1
            self.walks = max(self.walks, steps)

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        sizes = (self.a, self.b)
        for i, (c, k, m) in enumerate(self.keys):
            t = (right * c + k) % PRIME
            left, right = right, (left + (t * t + m) % PRIME) % sizes[i % 2]
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        sizes = (self.a, self.b)
        for i, (c, k, m) in reversed(list(enumerate(self.keys))):
            t = (left * c + k) % PRIME
            left, right = (right - (t * t + m) % PRIME) % sizes[i % 2], left
        return left * self.b + right

    def __call__(self, row: int) -> int:
        row = self._once(row)
        while row >= self.n:
            row = self._once(row)
        return row

    def inverse(self, position: int) -> int:
        position = self._back(position)
        while position >= self.n:
            position = self._back(position)
        return position

    def column(self, df: DataFrame, of: str, to: str) -> DataFrame:
        """``df`` with ``to``, the position of row number ``of``, in native expressions."""

        def half(name: str) -> Column:
            return F.col(name)

        df = df.withColumn("_x", F.col(of).cast("long"))
        for walk in range(self.walks + 1):
            # Once is for all rows; further walks move only those still outside.
            df = df.withColumn("_left", F.expr(f"_x div {self.b}")).withColumn("_right", F.col("_x") % self.b)
            for i, (c, k, m) in enumerate(self.keys):
                t = (half("_right") * F.lit(c).cast("long") + F.lit(k)) % F.lit(PRIME)
                df = df.withColumn("_t", t).withColumn("_next", (F.col("_left") + (F.col("_t") * F.col("_t") + F.lit(m)) % F.lit(PRIME)) % F.lit((self.a, self.b)[i % 2]))
                df = df.withColumn("_left", F.col("_right")).withColumn("_right", F.col("_next"))
            moved = F.col("_left") * self.b + F.col("_right")
            df = df.withColumn("_x", moved if walk == 0 else F.when(F.col("_x") >= self.n, moved).otherwise(F.col("_x")))
        return df.withColumn(to, F.col("_x")).drop("_x", "_left", "_right", "_t", "_next")


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number, from n, the number of shards and the seed alone."""
    position = Feistel(n, seed)(row)
    return position % shards, position // shards


def shard(docs: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, row_number, shard, slot.

    The law is ``rows``. Null texts are empty (size 16, CRC 0); null ids come first.
    Rows equal in id, CRC and size are told apart in no way and take neighbouring
    row numbers. The result doesn't depend on files, partitions or run. An empty
    table gives no rows; other columns are not read.
    """
    n = docs.count()
    buckets = min(MOST_BUCKETS, max(64, -(-n // ROWS_A_BUCKET)))
    text = whole(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = written(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int")), "sharded")
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # one row a bucket
    place = F.row_number().over(W.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("place", place).join(offsets, "bucket").withColumn("row_number", F.col("offset") + F.col("place") - 1)
    moved = Feistel(n, seed).column(numbered, "row_number", "position")
    return moved.select("doc_id", "size", "text_crc32", "row_number", (F.col("position") % shards).cast("int").alias("shard"), F.expr(f"position div {shards}").alias("slot"))
