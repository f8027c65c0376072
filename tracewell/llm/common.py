"""What the corpus operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, discard, shared_dir, written

#: Words as the mixing contract counts them: runs without space or \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(text: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Python in tasks gets rows in smaller batches, as texts may be long; for jobs that run within the block."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """What a task's arrays took goes back to the system, as workers live on idle beside each other."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)  # of the C library, where it has it


def bucketed(df: DataFrame, name: str, key: str, buckets: int, *partition_by: str, compression: str = "snappy") -> str:
    """The name of a table of ``df`` in the shared folder, in buckets of ``key``: joins by it move none of its rows. The caller drops it."""
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.bucketBy(buckets, key).option("compression", compression).option("path", f"{shared_dir(df.sparkSession)}/tables/{table}").saveAsTable(table)
    return table


def unbucketed(spark: SparkSession, table: str) -> None:
    """Drops a table of ``bucketed``, files included."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    delete(spark, f"{shared_dir(spark)}/tables/{table}")


#: Bits of the map that ``filtered`` sends to all tasks: for each hash 16, between 2^16 and 2^27 (a table of at most 2^21 rows).
BITS_A_HASH, LEAST_BITS, MOST_BITS = 16, 16, 27


def with_mark(df: DataFrame, hashes: DataFrame, of: Column, to: str = "_may") -> DataFrame:
    """``df`` with ``to``: false only where the 64-bit hash ``of`` is surely not among ``hashes`` (hash).

    A bitmap of bounded size goes to all tasks, so rows are told apart where they lie and
    only those marked need be shuffled. Beyond 2^27 bits' worth of hashes more and more
    rows are marked; what is decided by an exact join afterwards stays right.
    """
    n = hashes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (max(n, 1) * BITS_A_HASH - 1).bit_length()))
    cell = lambda c: F.shiftrightunsigned(c, 64 - bits)
    word, bit = lambda c: F.shiftright(cell(c), 6), lambda c: cell(c).bitwiseAND(F.lit(63)).cast("int")
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("hash")))
    words = written(hashes.select(word(F.col("hash")).alias("_word"), ones.alias("_one")).groupBy("_word").agg(F.bit_or("_one").alias("_bits")), "bitmap")
    marked = df.withColumn("_hash", of).withColumn("_cell", word(F.col("_hash"))).join(F.broadcast(words), F.col("_cell") == F.col("_word"), "left")
    seen = F.call_function("shiftright", F.col("_bits"), bit(F.col("_hash"))).bitwiseAND(F.lit(1)) == 1
    return marked.withColumn(to, F.coalesce(seen, F.lit(False))).drop("_hash", "_cell", "_word", "_bits")


def filtered(df: DataFrame, hashes: DataFrame, of: Column) -> DataFrame:
    """The rows of ``df`` whose hash may be among ``hashes``."""
    return with_mark(df, hashes, of, "_may").where("_may").drop("_may")


__all__ = ["WORD", "bucketed", "delete", "discard", "filtered", "give_back", "read", "shared_dir", "small_batches", "unbucketed", "whole", "with_mark", "written"]
