"""The driver's tables in the shapes of a case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import Case, Settings


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def millis(c) -> F.Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, user, eventType, value, data."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), millis("ts").alias("ts"), F.col("user_id").alias("user"), F.col("event_type").alias("eventType"), "value", F.col("props").alias("data"))


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages: customer as sender, order date as date, priority as flag."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), millis("o_orderdate").alias("date"), F.col("o_custkey").cast("string").alias("fromAddr"), F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("spf"), F.array("o_orderpriority").alias("flags"), F.col("o_totalprice").alias("total"))


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as attachments of their order."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mailId"), F.col("l_returnflag").alias("category"), F.col("l_quantity").alias("size"), F.col("l_linestatus").alias("ext"))


def case(spark: SparkSession, sf_dir: str, **lists: list[str]) -> Case:
    return Case({"events": events(spark, sf_dir), "mails": mails(spark, sf_dir), "attachments": attachments(spark, sf_dir)}, Settings(lists=lists))
