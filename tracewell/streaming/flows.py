"""Structured Streaming: timelines, record-key dedupe, bursts and follow-ups over event time.

Every flow takes a stream of case events (``ts`` in milliseconds) and gives a stream.
Late rows are dropped beyond the watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..schema import struct


def events(spark: SparkSession, path: str, schema: str | None = None, files_a_trigger: int = 100) -> DataFrame:
    """New event files of a folder."""
    return spark.readStream.schema(schema or struct("events")).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def timed(df: DataFrame, late: str, ts: str = "ts") -> DataFrame:
    return df.withColumn("at", F.timestamp_millis(ts)).withWatermark("at", late)


def timeline(df: DataFrame, bucket: str = "1 hour", late: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """(bucket, by, n) of tumbling windows."""
    return timed(df, late).groupBy(F.window("at", bucket), *(by or [])).agg(F.count(F.lit(1)).alias("n")).select(F.unix_millis("window.start").alias("bucket"), *(by or []), "n")


def deduplicated(df: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return timed(df, late).dropDuplicatesWithinWatermark([key]).drop("at")


def sessions(df: DataFrame, by: list[str], gap: str, test: Column, least: int, late: str = "10 minutes") -> DataFrame:
    """(by, start, end, n): sessions of matching rows no more than ``gap`` apart that have at least ``least`` rows."""
    rows = timed(df.where(V.truth(test)), late)
    out = rows.groupBy(F.session_window("at", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return out.where(F.col("n") >= least).select(*by, "start", "end", "n")


def sliding_counts(df: DataFrame, by: list[str], width: str, step: str, least: int, late: str = "10 minutes", distinct: str | None = None) -> DataFrame:
    """(by, start, n) of sliding windows that reach a count, or an approximate count of different values."""
    size = F.approx_count_distinct(distinct) if distinct else F.count(F.lit(1))
    out = timed(df, late).groupBy(F.window("at", width, step).alias("w"), *by).agg(size.alias("n"))
    return out.where(F.col("n") >= least).select(*by, F.unix_millis("w.start").alias("start"), "n")


def followed(first: DataFrame, then: DataFrame, on: list[str], within: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of a row and a later one with the same keys no more than ``within`` after it."""
    a = timed(first, late).select(*on, F.col("id").alias("first_id"), F.col("at").alias("first_at"))
    b = timed(then, late).select(*[F.col(k).alias(f"_k_{k}") for k in on], F.col("id").alias("then_id"), F.col("at").alias("then_at"))
    test = F.expr(f"then_at >= first_at AND then_at <= first_at + INTERVAL {within}")
    for k in on:
        test = test & (F.col(k) == F.col(f"_k_{k}"))
    return a.join(b, test).select(*on, "first_id", "then_id", F.unix_millis("first_at").alias("first_ts"), F.unix_millis("then_at").alias("then_ts"))


def rules_each_batch(df: DataFrame, rules: list[dict], case, sink: str, checkpoint: str):
    """Runs rules over each batch together with what the case has, and writes findings by key."""
    from ..plans.rules import run_rules
    from ..schema import Case

    def run(batch: DataFrame, number: int) -> None:
        own = Case({**case.tables, "events": case["events"].unionByName(batch, allowMissingColumns=True)}, case.settings)
        run_rules(rules, own).withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
