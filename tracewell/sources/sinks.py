"""Writing into a case and out of it: dedupe, child tables, indicators, exports."""

from __future__ import annotations

import json
import uuid
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import web


def first_of_key(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """One row for each key, the first in order; rows without a key all stay.

    The least (order) of a key is aggregated before the shuffle and joined back, so
    a key that very many rows share isn't sorted in one task.
    """
    rows = df.withColumn("_key", key).withColumn("_order", F.struct(*order))
    least = rows.where(F.col("_key").isNotNull()).groupBy(F.col("_key").alias("_k")).agg(F.min("_order").alias("_least"))
    return rows.join(least, F.col("_key") == F.col("_k"), "left").where(F.col("_key").isNull() | (F.col("_order") == F.col("_least"))).drop("_key", "_k", "_order", "_least")


def not_stored(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't stored yet; rows without a key always."""
    return df.join(stored.select(F.col(key).alias("_stored")), F.col(key) == F.col("_stored"), "left_anti")


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def numbered(df: DataFrame, start: int, *order: str) -> DataFrame:
    """``df`` with dense ids from ``start`` on, in order: ranges are numbered apart and shifted by what lies before."""
    from ..session import written

    placed = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_place", place).join(before.drop("n"), "_part").withColumn("id", F.lit(start) + F.col("_before") + F.col("_place") - 1).drop("_part", "_place", "_before")


def split_mails(rows: DataFrame) -> dict[str, DataFrame]:
    """Nested mail rows (attachments, urls and body inside) as mails, mail_bodies, attachments and urls."""
    parent = {"date": F.col("date"), "fromAddr": F.col("fromAddr"), "mailSubject": F.col("subject")}
    child = lambda c: rows.select(F.col("id").alias("mailId"), *[v.alias(k) for k, v in parent.items()], F.posexplode(c).alias("pos", "x")).select("mailId", "pos", *parent, "x.*")
    bodies = [c for c in ("bodyText", "bodyHtml", "headersText", "visibleText") if c in rows.columns]
    return {"mails": rows.drop("attachments", "urls", *bodies), "mail_bodies": rows.select(F.col("id").alias("mailId"), *bodies), "attachments": child("attachments"), "urls": child("urls")}


def nested_mails(mails: DataFrame, attachments: DataFrame, urls: DataFrame) -> DataFrame:
    """The way back: children as arrays inside their mail, in order."""
    for name, child in (("attachments", attachments), ("urls", urls)):
        own = child.groupBy("mailId").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in child.columns if c not in ("mailId", "pos")]))).alias(name))
        mails = mails.join(own.withColumnRenamed("mailId", "_mail"), F.col("id") == F.col("_mail"), "left").drop("_mail")
    return mails


def merged_indicators(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Indicators of two loads as one table: counts added, times widened, sources united."""
    both = stored.unionByName(new)
    return both.groupBy("kind", "value", "evidenceId").agg(F.sum("count").alias("count"), F.min("firstSeen").alias("firstSeen"), F.max("lastSeen").alias("lastSeen"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"))


def replaced(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows with those of a new load in their place."""
    return stored.join(new.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti").unionByName(new, allowMissingColumns=True)


def without_evidence(tables: dict[str, DataFrame], evidence: str) -> dict[str, DataFrame]:
    return {n: df.where(~F.col("evidenceId").eqNullSafe(evidence)) if "evidenceId" in df.columns else df for n, df in tables.items()}


def enriched(df: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``df`` with columns overwritten by ``facts`` where it has a row for the key."""
    over = [c for c in facts.columns if c != key]
    joined = df.join(facts.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in over]), F.col(key) == F.col("_k"), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in over else F.col(c) for c in df.columns], *[F.col(f"_new_{c}").alias(c) for c in over if c not in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose cells a spreadsheet won't run."""
    df.select(*[web.csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c).cast("string").alias(c) for c, t in df.dtypes]).write.option("header", True).csv(path)


def write_ndjson(df: DataFrame, path: str, kind: str | None = None) -> None:
    (df.withColumn("type", F.lit(kind)) if kind else df).write.json(path)


# Fixed value: the name space of deterministic STIX identifiers.
STIX = uuid.UUID("00abedb4-aa42-466c-9c01-fed23315a9b7")
_STIX = {"ip": ("ipv4-addr", "value"), "domain": ("domain-name", "value"), "url": ("url", "value"), "email": ("email-addr", "value"), "hash": ("file", "hashes")}


@F.pandas_udf(T.StringType())
def _stix(kind: pd.Series, value: pd.Series) -> pd.Series:
    def one(k: str, v: str) -> str | None:
        if k not in _STIX:
            return None
        name, field = _STIX[k]
        body = {field: v if field == "value" else {{32: "MD5", 40: "SHA-1", 64: "SHA-256"}.get(len(v), "SHA-256"): v}}
        return json.dumps({"type": name, "spec_version": "2.1", "id": f"{name}--{uuid.uuid5(STIX, json.dumps(body, sort_keys=True, separators=(',', ':')))}", **body}, sort_keys=True)

    return pd.Series([one(k, v) for k, v in zip(kind, value, strict=True)])


def stix_objects(iocs: DataFrame) -> DataFrame:
    """A STIX object for each indicator, as JSON; equal indicators have equal ids."""
    return iocs.select(_stix("kind", "value").alias("object")).where("object is not null")


def timeline_records(findings: DataFrame, events: DataFrame, label: Column) -> DataFrame:
    """Findings and the events that they name as (datetime, timestamp_desc, message, tag, ref) in time order."""
    named = findings.select(F.explode("refs").alias("_ref"), "ruleId").distinct()
    rows = events.join(named, F.col("id") == F.col("_ref")).groupBy("id", "ts").agg(F.array_sort(F.collect_set("ruleId")).alias("tag"), F.first(label).alias("message"))
    iso = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    a = findings.select(iso(F.col("ts")).alias("datetime"), F.lit("finding").alias("timestamp_desc"), F.col("title").alias("message"), F.array("severity").alias("tag"), F.col("key").alias("ref"))
    b = rows.select(iso(F.col("ts")).alias("datetime"), F.lit("event").alias("timestamp_desc"), "message", "tag", F.col("id").cast("string").alias("ref"))
    return a.unionByName(b).orderBy("datetime", "timestamp_desc", "ref")


def suffix(name: str) -> str:
    return PurePosixPath(name.lower()).suffix.lstrip(".")
