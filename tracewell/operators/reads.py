"""The read operators: search, count, aggregate, stack, timeline, facets, pivot, summary, indicator list."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from .filters import TIME, Context, ordering, resolve, search_filter

# Limits of results, and sizes of timeline buckets in milliseconds.
MOST_ROWS, MOST_GROUPS = 20_000, 5_000
BUCKETS = {"minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def search(df: DataFrame, ctx: Context, f: dict | None = None, limit: int = 200, offset: int = 0, sort: dict | None = None, columns: list[str] | None = None) -> DataFrame:
    """A page of matching rows; one row more than ``limit`` says that there are more."""
    found = df.where(search_filter(f, ctx)).orderBy(*ordering(sort, ctx))
    return (found.select(*columns) if columns else found).offset(offset).limit(min(limit, MOST_ROWS) + 1)


def keyset_page(df: DataFrame, after, limit: int, key: str = "id") -> DataFrame:
    """The next rows by key, without counting off those before."""
    rows = df if after is None else df.where(F.col(key) > after)
    return rows.orderBy(key).limit(limit)


def count(df: DataFrame, ctx: Context, f: dict | None = None) -> DataFrame:
    return df.where(search_filter(f, ctx)).agg(F.count(F.lit(1)).alias("n"))


def _grouped(df: DataFrame, ctx: Context, field: str) -> DataFrame:
    """``df`` with ``value``; a list gives a row for each element and none if it is empty."""
    c, kind = resolve(field, ctx)
    return df.withColumn("value", F.explode(c)) if kind == "list" else df.withColumn("value", c.cast("string"))


def aggregate(df: DataFrame, ctx: Context, field: str, f: dict | None = None, limit: int = 100) -> DataFrame:
    """(value, n, first, last), the most frequent first; null and blank are '(empty)'."""
    ts = TIME.get(ctx.source, "ts")
    rows = _grouped(df.where(search_filter(f, ctx)), ctx, field)
    value = F.coalesce(F.nullif("value", F.lit("")), F.lit("(empty)")).alias("value")
    out = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return out.orderBy(F.desc("n"), "value").limit(min(limit, MOST_GROUPS))


def totals(df: DataFrame, ctx: Context, field: str, f: dict | None = None) -> DataFrame:
    """Rows and distinct values; null isn't a distinct value."""
    rows = _grouped(df.where(search_filter(f, ctx)), ctx, field)
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("value").alias("distinct_values"))


def facets(df: DataFrame, ctx: Context, field: str, limit: int = 100) -> DataFrame:
    return aggregate(df, ctx, field, None, limit)


def short_host(c: Column) -> Column:
    """Lower-cased and without the domain; addresses stay whole."""
    low = F.lower(c)
    return F.when(low.rlike(r"^[0-9.]+$") | low.contains(":"), low).otherwise(F.split_part(low, F.lit("."), F.lit(1)))


def stack(df: DataFrame, value: Column, host: Column, ts: Column, order: str = "rare", limit: int = 500, case_sensitive: bool = False) -> DataFrame:
    """Values by how many hosts have them: value, n, hosts, host_names (if five at most), first, last.

    ``rare`` puts values of few hosts first, ``common`` those of many. Hosts are
    counted from (value, host) pairs, so a value on every host is no single task's work.
    """
    rows = df.select(F.lower(value).alias("key") if not case_sensitive else value.alias("key"), value.alias("value"), host.alias("host"), ts.alias("ts")).where("value is not null and value <> ''")
    pairs = rows.groupBy("key", "host").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    # The six least hosts of each hash slice of a value's hosts, then of the slices: no task sorts all hosts of a value.
    sliced = pairs.withColumn("_slice", F.pmod(F.xxhash64("host"), F.lit(32)))
    sliced = sliced.withColumn("nth", F.row_number().over(W.partitionBy("key", "_slice").orderBy(F.col("host").asc_nulls_last())))
    part = sliced.groupBy("key", "_slice").agg(F.min("value").alias("value"), F.sum("n").alias("n"), F.count("host").alias("hosts"), F.collect_list(F.when(F.col("nth") <= 6, F.col("host"))).alias("few"), F.min("first").alias("first"), F.max("last").alias("last"))
    out = part.groupBy("key").agg(F.min("value").alias("value"), F.sum("n").alias("n"), F.sum("hosts").alias("hosts"), F.slice(F.array_sort(F.flatten(F.collect_list("few"))), 1, 6).alias("few"), F.min("first").alias("first"), F.max("last").alias("last"))
    out = out.withColumn("host_names", F.when(F.col("hosts") <= 5, F.array_join("few", ",")))
    by = ["hosts", "n", "key"] if order == "rare" else [F.desc("hosts"), F.desc("n"), "key"]
    return out.orderBy(*by).limit(limit).select("value", "n", "hosts", "host_names", "first", "last")


# Fields whose values are stacked, and those that keep their case.
STACK_FIELDS = (
    "image", "parentImage", "processName", "parentProcessName", "commandLine", "parentCommandLine", "path", "serviceName", "serviceFile", "taskName",
    "objectName", "targetFilename", "imageLoaded", "subjectUser", "targetUser", "workstation", "ipAddress", "destinationIp", "query", "providerEventId",
)
STACK_CASED = ("commandLine", "parentCommandLine")


def stack_field(df: DataFrame, ctx: Context, field: str, order: str = "rare", limit: int = 500) -> DataFrame:
    """``stack`` of one of the fields meant for it, by short host name."""
    if field not in STACK_FIELDS:
        raise ValueError(f"{field!r} is not stacked")
    return stack(df, resolve(field, ctx)[0].cast("string"), short_host(F.col("computer")), F.col(TIME.get(ctx.source, "ts")), order, limit, field in STACK_CASED)


def pinned(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the given ids (id)."""
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def regex_sample(df: DataFrame, text: Column, pattern: str, limit: int = 20) -> DataFrame:
    """(match, n): what a pattern finds, most frequent first."""
    return df.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("match")).groupBy("match").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "match").limit(limit)


def selectors(df: DataFrame) -> DataFrame:
    """(eventId, channel, n): which records a case has, for telling what rules can apply."""
    return df.groupBy("eventId", F.lower("channel").alias("channel")).agg(F.count(F.lit(1)).alias("n"))


def compacted(df: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Each combination of values once, with how often it occurs and its least id."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"))


def nearest_first(df: DataFrame, times: DataFrame, ts: str, weighty: Column, limit: int) -> DataFrame:
    """At most ``limit`` rows: weighty ones first, then those nearest to any of the ``times`` (at), then by time and id."""
    from .joins import nearest_distance

    near = nearest_distance(df, times, ts, "away")
    return near.orderBy(V.truth(weighty).desc(), F.col("away").asc_nulls_last(), ts, "id").limit(limit)


def timeline(df: DataFrame, ctx: Context, bucket: str = "hour", f: dict | None = None) -> DataFrame:
    """(bucket, n): rows by the start of their stretch of time; an unknown size counts by the hour."""
    size = BUCKETS.get(bucket, BUCKETS["hour"])
    ts = F.col(TIME.get(ctx.source, "ts"))
    return df.where(search_filter(f, ctx) & ts.isNotNull()).groupBy((F.floor(ts / size) * size).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def pivot(df: DataFrame, ctx: Context, value: str, fields: list[str]) -> DataFrame:
    """One row for each field: in how many rows it holds the value. One pass over the table."""
    low = value.lower()
    sums = df.agg(*[F.count(F.when(V.truth(F.lower(resolve(f, ctx)[0].cast("string")).contains(low)), 1)).alias(f) for f in fields])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])).alias("x")).select("x.field", "x.n")


def top_events(df: DataFrame, ctx: Context, value: str, fields: list[str], by: str, limit: int = 12) -> DataFrame:
    """The most frequent ``by`` among the rows that hold the value in some field."""
    held = V.any_of([V.truth(F.lower(resolve(f, ctx)[0].cast("string")).contains(value.lower())) for f in fields])
    return df.where(held).groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(limit)


def summary(df: DataFrame, ctx: Context, key: str) -> DataFrame:
    ts = TIME.get(ctx.source, "ts")
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.count_distinct(key).alias("keys"))


def indicator_list(iocs: DataFrame, reputation: DataFrame | None = None, kind: str | None = None, text: str | None = None, only_bad: bool = False, order: str = "count") -> DataFrame:
    """Indicators over all evidence: kind, value, count, first, last, sources, verdict."""
    rows = iocs.where(F.col("kind") == kind) if kind else iocs
    rows = rows.where(F.lower("value").contains(text.lower())) if text else rows
    one = rows.groupBy("kind", "value").agg(F.sum("count").alias("count"), F.min("firstSeen").alias("first"), F.max("lastSeen").alias("last"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    if reputation is not None:
        one = one.join(reputation.select("kind", "value", "verdict"), ["kind", "value"], "left")
        one = one.where(F.col("verdict").isin("malicious", "suspicious")) if only_bad else one
    orders = {"count": [F.desc("count"), "value"], "value": ["value"], "first": ["first", "value"], "last": [F.desc("last"), "value"], "kind": ["kind", "value"]}
    return one.orderBy(*orders[order])


_READ_ONLY = re.compile(r"(?is)^\s*(select|with|values|from)\b")
_WRITES = re.compile(r"(?i)\b(insert|create|drop|alter|truncate|load|set|reset|cache|uncache|refresh|delete|merge|update|overwrite|add|grant|revoke)\b")


def guarded_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame], limit: int = 1000) -> DataFrame:
    """One read-only statement over the given views; a statement with a word that changes anything, outside quotes, is refused."""
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|`[^`]*`|\"(?:[^\"\\]|\\.)*\"", "''", sql)
    if not _READ_ONLY.match(bare) or ";" in bare.strip().rstrip(";"):
        raise ValueError("one read-only statement is allowed")
    if _WRITES.search(bare):
        raise ValueError("only reading is allowed")
    known = {m.lower() for m in re.findall(r"(?i)\b([a-z_]\w*)\s+as\s*\(", bare)} | {v.lower() for v in views}
    for m in re.findall(r"(?i)\b(?:from|join)\s+([a-z_][\w.]*)(?!\w*\s*\()", bare):
        if m.lower() not in known:
            raise ValueError(f"no such view: {m}")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql.strip().rstrip(";")).limit(limit)


def indicators_of(df: DataFrame, spec: dict[str, Column], ts: Column, source: str) -> DataFrame:
    """(kind, value, count, firstSeen, lastSeen, sources) from expressions by kind, each a value or a list of values."""
    parts = []
    for kind, c in spec.items():
        values = F.explode(c) if isinstance(df.select(c).schema[0].dataType, T.ArrayType) else c
        parts.append(df.select(F.lit(kind).alias("kind"), values.alias("value"), ts.alias("ts")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    out = every.where("value is not null and value <> ''").groupBy("kind", F.lower("value").alias("value")).agg(F.count(F.lit(1)).alias("count"), F.min("ts").alias("firstSeen"), F.max("ts").alias("lastSeen"))
    return out.withColumn("sources", F.array(F.lit(source)))
