"""What becomes of findings: incidents, priorities, folds, evidence gaps, review state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators.joins import band

HOUR, DAY = 3_600_000, 86_400_000
# Points by severity and confidence.
POINTS = {"critical": 100.0, "high": 60.0, "medium": 30.0, "low": 10.0, "info": 2.0}
CONFIDENCE = {"high": 1.0, "medium": 0.7, "low": 0.4}


def primary_entity(entities: Column) -> Column:
    """Who or what a finding is about: user before host before address."""
    first = lambda *names: F.coalesce(*[F.nullif(F.lower(entities[n]), F.lit("")) for n in names])
    return F.coalesce(F.concat(F.lit("user:"), first("targetUser", "subjectUser", "upn", "user")), F.concat(F.lit("host:"), first("computer")), F.concat(F.lit("ip:"), first("ipAddress", "originIp")), F.lit("none:"))


def incidents(findings: DataFrame, gap: int = 6 * HOUR) -> DataFrame:
    """(entity, incident, start, end, n, severity, lead, keys): findings of one entity no more than ``gap`` after the latest end before."""
    rows = findings.withColumn("entity", primary_entity(F.col("entities"))).withColumn("until", F.coalesce("tsEnd", "ts"))
    w = W.partitionBy("entity").orderBy(F.col("ts"), "key")
    reach = F.max("until").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(reach.isNull() | (F.col("ts") - reach > gap), 1).otherwise(0)).withColumn("incident", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    rank = V.severity_rank(F.col("severity"))
    return rows.groupBy("entity", "incident").agg(
        F.min("ts").alias("start"), F.max("until").alias("end"), F.count(F.lit(1)).alias("n"), F.element_at(F.array(*[F.lit(s) for s in V.SEVERITIES]), F.max(rank) + 1).alias("severity"),
        F.min(F.struct(-rank, F.col("ts"), F.col("key")))["key"].alias("lead"), F.array_sort(F.collect_set("key")).alias("keys"),
    )


def corroboration(findings: DataFrame, within: int = DAY) -> DataFrame:
    """(key, rules): how many other rules have a finding on the same entity within a day before or after.

    Findings are first cut to one a rule, entity and hour, so a rule that fires all
    the time brings an entity a bounded number of rows.
    """
    rows = findings.select("key", "ruleId", "ts", primary_entity(F.col("entities")).alias("entity")).where("ts is not null and entity <> 'none:'")
    others = rows.groupBy("entity", "ruleId", F.expr(f"ts div {HOUR}").alias("_h")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    each = others.select("entity", "ruleId", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("ts"))
    pairs = band(rows, each, ["entity"], "ts", "ts", within, within).where(F.col("ruleId") != F.col("r_ruleId"))
    return pairs.groupBy("key").agg(F.count_distinct("r_ruleId").alias("rules"))


def priorities(findings: DataFrame, precision: DataFrame | None = None) -> DataFrame:
    """``findings`` with priority: severity by confidence by the rule's precision, less the more findings the rule has, more with corroboration."""
    n = findings.groupBy("ruleId").agg(F.count(F.lit(1)).alias("_n"))
    points = F.coalesce(F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv])[F.col("severity")], F.lit(2.0))
    trust = F.coalesce(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[F.col("confidence")], F.lit(0.7)) if "confidence" in findings.columns else F.lit(0.7)
    rows = findings.join(n, "ruleId").join(corroboration(findings), "key", "left")
    rows = rows.join(precision.select("ruleId", "precision"), "ruleId", "left") if precision is not None else rows.withColumn("precision", F.lit(None).cast("double"))
    score = points * trust * F.coalesce("precision", F.lit(1.0)) / (1 + F.log(F.col("_n").cast("double"))) * (1 + 0.15 * F.least(F.coalesce("rules", F.lit(0)), F.lit(4)))
    return rows.withColumn("priority", F.round(score, 1)).drop("_n", "rules", "precision")


def fold_below(findings: DataFrame, floor: str, host: str = "computer") -> DataFrame:
    """Findings below a severity as one row a rule and host: (ruleId, host, n, first, last)."""
    low = findings.where(V.severity_rank(F.col("severity")) < V.SEVERITIES.index(floor))
    return low.groupBy("ruleId", F.coalesce(F.lower(F.col("entities")[host]), F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def widespread(findings: DataFrame, host: str = "computer", least: int = 3) -> DataFrame:
    """Rules with findings on at least half of the hosts, where there are three or more: (ruleId, hosts, of)."""
    rows = findings.select("ruleId", F.lower(F.col("entities")[host]).alias("host")).where("host is not null").distinct()
    hosts = rows.agg(F.count_distinct("host").alias("of"))  # one row
    return rows.groupBy("ruleId").agg(F.count(F.lit(1)).alias("hosts")).join(F.broadcast(hosts)).where((F.col("of") >= least) & (F.col("hosts") * 2 >= F.col("of")))


def floors(findings: DataFrame, by_rule: DataFrame) -> DataFrame:
    """``findings`` with severities raised to their rule's floor."""
    names = F.array(*[F.lit(s) for s in V.SEVERITIES])
    rows = findings.join(by_rule.select("ruleId", F.col("floor")), "ruleId", "left")
    raised = F.element_at(names, F.greatest(V.severity_rank(F.col("severity")), F.coalesce(V.severity_rank(F.col("floor")), F.lit(0))) + 1)
    return rows.withColumn("severity", raised).drop("floor")


def with_reviews(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """New findings with the status and note that findings of the same key had."""
    return findings.join(reviews.select("key", "status", "note"), "key", "left").withColumn("status", F.coalesce("status", F.lit("open")))


def decision_signature(entities: Column) -> Column:
    """Entities in one order, as a text that equal sets share."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(entities)), lambda e: F.concat(e["key"], F.lit("="), F.lower(e["value"]))), "|")


def trusted_senders(mails: DataFrame, sender: str, risk: str, ts: str, least: int = 5) -> DataFrame:
    """Senders of several messages on different days, none risky: (sender, n, days)."""
    rows = mails.groupBy(F.lower(sender).alias("sender")).agg(F.count(F.lit(1)).alias("n"), F.max(risk).alias("worst"), F.count_distinct(F.expr(f"{ts} div {DAY}")).alias("days"))
    return rows.where((F.col("n") >= least) & (F.col("worst") < 20) & (F.col("days") > 1)).select("sender", "n", "days")


def marks_summary(marks: DataFrame) -> DataFrame:
    return marks.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tag").alias("tags"))


def navigator(findings: DataFrame, attack: str = "attack") -> DataFrame:
    """(technique, severity, n, rules) for a technique matrix: an id by its pattern, the worst severity of its findings."""
    rows = findings.select("ruleId", V.severity_rank(F.col("severity")).alias("rank"), F.explode(attack).alias("technique")).withColumn("technique", F.regexp_extract("technique", r"(T\d{4}(?:\.\d{3})?)", 1)).where("technique <> ''")
    return rows.groupBy("technique").agg(F.element_at(F.array(*[F.lit(s) for s in V.SEVERITIES]), F.max("rank") + 1).alias("severity"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("ruleId")).alias("rules"))


def evidence_gaps(events: DataFrame, quiet: int = DAY) -> DataFrame:
    """(kind, channel, computer, at, size): where the evidence itself has holes.

    Record numbers that skip, clocks that run back, long silences within a log, and
    logs that begin later than most of the case.
    """
    from ..operators.sequences import backward_steps, record_holes

    by = ["computer", "channel"]
    rows = events.where("computer is not null and channel is not null")
    holes = record_holes(rows.where("recordId is not null"), by, "recordId").select(F.lit("missing records").alias("kind"), *by, F.col("after").alias("at"), F.col("missing").alias("size"))
    steps = backward_steps(rows.where("recordId is not null and ts is not null"), by, "recordId", "ts").select(F.lit("clock set back").alias("kind"), *by, F.col("record").alias("at"), F.col("step").alias("size"))
    silence = F.lead("ts").over(W.partitionBy(*by).orderBy("ts")) - F.col("ts")
    silent = rows.where("ts is not null").select(*by, F.col("ts").alias("at"), silence.alias("size")).where(F.col("size") > quiet).select(F.lit("silence").alias("kind"), *by, "at", "size")
    first = rows.groupBy(*by).agg(F.min("ts").alias("at"))
    usual = first.agg(F.median("at").cast("long").alias("usual"))  # one row
    late = first.join(F.broadcast(usual)).where(F.col("at") - F.col("usual") > quiet).select(F.lit("late start").alias("kind"), *by, "at", (F.col("at") - F.col("usual")).alias("size"))
    return holes.unionByName(steps).unionByName(silent).unionByName(late)


def expectations(files: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected`` (name, category) with found: a file of that name, else one of that category, else missing."""
    named = files.select(F.lower("name").alias("_name")).distinct()
    kinds = files.where("category is not null").select(F.lower("category").alias("_kind")).distinct()
    out = expected.join(named, F.lower("name") == F.col("_name"), "left").join(kinds, F.lower("category") == F.col("_kind"), "left")
    return out.withColumn("found", F.when(F.col("_name").isNotNull(), "name").when(F.col("_kind").isNotNull(), "category").otherwise("missing")).drop("_name", "_kind")


def cited_rows_that_fail(findings: DataFrame, rows: DataFrame, holds: Column) -> DataFrame:
    """(key, cited, missing, failing): of the rows that a finding cites, how many are not there and how many its condition doesn't hold for."""
    cited = findings.select("key", F.explode_outer("refs").alias("ref")).distinct()
    judged = rows.select(F.col("id").alias("ref"), V.truth(holds).alias("ok"))
    return cited.join(judged, "ref", "left").groupBy("key").agg(F.count("ref").alias("cited"), F.count(F.when(F.col("ref").isNotNull() & F.col("ok").isNull(), 1)).alias("missing"), F.count(F.when(~F.col("ok"), 1)).alias("failing"))


def anchors(findings: DataFrame, rows: DataFrame, record: str = "recordKey") -> DataFrame:
    """(key, anchor): a hash of the record keys that a finding cites, the same after another import."""
    cited = findings.select("key", F.explode("refs").alias("id")).join(rows.select("id", F.col(record).alias("_r")), "id").where("_r is not null")
    return cited.groupBy("key").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("_r")), "\n"), 256).alias("anchor"))


def relationship_leads(edges: DataFrame, flagged: DataFrame, most: int = 3) -> DataFrame:
    """(a, b, relation): relations of a flagged node (id) with one that isn't, where that node has few relations."""
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    known = flagged.select(F.col("id").alias("_f")).distinct()
    quiet = ends.where(F.col("n") <= most).join(known, F.col("id") == F.col("_f"), "left_anti").select("id")
    out = edges.join(known, F.col("a") == F.col("_f"), "left_semi").join(quiet, F.col("b") == F.col("id"), "left_semi")
    into = edges.join(known, F.col("b") == F.col("_f"), "left_semi").join(quiet, F.col("a") == F.col("id"), "left_semi")
    return out.unionByName(into).select("a", "b", "relation").distinct()
