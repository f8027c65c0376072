"""The detection-rule engine: a rule is a dictionary, its findings a DataFrame.

A rule has a condition per row (``where``, ``exclude``, ``time``), may group the rows,
ask a count or a number of distinct values of each group or of each burst within a
sliding window, and may look for a follow-up (``then``) that escalates the finding.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import filters
from ..operators.joins import first_in_band
from ..operators.sequences import bursts
from ..schema import Case, Settings

# Limits on findings and on the rows that one finding names.
MOST_FINDINGS, MOST_REFS, COLLAPSE_AFTER = 2000, 5000, 200
SEPARATOR = "\x01"
ENTITIES = {
    "events": ["computer", "targetUser", "subjectUser", "ipAddress", "processName", "serviceName"],
    "mails": ["fromAddr", "fromDomain", "subject", "originIp"],
}


class RuleError(ValueError):
    """A rule that contradicts itself."""


@dataclass
class Found:
    """A rule's findings and what was left out of them."""

    findings: DataFrame
    groups: DataFrame | None = None
    notes: list[str] = field(default_factory=list)


def load(text: str) -> list[dict]:
    """The rules of a YAML file; a later rule replaces an earlier one of the same id."""
    return list({r["id"]: r for r in yaml.safe_load_all(text) if r}.values())


def problem(rule: dict) -> str | None:
    """Why a rule can't run."""
    if not rule.get("id"):
        return "a rule needs an id"
    if rule.get("source", "events") not in ("events", "mails"):
        return f"unknown source {rule.get('source')!r}"
    if not rule.get("group_by") and rule.get("threshold") is None and (unused := [k for k in ("then", "window", "distinct", "any_in_group") if rule.get(k)]):
        return f"{', '.join(unused)} need group_by or threshold"
    if rule.get("then") and not rule["then"].get("where"):
        return "then needs where"
    if rule.get("then_flags") and rule.get("source", "events") != "mails":
        return "then_flags needs mails: events carry no flags"
    if rule.get("severity", "medium") not in V.SEVERITIES:
        return f"unknown severity {rule.get('severity')!r}"
    return None


def out_of_hours(rule: dict, case: Case, ts: str) -> Column | None:
    t, s = rule.get("time") or {}, case.settings
    if not (t.get("outside_business_hours") or t.get("weekend") or t.get("hours")):
        return None
    start, end = (int(x) for x in (t.get("hours") or s.hours)[:2])
    at = F.col(t.get("field") or ts)
    parts = []
    if t.get("outside_business_hours") or (t.get("hours") and not t.get("weekend")):
        hour = V.local_hour(at, s.tz)
        parts.append(F.lit(False) if start == end else ~hour.between(start, end - 1) if start < end else hour.between(end, start - 1))
    if t.get("weekend"):
        parts.append(V.weekday(at, s.tz).isin(*s.weekend) if s.weekend else F.lit(False))
    return at.isNotNull() & V.any_of(parts)


def matched(rule: dict, case: Case) -> DataFrame:
    """The rows a rule is about."""
    source = rule.get("source", "events")
    rows = filters.where(case[source], rule.get("where"), source, case)
    if rule.get("exclude"):
        rows = rows.where(~filters.tree(rule["exclude"], filters.Context.of(rows, source, case.settings)))
    late = out_of_hours(rule, case, filters.TIME[source])
    return rows.where(late) if late is not None else rows


def _entities(rule: dict, ctx: filters.Context) -> dict[str, Column]:
    out = {}
    for name in rule.get("entities") or rule.get("group_by") or ENTITIES[ctx.source]:
        try:
            out[name] = filters.resolve(name, ctx)[0].cast("string")
        except filters.FilterError:
            continue
    return out


def _entity_map(names: list[str], of) -> Column:
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.substring(of(n), 1, 200).alias("v")) for n in names])
    return F.map_from_entries(F.filter(pairs, lambda p: V.truth((p["v"] != "") & (p["v"] != "[]"))))


def _key(rule: dict, *parts: Column) -> Column:
    return F.concat_ws("|", F.lit(rule["id"]), *parts)


def _finding(rule: dict, key: Column, ts: Column, end: Column, n: Column, entities: Column, refs: Column, *more: Column) -> list[Column]:
    return [
        F.lit(rule["id"]).alias("ruleId"), F.lit(rule.get("title", rule["id"])).alias("title"), F.lit(rule.get("severity", "medium")).alias("severity"), key.alias("key"),
        ts.alias("ts"), end.alias("tsEnd"), n.cast("long").alias("count"), entities.alias("entities"), refs.alias("refs"), F.lit(None).cast("string").alias("escalation"), *more,
    ]


def run_rule(rule: dict, case: Case) -> Found:
    """Findings: ruleId, title, severity, key, ts, tsEnd, count, entities, refs, escalation."""
    if why := problem(rule):
        raise RuleError(why)
    if any(not case.settings.values(s) for s in ([rule["require_setting"]] if rule.get("require_setting") else [])):
        return Found(case.tables[rule.get("source", "events")].sparkSession.createDataFrame([], _schema()), notes=[f"setting {rule['require_setting']} is empty"])
    source = rule.get("source", "events")
    if rule.get("then_flags"):
        from .rule_set import run_set

        return Found(run_set([rule], case), run_set([rule], case, capped=False))
    ts = filters.TIME[source]
    rows = matched(rule, case)
    ctx = filters.Context.of(rows, source, case.settings)
    if not rule.get("group_by") and rule.get("threshold") is None:
        found = _by_row(rule, rows, ctx, ts)
    elif rule.get("window"):
        found = _by_burst(rule, rows, ctx, ts)
    else:
        found = _by_group(rule, rows, ctx, ts)
    if rule.get("then"):
        found = _then(rule, found, case, ts)
    return _capped(rule, found)


def _schema() -> str:
    from ..schema import FINDING

    return FINDING


def _by_row(rule: dict, rows: DataFrame, ctx: filters.Context, ts: str) -> DataFrame:
    """A finding a row; with too many, one for each combination of entities, unless ``collapse_after`` is None."""
    entities = _entities(rule, ctx)
    rows = rows.select("id", F.col(ts).alias("_ts"), *[c.alias(f"_e_{n}") for n, c in entities.items()])
    names = list(entities)
    after = rule.get("collapse_after", COLLAPSE_AFTER)
    many = after is not None and rows.limit(int(after) + 1).count() > int(after)
    of = lambda n: F.col(f"_e_{n}")
    if not many:
        return rows.select(*_finding(rule, _key(rule, F.col("id").cast("string")), F.col("_ts"), F.col("_ts"), F.lit(1), _entity_map(names, of), F.array("id")))
    lowered = [F.lower(F.coalesce(of(n), F.lit(""))).alias(f"_g_{n}") for n in names]
    return _grouped(rule, rows.select("*", *lowered), names, names)


def _grouped(rule: dict, rows: DataFrame, keys: list[str], names: list[str], having: Column | None = None, extra: list[Column] | None = None, merged: list[Column] | None = None) -> DataFrame:
    groups = [f"_g_{k}" for k in keys]
    # The first references by time: of each slice of a group only its first are gathered.
    slices = rows.withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(32)))
    slices = slices.withColumn("_nth", F.row_number().over(W.partitionBy(*groups, "_slice").orderBy(F.col("_ts").asc_nulls_last(), "id")))
    refs = F.collect_list(F.when(F.col("_nth") <= MOST_REFS, F.struct(F.col("_ts").alias("t"), "id"))).alias("_r")
    part = slices.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_ts").alias("_from"), F.max("_ts").alias("_to"), F.min(F.struct(F.col("_ts").isNull(), F.col("_ts").alias("t"), "id", *[F.col(f"_e_{n}") for n in names])).alias("_first"), refs, *(extra or []))
    whole = part.groupBy(*groups).agg(F.sum("_n").alias("_n"), F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.min("_first").alias("_first"), F.slice(F.array_sort(F.flatten(F.collect_list("_r"))), 1, MOST_REFS).alias("_r"), *(merged or []))
    if having is not None:
        whole = whole.where(having)
    of = lambda n: F.col(f"_first._e_{n}")
    return whole.select(*_finding(rule, _key(rule, F.concat_ws(SEPARATOR, *groups)), F.col("_from"), F.col("_to"), F.col("_n"), _entity_map(names, of), F.transform("_r", lambda r: r["id"])), *[F.col(g) for g in groups])


def _keyed(rule: dict, rows: DataFrame, ctx: filters.Context, ts: str) -> tuple[DataFrame, list[str], list[str]]:
    keys, entities = list(rule.get("group_by") or []), _entities(rule, ctx)
    lowered = [F.lower(F.coalesce(filters.resolve(k, ctx)[0].cast("string"), F.lit(""))).alias(f"_g_{k}") for k in keys]
    own = [F.lower(filters.resolve(rule["distinct"], ctx)[0].cast("string")).alias("_what")] if rule.get("distinct") else []
    some = [V.truth(filters.tree(rule["any_in_group"], ctx)).alias("_some")] if rule.get("any_in_group") else []
    rows = rows.select("id", F.col(ts).alias("_ts"), *lowered, *[c.alias(f"_e_{n}") for n, c in entities.items()], *own, *some)
    return rows.where(V.any_of([F.col(f"_g_{k}") != "" for k in keys])) if keys else rows, keys, list(entities)


def _by_group(rule: dict, rows: DataFrame, ctx: filters.Context, ts: str) -> DataFrame:
    rows, keys, names = _keyed(rule, rows, ctx, ts)
    comparator, n = V.threshold(rule.get("threshold", 1))
    extra, merged = [], []
    size = F.col("_n")
    groups = [f"_g_{k}" for k in keys]
    having = F.lit(True)
    if rule.get("any_in_group"):
        extra.append(F.bool_or("_some").alias("_some"))
        merged.append(F.bool_or("_some").alias("_some"))
        having = having & F.col("_some")
    if rule.get("distinct"):
        values = rows.where("_what <> ''").select(*groups, "_what").distinct().groupBy(*groups).agg(F.count(F.lit(1)).alias("_distinct"))
        met = values.where(V.meets(F.col("_distinct"), comparator, n)) if comparator in (">=", ">") and n > 0 else None
        found = _grouped(rule, rows, keys, names, having, extra, merged)
        # The values are the point of the finding, so it counts them.
        counted = found.join(met, groups) if met is not None else found.join(values, groups, "left")
        return counted.withColumn("count", F.coalesce("_distinct", F.lit(0)).cast("long")).where(V.meets(F.col("count"), comparator, n)).drop("_distinct")
    return _grouped(rule, rows, keys, names, having & V.meets(size, comparator, n), extra, merged)


def _by_burst(rule: dict, rows: DataFrame, ctx: filters.Context, ts: str) -> DataFrame:
    rows, keys, names = _keyed(rule, rows, ctx, ts)
    groups = [f"_g_{k}" for k in keys]
    if rule.get("any_in_group"):
        having = rows.where("_some").select(*groups).distinct()
        rows = rows.join(having, groups, "left_semi")
    what = F.col("_what") if rule.get("distinct") else None
    comparator, n = V.threshold(rule.get("threshold", 1))
    found = bursts(rows, groups, "_ts", V.duration_ms(rule["window"]), comparator, n, what, [f"_e_{x}" for x in names], MOST_REFS)
    minute = F.expr("start div 60000").cast("string")
    return found.select(*_finding(rule, _key(rule, F.concat_ws(SEPARATOR, *groups), minute), F.col("start"), F.col("end"), F.col("count"), _entity_map(names, lambda x: F.col(f"_e_{x}")), F.col("refs")), *[F.col(g) for g in groups])


def _then(rule: dict, found: DataFrame, case: Case, ts: str) -> DataFrame:
    """The first follow-up by (time, id) within reach: severity and title change, its row joins, the end moves."""
    then = rule["then"]
    source = then.get("source") or rule.get("source", "events")
    follow_ts = filters.TIME[source]
    rows = filters.where(case[source], then["where"], source, case)
    ctx = filters.Context.of(rows, source, case.settings)
    joins = [(a, b or a) for a, _, b in (str(j).partition("=") for j in then.get("join") or rule.get("group_by") or [])]
    lowered = lambda c: F.lower(F.coalesce(c.cast("string"), F.lit("")))
    follow = rows.select("id", F.col(follow_ts).alias("t"), *[lowered(filters.resolve(b, ctx)[0]).alias(f"_j_{i}") for i, (_, b) in enumerate(joins)])
    grouped = set(found.columns)
    mine = [lowered(F.col(f"_g_{a}") if f"_g_{a}" in grouped else F.col("entities")[a]).alias(f"_j_{i}") for i, (a, _) in enumerate(joins)]
    keyed = found.select("key", "ts", "tsEnd", *mine).where(F.col("ts").isNotNull())
    on = [f"_j_{i}" for i in range(len(joins))]
    first = first_in_band(keyed, follow, on, ["key"], "ts", "tsEnd", "t", ["id"], V.duration_ms(then.get("within", "1h"))).withColumnRenamed("key", "_key")
    out = found.join(first, F.col("key") == F.col("_key"), "left")
    hit = F.col("r_id").isNotNull()
    kept = [c for c in found.columns if c.startswith("_g_")]
    return out.select(
        "ruleId", F.when(hit & F.lit(bool(then.get("title"))), F.lit(then.get("title"))).otherwise(F.col("title")).alias("title"),
        F.when(hit, F.lit(then.get("severity", rule.get("severity", "medium")))).otherwise(F.col("severity")).alias("severity"), "key", "ts", F.when(hit, F.greatest("tsEnd", "r_t")).otherwise(F.col("tsEnd")).alias("tsEnd"), "count", "entities",
        F.when(hit & ~F.array_contains("refs", F.col("r_id")), F.array_append("refs", F.col("r_id"))).otherwise(F.col("refs")).alias("refs"), F.when(hit, F.lit(then.get("title") or "follow-up")).alias("escalation"), *kept,
    )


def cap_of(rule: dict) -> int:
    return int(rule.get("max_findings", MOST_FINDINGS))


def biggest(rule: dict) -> bool:
    """Whether a rule that finds too much is about its largest groups: one that counts up to more than one. Any other is about its rarest."""
    if rule.get("threshold") is None:
        return False
    comparator, n = V.threshold(rule["threshold"])
    return (comparator == ">=" and n > 1) or (comparator == ">" and n >= 1)


COLUMNS = ["ruleId", "title", "severity", "key", "ts", "tsEnd", "count", "entities", "refs", "escalation", "confidence", "attack", "tags", "description"]


def _capped(rule: dict, found: DataFrame) -> Found:
    """At most ``max_findings``: the largest groups or the rarest, of rows the first."""
    said = lambda k: F.lit(rule.get(k)).cast("string").alias(k)
    listed = lambda k: F.array(*[F.lit(str(x)) for x in rule.get(k) or []]).cast("array<string>").alias(k)
    every = found.select(*COLUMNS[:10], said("confidence"), listed("attack"), listed("tags"), said("description"))
    if rule.get("group_by") or rule.get("threshold") is not None:
        order = [F.desc("count") if biggest(rule) else F.asc("count"), "key"]
    else:
        order = [F.col("ts").asc_nulls_last(), "key"]
    return Found(every.orderBy(*order).limit(cap_of(rule)), every)


def dropped(found: Found, rule: dict) -> DataFrame:
    """How many findings there were and how many the cap left out."""
    most = int(rule.get("max_findings", MOST_FINDINGS))
    return found.groups.agg(F.count(F.lit(1)).alias("found")).withColumn("left_out", F.greatest(F.lit(0), F.col("found") - most))


def diagnose(rule: dict, case: Case) -> DataFrame:
    """Where a rule that finds nothing loses its rows: one pass that counts what passes each step."""
    source = rule.get("source", "events")
    rows = case[source]
    ctx = filters.Context.of(rows, source, case.settings)
    met = V.truth(filters.tree(rule.get("where"), ctx))
    kept = met & ~V.truth(filters.tree(rule["exclude"], ctx)) if rule.get("exclude") else met
    late = out_of_hours(rule, case, filters.TIME[source])
    timed = kept & V.truth(late) if late is not None else kept
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return rows.agg(F.count(F.lit(1)).alias("rows"), n(met, "meet_where"), n(kept, "not_excluded"), n(timed, "in_time"))


def pinned(cond: dict | None, name: str = "eventId") -> set | None:
    """The values of a field outside which a tree can't hold, or None if it may hold with any."""
    found = None
    for key, value in (cond or {}).items():
        own = None
        head, _, op = key.partition("|")
        if key.startswith("any_of"):
            parts = [pinned(v, name) for v in (value if isinstance(value, list) else [value])]
            own = set().union(*parts) if parts and all(p is not None for p in parts) else None
        elif key.startswith("all_of"):
            for v in value if isinstance(value, list) else [value]:
                if (p := pinned(v, name)) is not None:
                    own = p if own is None else own & p
        elif head == name and op in ("", "eq", "in"):
            own = set(filters._listed(value) if op == "in" else value if isinstance(value, list) else [value])
        if own is not None:
            found = own if found is None else found & own
    return found


def applicable(rule: dict, present: set) -> bool:
    """Whether any of the values that a rule is pinned to is in the case."""
    own = pinned(rule.get("where"))
    return own is None or bool({str(x) for x in own} & {str(x) for x in present})


def empty_settings(cond: dict | None, case: Case) -> list[str]:
    """Lists that a tree can't hold without and that have nothing in them."""
    out: list[str] = []
    for key, value in (cond or {}).items():
        if key.startswith("all_of"):
            for v in value if isinstance(value, list) else [value]:
                out += empty_settings(v, case)
        elif key.endswith("|in_setting") and not case.settings.values(str(value)):
            out.append(str(value))
    return list(dict.fromkeys(out))


def empty_settings_of(df: DataFrame, key: str, cond: str, settings: Settings) -> DataFrame:
    """(key, list) for a table of rules whose conditions are JSON: the lists that each can't hold without and that have nothing in them."""
    case = Case({}, settings)

    def run(batches):
        for batch in batches:
            rows = [(k, name) for k, text in zip(batch[key], batch[cond], strict=True) for name in empty_settings(json.loads(text) if text else None, case)]
            yield pd.DataFrame(rows, columns=[key, "list"])

    return df.select(key, cond).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, list string")


def run_rules(rules: list[dict], case: Case) -> DataFrame:
    """The findings of all rules, found in one pass over each table."""
    from .rule_set import run_set

    return run_set(rules, case)


def groups_beside(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts by group with the number of groups beside each."""
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return groups.join(F.broadcast(groups.agg(F.count(F.lit(1)).alias("groups"))))  # one row
