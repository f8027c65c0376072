"""The filter language: conditions, condition trees and search filters as Columns.

Comparisons ignore case unless an operator ends in ``_cs``. A comparison with null is
false, so a negative operator matches null. Fields of child tables and of bodies are
joined on demand: ``where`` returns a DataFrame, since a child condition is a semi or
anti join and not an expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions import web
from ..schema import ATTACHMENTS, BODIES, URLS, Case, Settings

# The operators, and names that fields go by.
OPERATORS = {
    "eq", "ne", "in", "nin", "contains", "not_contains", "contains_any", "contains_all", "startswith", "not_startswith", "endswith", "not_endswith", "re", "not_re", "re_cs",
    "gt", "gte", "lt", "lte", "exists", "empty", "in_setting", "nin_setting", "levenshtein", "length", "contains_cs", "startswith_cs", "endswith_cs",
    "cidr",
}
NEGATIVE = {"ne": "eq", "nin": "in", "not_contains": "contains_any", "not_startswith": "startswith", "not_endswith": "endswith", "not_re": "re", "nin_setting": "in_setting", "empty": "exists"}
MAIL_NAMES = {"auth.spf": "spf", "auth.dkim": "dkim", "auth.dmarc": "dmarc", "auth.compauth": "compauth", "reputation.worst": "reputationWorst", "reputation.originIp.verdict": "reputationOriginIp", "replyTo.addr": "replyToList", "replyTo.domain": "replyToDomain", "to.addr": "toList", "cc.addr": "ccList", "bcc.addr": "bccList", "sender.addr": "senderAddr"}
SEARCHED = {
    "events": ("computer", "provider", "channel", "targetUser", "subjectUser", "ipAddress", "workstation", "processName", "commandLine", "image", "serviceName", "taskName", "targetFilename", "targetObject", "destinationIp", "destinationHostname", "queryName", "scriptBlockText", "operation", "upn", "userAgent", "status", "data"),
    "mails": ("subject", "fromAddr", "fromName", "fromDomain", "senderAddr", "replyToDomain", "originIp", "messageId", "snippet"),
}
TIME = {"events": "ts", "mails": "date"}


class FilterError(ValueError):
    """A field or operator that the language doesn't have."""


@dataclass(frozen=True)
class Context:
    source: str
    schema: T.StructType
    settings: Settings
    known: dict = field(default_factory=dict, compare=False)  # conditions made so far, as many rules share some

    @classmethod
    def of(cls, df: DataFrame, source: str, settings: Settings | None = None) -> Context:
        return cls(source, df.schema, settings or Settings())


def resolve(field: str, ctx: Context) -> tuple[Column, str]:
    """A field's expression and kind: text, num, bool or list."""
    name = field.strip()
    if ctx.source == "mails":
        name = MAIL_NAMES.get(name, name)
        if m := re.fullmatch(r"(to|cc|bcc|replyTo)\.(domain|name|addr)", name):
            people = F.from_json(F.col(m[1]), "array<struct<addr:string,domain:string,name:string>>")
            return F.transform(people, lambda p: p[m[2]]), "list"
    if name == "riskBand":
        return V.risk_band(F.col("risk")), "text"
    if name == "providerEventId" and ctx.source == "events":
        return F.concat(F.coalesce("provider", F.lit("")), F.lit(" / "), F.col("eventId").cast("string")), "text"
    if ctx.source == "urls" and name == "subdomain":
        return web.subdomain_of(F.col("host")), "text"
    if ctx.source == "urls" and name == "fragment":
        return web.fragment_of(F.col("url")), "text"
    if name in ctx.schema.fieldNames():
        kind = ctx.schema[name].dataType
        if isinstance(kind, T.ArrayType):
            return F.col(f"`{name}`"), "list"
        return F.col(f"`{name}`"), "num" if isinstance(kind, T.NumericType) else "bool" if isinstance(kind, T.BooleanType) else "text"
    for holder, sources in (("data", ("events",)), ("details", ("attachments",))):
        if ctx.source in sources and holder in ctx.schema.fieldNames():
            return V.json_field(F.col(holder), name.removeprefix(f"{holder}.")), "text"
    if ctx.source == "mails" and (m := re.fullmatch(r"(auth|lookalike)\.(.+)", name)):
        return V.json_field(F.col(m[1]), m[2]), "text"
    raise FilterError(f"unknown field {field!r} of {ctx.source}")


def _listed(value) -> list:
    if isinstance(value, (list, tuple, set)):
        return list(value)
    return [x.strip() for x in value.split(",")] if isinstance(value, str) and "," in value else [value]


def _number(value) -> float | None:
    try:
        if isinstance(value, str) and re.fullmatch(r"\s*0[xX][0-9a-fA-F]+\s*", value):
            return float(int(value, 16))
        return float(value)
    except (TypeError, ValueError):
        return None


def _alternatives(items: list[str]) -> str:
    return "|".join(re.escape(i) for i in items)


def _text(c: Column, kind: str) -> Column:
    return c.cast("string") if kind != "text" else c


def _blank(c: Column, kind: str) -> Column:
    return c.isNull() | ((F.size(c) == 0) if kind == "list" else (_text(c, kind) == ""))


def _equal(c: Column, kind: str, values: list) -> Column:
    """Equal to one of the values: as numbers where they are numbers, else as lower-cased text; blank equals blank."""
    texts = [str(v).lower() for v in values if v not in (None, "") and not isinstance(v, bool)]
    texts += [str(v).lower() for v in values if isinstance(v, bool)]
    numbers = [n for v in values if not isinstance(v, (str, bool, type(None))) and (n := _number(v)) is not None]
    if kind == "num":
        numbers += [n for v in values if isinstance(v, str) and (n := _number(v)) is not None]
    parts = []
    if texts:
        parts.append(F.lower(_text(c, kind)).isin(texts))
    if numbers:
        parts.append(c.try_cast("double").isin(numbers))
    if any(v in (None, "") for v in values):
        parts.append(_blank(c, kind))
    return V.any_of([V.truth(p) for p in parts])


def _in_setting(c: Column, kind: str, name: str, settings: Settings) -> Column:
    values = settings.values(name)
    lowered = F.lower(_text(c, kind))
    if not values:
        return F.lit(False)
    if name == "internal_ips":
        return V.in_networks(c, values)
    if "name" in name.lower():
        return V.truth(V.normal_names(_text(c, kind)).isin([V.normal_name(v) for v in values]))
    if "domain" in name.lower() or name == "brands":
        return V.domain_in(lowered, values)
    return V.truth(lowered.isin([v.lower() for v in values]))


def _of_text(op: str, value, c: Column, kind: str, settings: Settings) -> Column:
    t = _text(c, kind)
    low = F.lower(t)
    # A text is one value, but for the two operators whose name says list.
    items = [str(v) for v in _listed(value)] if not isinstance(value, str) or op in ("contains_any", "contains_all") else [value]
    lows = [i.lower() for i in items]
    if op == "eq":
        return _equal(c, kind, value if isinstance(value, list) else [value])
    if op == "in":
        return _equal(c, kind, _listed(value))
    if op in ("contains", "contains_any"):
        return V.truth(low.contains(lows[0]) if len(lows) == 1 else low.rlike(_alternatives(lows)) if lows else F.lit(False))
    if op == "contains_all":
        return V.all_of([V.truth(low.contains(i)) for i in lows])
    if op == "startswith":
        return V.any_of([V.truth(low.startswith(i)) for i in lows])
    if op == "endswith":
        return V.any_of([V.truth(low.endswith(i)) for i in lows])
    if op == "contains_cs":
        return V.any_of([V.truth(t.contains(i)) for i in items])
    if op == "startswith_cs":
        return V.any_of([V.truth(t.startswith(i)) for i in items])
    if op == "endswith_cs":
        return V.any_of([V.truth(t.endswith(i)) for i in items])
    if op == "re":
        return V.any_of([V.truth(t.rlike("(?i)" + i)) for i in items])
    if op == "re_cs":
        return V.any_of([V.truth(t.rlike(i)) for i in items])
    if op in ("gt", "gte", "lt", "lte"):
        n = _number(value)
        if n is None:
            return F.lit(False)
        return V.truth(V.meets(c.try_cast("double"), {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}[op], n))
    if op == "exists":
        return ~_blank(c, kind) if str(value).lower() != "false" else _blank(c, kind)
    if op == "in_setting":
        return _in_setting(c, kind, str(value), settings)
    if op == "cidr":
        return V.in_networks(t, items)
    if op == "levenshtein":
        needle, most = value
        return V.truth(F.levenshtein(low, F.lit(str(needle).lower())) <= int(most))
    if op == "length":
        return V.truth(V.meets(F.length(t), *V.threshold(value, "==")))
    raise FilterError(f"unknown operator {op!r}")


def _of_list(op: str, value, c: Column, settings: Settings) -> Column:
    c = F.coalesce(c, F.array().cast("array<string>"))
    low = F.transform(c, F.lower)
    items = [str(v) for v in (value if isinstance(value, (list, tuple)) else [value])]
    lows = F.array(*[F.lit(i.lower()) for i in items])
    some = lambda test: V.truth(F.exists(c, lambda x: V.truth(test(x))))
    if op in ("eq", "in", "contains_any"):
        return V.truth(F.arrays_overlap(low, lows))
    if op == "contains_all":
        return V.truth(F.size(F.array_except(lows, low)) == 0)
    if op == "exists":
        return F.size(c) > 0 if str(value).lower() != "false" else F.size(c) == 0
    if op == "length":
        return V.meets(F.size(c), *V.threshold(value, "=="))
    if op in ("contains", "startswith", "endswith", "re", "re_cs", "contains_cs", "startswith_cs", "endswith_cs", "in_setting"):
        return some(lambda x: _of_text(op, value, x, "text", settings))
    raise FilterError(f"operator {op!r} doesn't apply to a list")


def condition(name: str, op: str, value, ctx: Context) -> Column:
    """One condition on a field of the row itself."""
    if op not in OPERATORS:
        raise FilterError(f"unknown operator {op!r}")
    key = (name, op, repr(value))
    if key not in ctx.known:
        c, kind = resolve(name, ctx)
        if op in NEGATIVE:
            ctx.known[key] = ~condition(name, NEGATIVE[op], True if op == "empty" else value, ctx)
        else:
            ctx.known[key] = _of_list(op, value, c, ctx.settings) if kind == "list" else _of_text(op, value, c, kind, ctx.settings)
    return ctx.known[key]


def _split(key: str, value) -> tuple[str, str]:
    field, _, op = key.partition("|")
    op = op or ("in" if isinstance(value, list) else "eq")
    return field, "contains_any" if op == "contains" and isinstance(value, list) else op


def tree(cond: dict | None, ctx: Context) -> Column:
    """A condition tree: keys together, any_of and all_of (with a number or not) lists of trees, not a tree."""
    parts = []
    for key, value in (cond or {}).items():
        if re.fullmatch(r"(any|all)_of(_\d+)?", key):
            own = [tree(v, ctx) for v in (value if isinstance(value, list) else [value])]
            parts.append(V.any_of(own) if key.startswith("any") else V.all_of(own))
        elif key == "not":
            parts.append(~tree(value, ctx))
        else:
            parts.append(condition(*_split(key, value), value, ctx))
    return V.all_of(parts)


def _child_flag(df: DataFrame, case: Case, child: str, field: str, op: str, value, key: str, flag: str) -> DataFrame:
    """``df`` with ``flag``: whether some child row meets the condition, or none does for a negative operator."""
    rows = case[child]
    own = Context(child, rows.schema, case.settings)
    met = rows.where(condition(field, NEGATIVE.get(op, op), True if op == "empty" else value, own)).select(F.col("mailId").alias("_child")).distinct()
    found = df.join(met, df[key] == met["_child"], "left")
    return found.withColumn(flag, F.col("_child").isNull() if op in NEGATIVE else F.col("_child").isNotNull()).drop("_child")


def where(df: DataFrame, cond: dict | None, source: str, case: Case, key: str = "id") -> DataFrame:
    """The rows that meet a tree, which may name ``attachments.*``, ``urls.*`` and body fields.

    A child condition that must hold is a semi join, or an anti join if it is
    negative; one inside any_of, all_of or not becomes a flag joined to the rows.
    """
    columns = df.columns
    plain, n = {}, 0

    def child_of(k: str) -> str | None:
        head = k.partition("|")[0].partition(".")[0]
        return head if head in ("attachments", "urls") and source == "mails" and "." in k else None

    def lifted(node: dict) -> dict:
        """The tree with nested child conditions replaced by flags."""
        nonlocal df, n
        out = {}
        for k, v in node.items():
            if re.fullmatch(r"(any|all)_of(_\d+)?", k):
                out[k] = [lifted(x) for x in (v if isinstance(v, list) else [v])]
            elif k == "not":
                out[k] = lifted(v)
            elif child := child_of(k):
                field, op = _split(k.partition(".")[2], v)
                df = _child_flag(df, case, child, field, op, v, key, f"_met{n}")
                out[f"_met{n}|eq"] = True
                n += 1
            else:
                out[k] = v
        return out

    joins = []
    for k, v in (cond or {}).items():
        if child := child_of(k):
            joins.append((child, *_split(k.partition(".")[2], v), v))
        else:
            plain[k] = v
    named = set(re.findall(r"[A-Za-z]+", str(plain)))
    if source == "mails" and named & (BODIES.keys() - {"mailId"}) and case.get("mail_bodies") is not None:
        bodies = case["mail_bodies"].select(F.col("mailId").alias("_body"), *[c for c in BODIES if c != "mailId" and c in named])
        df = df.join(bodies, df[key] == bodies["_body"], "left")
    plain = lifted(plain)
    df = df.where(tree(plain, Context.of(df, source, case.settings)))
    for child, field, op, value in joins:
        rows = case[child]
        met = rows.where(condition(field, NEGATIVE.get(op, op), True if op == "empty" else value, Context(child, rows.schema, case.settings)))
        df = df.join(met.select(F.col("mailId").alias("_child")), df[key] == F.col("_child"), "left_anti" if op in NEGATIVE else "left_semi")
    return df.select(*[f"`{c}`" for c in columns])


def search_filter(f: dict | None, ctx: Context) -> Column:
    """A search: conditions (and, or), timeRange, hourRange, regex on a field or all, and free text."""
    f = f or {}
    ts = F.col(TIME.get(ctx.source, "ts"))
    parts = []
    if conds := [condition(c["field"], c["op"], c.get("value"), ctx) for c in f.get("conditions") or [] if c.get("field") and c.get("op")]:
        parts.append(V.any_of(conds) if f.get("logic") == "or" else V.all_of(conds))
    span = f.get("timeRange") or {}
    if span.get("from") is not None:
        parts.append(V.truth(ts >= int(span["from"])))
    if span.get("to") is not None:
        parts.append(V.truth(ts <= int(span["to"])))
    hours = f.get("hourRange") or {}
    if hours.get("from") is not None and hours.get("to") is not None:
        inside = V.within_hours(V.local_hour(ts, hours.get("tz") or ctx.settings.tz), int(hours["from"]), int(hours["to"]))
        parts.append(ts.isNotNull() & V.truth(~inside if hours.get("outside") else inside))
    named = [c for c in SEARCHED.get(ctx.source, ()) if c in ctx.schema.fieldNames()]
    if (rx := f.get("regex") or {}).get("pattern"):
        if rx.get("field") not in (None, "*"):
            target = _text(*resolve(rx["field"], ctx))
        else:
            target = F.col("raw") if "raw" in ctx.schema.fieldNames() else F.concat_ws(" ", *named)
        parts.append(V.truth(target.rlike("(?i)" + rx["pattern"])))
    if text := str(f.get("text") or "").strip().lower():
        parts.append(V.any_of([V.truth(F.lower(F.col(c)).contains(text)) for c in named]))
    return V.all_of(parts)


def ordering(sort: dict | None, ctx: Context) -> list[Column]:
    """By a field, nulls last, and by id; by time if the field is unknown."""
    ts = TIME.get(ctx.source, "ts")
    up = str((sort or {}).get("dir") or "desc").lower() == "asc"
    try:
        c, _ = resolve((sort or {}).get("field") or ts, ctx)
    except FilterError:
        c, _ = resolve(ts, ctx)
    return [c.asc_nulls_last() if up else c.desc_nulls_last(), F.col("id").asc() if up else F.col("id").desc()]


def with_facet(f: dict, field: str, value, on: bool = True) -> dict:
    """A filter with a facet's value added, or taken out again."""
    cond = {"field": field, "op": "eq", "value": value}
    others = [c for c in f.get("conditions") or [] if c != cond]
    return {**f, "conditions": [*others, cond] if on else others}


def context_lines(df: DataFrame, test: Column, around: int, *order: str) -> DataFrame:
    """The rows that meet a test and ``around`` rows on each side of them, in the order given within its first column."""
    near = W.partitionBy(order[0]).orderBy(*order[1:]).rowsBetween(-around, around)
    return df.withColumn("_near", F.max(V.truth(test).cast("int")).over(near)).where("_near = 1").drop("_near")


__all__ = ["ATTACHMENTS", "URLS", "Context", "FilterError", "condition", "context_lines", "ordering", "replace", "resolve", "search_filter", "tree", "where", "with_facet"]
