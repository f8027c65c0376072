"""Many rules in one pass: a table is read once, whatever the number of rules.

Every row gets the numbers of the rules it meets, rows that meet none are gone at once, and
the rest is laid out once for each rule met. From there on a rule is a value in a column:
groups, bursts, thresholds, follow-ups and caps of all rules are the same few
aggregations, so a set of a thousand rules has no more stages than one of ten. Rules are
taken CHUNK at a time, which bounds the expressions of a pass. What a rule's field has to be equal to
routes it: a row is put only to the rules that its own value of that field may meet.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..operators import filters
from ..operators.joins import first_in_band
from ..operators.sequences import bursts
from ..schema import Case
from ..session import written
from . import rules as R

CHUNK = 500
_META = (
    "rule int, kind string, keys array<string>, names array<string>, distinct string, some boolean, cmp string, least long, after long, cap long, biggest boolean, win long, id_ string, title_ string, severity_ string, "
    "confidence_ string, attack_ array<string>, tags_ array<string>, description_ string, flags_ array<struct<flag:string,rank:int>>, joins array<string>, then_severity string, then_title string, within long"
)


def _alone(rule: dict) -> bool:
    """Whether a rule asks for child tables or bodies, which are joins of its own."""
    return bool(re.search(r"'(attachments|urls)\.|'(bodyText|bodyHtml|headersText|visibleText)\b", str(rule)))


def _fields(names, ctx: filters.Context) -> dict[str, Column]:
    """The fields that can be resolved, as text."""
    out = {}
    for n in dict.fromkeys(names):
        try:
            out[n] = filters.resolve(n, ctx)[0].cast("string")
        except filters.FilterError:
            continue
    return out


def _met(size: Column) -> Column:
    """A count against each row's own comparator."""
    cmp, least = F.col("cmp"), F.col("least")
    return F.when(cmp == ">=", size >= least).when(cmp == ">", size > least).when(cmp == "<=", size <= least).when(cmp == "<", size < least).when(cmp == "!=", size != least).otherwise(size == least)


def _row_of(i: int, rule: dict, ctx: filters.Context) -> tuple:
    keys = list(rule.get("group_by") or [])
    names = list(_fields(rule.get("entities") or keys or R.ENTITIES[ctx.source], ctx))
    threshold = rule.get("threshold")
    cmp, least = V.threshold(threshold if threshold is not None else 1)
    kind = "row" if not keys and threshold is None else "burst" if rule.get("window") else "group"
    after = rule.get("collapse_after", R.COLLAPSE_AFTER)
    then = rule.get("then") or {}
    pairs = [str(j).partition("=") for j in then.get("join") or keys]
    flags = [(k, V.SEVERITIES.index(v)) for o in rule.get("then_flags") or [] for k, v in o.items()]
    return (
        i, kind, keys, names, rule.get("distinct"), bool(rule.get("any_in_group")), cmp, least, None if after is None else int(after), R.cap_of(rule), R.biggest(rule), V.duration_ms(rule["window"]) if rule.get("window") else None,
        rule["id"], rule.get("title") or rule["id"], rule.get("severity", "medium"), rule.get("confidence"), list(rule.get("attack") or []), list(rule.get("tags") or []), rule.get("description"), flags, [a for a, _, _ in pairs] if then else None,
        then.get("severity", rule.get("severity", "medium")) if then else None, then.get("title") if then else None, V.duration_ms(then.get("within", "1h")) if then else None,
    )


def _routable(cond: dict | None, name: str, ctx: filters.Context) -> set[str] | None:
    """The texts of a field outside which a tree can't hold; None if that can't be told by comparing texts."""
    values = R.pinned(cond, name)
    if values is None or not all(isinstance(v, (str, int)) and not isinstance(v, bool) and v != "" for v in values):
        return None
    if name not in ctx.schema.fieldNames():
        return None
    kind = ctx.schema[name].dataType
    if isinstance(kind, T.StringType):
        return {v.lower() for v in values} if all(isinstance(v, str) for v in values) else None
    if isinstance(kind, T.IntegralType):
        numbers = [filters._number(v) for v in values]
        return {str(int(n)) for n in numbers if n is not None and n == int(n)}
    return None


def _heads(cond: dict | None) -> set[str]:
    out = set()
    for key, value in (cond or {}).items():
        if re.match(r"(any|all)_of", key):
            for v in value if isinstance(value, list) else [value]:
                out |= _heads(v)
        else:
            out.add(key.partition("|")[0])
    return out


def routes(chunk: list[tuple[int, dict]], ctx: filters.Context) -> tuple[str | None, dict[tuple[int, ...], list[str]]]:
    """The field that tells most rules apart, and which of its values lead to which rules; rules that it doesn't pin are in none."""
    best, found = None, {}
    for name in sorted(set().union(*[_heads(r.get("where")) for _, r in chunk])):
        to: dict[str, list[int]] = {}
        own = {i: p for i, r in chunk if (p := _routable(r.get("where"), name, ctx)) is not None}
        for i, values in own.items():
            for v in values:
                to.setdefault(v, []).append(i)
        # What an average row is spared: rules that values other than its own lead to.
        spared = len(own) - sum(map(len, to.values())) / max(1, len(to))
        if spared > (best[0] if best else 0):
            groups: dict[tuple[int, ...], list[str]] = {}
            for v, rules in sorted(to.items()):
                groups.setdefault(tuple(rules), []).append(v)
            best, found = (spared, name, set(own)), groups
    return (best[1], found) if best else (None, {})


def _met_rules(conds: dict[int, Column], name: str | None, groups: dict[tuple[int, ...], list[str]]) -> Column:
    """The numbers of the rules that a row meets: those of its value's route, and those without a route."""
    these = lambda rules: F.array_compact(F.array(*[F.when(conds[i], F.lit(i)) for i in rules]).cast("array<int>"))
    routed = set().union(*groups) if groups else set()
    rest = these([i for i in conds if i not in routed])
    if not groups:
        return rest
    text = F.lower(F.col(f"`{name}`").cast("string"))
    found = None
    for rules, values in groups.items():
        found = F.when(text.isin(values), these(rules)) if found is None else found.when(text.isin(values), these(rules))
    return F.concat(found.otherwise(F.array().cast("array<int>")), rest)


def _hits(chunk: list[tuple[int, dict]], source: str, case: Case) -> DataFrame:
    """(rule, id, ts, fields, some, flags): a row of the table once for each rule it meets."""
    table = case[source]
    ctx = filters.Context.of(table, source, case.settings)
    ts = filters.TIME[source]
    met, some, names = {}, [], []
    by, groups = routes(chunk, ctx)
    routed = set().union(*groups) if groups else set()
    for i, rule in chunk:
        # What the route says already needn't be asked again.
        where = {k: v for k, v in (rule.get("where") or {}).items() if i not in routed or k not in (by, f"{by}|eq", f"{by}|in")}
        cond = V.truth(filters.tree(where, ctx))
        if rule.get("exclude"):
            cond = cond & ~V.truth(filters.tree(rule["exclude"], ctx))
        if (late := R.out_of_hours(rule, case, ts)) is not None:
            cond = cond & V.truth(late)
        met[i] = cond
        if rule.get("any_in_group"):
            some.append(F.when(V.truth(filters.tree(rule["any_in_group"], ctx)), F.lit(i)))
        names += [*(rule.get("group_by") or []), *(rule.get("entities") or rule.get("group_by") or R.ENTITIES[source]), *([rule["distinct"]] if rule.get("distinct") else [])]
    fields = _fields(names, ctx)
    every = F.map_from_arrays(F.array(*[F.lit(n) for n in fields]), F.array(*fields.values()))
    flags = F.col("flags").cast("array<string>") if "flags" in table.columns else F.lit(None).cast("array<string>")
    chosen = table.select("id", F.col(ts).alias("ts"), _met_rules(met, by, groups).alias("met"), F.array_compact(F.array(*some, F.lit(None).cast("int"))).alias("holds"), every.alias("fields"), flags.alias("flags")).where(F.size("met") > 0)
    return chosen.withColumn("rule", F.explode("met")).withColumn("some", F.array_contains("holds", F.col("rule"))).drop("met", "holds")


def _values(names: str) -> Column:
    return F.transform(names, lambda n: F.lower(F.coalesce(F.col("fields")[n], F.lit(""))))


def _entities(fields: Column, names: Column) -> Column:
    pairs = F.transform(names, lambda n: F.struct(n.alias("k"), F.substring(fields[n], 1, 200).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p: V.truth((p["v"] != "") & (p["v"] != "[]"))))


def _groups(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Groups that meet their rule's threshold: rule, g, ts, tsEnd, count, entities, refs, seen flags and the row that shows the weightiest.

    Groups are counted first, partly before the shuffle; only the rows of those that meet their threshold are looked at
    again. A group with no more rows than it may refer to gathers them, a larger one in slices.
    """
    sizes = hits.groupBy("rule", "g").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("ts"), F.max("ts").alias("tsEnd"), F.bool_or("some").alias("any"))
    different = hits.where("distinct is not null").select("rule", "g", F.lower(F.col("fields")[F.col("distinct")]).alias("v")).where("v <> ''").distinct().groupBy("rule", "g").agg(F.count(F.lit(1)).alias("d"))
    told = sizes.join(different, ["rule", "g"], "left").join(F.broadcast(meta.select("rule", "kind", "distinct", "cmp", "least", "some", "names")), "rule")
    count = F.when(F.col("distinct").isNotNull(), F.coalesce("d", F.lit(0))).otherwise(F.col("n"))
    told = told.withColumn("count", count).where((F.col("kind") == "row") | (_met(F.col("count")) & (~F.col("some") | F.col("any"))))
    told = written(told.select("rule", "g", "n", "ts", "tsEnd", "count", "names"), "groups")

    shown = F.filter("flags_", lambda x: V.truth(F.array_contains("flags", x["flag"])))
    rows = hits.select("rule", "g", "ts", "id", "fields", F.transform(shown, lambda x: x["flag"]).alias("_shown"), F.array_max(F.transform(shown, lambda x: x["rank"])).alias("_weight"))
    first = F.min(F.struct(F.col("ts").isNull().alias("n"), F.col("ts").alias("t"), "id", F.map_entries("fields").alias("fields"))).alias("first")
    ref = F.struct("ts", "id")
    more = [first, F.array_distinct(F.flatten(F.collect_set("_shown"))).alias("seen"), F.max(F.struct("_weight", F.col("id"))).alias("top")]
    small = rows.join(told.where(F.col("n") <= R.MOST_REFS).select("rule", "g"), ["rule", "g"]).groupBy("rule", "g").agg(F.array_sort(F.collect_list(ref)).alias("r"), *more)
    if not told.where(F.col("n") > R.MOST_REFS).isEmpty():
        sliced = rows.join(told.where(F.col("n") > R.MOST_REFS).select("rule", "g"), ["rule", "g"]).withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(32)))
        sliced = sliced.withColumn("_nth", F.row_number().over(W.partitionBy("rule", "g", "_slice").orderBy(F.col("ts").asc_nulls_last(), "id")))
        part = sliced.groupBy("rule", "g", "_slice").agg(F.collect_list(F.when(F.col("_nth") <= R.MOST_REFS, ref)).alias("r"), *more)
        large = part.groupBy("rule", "g").agg(F.slice(F.array_sort(F.flatten(F.collect_list("r"))), 1, R.MOST_REFS).alias("r"), F.min("first").alias("first"), F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.max("top").alias("top"))
        small = small.unionByName(large)
    out = told.join(small, ["rule", "g"])
    return out.select("rule", "g", F.lit(None).cast("long").alias("minute"), "ts", "tsEnd", "count", _entities(F.map_from_entries("first.fields"), F.col("names")).alias("entities"), F.transform("r", lambda x: x["id"]).alias("refs"), "seen", F.when(F.col("top._weight").isNotNull(), F.col("top.id")).alias("shows"))


def _bursts(hits: DataFrame, kinds: set[bool]) -> DataFrame:
    """Bursts of the rules that count rows, and of those that count values, as far as there are such rules."""
    having = hits.where("needs and some").select("rule", "g").distinct()
    held = hits.where("not needs").unionByName(hits.where("needs").join(having, ["rule", "g"], "left_semi"))
    parts = []
    for of_values in sorted(kinds):
        own = held.where("distinct is not null" if of_values else "distinct is null")
        what = F.col("fields")[F.col("distinct")] if of_values else None
        rows = own.withColumn("_all", F.map_entries("fields")).drop("some", "flags")
        found = bursts(rows, ["rule", "g"], "ts", F.col("win"), "", 0, what, ["_all", "names"], R.MOST_REFS, met=_met)
        parts.append(found.select("rule", "g", F.expr("start div 60000").alias("minute"), F.col("start").alias("ts"), F.col("end").alias("tsEnd"), "count", _entities(F.map_from_entries("_all"), F.col("names")).alias("entities"), "refs", F.array().cast("array<string>").alias("seen"), F.lit(None).cast("long").alias("shows")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _followed(found: DataFrame, chunk: list[tuple[int, dict]], meta: DataFrame, source: str, case: Case) -> DataFrame:
    """``found`` with the first follow-up by (time, id) within reach: r_t and r_id."""
    follow = None
    by_source: dict[str, list] = {}
    for i, rule in chunk:
        if rule.get("then"):
            by_source.setdefault(rule["then"].get("source") or source, []).append((i, rule))
    for other, own in by_source.items():
        table = case[other]
        ctx = filters.Context.of(table, other, case.settings)
        met, keys = [], []
        for i, rule in own:
            then = rule["then"]
            wanted = [b or a for a, _, b in (str(j).partition("=") for j in then.get("join") or rule.get("group_by") or [])]
            texts = F.array(*[F.lower(F.coalesce(filters.resolve(b, ctx)[0].cast("string"), F.lit(""))) for b in wanted]).cast("array<string>")
            met.append(F.when(V.truth(filters.tree(then["where"], ctx)), F.struct(F.lit(i).alias("rule"), texts.alias("j"))))
        rows = table.select(F.col("id"), F.col(filters.TIME[other]).alias("t"), F.explode(F.array_compact(F.array(*met))).alias("x")).select("id", "t", "x.rule", "x.j")
        follow = rows if follow is None else follow.unionByName(rows)
    if follow is None:
        return found.withColumns({"r_t": F.lit(None).cast("long"), "r_id": F.lit(None).cast("long")})
    reach = F.broadcast(meta.select("rule", "within"))
    mine = found.join(F.broadcast(meta.select("rule", "keys", "joins", "within")), "rule").where("joins is not null and ts is not null")
    mine = mine.select("rule", "key", "ts", "tsEnd", "within", F.transform("joins", lambda a: F.when(F.array_contains("keys", a), F.get(F.col("g"), F.array_position("keys", a).cast("int") - 1)).otherwise(F.lower(F.coalesce(F.col("entities")[a], F.lit(""))))).alias("j"))
    first = first_in_band(mine, follow.join(reach, "rule"), ["rule", "j"], ["key"], "ts", "tsEnd", "t", ["id"], F.col("within"))
    return found.join(first, "key", "left")


def run_set(rules: list[dict], case: Case, capped: bool = True) -> DataFrame:
    """The findings of all rules, each with at most its own number of them unless ``capped`` is false.

    Columns: ruleId, title, severity, key, ts, tsEnd, count, entities, refs,
    escalation, confidence, attack, tags, description.
    """
    spark = next(iter(case.tables.values())).sparkSession
    out = spark.createDataFrame([], R._schema())
    for source in ("events", "mails"):
        own = [r for r in rules if r.get("source", "events") == source and not (r.get("require_setting") and not case.settings.values(r["require_setting"]))]
        for r in own:
            if why := R.problem(r):
                raise R.RuleError(f"{r.get('id')}: {why}")
        for r in (r for r in own if _alone(r)):
            found = R.run_rule(r, case)
            out = out.unionByName(found.findings if capped else found.groups)
        together = [r for r in own if not _alone(r)]
        for start in range(0, len(together), CHUNK):
            out = out.unionByName(_pass(list(enumerate(together[start : start + CHUNK])), source, case, capped))
    return out


def _pass(chunk: list[tuple[int, dict]], source: str, case: Case, capped: bool) -> DataFrame:
    spark = case[source].sparkSession
    ctx = filters.Context.of(case[source], source, case.settings)
    own = [_row_of(i, r, ctx) for i, r in chunk]
    meta = spark.createDataFrame(own, _META)  # a row a rule, at most CHUNK
    kinds, folds = {o[1] for o in own}, any(o[1] == "row" and o[8] is not None for o in own)
    use = F.broadcast(meta.select("rule", "kind", "keys", "names", "distinct", F.col("some").alias("needs"), "cmp", "least", "after", "win", "flags_"))
    hits = _hits(chunk, source, case)
    hits = written(hits, "hits").join(use, "rule")
    number = lambda x: F.lit(x).cast("long")
    parts, many = [], F.lit(False)
    if "row" in kinds:
        if folds:
            n = hits.where("kind = 'row' and after is not null").groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))  # a row a rule
            n = F.broadcast(written(n, "rows"))
            hits = hits.join(n, "rule", "left")
            many = V.truth(F.col("rows") > F.col("after"))
        shown = F.filter("flags_", lambda x: V.truth(F.array_contains("flags", x["flag"])))
        single = hits.where((F.col("kind") == "row") & ~many)
        parts.append(single.select("rule", F.array(F.col("id").cast("string")).alias("g"), number(None).alias("minute"), "ts", F.col("ts").alias("tsEnd"), number(1).alias("count"), _entities(F.col("fields"), F.col("names")).alias("entities"), F.array("id").alias("refs"), F.transform(shown, lambda x: x["flag"]).alias("seen"), number(None).alias("shows"), number(None).alias("rows")))
    if "group" in kinds or folds:
        grouped = hits.withColumn("many", many).where("kind = 'group' or many").withColumn("g", F.when(F.col("many"), _values("names")).otherwise(_values("keys")))
        groups = _groups(grouped.where(F.col("many") | (F.size("keys") == 0) | F.exists("g", lambda v: v != "")), meta)
        parts.append(groups.join(n, "rule", "left").withColumn("rows", F.col("rows").cast("long")) if folds else groups.withColumn("rows", number(None)))
    if "burst" in kinds:
        rapid = hits.where("kind = 'burst'").drop("rows").withColumn("g", _values("keys")).where((F.size("keys") == 0) | F.exists("g", lambda v: v != ""))
        parts.append(_bursts(rapid, {o[4] is not None for o in own if o[1] == "burst"}).withColumn("rows", number(None)))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.join(F.broadcast(meta.select("rule", "id_", "severity_", "flags_", "kind", "biggest", "cap")), "rule")
    found = found.withColumn("key", F.concat_ws("|", "id_", F.array_join("g", R.SEPARATOR), F.col("minute").cast("string")))
    # Flags raise the severity in the order in which the rule names them.
    rank = F.array_position(F.array(*[F.lit(s) for s in V.SEVERITIES]), F.col("severity_")).cast("int") - 1
    raised = F.aggregate("flags_", F.struct(rank.alias("rank"), F.lit(None).cast("string").alias("flag")), lambda a, x: F.when(F.array_contains(F.col("seen"), x["flag"]) & (x["rank"] > a["rank"]), F.struct(x["rank"].alias("rank"), x["flag"].alias("flag"))).otherwise(a))
    found = found.withColumn("raised", raised).withColumn("severity", F.element_at(F.array(*[F.lit(s) for s in V.SEVERITIES]), F.col("raised.rank") + 1))
    shows = F.when(F.col("raised.flag").isNotNull() & F.col("shows").isNotNull() & ~F.array_contains("refs", F.col("shows")), F.array_append(F.slice("refs", 1, R.MOST_REFS - 1), F.col("shows"))).otherwise(F.col("refs"))
    found = found.withColumn("refs", shows).withColumn("escalation", F.coalesce("raised.flag", F.when(F.col("rows").isNotNull(), F.format_string("collapsed: %d matching rows", F.col("rows")))))
    if any(r.get("then") for _, r in chunk):
        found = _followed(written(found, "found"), chunk, meta, source, case).join(F.broadcast(meta.select("rule", "then_severity", "then_title")), "rule")
        hit = F.col("r_id").isNotNull()
        found = found.withColumn("title", F.when(hit, F.col("then_title"))).withColumn("severity", F.when(hit, F.col("then_severity")).otherwise(F.col("severity"))).withColumn("tsEnd", F.when(hit, F.greatest("tsEnd", "r_t")).otherwise(F.col("tsEnd")))
        found = found.withColumn("refs", F.when(hit & ~F.array_contains("refs", F.col("r_id")), F.array_append("refs", F.col("r_id"))).otherwise(F.col("refs"))).withColumn("escalation", F.when(hit, F.coalesce("then_title", F.lit("follow-up"))).otherwise(F.col("escalation")))
    else:
        found = found.withColumn("title", F.lit(None).cast("string"))
    if capped:
        order = F.when(F.col("kind") == "row", F.coalesce(F.when(F.col("rows").isNull(), F.col("ts")), F.col("count"))).when(F.col("biggest"), -F.col("count")).otherwise(F.col("count"))
        # The first of each slice first, so that no rule's findings are all sorted in one task.
        for by in (["rule", "_slice"], ["rule"]):
            sliced = found.withColumn("_slice", F.pmod(F.xxhash64("key"), F.lit(32)))
            found = sliced.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(order.asc_nulls_last(), "key"))).where(F.col("_place") <= F.col("cap")).drop("_slice")
    said = F.broadcast(meta.select("rule", "title_", "confidence_", "attack_", "tags_", "description_"))
    return found.join(said, "rule").select(
        F.col("id_").alias("ruleId"), F.coalesce("title", "title_").alias("title"), "severity", "key", "ts", "tsEnd", F.col("count").cast("long").alias("count"), "entities", "refs", "escalation",
        F.col("confidence_").alias("confidence"), F.col("attack_").alias("attack"), F.col("tags_").alias("tags"), F.col("description_").alias("description"),
    )
