"""What belongs to what: logons and tickets, services and shares, replies, artifacts, owners, and how surely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import graph, joins

# How long before a logon its ticket is asked for, how long after a share is used a service belongs to it, and how many stories an incident holds.
TICKET_BEFORE, SERVICE_AFTER, INCIDENT_MOST = 60_000, 300_000, 20
CONFIDENCES = ("weak", "medium", "strong")


def authentications(logons: DataFrame, tickets: DataFrame, before: int = TICKET_BEFORE) -> DataFrame:
    """(id, ticket, confidence): a logon's ticket by its GUID (strong), else the nearest of its account for its host within a minute before (medium).

    ``logons`` and ``tickets`` have id, guid, account, host and ts.
    """
    known = logons.where("guid is not null and guid <> ''").join(tickets.where("guid is not null").groupBy("guid").agg(F.min(F.struct("ts", "id")).alias("_t")), "guid").select("id", F.col("_t.id").alias("ticket"), F.lit("strong").alias("confidence"))
    rest = logons.join(known.select("id"), "id", "left_anti")
    near = joins.asof(rest, tickets.select("account", "host", F.col("ts").alias("asked"), F.col("id").alias("ticket")), ["account", "host"], "ts", "asked", ["ticket"], "backward", before)
    return known.unionByName(near.where("r_ticket is not null").select("id", F.col("r_ticket").alias("ticket"), F.lit("medium").alias("confidence")))


def services_after_shares(services: DataFrame, hops: DataFrame, after: int = SERVICE_AFTER) -> DataFrame:
    """(id, hop): the latest way into the host (id, host, start, end) that begins before the service and ends at most five minutes before it."""
    # A way in lies in each stretch of time that it and what it may lead to touch, a service in its own: a busy host is many stretches.
    cut = lambda t: F.floor(t / (12 * after)).cast("long")
    until = F.greatest(F.col("end"), F.col("start")) + after
    ways = hops.select(F.col("id").alias("hop"), F.col("host").alias("_host"), "start", until.alias("_until")).where("start is not null and _until is not null")
    ways = ways.withColumn("_cut", F.explode(F.sequence(cut(F.col("start")), cut(F.col("_until")))))
    near = services.select("id", "host", "ts", cut(F.col("ts")).alias("_at")).join(ways, (F.col("host") == F.col("_host")) & (F.col("_at") == F.col("_cut")) & F.col("ts").between(F.col("start"), F.col("_until")))
    return near.groupBy("id").agg(F.max(F.struct("start", "hop"))["hop"].alias("hop"))


def sole_process(rows: DataFrame, snapshot: DataFrame, on: list[str], process: str) -> DataFrame:
    """``rows`` with the process of a snapshot that alone has its keys; none where several have."""
    sole = snapshot.groupBy(*on).agg(F.count_distinct(process).alias("_n"), F.min(process).alias(process)).where("_n = 1").drop("_n")
    return rows.join(sole, on, "left")


def rows_of_findings(findings: DataFrame, events: DataFrame) -> DataFrame:
    """(key, refs): ids of the rows that another engine's findings (key, computer, channel, recordId) are about."""
    named = events.where("recordId is not null").select("computer", "channel", "recordId", "id")
    hits = findings.join(named, ["computer", "channel", "recordId"]).groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("refs"))
    return findings.select("key").distinct().join(hits, "key", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<long>")))


def host_coverage(events: DataFrame, host: str, kinds: dict[str, Column]) -> DataFrame:
    """(host, n, first, last, a count for each kind of record): what evidence a host has."""
    return events.where(F.col(host).isNotNull()).groupBy(F.lower(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), *[F.count(F.when(V.truth(c), 1)).alias(k) for k, c in kinds.items()])


def replies(seeds: DataFrame, mails: DataFrame, within: int) -> DataFrame:
    """(seed, reply): messages of a seed's recipient to its sender, or in its thread, at most ``within`` ms after it.

    ``seeds`` have id, ts, recipient, sender and messageId; ``mails`` id, ts, sender, toList and inReplyTo.
    """
    to = mails.select(F.col("id").alias("reply"), F.col("ts").alias("at"), F.lower("sender").alias("who"), F.explode_outer("toList").alias("to"), F.trim("inReplyTo").alias("thread"))
    first = seeds.select(F.col("id").alias("seed"), "ts", F.lower("recipient").alias("who"), F.lower("sender").alias("from"), F.trim("messageId").alias("mid"))
    # By who wrote to whom within the band, and by who wrote in which thread: two equi-joins, neither pairs all of a recipient.
    answers = to.where("to is not null").select(F.col("reply"), F.col("at"), F.col("who"), F.lower("to").alias("from"))
    by_sender = joins.band(first.where("`from` is not null"), answers, ["who", "from"], "ts", "at", 0, within).select("seed", F.col("r_reply").alias("reply"))
    threads = to.where("thread <> ''").select("reply", "at", F.col("who").alias("_who"), "thread").distinct()
    by_thread = first.join(threads, (F.col("who") == F.col("_who")) & (F.col("mid") == F.col("thread"))).where((F.col("at") - F.col("ts")).between(0, within)).select("seed", "reply")
    return by_sender.unionByName(by_thread).where("seed <> reply").distinct()


#: What artifacts look like in a text: addresses, host names, hashes.
_ARTIFACT = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|\b[0-9a-f]{64}\b|\b[0-9a-f]{32}\b|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b|\b[a-z0-9-]+(?:\.[a-z0-9-]+)+\b"


def artifact_hits(texts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(id, artifact): artifacts named in a text (id, text).

    The text's own addresses, host names and hashes are drawn out and joined, so texts
    and artifacts are never paired. A host name counts with all that it is below.
    """
    found = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_ARTIFACT), F.lit(0)))).alias("_x"))
    parts = F.split("_x", r"\.")
    suffixes = F.when(F.col("_x").contains("@") | F.col("_x").rlike(r"^[0-9.]+$"), F.array("_x")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    return found.select("id", F.explode(suffixes).alias("artifact")).distinct().join(artifacts.select(F.lower("artifact").alias("artifact")).distinct(), "artifact").select("id", "artifact")


def owner_chains(campaigns: DataFrame, chains: DataFrame, before: int, within: int) -> DataFrame:
    """(campaign, chain): the best chain of a campaign's account in whose window the campaign begins; of equals the least."""
    own = joins.band(chains.select("identity", F.col("id").alias("chain"), "score", F.col("ts").alias("t")), campaigns.select("identity", F.col("id").alias("campaign"), F.col("start").alias("s")), ["identity"], "t", "s", before, within)
    return own.groupBy(F.col("r_campaign").alias("campaign")).agg(F.min(F.struct(-F.col("score"), F.col("chain")))["chain"].alias("chain"))


def surest(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(form, label, confidence): how surely a form is a label's: the weakest step of the surest path between them.

    Forms joined by strong edges alone are strong, by strong and medium ones medium,
    and so on: a component a level, no walking. ``edges`` have a, b and confidence.
    """
    found = None
    for i in range(len(CONFIDENCES) - 1, -1, -1):
        own = graph.components(edges.where(F.col("confidence").isin(*CONFIDENCES[i:])).select("a", "b"))
        of = labels.select(F.col("label").alias("id"), "label").join(own, "id", "left").select("label", F.coalesce("root", "id").alias("root"))
        reach = own.join(of, "root").select(F.col("id").alias("form"), "label", F.lit(i).alias("level"))
        reach = reach.unionByName(labels.select(F.col("label").alias("form"), "label", F.lit(i).alias("level")))
        found = reach if found is None else found.unionByName(reach)
    best = found.groupBy("form", "label").agg(F.max("level").alias("level"))
    return best.select("form", "label", F.element_at(F.array(*[F.lit(c) for c in CONFIDENCES]), F.col("level") + 1).alias("confidence"))


def standing(flags: DataFrame) -> DataFrame:
    """(story, standing): what a host's story stands on: a critical finding, a measured quiet rule, or two phases; null is a lone lead.

    ``flags`` have story, severity, phase, quiet (measured and not seen on clean machines) and noisy.
    """
    rank = V.severity_rank(F.col("severity"))
    rows = flags.groupBy("story").agg(F.bool_or(rank >= 4).alias("critical"), F.bool_or((rank >= 2) & V.truth(F.col("quiet"))).alias("measured"), F.count_distinct(F.when((rank >= 2) & ~V.truth(F.col("noisy")), F.col("phase"))).alias("phases"))
    return rows.select("story", F.when(F.col("critical"), "critical").when(F.col("measured"), "measured").when(F.col("phases") >= 2, "phases").alias("standing"))


def three_in_three(firm: DataFrame) -> DataFrame:
    """(story, three): whether three techniques can be matched with three phases one to one (story, technique, phase).

    They can unless two lines cover all pairs: two techniques, two phases, or one of each.
    """
    pairs = firm.select("story", "technique", "phase").distinct()
    size = pairs.groupBy("story").agg(F.count(F.lit(1)).alias("e"), F.count_distinct("technique").alias("t"), F.collect_set("phase").alias("ps"))  # phases are few
    by_t, by_p = pairs.groupBy("story", "technique").agg(F.count(F.lit(1)).alias("dt"), F.collect_set("phase").alias("own")), pairs.groupBy("story", "phase").agg(F.count(F.lit(1)).alias("dp"))
    grid = by_t.join(size, "story").withColumn("phase", F.explode("ps")).join(by_p, ["story", "phase"])
    covered = grid.groupBy("story").agg(F.max(F.col("dt") + F.col("dp") - F.array_contains("own", F.col("phase")).cast("int") - F.col("e")).alias("gap"), F.first("t").alias("t"), F.first(F.size("ps")).alias("p"))
    return covered.select("story", ((F.col("t") >= 3) & (F.col("p") >= 3) & (F.col("gap") < 0)).alias("three"))


def story_incidents(stories: DataFrame, links: DataFrame, most: int = INCIDENT_MOST) -> DataFrame:
    """(story, incident, place): stories (story, score) that medium or strong links join, the best ``most`` of each."""
    joined = graph.components(links.where("confidence in ('medium', 'strong')").select("a", "b"))
    rows = stories.join(joined, F.col("story") == F.col("id"), "left").select("story", F.coalesce("root", "story").alias("incident"), "score")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("incident").orderBy(F.desc("score"), "story"))).where(F.col("place") <= most).drop("score")


def resolved_users(forms: DataFrame, internal: list[str]) -> DataFrame:
    """(form, key): accounts in their spellings as name@realm.

    A short realm becomes the one full realm that begins with it; a plain name takes the
    one realm it is seen in, or the one that is internal.
    """
    low = F.col("form")
    realm = F.when(low.contains("\\"), F.concat(F.lit("netbios:"), F.substring_index(low, "\\", 1))).when(low.contains("@"), F.substring_index(low, "@", -1))
    name = F.when(low.contains("\\"), F.substring_index(low, "\\", -1)).otherwise(F.substring_index(low, "@", 1))
    parsed = forms.select(F.lower(F.trim("form")).alias("form")).distinct().select("form", realm.alias("realm"), name.alias("name")).where("name <> ''")
    inside = [d.strip().lower() for d in internal if d.strip()]
    full = parsed.where("realm is not null and not startswith(realm, 'netbios:')").select(F.col("realm").alias("dns"))
    full = full.unionByName(parsed.sparkSession.createDataFrame([(d,) for d in inside], "dns string")).distinct() if inside else full.distinct()
    short = full.groupBy(F.concat(F.lit("netbios:"), F.split_part("dns", F.lit("."), F.lit(1))).alias("realm")).agg(F.count(F.lit(1)).alias("n"), F.min("dns").alias("dns")).where("n = 1").drop("n")
    placed = parsed.join(short, "realm", "left").select("form", "name", F.coalesce("dns", "realm").alias("realm"))
    within = V.any_of([V.truth((F.col("realm") == d) | F.col("realm").endswith("." + d)) for d in inside])
    seen = placed.where("realm is not null").select("name", "realm").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("realm").alias("only"), F.count(F.when(within, 1)).alias("m"), F.min(F.when(within, F.col("realm"))).alias("own"))
    guess = F.when(F.col("n") == 1, F.col("only")).when(F.col("m") == 1, F.col("own"))
    return placed.join(seen, "name", "left").select("form", F.concat("name", F.coalesce(F.concat(F.lit("@"), F.coalesce("realm", guess)), F.lit(""))).alias("key"))
