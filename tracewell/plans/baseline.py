"""Senders against their own history, authentication regressions, and campaigns of alike messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V

# How many earlier messages make a sender known, and earlier passes a failure a regression.
COMMON, PASSES = 5, 3


def sender_history(mails: DataFrame, sender: str, ts: str, key: str = "id") -> DataFrame:
    """``mails`` with prior_count, first_seen and prevalence (new, rare or common) of the sender at that time."""
    w = W.partitionBy(sender).orderBy(F.col(ts), key)
    prior = F.row_number().over(w) - 1
    out = mails.withColumn("prior_count", prior.cast("long")).withColumn("first_seen", F.min(ts).over(W.partitionBy(sender)))
    return out.withColumn("prevalence", F.when(F.col("prior_count") == 0, "new").when(F.col("prior_count") < COMMON, "rare").otherwise("common"))


def auth_regression(mails: DataFrame, domain: str, ts: str, passed: Column, failed: Column, key: str = "id") -> DataFrame:
    """``mails`` with regression: it fails, and at least three earlier ones of the domain passed."""
    w = W.partitionBy(domain).orderBy(F.col(ts), key).rowsBetween(W.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(V.truth(passed).cast("long")).over(w), F.lit(0))
    return mails.withColumn("earlier_passes", earlier).withColumn("regression", (F.col("earlier_passes") >= PASSES) & V.truth(failed))


def solicited(mails: DataFrame, sender: str, ts: str, recipients: str, internal: Column, key: str = "id") -> DataFrame:
    """``mails`` with solicited: an internal sender wrote to this address before; null while none has written to anyone.

    First contacts are one row an address, joined back; "anyone yet" is the least of all first contacts.
    """
    out = mails.where(V.truth(internal)).select(F.explode(recipients).alias("addr"), F.col(ts).alias("t")).groupBy(F.lower("addr").alias("_addr")).agg(F.min("t").alias("_contact"))
    anyone = out.agg(F.min("_contact").alias("_anyone"))
    joined = mails.join(out, F.lower(F.col(sender)) == F.col("_addr"), "left").join(F.broadcast(anyone))  # one row
    answer = F.when(F.col("_anyone").isNull() | (F.col("_anyone") >= F.col(ts)), F.lit(None).cast("boolean")).otherwise(V.truth(F.col("_contact") < F.col(ts)))
    return joined.withColumn("solicited", answer).drop("_addr", "_contact", "_anyone")


# Marks of replies and forwards in several languages, how much of a subject counts, and the least that tells anything.
REPLY = r"^\s*(?:(?:re|fw|fwd|tr|aw|sv|vs|wg|r|i)\s*:\s*)+"
SUBJECT_CHARS, LEAST_CHARS, PARTS = 80, 8, 5


def skeleton(subject: Column) -> Column:
    """A subject without its variable parts: lower case, reply marks off, numbers as #, white space folded, 80 characters."""
    x = F.regexp_replace(F.lower(F.coalesce(subject, F.lit(""))), REPLY, "")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(x, r"[0-9]+", "#"), r"\s+", " ")), 1, SUBJECT_CHARS)


def fingerprint(subject: Column, domains: Column, hashes: Column, reply: Column | None = None) -> Column:
    """The first 16 digits of the SHA-1 of skeleton, five link domains and five attachment hashes.

    Null where nothing tells a campaign: all blank, or no link and no attachment and a
    subject that is short or a reply's (by its mark, or because ``reply`` says so).
    """
    listed = lambda c: F.slice(F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower))), 1, PARTS)
    bare = skeleton(subject)
    links, files = listed(domains), listed(hashes)
    alone = (F.size(links) == 0) & (F.size(files) == 0)
    answer = F.lower(F.coalesce(subject, F.lit(""))).rlike(REPLY)
    answer = answer | V.truth(reply) if reply is not None else answer
    joined = F.concat(bare, F.lit("|"), F.array_join(links, ","), F.lit("|"), F.array_join(files, ","))
    return F.when(~(alone & ((F.length(bare) < LEAST_CHARS) | answer)), F.substring(F.sha1(joined), 1, 16))


def campaigns(mails: DataFrame, print_col: str, sender: str, recipient: str, ts: str, least: int = 3) -> DataFrame:
    """Fingerprints sent at least ``least`` times: (fingerprint, n, senders, recipients, first, last)."""
    return mails.where(F.col(print_col).isNotNull()).groupBy(print_col).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(sender).alias("senders"), F.count_distinct(recipient).alias("recipients"), F.min(ts).alias("first"), F.max(ts).alias("last")).where(F.col("n") >= least)


def shared_addresses(df: DataFrame, org: str, person: str, address: str, share: float = 0.5) -> DataFrame:
    """Addresses used by more than a share of an organisation's people: (org, address, people, of)."""
    people = df.groupBy(org).agg(F.count_distinct(person).alias("of"))
    used = df.groupBy(org, address).agg(F.count_distinct(person).alias("people"))
    return used.join(people, org).where(F.col("people") > share * F.col("of"))


def prevalence(df: DataFrame, what: list[str], host: str) -> DataFrame:
    """On how many hosts each combination occurs."""
    return df.groupBy(*what).agg(F.count_distinct(host).alias("hosts"), F.count(F.lit(1)).alias("n"))


def verdicts(df: DataFrame, key: str, verdict: str) -> DataFrame:
    """The worst verdict of each key and how many say so."""
    # Verdicts from best to worst.
    order = F.array(*[F.lit(v) for v in ("unknown", "clean", "suspicious", "malicious")])
    rank = F.array_position(order, F.coalesce(F.lower(F.col(verdict)), F.lit("unknown"))).cast("int")
    ranked = df.withColumn("_rank", F.greatest(rank, F.lit(1)))
    out = ranked.groupBy(key).agg(F.max("_rank").alias("_worst"), F.count(F.lit(1)).alias("n"), F.sum((F.col("_rank") == 4).cast("long")).alias("malicious"), F.sum((F.col("_rank") == 3).cast("long")).alias("suspicious"))
    return out.select(key, F.element_at(order, F.col("_worst")).alias("worst"), "n", "malicious", "suspicious")


def enrichment_summary(mails: DataFrame) -> DataFrame:
    """One row: mails, new senders, unsolicited new ones, regressions, campaigns and the largest (id, prevalence, solicited, regression, campaign)."""
    size = mails.where("campaign is not null").groupBy("campaign").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("campaigns"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    new = F.col("prevalence") == "new"
    sums = mails.agg(F.count(F.lit(1)).alias("mails"), F.count(F.when(new, 1)).alias("new_senders"), F.count(F.when(new & (F.col("solicited") == F.lit(False)), 1)).alias("unsolicited_new"), F.count(F.when(F.col("regression"), 1)).alias("regressions"))
    return sums.join(F.broadcast(size))  # one row each


# Families of flags that count once, by how their names begin.
FAMILIES = {"authentication": ("spf_", "dkim_", "dmarc_", "compauth_", "returnpath_"), "identity": ("sender_", "replyto_", "display_name_", "mixed_script_display", "internal_spoof"), "wording": ("lexicon_",), "links": ("url_",), "content": ("bec_pattern", "credential_phishing_pattern", "html_form_password", "html_form_external", "hidden_text", "bidi_override")}


def score_groups(mails: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, family, points): the weightiest flag of each family; attachments are scored elsewhere, flags without a weight don't count."""
    family = F.coalesce(*[F.when(V.any_of([F.col("flag").startswith(p) for p in ps]), name) for name, ps in FAMILIES.items()], F.lit("context"))
    rows = mails.select("id", F.explode(F.array_distinct("flags")).alias("flag")).where("not startswith(flag, 'att_')").join(weights.select("flag", "weight"), "flag")
    return rows.groupBy("id", family.alias("family")).agg(F.max("weight").alias("points"))
