"""Message headers, look-alike domains and words that lure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

# Characters that pass for others, and words by what they play on.
CONFUSABLE = ("0135$|", "olessl")
LEXICON = {
    "urgency": ("urgent", "immediately", "asap", "final notice", "expires today"),
    "credentials": ("password", "verify your account", "sign in", "log in", "confirm your identity"),
    "payment": ("invoice", "wire transfer", "bank details", "gift card", "payment"),
    "delivery": ("parcel", "shipment", "delivery failed", "tracking number"),
}


def unfolded(headers: Column) -> Column:
    """Headers with each on one line."""
    return F.regexp_replace(headers, r"\r?\n[ \t]+", " ")


def header(headers: Column, name: str) -> Column:
    """The values of a header, in order."""
    found = F.regexp_extract_all(unfolded(headers), F.lit(rf"(?im)^{name}:[ \t]*(.*)$"), F.lit(1))
    return F.transform(found, lambda v: F.trim(F.regexp_replace(v, "\r$", "")))


def received_chain(headers: Column) -> Column:
    """The relays, the first one first: array<struct<from, by, ip>>."""
    part = lambda v, p: F.nullif(F.regexp_extract(v, p, 1), F.lit(""))
    hops = F.transform(header(headers, "Received"), lambda v: F.struct(F.lower(part(v, r"(?i)\bfrom\s+([^\s;()]+)")).alias("from"), F.lower(part(v, r"(?i)\bby\s+([^\s;()]+)")).alias("by"), part(v, r"[\[(]((?:\d{1,3}\.){3}\d{1,3}|[0-9a-fA-F]*:[0-9a-fA-F:]+)[\])]").alias("ip")))
    return F.reverse(hops)


def origin_ip(headers: Column, internal: list[str] | None = None) -> Column:
    """The first relay's address that is neither private nor internal."""
    private = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "fc00::/7", "fe80::/10", "::1", *(internal or [])]
    public = F.filter(received_chain(headers), lambda h: h["ip"].isNotNull() & ~V.in_networks(h["ip"], private))
    return F.get(public, F.lit(0))["ip"]


def auth_result(headers: Column, method: str) -> Column:
    """What the first Authentication-Results header says of spf, dkim, dmarc or compauth."""
    return F.nullif(F.lower(F.regexp_extract(F.get(header(headers, "Authentication-Results"), F.lit(0)), rf"(?i)\b{method}\s*=\s*([a-z]+)", 1)), F.lit(""))


def skeleton(domain: Column) -> Column:
    """A domain's label as it looks at a glance."""
    label = F.split_part(V.registrable(F.lower(domain)), F.lit("."), F.lit(1))
    plain = F.translate(label, *CONFUSABLE)
    for pair, one in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("-", "")):
        plain = F.replace(plain, F.lit(pair), F.lit(one))
    return plain


def lookalike(domain: Column, brands: list[str]) -> Column:
    """The first brand domain that this one resembles without being it or below it: equal at a glance, one letter off, or with the name inside."""
    label = F.split_part(V.registrable(F.lower(domain)), F.lit("."), F.lit(1))
    tests = []
    for brand in brands:
        name = brand.lower().split(".")[0]
        own = V.registrable(F.lower(domain)) == brand.lower()
        alike = skeleton(domain) == skeleton(F.lit(brand))
        near = (F.levenshtein(label, F.lit(name)) == 1) if len(name) >= 5 else F.lit(False)
        inside = label.contains(name) if len(name) >= 5 else F.lit(False)
        tests.append(F.when(V.truth(~own & (alike | near | inside)), F.lit(brand)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def lexicon_hits(text: Column, lexicon: dict[str, tuple[str, ...]] = LEXICON) -> Column:
    """How often words of each kind occur, as a struct."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.struct(*[F.regexp_count(low, F.lit("|".join(words))).cast("long").alias(kind) for kind, words in lexicon.items()])


def mail_flags(df_columns: list[str], internal_domains: list[str], brands: list[str]) -> Column:
    """What is odd about a message, from the columns it has, as a list in fixed order."""
    c = lambda n: F.col(n) if n in df_columns else F.lit(None).cast("string")
    outside = ~V.domain_in(F.lower(c("fromDomain")), internal_domains)
    checks = {
        "spf-fail": F.lower(c("spf")).isin("fail", "softfail"), "dkim-fail": F.lower(c("dkim")) == "fail", "dmarc-fail": F.lower(c("dmarc")) == "fail",
        "reply-elsewhere": outside & (F.lower(c("replyToDomain")) != F.lower(c("fromDomain"))), "lookalike": lookalike(c("fromDomain"), [*internal_domains, *brands]).isNotNull(),
        "name-is-address": c("fromName").contains("@") & ~F.lower(c("fromName")).contains(F.lower(c("fromAddr"))),
        "own-domain-unproven": V.domain_in(F.lower(c("fromDomain")), internal_domains) & (F.lower(c("spf")) != "pass"),
    }
    return F.array_compact(F.array(*[F.when(V.truth(t), F.lit(n)) for n, t in checks.items()]))


# Points of each flag.
POINTS = {"spf-fail": 15, "dkim-fail": 10, "dmarc-fail": 20, "reply-elsewhere": 15, "lookalike": 35, "name-is-address": 20, "own-domain-unproven": 25}


def risk_of(flags: Column) -> Column:
    """0 to 100 from a message's flags."""
    points = F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv])
    return V.risk_score(F.transform(flags, lambda f: F.coalesce(points[f], F.lit(5))))
