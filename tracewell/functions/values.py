"""Scalar expressions: truth of nulls, JSON fields, addresses, hours, thresholds, names and domains."""

from __future__ import annotations

import ipaddress
import operator
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
_COMPARE = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "==": operator.eq, "=": operator.eq, "!=": operator.ne}


def truth(c: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(c, F.lit(False))


def any_of(parts: list[Column]) -> Column:
    return reduce(operator.or_, parts) if parts else F.lit(False)


def all_of(parts: list[Column]) -> Column:
    return reduce(operator.and_, parts) if parts else F.lit(True)


def duration_ms(v: int | float | str) -> int:
    """'5m', '2d' or a number of seconds, in milliseconds."""
    if isinstance(v, (int, float)):
        return int(v * 1000)
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h|d|w)?\s*", v)
    if not m:
        raise ValueError(f"not a duration: {v!r}")
    return int(float(m[1]) * _UNITS[m[2] or "s"])


def threshold(v: int | str, bare: str = ">=") -> tuple[str, int]:
    """'< 500' or a number as comparator and count; a bare number gets ``bare``."""
    if isinstance(v, int):
        return bare, v
    m = re.fullmatch(r"\s*(>=|<=|==|=|!=|>|<)?\s*(\d+)\s*", str(v))
    if not m:
        raise ValueError(f"not a threshold: {v!r}")
    return m[1] or bare, int(m[2])


def meets(c: Column, comparator: str, n: int) -> Column:
    return _COMPARE[comparator](c, F.lit(n))


def json_field(c: Column, key: str) -> Column:
    """The text of one key; a dot in it is part of the key."""
    escaped = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.get_json_object(c, f"$['{escaped}']")


def ipv4_number(c: Column) -> Column:
    """The address as a number; null for anything else."""
    part = lambda i: F.split_part(c, F.lit("."), F.lit(i)).try_cast("long")
    number = part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)
    return F.when(c.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), number)


def ipv6_hex(c: Column) -> Column:
    """The 32 hex digits of an address, zone dropped and '::' filled in; null for anything else."""
    a = F.lower(F.regexp_replace(c, "%.*$", ""))
    groups = lambda i: F.filter(F.split(F.split_part(a, F.lit("::"), F.lit(i)), ":"), lambda g: g != "")
    padded = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")
    head, tail = groups(1), groups(2)
    filled = F.concat(padded(head), F.repeat(F.lit("0"), (8 - F.size(head) - F.size(tail)) * 4), padded(tail))
    return F.when(a.rlike("^[0-9a-f:]+$") & a.contains(":"), filled)


def in_networks(c: Column, networks: list[str]) -> Column:
    """Whether an address is in one of the networks or is one of the addresses given."""
    parts = []
    for net in networks:
        try:
            n = ipaddress.ip_network(net.strip(), strict=False)
        except ValueError:
            parts.append(F.lower(c) == net.strip().lower())
            continue
        if n.version == 4:
            parts.append(ipv4_number(c).between(int(n.network_address), int(n.broadcast_address)))
        else:
            whole, rest = divmod(n.prefixlen, 4)
            digits = f"{int(n.network_address):032x}"
            h = ipv6_hex(c)
            same = h.startswith(digits[:whole]) if whole else h.isNotNull()
            if rest:
                low = int(digits[whole], 16) >> (4 - rest) << (4 - rest)
                same = same & F.substring(h, whole + 1, 1).isin(*[f"{x:x}" for x in range(low, low + (1 << (4 - rest)))])
            parts.append(same)
    return truth(any_of([truth(p) for p in parts]))


def local_time(ms: Column, tz: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ms), tz)


def local_hour(ms: Column, tz: str) -> Column:
    return F.hour(local_time(ms, tz))


def weekday(ms: Column, tz: str) -> Column:
    """Sunday is 0."""
    return F.dayofweek(local_time(ms, tz)) - 1


def within_hours(hour: Column, start: int, end: int) -> Column:
    """From ``start`` to before ``end``; over midnight if start isn't smaller."""
    return hour.between(start, end - 1) if start < end else ~hour.between(end, start - 1)


def normal_name(text: str | None) -> str:
    """Accents off, lower case, words in order."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return " ".join(sorted(re.findall(r"[^\W_]+", plain.lower())))


@F.pandas_udf(T.StringType())
def normal_names(names: pd.Series) -> pd.Series:
    return names.map(normal_name)


# Suffixes under which names are registered one level deeper.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.sg", "com.tr", "gob.es", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")


def registrable(host: Column) -> Column:
    """The part of a host name that is registered; addresses stay whole."""
    h = F.lower(F.rtrim(host, F.lit(".")))
    parts = F.split(h, r"\.")
    last = lambda n: F.array_join(F.slice(parts, -F.least(F.lit(n), F.size(parts)), F.least(F.lit(n), F.size(parts))), ".")
    return F.when(h.rlike(r"^[0-9.]+$") | h.contains(":"), h).otherwise(F.when(last(2).isin(*SUFFIXES), last(3)).otherwise(last(2)))


def domain_in(c: Column, domains: list[str]) -> Column:
    """Equal to one of the domains, or below it."""
    return any_of([truth((c == d) | c.endswith("." + d)) for d in (x.lower() for x in domains)])


def risk_band(risk: Column) -> Column:
    # The bands' lower ends.
    return F.when(risk >= 80, "critical").when(risk >= 60, "high").when(risk >= 40, "medium").when(risk >= 20, "low").otherwise("info")


# Severities from least to most.
SEVERITIES = ("info", "low", "medium", "high", "critical")


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower(c)).cast("int") - 1


def risk_score(points: Column) -> Column:
    """The largest of an array of points and a quarter of up to 30 of each of the next seven, 100 at most."""
    by_size = F.sort_array(F.coalesce(points, F.array().cast("array<int>")), asc=False)
    rest = F.aggregate(F.slice(by_size, 2, 7), F.lit(0).cast("long"), lambda a, w: a + F.floor(F.least(w, F.lit(30)) / 4))
    return F.least(F.lit(100), F.coalesce(F.get(by_size, F.lit(0)), F.lit(0)) + rest)


def named_codes(c: Column, names: dict[str, str]) -> Column:
    """A list of codes like %%4416 with the names of those known in a line below."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    found = F.array_compact(F.transform(F.regexp_extract_all(c, F.lit("%%([0-9]+)"), F.lit(1)), lambda x: known[x]))
    return F.when(_filled(found), F.concat(c, F.lit("\n"), F.array_join(found, " "))).otherwise(c)


def _filled(c: Column) -> Column:
    return truth(F.size(c) > 0)
