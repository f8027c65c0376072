"""Links and HTML: extraction, parts, flags, defanging and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import registrable, truth

URL = r"(?i)\b(?:https?|ftp)://[^\s<>\"']+"


def urls_in(text: Column) -> Column:
    """The distinct links of a text, without closing punctuation."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]}]+$", "")))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def scheme_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))


def fragment_of(url: Column) -> Column:
    return F.when(F.instr(url, "#") > 0, F.substring_index(url, "#", -1))


def subdomain_of(host: Column) -> Column:
    base = registrable(host)
    return F.when(host.endswith(F.concat(F.lit("."), base)), F.substring(host, F.lit(1), (F.length(host) - F.length(base) - 1).cast("int"))).otherwise(F.lit(""))


def url_flags(url: Column) -> Column:
    """What is odd about a link, as a list in fixed order."""
    host = host_of(url)
    checks = {
        "ip-host": host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"),
        "punycode": host.contains("xn--"),
        "user-info": url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@"),
        "odd-port": url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:\d+") & ~url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:(80|443)([/?#]|$)"),
        "many-subdomains": F.size(F.split(host, r"\.")) > 4,
        "plain-http": url.rlike("^(?i)http://"),
        "encoded": url.rlike("%[0-9A-Fa-f]{2}"),
        "long": F.length(url) > 200,
        "executable": url.rlike(r"(?i)\.(exe|scr|js|vbs|hta|msi|jar|bat|ps1|iso|lnk)([?#]|$)"),
    }
    return F.array_compact(F.array(*[F.when(truth(c), F.lit(n)) for n, c in checks.items()]))


def defang(url: Column) -> Column:
    return F.replace(F.regexp_replace(url, "^(?i)http", "hxxp"), F.lit("."), F.lit("[.]"))


def refang(url: Column) -> Column:
    return F.replace(F.replace(F.regexp_replace(url, "^(?i)hxxp", "http"), F.lit("[.]"), F.lit(".")), F.lit("[:]"), F.lit(":"))


def html_text(html: Column) -> Column:
    """What a page shows: scripts, styles, comments and tags off, common entities read, white space folded."""
    x = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t\x0B\f\r]+", " "), r" *\n[ \n]*", "\n"))


def csv_safe(c: Column) -> Column:
    """A cell that a spreadsheet won't take for a formula."""
    return F.when(c.rlike(r"^[=+@\t\r-]"), F.concat(F.lit("'"), c)).otherwise(c)
