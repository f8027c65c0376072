"""The case's tables. Times are epoch milliseconds; everything may be null."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"text": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "bool": T.BooleanType(), "list": T.ArrayType(T.StringType()), "double": T.DoubleType()}

EVENTS = {
    "id": "long", "ts": "long", "time": "text", "recordId": "long", "eventId": "int", "provider": "text", "channel": "text", "computer": "text", "level": "text",
    "targetUser": "text", "targetDomain": "text", "subjectUser": "text", "subjectDomain": "text", "logonType": "int", "logonId": "text", "subjectLogonId": "text", "logonGuid": "text", "ipAddress": "text", "ipPort": "int", "workstation": "text",
    "processName": "text", "processId": "text", "parentProcessName": "text", "parentProcessId": "text", "commandLine": "text", "image": "text", "parentImage": "text", "hashes": "text",
    "serviceName": "text", "taskName": "text", "targetFilename": "text", "targetObject": "text", "destinationIp": "text", "destinationHostname": "text", "queryName": "text", "scriptBlockText": "text",
    "operation": "text", "status": "text", "upn": "text", "userAgent": "text", "recordKey": "text", "evidenceId": "text", "data": "text", "raw": "text",
}
MAILS = {
    "id": "long", "date": "long", "messageId": "text", "subject": "text", "fromAddr": "text", "fromName": "text", "fromDomain": "text", "fromRegistrable": "text", "senderAddr": "text", "replyToDomain": "text",
    "toList": "list", "ccList": "list", "bccList": "list", "replyToList": "list", "to": "text", "cc": "text", "bcc": "text", "replyTo": "text", "spf": "text", "dkim": "text", "dmarc": "text", "compauth": "text", "auth": "text", "lookalike": "text",
    "originIp": "text", "flags": "list", "risk": "int", "reputationWorst": "text", "reputationOriginIp": "text", "snippet": "text", "campaignId": "text", "hasAttachments": "bool", "evidenceId": "text",
}
ATTACHMENTS = {"id": "long", "mailId": "long", "name": "text", "ext": "text", "realExt": "text", "realMime": "text", "size": "long", "sha256": "text", "md5": "text", "risk": "int", "flags": "list", "category": "text", "inline": "bool", "details": "text", "date": "long", "fromAddr": "text", "mailSubject": "text"}
URLS = {"id": "long", "mailId": "long", "url": "text", "normalized": "text", "defanged": "text", "host": "text", "domain": "text", "scheme": "text", "flags": "list", "text": "text", "source": "text", "date": "long"}
BODIES = {"mailId": "long", "bodyText": "text", "bodyHtml": "text", "headersText": "text", "visibleText": "text"}
IOCS = {"kind": "text", "value": "text", "evidenceId": "text", "count": "long", "firstSeen": "long", "lastSeen": "long", "sources": "list"}
TABLES = {"events": EVENTS, "mails": MAILS, "attachments": ATTACHMENTS, "urls": URLS, "mail_bodies": BODIES, "iocs": IOCS}

FINDING = "ruleId string, title string, severity string, key string, ts long, tsEnd long, count long, entities map<string,string>, refs array<long>, escalation string, confidence string, attack array<string>, tags array<string>, description string"


def struct(table: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in TABLES[table].items()])


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` in the table's columns and types: what fails to cast is null, missing columns are null, unknown ones are kept."""
    out = []
    for name, kind in TABLES[table].items():
        if name not in df.columns:
            out.append(F.lit(None).cast(_TYPES[kind]).alias(name))
        elif kind == "bool":
            v = F.lower(F.col(name).cast("string"))
            out.append(F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False).alias(name))
        elif kind in ("int", "long", "double"):
            out.append(F.col(name).try_cast(_TYPES[kind]).alias(name))
        elif kind == "text" and isinstance(df.schema[name].dataType, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(name).alias(name))
        else:
            out.append(F.col(name).cast(_TYPES[kind]).alias(name))
    return df.select(*out, *[c for c in df.columns if c not in TABLES[table]])


@dataclass
class Settings:
    """Lists and hours that filters and rules refer to."""

    lists: dict[str, list[str]] = field(default_factory=dict)
    hours: tuple[int, int] = (8, 19)
    tz: str = "UTC"
    weekend: tuple[int, ...] = (0, 6)  # Sunday is 0

    def values(self, name: str) -> list[str]:
        return [v for v in self.lists.get(name, []) if v not in (None, "")]


@dataclass
class Case:
    """The tables of one case by name."""

    tables: dict[str, DataFrame]
    settings: Settings = field(default_factory=Settings)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def get(self, name: str) -> DataFrame | None:
        return self.tables.get(name)
