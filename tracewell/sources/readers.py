"""Readers: event exports, audit and sign-in records, collection files, mailboxes, archives.

Text formats are read by Spark's own readers. Binary containers come through
``binaryFile`` and are taken apart inside the tasks, a file to a row at first and then a row a record.
"""

from __future__ import annotations

import email
import email.policy
import gzip
import io
import json
import tarfile
import zipfile
from collections.abc import Iterator
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators.filters import context_lines
from ..operators.sequences import filled_forward
from ..schema import conform
from .json_arrays import array_records

# First bytes of containers.
MAGIC = {"zip": b"PK\x03\x04", "gz": b"\x1f\x8b", "bz2": b"BZh", "xz": b"\xfd7zXZ\x00", "evtx": b"ElfFile\x00", "pst": b"!BDN", "msg": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"}
# Names that Windows records give to fields, and the columns they go to; the first that is there counts.
WINDOWS = {
    "targetUser": ("TargetUserName",), "targetDomain": ("TargetDomainName",), "subjectUser": ("SubjectUserName", "User"), "subjectDomain": ("SubjectDomainName",), "logonType": ("LogonType",), "logonId": ("TargetLogonId", "LogonId"), "subjectLogonId": ("SubjectLogonId", "LogonId"), "logonGuid": ("LogonGuid",),
    "ipAddress": ("IpAddress", "SourceIp"), "ipPort": ("IpPort",), "workstation": ("WorkstationName", "Workstation"), "processName": ("NewProcessName", "ProcessName"), "processId": ("NewProcessId", "ProcessId"), "parentProcessName": ("ParentProcessName",), "commandLine": ("CommandLine",),
    "image": ("Image",), "parentImage": ("ParentImage",), "hashes": ("Hashes",), "serviceName": ("ServiceName",), "taskName": ("TaskName",), "targetFilename": ("TargetFilename",), "targetObject": ("TargetObject",), "destinationIp": ("DestinationIp",), "destinationHostname": ("DestinationHostname",), "queryName": ("QueryName",), "scriptBlockText": ("ScriptBlockText",),
}


def container_of(name: str, head: bytes) -> str | None:
    """What a file is, by its first bytes, else by its name."""
    for kind, magic in MAGIC.items():
        if head.startswith(magic):
            return kind
    if head[257:262] == b"ustar":
        return "tar"
    low = name.lower()
    if low.endswith((".mbox", ".eml")) or head.startswith((b"From ", b"Return-Path:", b"Received:")):
        return "mbox" if head.startswith(b"From ") or low.endswith(".mbox") else "eml"
    if head.lstrip().startswith(b"<Event"):
        return "event-xml"
    return next((k for k in ("csv", "json", "jsonl", "xml", "tsv", "txt", "log") if low.endswith("." + k)), None)


def iso_millis(c: Column) -> Column:
    """Milliseconds of an ISO or similar time; null if it is none of the forms known."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSS][XXX]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][X]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "MM/dd/yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss Z")
    trimmed = F.regexp_replace(F.regexp_replace(c, r"(\.\d{6})\d+", "$1"), r"^[A-Z][a-z]{2},\s*", "")
    return F.unix_millis(F.coalesce(F.try_to_timestamp(trimmed), *[F.try_to_timestamp(trimmed, F.lit(f)) for f in forms[2:]]))


def flattened(df: DataFrame, data: str = "data") -> DataFrame:
    """Event rows with the columns that their JSON data has names for."""
    return conform(df.withColumns({c: F.coalesce(*[V.json_field(F.col(data), n) for n in names]) for c, names in WINDOWS.items() if c not in df.columns}), "events")


def event_xml(spark: SparkSession, path: str) -> DataFrame:
    """An export of <Event> elements, by Spark's XML reader."""
    schema = "System struct<Provider:struct<_Name:string>,EventID:string,Level:string,Channel:string,Computer:string,EventRecordID:long,TimeCreated:struct<_SystemTime:string>>, EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"
    x = spark.read.format("xml").option("rowTag", "Event").schema(schema).load(path)
    pairs = F.map_from_entries(F.transform(F.filter("EventData.Data", lambda d: d["_Name"].isNotNull()), lambda d: F.struct(d["_Name"], d["_VALUE"])))
    rows = x.select(F.col("System.EventRecordID").alias("recordId"), F.col("System.EventID").alias("eventId"), F.col("System.Provider._Name").alias("provider"), F.col("System.Channel").alias("channel"), F.col("System.Computer").alias("computer"), F.col("System.Level").alias("level"), iso_millis(F.col("System.TimeCreated._SystemTime")).alias("ts"), F.to_json(pairs).alias("data"))
    return flattened(rows)


def json_records(spark: SparkSession, path: str, lines: bool = True, depth: int | None = None) -> DataFrame:
    """(data): the text of each record of JSON lines, or of files that hold one array, one record, or records under ``value`` or ``records``.

    An array's file is one row until it is taken apart, so a file must fit in a task, unless ``depth`` says how deep its records
    lie (1: in an array, 2: in an array of an object); then files of any size are read in parallel.
    """
    if depth is not None:
        return array_records(spark, path, depth).select("data")
    raw = spark.read.text(path, wholetext=not lines).select(F.trim("value").alias("data")).where("data <> ''")
    if lines:
        return raw
    held = F.coalesce(F.when(F.col("data").startswith("["), F.col("data")), F.get_json_object("data", "$.value"), F.get_json_object("data", "$.records"))
    many = F.transform(F.from_json(held, "array<variant>"), lambda v: F.to_json(v))
    return raw.select(F.explode(F.coalesce(many, F.array("data"))).alias("data"))


def event_json(spark: SparkSession, path: str, lines: bool = True, depth: int | None = None) -> DataFrame:
    """Exports of other tools as JSON: their names for computer, record and time are looked for in turn."""
    raw = json_records(spark, path, lines, depth)
    first = lambda *names: F.coalesce(*[F.get_json_object("data", f"$.{n}") for n in names])
    rows = raw.select(
        "data", first("EventId", "EventID", "winlog.event_id", "event_id").alias("eventId"), first("Computer", "winlog.computer_name", "host.name").alias("computer"), first("Channel", "winlog.channel").alias("channel"), first("Provider", "winlog.provider_name").alias("provider"),
        first("RecordNumber", "EventRecordId", "winlog.record_id").alias("recordId"), iso_millis(first("TimeCreated", "@timestamp", "timestamp")).alias("ts"),
    )
    return flattened(rows)


def csv_records(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(data, bad): one column of a CSV export; a row without a JSON record in it is bad."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(F.col(column).alias("data"), F.try_parse_json(column).isNull().alias("bad"))


def bad_rows(records: DataFrame) -> DataFrame:
    """(rows, bad): how many rows an export has and how many of them are none."""
    return records.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("bad"), 1)).alias("bad"))


def one_a_key(rows: DataFrame) -> DataFrame:
    """Of the records of one key one; records without a key are all kept."""
    return rows.where("recordKey is null").unionByName(rows.where("recordKey is not null").dropDuplicates(["recordKey"]))


def audit_records(spark: SparkSession, path: str, lines: bool = True, depth: int | None = None) -> DataFrame:
    """Unified audit records, JSON or CSV with an AuditData column, one a record key."""
    raw = csv_records(spark, path, "AuditData").where("not bad").select("data") if path.lower().endswith(".csv") else json_records(spark, path, lines, depth)
    get = lambda k: V.json_field(F.col("data"), k)
    rows = raw.select("data", get("Operation").alias("operation"), F.coalesce(get("ResultStatus"), get("Status")).alias("status"), F.lower(F.coalesce(get("UserId"), get("UserKey"))).alias("upn"), F.regexp_replace(F.coalesce(get("ClientIP"), get("ClientIPAddress"), get("ActorIpAddress")), r"^\[?([0-9a-fA-F.:]+?)\]?(:\d+)?$", "$1").alias("ipAddress"), iso_millis(get("CreationTime")).alias("ts"), get("Id").alias("recordKey"))
    return one_a_key(conform(rows, "events"))


def sign_ins(spark: SparkSession, path: str, lines: bool = True, depth: int | None = None) -> DataFrame:
    """Sign-in records as events; the error code says whether it failed."""
    raw = json_records(spark, path, lines, depth)
    get = lambda p: F.get_json_object("data", f"$.{p}")
    rows = raw.select("data", F.lit("SignIn").alias("operation"), F.when(get("status.errorCode") == "0", "Success").when(get("status.errorCode").isNotNull(), "Failure").alias("status"), F.lower(get("userPrincipalName")).alias("upn"), get("ipAddress").alias("ipAddress"), get("userAgent").alias("userAgent"), iso_millis(get("createdDateTime")).alias("ts"), get("id").alias("recordKey"))
    return one_a_key(conform(rows, "events"))


def dhcp_log(spark: SparkSession, path: str) -> DataFrame:
    """DHCP audit logs: what comes before the header and lines without a number are left out."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\d+,"))
    part = lambda i: F.trim(F.split_part("value", F.lit(","), F.lit(i)))
    rows = lines.select(part(1).alias("eventId"), F.unix_millis(F.try_to_timestamp(F.concat_ws(" ", part(2), part(3)), F.lit("MM/dd/yy HH:mm:ss"))).alias("ts"), part(4).alias("status"), part(5).alias("ipAddress"), part(6).alias("computer"), F.lit("DHCP").alias("provider"))
    return conform(rows, "events")


def registry_text(spark: SparkSession, path: str) -> DataFrame:
    """(key, name, type, value) of registry listings: each value line belongs to the last key line before it in its file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    keyed = filled_forward(lines.withColumn("_key", F.when(F.col("value").rlike("^HK"), F.trim("value"))), ["file"], ["line"], "_key", "key")
    m = lambda i: F.regexp_extract("value", r"^\s+(.+?)\s+(REG_[A-Z_]+)(?:\s+(.*))?$", i)
    return keyed.where(F.col("value").rlike(r"^\s+.+?\s+REG_")).select("file", "key", m(1).alias("name"), m(2).alias("type"), m(3).alias("value"))


def log_context(spark: SparkSession, path: str, pattern: str, around: int = 4) -> DataFrame:
    """Lines of logs that match, with the lines around them."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    return context_lines(lines, F.col("value").rlike("(?i)" + pattern), around, "file", "line")


def macb(df: DataFrame, times: dict[str, str], key: str) -> DataFrame:
    """A row for each different time of a file, with the letters of the times that it is: (key, ts, macb)."""
    each = F.explode(F.array(*[F.struct(F.lit(letter).alias("letter"), F.col(c).alias("ts")) for letter, c in times.items()])).alias("x")
    rows = df.select(key, each).select(key, "x.*").where("ts is not null")
    order = "".join(times)
    marks = F.array_join(F.array(*[F.when(F.array_contains("letters", x), F.lit(x)).otherwise(F.lit(".")) for x in order]), "")
    return rows.groupBy(key, "ts").agg(F.collect_set("letter").alias("letters")).select(key, "ts", marks.alias("macb"))


def timestomped(si: Column, fn: Column) -> Column:
    """Whether standard times look set by hand: before the file name's, or without fractions where that has some."""
    return F.array_compact(F.array(F.when(V.truth(si < fn), "si-before-fn"), F.when(V.truth((si % 1000 == 0) & (fn % 1000 != 0)), "no-fraction")))


MAIL = "messageId string, date long, subject string, fromAddr string, fromName string, fromDomain string, toList array<string>, ccList array<string>, bodyText string, bodyHtml string, headersText string, spf string, dkim string, dmarc string, attachments array<struct<name:string,mime:string,size:long,sha256:string>>"


def _message(raw: bytes) -> dict:
    import hashlib

    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    text = lambda v: str(email.header.make_header(email.header.decode_header(v))) if v else None

    def safe(v):
        try:
            return text(v)
        except (ValueError, LookupError, UnicodeError):
            return str(v)

    people = lambda *names: [a.lower() for _, a in getaddresses([str(x) for n in names for x in m.get_all(n, [])]) if a]
    sender = next(iter(getaddresses([str(m.get("From", ""))])), ("", ""))
    try:
        when = int(parsedate_to_datetime(m["Date"]).timestamp() * 1000) if m["Date"] else None
    except (TypeError, ValueError):
        when = None
    bodies, files = {"text/plain": [], "text/html": []}, []
    for part in m.walk():
        if part.is_multipart():
            continue
        data = part.get_payload(decode=True) or b""
        if part.get_filename() or part.get_content_disposition() == "attachment":
            files.append({"name": safe(part.get_filename()), "mime": part.get_content_type(), "size": len(data), "sha256": hashlib.sha256(data).hexdigest()})
        elif part.get_content_type() in bodies:
            try:
                bodies[part.get_content_type()].append(data.decode(part.get_content_charset() or "utf-8", "replace"))
            except LookupError:
                bodies[part.get_content_type()].append(data.decode("utf-8", "replace"))
    results = " ".join(str(x) for x in m.get_all("Authentication-Results", [])).lower()
    verdict = lambda k: next((r.split("=", 1)[1].strip(";, ") for r in results.replace(";", " ").split() if r.startswith(k + "=")), None)
    addr = sender[1].lower()
    return {
        "messageId": str(m["Message-ID"]) if m["Message-ID"] else None, "date": when, "subject": safe(m["Subject"]), "fromAddr": addr or None, "fromName": safe(sender[0]) or None, "fromDomain": addr.rpartition("@")[2] or None, "toList": people("To"), "ccList": people("Cc"),
        "bodyText": "\n".join(bodies["text/plain"]), "bodyHtml": "\n".join(bodies["text/html"]), "headersText": "\n".join(f"{k}: {v}" for k, v in m.items()), "spf": verdict("spf"), "dkim": verdict("dkim"), "dmarc": verdict("dmarc"), "attachments": files,
    }


def _messages(name: str, raw: bytes) -> Iterator[bytes]:
    if container_of(name, raw[:600]) != "mbox":
        yield raw
        return
    held: list[bytes] = []
    for line in io.BytesIO(raw):
        if line.startswith(b"From "):
            if held:
                yield b"".join(held)
            held = []
        else:
            held.append(line[1:] if line.startswith(b">From ") else line)
    if held:
        yield b"".join(held)


def mails(spark: SparkSession, path: str) -> DataFrame:
    """Messages of .eml and mbox files, parsed in the tasks: file and the columns of MAIL.

    Files whose names end in x (.mbox, inbox) are mailboxes of any size: Spark splits them
    and a record ends where a line begins with "From ". Other files are read whole, by
    their first bytes a message or a mailbox.
    """

    def parsed(found: Iterator[tuple[str, bytes]]) -> Iterator[pd.DataFrame]:
        rows = []
        for name, message in found:
            rows.append({"file": name, **_message(message)})
            if len(rows) == 500:
                yield pd.DataFrame(rows)
                rows = []
        if rows:
            yield pd.DataFrame(rows)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from parsed((name, m) for frame in frames for name, raw in zip(frame["path"], frame["content"], strict=True) for m in _messages(name, raw))

    def record(raw: bytes) -> bytes:
        """A record of a mailbox without the rest of the line that begins it; quoted lines get their own form back."""
        return raw.partition(b"\n")[2].replace(b"\n>From ", b"\nFrom ")

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from parsed((name, record(raw)) for frame in frames for name, raw in zip(frame["path"], frame["content"], strict=True))

    out = f"file string, {MAIL}"
    boxes = spark.read.option("pathGlobFilter", "*[xX]").text(path, lineSep="\nFrom ").select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("content")).where(F.octet_length("content") > 0)
    others = spark.read.format("binaryFile").option("pathGlobFilter", "*[!xX]").load(path).select("path", "content")
    return others.mapInPandas(whole, out).unionByName(boxes.mapInPandas(split, out))


def archive_members(spark: SparkSession, path: str, most_ratio: int = 200, most_bytes: int = 1 << 30) -> DataFrame:
    """(archive, name, size, content, refused) of zip, tar and gzip files; members that unpack too far are named and refused."""

    def members(name: str, raw: bytes) -> Iterator[tuple]:
        kind = container_of(name, raw[:600])
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        bad = i.file_size > most_bytes or i.file_size > most_ratio * max(1, i.compress_size)
                        yield name, i.filename, i.file_size, None if bad else z.read(i), bad
        elif kind == "tar" or name.lower().endswith((".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
            with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                for i in t:
                    if i.isfile():
                        bad = i.size > most_bytes or i.size > most_ratio * len(raw)
                        yield name, i.name, i.size, None if bad else t.extractfile(i).read(), bad
        elif kind == "gz":
            with gzip.GzipFile(fileobj=io.BytesIO(raw)) as g:
                data = g.read(min(most_bytes, most_ratio * len(raw)) + 1)
            bad = len(data) > min(most_bytes, most_ratio * len(raw))
            yield name, name.rsplit("/", 1)[-1].removesuffix(".gz"), len(data), None if bad else data, bad

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                for row in members(name, raw):
                    yield pd.DataFrame([row], columns=["archive", "name", "size", "content", "refused"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, size long, content binary, refused boolean")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, kind) of files, for choosing a reader: by their first bytes, else by their name.

    Spark reads a file whole, so those of 2 GB and more are told by their name alone.
    """
    files = spark.read.format("binaryFile").load(path)
    head, low = F.hex(F.substring("content", 1, 512)), F.lower("path")
    kind = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        kind = F.coalesce(kind, F.when(head.startswith(magic.hex().upper()), name))
    kind = F.coalesce(kind, F.when(F.substring(head, 515, 10) == b"ustar".hex().upper(), "tar"), F.when(low.endswith(".mbox") | head.startswith(b"From ".hex().upper()), "mbox"))
    kind = F.coalesce(kind, F.when(low.endswith(".eml") | head.startswith(b"Return-Path:".hex().upper()) | head.startswith(b"Received:".hex().upper()), "eml"), F.when(F.ltrim(F.substring("content", 1, 512).try_cast("string")).startswith("<Event"), "event-xml"))
    kind = F.coalesce(kind, *[F.when(low.endswith("." + k), k) for k in ("csv", "json", "jsonl", "xml", "tsv", "txt", "log")])
    return files.select("path", "length", F.unix_millis("modificationTime").alias("modified"), kind.alias("kind"))


def import_rows(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Typed rows {type: event | mail | evidence, ...} of an NDJSON file, by type."""
    lines = spark.read.text(path).select(F.get_json_object("value", "$.type").alias("type"), "value")
    out = {}
    for kind, table in (("event", "events"), ("mail", "mails")):
        from ..schema import struct

        out[table] = conform(lines.where(F.col("type") == kind).select(F.from_json("value", struct(table)).alias("x")).select("x.*"), table)
    out["evidence"] = lines.where(F.col("type") == "evidence").select(F.from_json("value", "id string, name string, sha256 string, count long, status string").alias("x")).select("x.*")
    return out


def dumped(row: dict) -> str:
    return json.dumps(row, sort_keys=True)
