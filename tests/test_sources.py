"""Readers and sinks round small files; streams over small folders."""

import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewell.plans.rules import run_rules
from tracewell.schema import Case, conform
from tracewell.sources import readers, sinks
from tracewell.streaming import flows

MAIL = b"""From: "Ann" <Ann@Example.com>
To: bob@corp.test, Eve <eve@corp.test>
Subject: =?utf-8?q?Caf=C3=A9?=
Date: Mon, 01 Jan 2024 10:00:00 +0000
Message-ID: <1@example.com>
Authentication-Results: mx; spf=pass smtp.mailfrom=x; dkim=fail
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=b

--b
Content-Type: text/plain; charset=utf-8

hello
--b
Content-Type: application/pdf; name=a.pdf
Content-Disposition: attachment; filename=a.pdf
Content-Transfer-Encoding: base64

AAAA
--b--
"""


def test_mailboxes(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(MAIL)
    (tmp_path / "b.mbox").write_bytes(b"From x\n" + MAIL + b"\nFrom y\n" + MAIL.replace(b"<1@", b"<2@"))
    rows = readers.mails(spark, str(tmp_path)).collect()
    assert sorted(r.messageId for r in rows) == ["<1@example.com>", "<1@example.com>", "<2@example.com>"]
    r = rows[0]
    assert (r.fromAddr, r.fromName, r.subject, r.date, r.spf, r.dkim, r.dmarc) == ("ann@example.com", "Ann", "Café", 1704103200000, "pass", "fail", None)
    assert r.toList == ["bob@corp.test", "eve@corp.test"]
    assert [(a.name, a.size) for a in r.attachments] == [("a.pdf", 3)]


def test_event_exports(spark, tmp_path):
    event = "<Event><System><Provider Name='P'/><EventID>4625</EventID><Channel>Security</Channel><Computer>h1</Computer><EventRecordID>7</EventRecordID><TimeCreated SystemTime='2024-01-01T00:00:01.1234567Z'/></System><EventData><Data Name='TargetUserName'>Bob</Data><Data Name='LogonType'>3</Data></EventData></Event>"
    (tmp_path / "e.xml").write_text(f"<Events>{event}</Events>")
    r = readers.event_xml(spark, str(tmp_path / "e.xml")).first()
    assert (r.eventId, r.recordId, r.computer, r.targetUser, r.logonType, r.ts) == (4625, 7, "h1", "Bob", 3, 1704067201123)
    (tmp_path / "e.jsonl").write_text(json.dumps({"EventId": 1, "Computer": "h2", "TimeCreated": "2024-01-01 00:00:00", "Image": "c:\\x.exe"}) + "\n")
    r = readers.event_json(spark, str(tmp_path / "e.jsonl")).first()
    assert (r.eventId, r.computer, r.image, r.ts) == (1, "h2", "c:\\x.exe", 1704067200000)


def test_audit_records_once_a_key(spark, tmp_path):
    one = {"Id": "k1", "Operation": "New-InboxRule", "UserId": "A@x.test", "ClientIP": "[2001:db8::1]:443", "CreationTime": "2024-01-01T00:00:00"}
    (tmp_path / "a.json").write_text("\n".join(json.dumps(x) for x in (one, one, {**one, "Id": "k2", "ClientIP": "1.2.3.4:5"})))
    rows = {r.recordKey: r for r in readers.audit_records(spark, str(tmp_path / "a.json")).collect()}
    assert set(rows) == {"k1", "k2"}
    assert (rows["k1"].ipAddress, rows["k2"].ipAddress, rows["k1"].upn, rows["k1"].ts) == ("2001:db8::1", "1.2.3.4", "a@x.test", 1704067200000)


def test_registry_log_context_and_dhcp(spark, tmp_path):
    (tmp_path / "r.txt").write_text("HKLM\\A\n    n1    REG_SZ    v 1\nHKLM\\B\n    n2    REG_DWORD    0x1\n")
    got = {(r.key, r.name, r.type, r.value) for r in readers.registry_text(spark, str(tmp_path / "r.txt")).collect()}
    assert got == {("HKLM\\A", "n1", "REG_SZ", "v 1"), ("HKLM\\B", "n2", "REG_DWORD", "0x1")}
    (tmp_path / "l.log").write_text("\n".join(f"line {i}" if i != 10 else "threat found" for i in range(20)))
    assert readers.log_context(spark, str(tmp_path / "l.log"), "THREAT").count() == 9
    (tmp_path / "d.log").write_text("Microsoft DHCP\nID,Date\n10,01/02/24,03:04:05,Assign,10.0.0.5,host1\n")
    r = readers.dhcp_log(spark, str(tmp_path / "d.log")).first()
    assert (r.eventId, r.ipAddress, r.computer, r.ts) == (10, "10.0.0.5", "host1", 1704164645000)


def test_archives_and_macb(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "small")
        z.writestr("bomb.txt", "0" * 5_000_000)
    (tmp_path / "x.zip").write_bytes(buffer.getvalue())
    (tmp_path / "y.log.gz").write_bytes(gzip.compress(b"line"))
    rows = {r.name: r for r in readers.archive_members(spark, str(tmp_path)).collect()}
    assert (bytes(rows["a.txt"].content), rows["bomb.txt"].refused, bytes(rows["y.log"].content)) == (b"small", True, b"line")
    df = spark.createDataFrame([("f", 1, 1, 2, None)], "path string, m long, a long, c long, b long")
    assert {(r.ts, r.macb) for r in readers.macb(df, {"M": "m", "A": "a", "C": "c", "B": "b"}, "path").collect()} == {(1, "MA.."), (2, "..C.")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "k", "a"), (2, "k", "b"), (3, None, "c"), (4, None, "d")], "id long, k string, v string")
    assert {r.id for r in sinks.first_of_key(df, F.col("k"), "id").collect()} == {1, 3, 4}
    ids = sinks.numbered(df.drop("id").withColumn("o", F.col("v")), 10, "o").collect()
    assert {(r.v, r.id) for r in ids} == {("a", 10), ("b", 11), ("c", 12), ("d", 13)}
    facts = spark.createDataFrame([(1, "new")], "id long, v string")
    assert {(r.id, r.v) for r in sinks.enriched(df, facts, "id").collect()} == {(1, "new"), (2, "b"), (3, "c"), (4, "d")}
    sinks.write_csv(spark.createDataFrame([("=cmd()",)], "x string"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().x == "'=cmd()"
    iocs = spark.createDataFrame([("ip", "1.2.3.4"), ("ip", "1.2.3.4"), ("other", "x")], "kind string, value string")
    objects = [r.object for r in sinks.stix_objects(iocs).collect()]
    assert len(objects) == 2
    assert objects[0] == objects[1]


def test_conform_casts_or_nulls(spark):
    df = spark.createDataFrame([("x", "7", "TRUE"), ("5", "z", "maybe")], "ts string, eventId string, hasAttachments string")
    rows = conform(df, "events").collect()
    assert [(r.ts, r.eventId) for r in rows] == [(None, 7), (5, None)]
    assert [r.hasAttachments for r in conform(df.select("hasAttachments"), "mails").collect()] == [True, None]


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(i, 1_704_067_200_000 + i * 60_000, "u1" if i < 12 else "u2", i, f"k{i // 2}") for i in range(20)] + [(99, 1_704_067_200_000 + 10 * 86_400_000, "late", 0, "z")]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "id long, ts long, user string, n int, k string").coalesce(1).write.parquet(path)
    return flows.events(spark, path, "id long, ts long, user string, n int, k string")


def run(spark, df, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out").collect()


def test_stream_dedupe(spark, stream):
    assert len(run(spark, flows.deduplicated(stream, "k"))) == 11


def test_stream_sessions(spark, stream):
    rows = run(spark, flows.sessions(stream, ["user"], "5 minutes", F.col("n") >= 0, 8))
    assert sorted((r.user, r.n) for r in rows) == [("u1", 12), ("u2", 8)]


def test_stream_timeline(spark, stream):
    assert sum(r.n for r in run(spark, flows.timeline(stream, "10 minutes"), "complete")) == 21


def test_rules_over_a_small_case(spark):
    rows = [(i, i * 1000, 4625, "1.2.3.4", f"u{i}", "h") for i in range(6)] + [(7, 9000, 4624, "1.2.3.4", "u1", "h")]
    case = Case({"events": conform(spark.createDataFrame(rows, "id long, ts long, eventId int, ipAddress string, targetUser string, computer string"), "events")})
    rule = {"id": "b", "title": "burst", "severity": "high", "where": {"eventId": 4625, "ipAddress|exists": True}, "group_by": ["ipAddress"], "window": "5m", "threshold": ">= 5", "then": {"where": {"eventId": 4624}, "join": ["ipAddress"], "within": "15m", "severity": "critical", "title": "in"}}
    (f,) = run_rules([rule, {**rule, "id": "none", "where": {"eventId": 1}}], case).collect()
    assert (f.key, f.severity, f.escalation, f["count"], f.tsEnd, f.refs) == ("b|1.2.3.4|0", "critical", "in", 6, 9000, [0, 1, 2, 3, 4, 5, 7])


def test_records_without_a_key_are_all_kept(spark, tmp_path):
    lines = ['{"Id": "k", "Operation": "a"}', '{"Id": "k", "Operation": "a"}', '{"Operation": "b"}', '{"Operation": "b"}', '{"Operation": "c"}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    assert sorted(r.operation for r in readers.audit_records(spark, str(tmp_path / "a.jsonl")).collect()) == ["a", "b", "b", "c"]
    (tmp_path / "s.jsonl").write_text('{"id": null, "ipAddress": "1"}\n{"ipAddress": "2"}\n{"id": "x", "ipAddress": "3"}\n{"id": "x", "ipAddress": "3"}')
    assert sorted(r.ipAddress for r in readers.sign_ins(spark, str(tmp_path / "s.jsonl")).collect()) == ["1", "2", "3"]


def test_arrays_and_wrapped_records(spark, tmp_path):
    import json

    records = [{"id": str(i), "userPrincipalName": "A@b.c", "status": {"errorCode": i}, "createdDateTime": "2024-01-02T03:04:05Z"} for i in range(3)]
    for name, body in (("array", records), ("value", {"value": records}), ("records", {"records": records})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
        rows = readers.sign_ins(spark, str(tmp_path / f"{name}.json"), lines=False).collect()
        assert sorted((r.recordKey, r.status, r.upn, r.ts) for r in rows) == [("0", "Success", "a@b.c", 1704164645000), ("1", "Failure", "a@b.c", 1704164645000), ("2", "Failure", "a@b.c", 1704164645000)]
    (tmp_path / "one.json").write_text('{"EventID": 7,\n "Computer": "h"}')
    assert [(r.eventId, r.computer) for r in readers.event_json(spark, str(tmp_path / "one.json"), lines=False).collect()] == [(7, "h")]


def test_bad_rows_of_a_csv_are_counted(spark, tmp_path):
    (tmp_path / "x.csv").write_text('RecordId,AuditData\n1,"{""Id"": ""a"", ""Operation"": ""o""}"\n2,not json\n3,\n')
    assert readers.bad_rows(readers.csv_records(spark, str(tmp_path / "x.csv"), "AuditData")).first() == (3, 2)
    assert [r.recordKey for r in readers.audit_records(spark, str(tmp_path / "x.csv")).collect()] == ["a"]


def test_files_are_told_by_their_first_bytes(spark, tmp_path):
    made = {"a.bin": b"PK\x03\x04xx", "b": b"\x1f\x8bzz", "c.csv": b"x,y", "d.txt": b"From a@b\n", "e": b"Received: by x", "f.dat": b"  <Event xmlns='x'>", "g.EML": b"x", "h": b"\x00" * 257 + b"ustar" + b"\x00" * 9, "i": b"what", "j": b"\xff\xfe"}
    for name, body in made.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[-1]: r.kind for r in readers.inventory(spark, str(tmp_path)).collect()}
    assert got == {"a.bin": "zip", "b": "gz", "c.csv": "csv", "d.txt": "mbox", "e": "eml", "f.dat": "event-xml", "g.EML": "eml", "h": "tar", "i": None, "j": None}
    assert all(readers.container_of(n, b) == got[n] for n, b in made.items())


def test_mailboxes_are_split(spark, tmp_path):
    """More messages than a split holds, raw bytes and quoted lines among them."""
    body = b"Subject: =?utf-8?q?n=C3=A4?= %d\r\nFrom: a%d@b.c\r\nContent-Type: text/plain; charset=latin-1\r\n\r\n>From here on \xe9t\xe9\r\n" + b"x" * 300 + b"\r\n"
    (tmp_path / "big.mbox").write_bytes(b"".join(b"From a Mon Jan  1\r\n" + body % (i, i) + b"\r\n" for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = readers.mails(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        rows = df.select("fromAddr", "subject", "bodyText").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.fromAddr for r in rows) == sorted(f"a{i}@b.c" for i in range(400))
    assert all(r.subject.startswith("n\u00e4 ") and r.bodyText.startswith("From here on \u00e9t\u00e9") for r in rows)


def _values(rng, depth=0):
    if depth < 3 and rng.random() < 0.3:
        return {rng.choice(["a", 'b"', "c\\", "{", "é"]): _values(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    if depth < 3 and rng.random() < 0.3:
        return [_values(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, None, True, "x", "}{", '"', "\\", '\\"}', "[", "line\nfeed", "ü" * 5])


def test_arrays_are_read_in_blocks(spark, tmp_path):
    import random

    rng = random.Random(2)
    records = [{"i": i, "v": _values(rng), "s": "q" * rng.choice([0, 3, 900])} for i in range(120)]
    texts = {
        "one": (json.dumps(records), 1), "pretty": (json.dumps(records, indent=2, ensure_ascii=False), 1), "two": (json.dumps(records[:50]) + "\n" + json.dumps(records[50:]), 1),
        "mixed": ("[" + ", ".join(json.dumps(r) + rng.choice(["", ", 5", ', "}{"', ', [1,"]"]']) for r in records) + "]", 1), "empty": ("[]", 1), "none": ("", 1), "cut": (json.dumps(records)[:-1000], 1),
        "wrapped": (json.dumps({"@c": "x{", "m": {"n": 1}, "value": records, "z": "}"}), 2), "pages": ("\n".join(json.dumps({"value": records[i : i + 50], "next": str(i)}) for i in range(0, 120, 50)), 2),
    }
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        for name, (text, depth) in texts.items():
            (tmp_path / name).mkdir()
            (tmp_path / name / "f.json").write_text(text)
            rows = readers.array_records(spark, str(tmp_path / name), depth)
            got = [json.loads(r.data) for r in rows.orderBy("place").collect()]
            assert got == (records if name not in ("empty", "none", "cut") else records[: len(got)]), name
            assert len(got) >= (0 if name in ("empty", "none") else 110), name
        assert readers.array_records(spark, str(tmp_path / "one")).select("file").distinct().count() == 1
        assert readers.audit_records(spark, str(tmp_path / "one"), depth=1).count() == 120
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
