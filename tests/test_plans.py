"""Filters, rules and correlation against brute force on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import mail
from tracewell.functions import values as V
from tracewell.operators import filters, graph, joins, sequences
from tracewell.operators.filters import Context
from tracewell.plans import correlate, rule_set, rules, sigma
from tracewell.schema import Case, Settings, conform

ROWS = [(1, "Alpha.EXE", 5, "10.0.0.7", ["a", "B"]), (2, "beta", None, "fe80::1%eth0", []), (3, None, 12, "192.168.1.300", None), (4, "", 0, "172.16.5.5", ["c", None])]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, name string, n int, ip string, flags array<string>").cache()


@pytest.mark.parametrize(("cond", "want"), [
    ({"name": "ALPHA.exe"}, {1}), ({"name|ne": "alpha.exe"}, {2, 3, 4}), ({"name": ""}, {3, 4}), ({"n|in": ["5", 12]}, {1, 3}), ({"n|nin": [5]}, {2, 3, 4}),
    ({"name|contains": ["ALP", "zz"]}, {1}), ({"name|not_contains": "a"}, {3, 4}), ({"name|contains_all": ["a", "exe"]}, {1}), ({"name|contains_cs": "alpha"}, set()), ({"name|re": "^b.*a$"}, {2}), ({"name|not_re": "."}, {3, 4}),
    ({"n|gte": "0x5"}, {1, 3}), ({"n|lt": "x"}, set()), ({"name|exists": True}, {1, 2}), ({"name|exists": False}, {3, 4}), ({"name|empty": True}, {3, 4}), ({"name|levenshtein": ["bata", 1]}, {2}), ({"name|length": 4}, {2}), ({"name|length": "< 5"}, {2, 4}),
    ({"flags": "b"}, {1}), ({"flags|ne": "b"}, {2, 3, 4}), ({"flags|contains_all": ["A", "b"]}, {1}), ({"flags|exists": True}, {1, 4}), ({"flags|length": 2}, {1, 4}), ({"flags|startswith": "C"}, {4}),
    ({"ip|in_setting": "internal_ips"}, {1, 2, 4}), ({"ip|nin_setting": "internal_ips"}, {3}), ({"ip|in_setting": "nothing"}, set()), ({"not": {"name": "beta"}}, {1, 3, 4}),
    ({"any_of": [{"n": 5}, {"all_of": [{"name|empty": True}, {"n|gt": 1}]}]}, {1, 3}), ({}, {1, 2, 3, 4}),
])
def test_conditions(rows, cond, want):
    ctx = Context("rows", rows.schema, Settings(lists={"internal_ips": ["10.0.0.0/8", "172.16.0.0/12", "fe80::/10"]}))
    assert {r.id for r in rows.where(filters.tree(cond, ctx)).collect()} == want


def test_unknown_operators_and_fields_are_refused(rows):
    ctx = Context("rows", rows.schema, Settings())
    for cond in ({"name|near": 1}, {"nothing": 1}, {"flags|gt": 1}):
        with pytest.raises(filters.FilterError):
            filters.tree(cond, ctx)


def burst_machine(times, window, least):
    """The rule's machine, row by row: a trailing window opens a burst, and the burst goes on while rows are near."""
    out, trailing, burst = [], [], None
    for t in times:
        trailing = [x for x in trailing if x >= t - window] + [t]
        if burst and t - burst[-1] <= window:
            burst.append(t)
        else:
            if burst:
                out.append(burst)
            burst = None
            if len(trailing) >= least:
                burst = list(trailing)
    return out + ([burst] if burst else [])


def test_bursts_match_the_machine(spark):
    rng = random.Random(3)
    given = {g: sorted(rng.randrange(200) for _ in range(rng.randint(1, 30))) for g in range(60)}
    df = spark.createDataFrame([(i, t, g) for g, ts in given.items() for i, t in enumerate(ts)], "id long, ts long, g int")
    found = sequences.bursts(df, ["g"], "ts", 8, ">=", 3).collect()
    want = {(g, b[0], b[-1], len(b)) for g, ts in given.items() for b in burst_machine(ts, 8, 3)}
    # Rows of one time are peers: the machine may open a burst amid them with fewer rows behind.
    assert {(r.g, r.start, r.end, r["count"]) for r in found} == want


def test_auth_campaigns_are_greedy(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3000), rng.choice("abc"), rng.random() < 0.8) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, ts long, who string, bad boolean")
    want = set()
    for who in "abc":
        bad = sorted(t for _, t, w, b in rows if w == who and b)
        i = 0
        while i < len(bad):
            n = sum(bad[i] <= t <= bad[i] + 60 for t in bad[i:])
            if n >= 5:
                want.add((who, bad[i], bad[i + n - 1], n))
                i += n
            else:
                i += 1
    found = sequences.auth_campaigns(df, "who", F.col("bad"), ~F.col("bad"), 60, 5).collect()
    assert {(r.who, r.start, r.end, r.failures) for r in found} == want


def test_heaviest_run(spark):
    rng = random.Random(7)
    rows, want = [], []
    for k in range(20):
        steps = [(rng.randrange(15), float(rng.randint(1, 9))) for _ in range(rng.randint(1, 9))]
        best = 0.0
        for mask in range(1 << len(steps)):
            chosen = [s for i, s in enumerate(steps) if mask >> i & 1]
            if all(a[0] < b[0] for a, b in zip(chosen, chosen[1:], strict=False)):
                best = max(best, sum(w for _, w in chosen))
        rows.append((k, steps))
        want.append((k, best))
    df = spark.createDataFrame(rows, "k int, s array<struct<phase:int,weight:double>>")
    assert [(r.k, r.v) for r in df.select("k", sequences.heaviest_run(F.col("s")).alias("v")).orderBy("k").collect()] == want


def test_asof_and_band_ties(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, None, 10), (4, "b", None)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 10, 1), ("a", 10, 2), ("a", 7, 3), (None, 9, 4)], "k string, u long, v long")
    back = {r.id: r.r_v for r in joins.asof(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert back == {1: 2, 2: None, 3: None, 4: None}
    ahead = {r.id: r.r_v for r in joins.asof(left, right, ["k"], "t", "u", ["v"], "forward").collect()}
    assert ahead == {1: 1, 2: 3, 3: None, 4: None}
    pairs = {(r.id, r.r_v) for r in joins.band(left, right, ["k"], "t", "u", 3, 2).collect()}
    assert pairs == {(1, 1), (1, 2), (1, 3), (2, 3)}


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200, x) for x in range(201, 260)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.root for r in found} == {x: top(x) for x in up}


def test_identities(spark):
    df = spark.createDataFrame([(["ann@corp.test", "CORP\\ann"],), (["ann@other.test", "ann"],), (["bob@corp.test", "bob"],), (["ann@corp.test", "ann@other.test"],)], "forms array<string>")
    got = {r.form: r.identity for r in correlate.identities(df).collect()}
    assert got["ann@corp.test"] == got["corp\\ann"] != got["ann@other.test"]
    assert got["bob"] == got["bob@corp.test"]
    assert got["ann"] == "ann"  # two organisations have one


def test_sessions_and_parents(spark):
    on = spark.createDataFrame([(1, "h", "0x1", 10), (2, "h", "0x1", 100)], "id long, host string, logonId string, ts long")
    off = spark.createDataFrame([("h", "0x1", 50), ("h", "0x1", 120)], "host string, logonId string, ts long")
    opened = correlate.sessions(on, off)
    assert {(r.id, r.end) for r in opened.collect()} == {(1, 50), (2, 120)}
    acts = spark.createDataFrame([(7, "h", "0x1", 40), (8, "h", "0x1", 110), (9, "h", "0x1", 90)], "id long, host string, logonId string, ts long")
    assert {(r.id, r.session) for r in correlate.in_session(acts, opened, 1).collect()} == {(7, 1), (8, 2), (9, None)}
    p = spark.createDataFrame([(1, "h", 4, None, None, "a.exe", 1), (2, "h", 5, 4, "C:\\a.exe", "b.exe", 5), (3, "h", 4, None, None, "z.exe", 8), (4, "h", 6, 4, "a.exe", "c.exe", 9)], "id long, host string, pid long, parentPid long, parentName string, name string, ts long")
    assert {(r.id, r.parent) for r in correlate.parents(p).collect()} == {(1, None), (2, 1), (3, None), (4, None)}


def test_chains_and_campaigns(spark):
    mails = spark.createDataFrame([(1, 1000, 90, ["ann@corp.test"]), (2, 2000, 10, ["bob@corp.test"])], "id long, date long, risk int, toList array<string>")
    events = spark.createDataFrame([(5, "Ann@Corp.test", 5000, "rule", 3), (6, "ann@else.test", 5000, "rule", 3), (7, "bob@corp.test", 5000, "rule", 3)], "id long, upn string, ts long, kind string, weight int")
    (c,) = correlate.chains(mails, events).collect()
    assert (c.mail, c.identity, c.steps, c.score, c.severity) == (1, "ann", 1, 37, "medium")  # 27 for the message, 10 for the step
    findings = spark.createDataFrame([([5], "high"), ([9], "critical")], "refs array<long>, severity string")
    links = spark.createDataFrame([(1, 5, 2)], "mail long, step long, n int")
    (c,) = correlate.chains(mails, events, findings).collect()
    assert c.score == 45
    (c,) = correlate.chains(mails, events.withColumn("source", F.lit("x")), findings, links, spark.createDataFrame([(1, "critical")], "mail long, severity string")).collect()
    assert (c.score, c.severity) == (27 + 15 + 10 + 15, "high")
    arts = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("e", "z")], "story string, artifact string")
    got = {r.story: r.campaign for r in correlate.story_campaigns(arts).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_rules_that_contradict_themselves(spark, rows):
    for rule in ({"id": "x", "source": "disks"}, {"id": "x", "window": "5m"}, {"id": "x", "then": {}}, {"id": "x", "then": {"join": ["a"]}}, {}):
        if rules.problem(rule):
            with pytest.raises(rules.RuleError):
                rules.run_rule(rule, Case({"events": rows}))
    assert rules.pinned({"eventId": 1, "any_of": [{"eventId|in": [1, 2]}, {"eventId": 3}]}) == {1}


def test_durations_and_thresholds():
    assert [V.duration_ms(x) for x in ("5m", "2d", 30, "1w")] == [300_000, 172_800_000, 30_000, 604_800_000]
    assert [V.threshold(x) for x in (">= 5", 3, "< 2")] == [(">=", 5), (">=", 3), ("<", 2)]


def test_sigma(spark):
    doc = {
        "id": "1", "title": "t", "level": "high", "tags": ["attack.t1059.001"], "logsource": {"product": "windows"},
        "detection": {"sel": {"image|endswith": "\\powershell.exe", "commandLine|contains|all": ["-enc", "bypass"]}, "net": {"ipAddress|cidr": ["10.0.0.0/8", "172.16.0.0/12"]}, "skip_a": {"commandLine": "*allowed*"}, "condition": "(sel or net) and not 1 of skip_*"},
    }
    rule = sigma.convert(doc)
    assert (rule["severity"], rule["attack"]) == ("high", ["T1059.001"])
    rows = [(1, "C:\\x\\PowerShell.exe", "-Enc x BYPASS", None), (2, "C:\\x\\powershell.exe", "-enc", None), (3, None, None, "172.20.1.1"), (4, None, None, "172.32.1.1"), (5, None, "is allowed here", "10.1.1.1")]
    case = Case({"events": conform(spark.createDataFrame(rows, "id long, image string, commandLine string, ipAddress string"), "events")})
    assert {r.refs[0] for r in rules.run_rule(rule, case).findings.collect()} == {1, 3}
    for bad in ({"sel": {"a|fieldref": "b"}, "condition": "sel"}, {"sel": {"a": 1}, "condition": "sel | count() > 1"}, {"sel": {"a": 1}, "condition": "other"}):
        with pytest.raises(rules.RuleError):
            sigma.convert({"title": "t", "detection": bad})
    assert "".join(sigma._offsets(b"http")) != ""


def test_headers_and_lookalikes(spark):
    headers = "Received: from relay.test (relay [8.8.4.4])\r\n by mx.corp.test; x\r\nReceived: from pc (pc [10.1.1.1]) by relay.test\r\nAuthentication-Results: mx; spf=softfail\r\n dmarc=FAIL\r\nSubject: x\r\n"
    df = spark.createDataFrame([(headers, "paypa1.com"), (None, "paypal.com"), ("", "mail.paypal.com"), ("x", "paypal-login.net"), ("x", "other.org")], "h string, d string")
    rows = df.select(mail.received_chain(F.col("h")).alias("c"), mail.origin_ip(F.col("h")).alias("ip"), mail.auth_result(F.col("h"), "spf").alias("spf"), mail.auth_result(F.col("h"), "dmarc").alias("dmarc"), mail.lookalike(F.col("d"), ["paypal.com"]).alias("b")).collect()
    assert [(h["from"], h["by"], h["ip"]) for h in rows[0].c] == [("pc", "relay.test", "10.1.1.1"), ("relay.test", "mx.corp.test", "8.8.4.4")]
    assert (rows[0].ip, rows[0].spf, rows[0].dmarc) == ("8.8.4.4", "softfail", "fail")
    assert [r.b for r in rows] == ["paypal.com", None, None, "paypal.com", None]
    flags = spark.createDataFrame([("fail", "fail", "corp.test", "a@corp.test", "x", "else.test")], "spf string, dmarc string, fromDomain string, fromAddr string, fromName string, replyToDomain string")
    r = flags.select(mail.mail_flags(flags.columns, ["corp.test"], []).alias("f")).select("f", mail.risk_of(F.col("f")).alias("n")).first()
    assert (r.f, r.n) == (["spf-fail", "dmarc-fail", "own-domain-unproven"], 33)


def test_rule_sets_find_what_single_rules_find(spark):
    """Rules of every kind in one pass, against each rule by itself."""
    rng = random.Random(21)
    rows = [(i, rng.randint(0, 40) * 60_000, rng.choice(["a", "B", "b", "", None]), rng.choice(["x", "y", None]), rng.randint(0, 9), rng.choice([None, "10.0.0.1", "10.0.0.2"])) for i in range(300)] + [(900, None, "a", "x", 3, None)]
    case = Case({"events": conform(spark.createDataFrame(rows, "id long, ts long, targetUser string, computer string, eventId int, ipAddress string"), "events"), "mails": conform(spark.createDataFrame([(1, 5, ["f"], "a@b.c")], "id long, date long, flags array<string>, fromAddr string"), "mails")}, Settings(lists={"on": ["1"]}))
    some = [
        {"where": {"eventId|gt": 7}}, {"where": {"eventId|lt": 5}, "entities": ["targetUser"], "collapse_after": 20}, {"where": {"eventId|gte": 0}, "group_by": ["targetUser", "computer"], "threshold": ">= 10", "max_findings": 3}, {"group_by": ["targetUser"], "threshold": "< 90", "exclude": {"eventId": 4}},
        {"group_by": ["computer"], "distinct": "targetUser", "threshold": 2}, {"group_by": ["computer"], "distinct": "ipAddress", "threshold": "<= 1"}, {"group_by": ["targetUser"], "any_in_group": {"ipAddress": "10.0.0.2"}, "threshold": 5}, {"threshold": ">= 5", "where": {"eventId": 3}},
        {"group_by": ["targetUser"], "window": "3m", "threshold": 6}, {"group_by": ["targetUser"], "window": "2m", "distinct": "eventId", "threshold": 4, "any_in_group": {"eventId": 9}}, {"where": {"eventId": 1}, "time": {"weekend": True}, "group_by": ["computer"]},
        {"where": {"eventId": 2}, "group_by": ["targetUser"], "window": "5m", "threshold": 2, "then": {"where": {"eventId": 7}, "within": "2m", "severity": "critical", "title": "then"}}, {"where": {"eventId": 5}, "require_setting": "off"}, {"where": {"eventId": 5}, "require_setting": "on", "attack": ["T1"], "tags": ["g"], "confidence": "high"},
        {"source": "mails", "where": {"fromAddr|contains": "@"}},
    ]
    ruled = [{"id": f"r{i}", **r} for i, r in enumerate(some)]

    def plain(df):
        cut = lambda e: None if (e or "").startswith("collapsed") else e
        return sorted(repr((r.ruleId, r.title, r.severity, r.key, r.ts, r.tsEnd, r["count"], sorted(r.entities.items()), r.refs, cut(r.escalation), r.confidence, r.attack, r.tags)) for r in df.collect())

    for capped in (True, False):
        each = [rules.run_rule(r, case) for r in ruled]
        want = [x for f in each for x in plain(f.findings if capped or f.groups is None else f.groups)]
        assert plain(rule_set.run_set(ruled, case, capped)) == sorted(want)
    assert len(want) > 100
    for bad in ({"id": "x", "window": "5m"}, {"id": "x", "then_flags": [{"f": "high"}]}, {"id": "x", "threshold": 2, "then": {}, "severity": "odd"}):
        with pytest.raises(rules.RuleError):
            rule_set.run_set([bad], case)


def test_then_flags_raise_in_their_order(spark):
    rows = [(1, 1, ["lure"], "a"), (2, 2, ["macro", "x"], "a"), (3, 3, None, "b"), (4, 4, [], "b"), (5, 5, ["lure"], "c"), (6, 6, ["x"], "c")]
    case = Case({"mails": conform(spark.createDataFrame(rows, "id long, date long, flags array<string>, fromAddr string"), "mails")})
    rule = {"id": "m", "source": "mails", "severity": "medium", "group_by": ["fromAddr"], "threshold": 2, "then_flags": [{"x": "low"}, {"lure": "high"}, {"macro": "critical"}]}
    assert {r.key: (r.severity, r.escalation, r.refs) for r in rules.run_rule(rule, case).findings.collect()} == {"m|a": ("critical", "macro", [1, 2]), "m|b": ("medium", None, [3, 4]), "m|c": ("high", "lure", [5, 6])}
    single = {"id": "m", "source": "mails", "severity": "low", "then_flags": [{"macro": "high"}]}
    assert {r.key: (r.severity, r.escalation) for r in rules.run_rule(single, case).findings.collect()} == {f"m|{i}": ("high", "macro") if i == 2 else ("low", None) for i in range(1, 7)}


def test_sigma_names_categories_and_modifiers(spark):
    rows = [(1, 4625, "Security", "root", None, "10.0.0.9"), (2, 4625, "System", "root", None, None), (3, 4688, "Security", None, "C:\\cmd.exe", "fe80::1"), (4, 1, "Microsoft-Windows-Sysmon/Operational", None, "c:\\CMD.exe", "fec0::1"), (5, 22, "Microsoft-Windows-Sysmon/Operational", None, None, "febf:1::")]
    case = Case({"events": conform(spark.createDataFrame(rows, "id long, eventId int, channel string, targetUser string, image string, ipAddress string"), "events")})
    hits = lambda source, **sel: {r.refs[0] for r in rules.run_rule(sigma.convert({"title": "t", "logsource": source, "detection": {"sel": sel, "condition": "sel"}}), case).findings.collect()}
    assert hits({"product": "windows", "service": "security"}, EventID=4625, TargetUserName="ROOT") == {1}
    assert hits({"product": "windows"}, EventID=[4625, 22]) == {1, 2, 5}
    assert hits({"product": "windows", "category": "process_creation"}, **{"Image|endswith": "\\cmd.exe"}) == {3, 4}
    assert hits({"category": "dns_query"}, **{"EventID|gt": 1}) == {5}
    assert hits({}, **{"IpAddress|cidr": ["fe80::/10", "10.0.0.0/30"]}) == {3, 5}
    assert hits({}, **{"Image|re|i": "^C:.*CMD"}) == {3, 4}
    for bad in ("Image|bogus", "Image|contains|minute"):
        with pytest.raises(rules.RuleError):
            sigma.convert({"title": "t", "detection": {"sel": {bad: "x"}, "condition": "sel"}})


def test_left_band_keeps_rows_without_partners(spark):
    left = spark.createDataFrame([(1, "a", 10), (1, "a", 10), (2, "a", 900), (3, None, 10), (4, "b", None)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 12, 7), ("a", 30, 8), (None, 10, 9)], "k string, u long, v long")
    got = sorted((r.id, r.r_v) for r in joins.band(left, right, ["k"], "t", "u", 5, 20, "left").collect())
    assert sorted(map(str, got)) == sorted(map(str, [(1, 7), (1, 8), (1, 7), (1, 8), (2, None), (3, None), (4, None)]))
    assert joins.band(left, right, ["k"], "t", "u", 5, 20, "left").columns == ["id", "k", "t", "r_k", "r_u", "r_v"]


def test_lists_in_text_conditions(rows):
    ctx = Context("rows", rows.schema, Settings())
    found = lambda cond: {r.id for r in rows.where(filters.tree(cond, ctx)).collect()}
    assert found({"name|contains_any": []}) == set()
    assert found({"name|contains_any": "zz, beta"}) == {2}
    assert found({"name|contains_all": "alp,exe"}) == {1}
    assert found({"name|contains": "a,b"}) == set()
    assert found({"ip|cidr": ["10.0.0.0/8", "fe80::/10"]}) == {1, 2}


def test_trailing_sizes_are_those_of_the_windows(spark):
    rng = random.Random(31)
    rows = [(i, rng.choice("gh"), rng.randint(0, 60), rng.choice(["x", "y", "z", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g string, ts long, w string")
    for what in (None, "w"):
        got = {r.id: r._size for r in sequences.trailing_sizes(df, ["g"], "ts", F.lit(7), what).collect()}
        for i, g, t, _ in rows:
            near = [(j, w) for j, h, u, w in rows if h == g and t - 7 <= u <= t]
            assert got[i] == (len(near) if what is None else len({w for _, w in near if w}))


def test_a_process_creations_logon_is_its_subjects(spark):
    from tracewell.sources.readers import flattened

    rows = spark.createDataFrame([(1, 4688, "Security", '{"SubjectLogonId": "0x3e7", "TargetLogonId": "0x5"}'), (2, 4688, "Security", '{"SubjectLogonId": "0x5", "TargetLogonId": "0x3e7"}')], "id long, eventId int, channel string, data string")
    document = {"title": "t", "id": "x", "logsource": {"product": "windows", "category": "process_creation"}, "detection": {"own": {"LogonId": "0x3E7"}, "condition": "own"}}
    found = rules.run_rule(sigma.convert(document), Case({"events": flattened(rows.withColumn("ts", F.lit(5).cast("long")))})).findings
    assert [r.refs for r in found.collect()] == [[1]]
