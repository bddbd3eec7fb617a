"""Small frames with known outcomes, at the default thresholds."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logrill.functions import text
from logrill.functions.matching import contains_join
from logrill.operators import alerts, enrich, mix, resolve, retrieval, sequence, signals, silence, state, summary, templates
from logrill.sources import raw, tables

T0 = datetime(2024, 3, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_read_raw(spark, tmp_path):
    (tmp_path / "raw.jsonl").write_text("\n".join([
        "", '{"message": "cut', '{"program": "x"}', '{"message": "veth88671e0: Link DOWN"}',
        '{"message": "good", "severity": "info"}']))
    assert values(raw.read_raw(spark, str(tmp_path)), "message", "severity") == [("good", "info")]


def test_multipart_ids_that_come_again(spark):
    def line(i, t, body):
        return (i, at(t), at(t), "10.0.0.1", "ACS", "CSCOacs_X", body, body)

    rows = frame(spark, [
        line(1, 0, "0001384016 2 0 A"), line(2, 1, "0001384016 2 1 B"), line(3, 5, "0001384016 2 0 C"), line(4, 6, "0001384016 2 1 D"),
        line(5, 100, "0000000007 3 0 x"), line(6, 106, "0000000007 3 1 y"), line(7, 112, "0000000007 3 2 z")],
        "event_id long, event_time timestamp_ntz, received_at timestamp_ntz, source_ip string, reported_hostname string, "
        "program string, message string, raw string")
    assert sorted(r.message for r in enrich.reassemble_multipart(rows).collect()) == ["AB", "CD", "xy", "z"]


def test_multipart(spark):
    def line(i, t, body, program="CSCOacs_X"):
        return (i, at(t), at(t), "10.0.0.1", "ACS", program, body, body)

    rows = frame(spark, [
        line(1, 1, " 0001384016 2 1  B"), line(2, 2, " 0001384016 2 0 A,"), line(3, 60, "0001384017 2 0 lone"),
        line(4, 61, "0001384018 1 0 single"), line(5, 62, "0001384019 2 0 other", "sshd"),
        line(6, 900, "0001384016 2 0 again,"), line(7, 901, "0001384016 2 1  C")],
        "event_id long, event_time timestamp_ntz, received_at timestamp_ntz, source_ip string, "
        "reported_hostname string, program string, message string, raw string")
    out = enrich.reassemble_multipart(rows)
    assert sorted(values(out, "message")) == [
        ("0001384019 2 0 other",), ("A, B",), ("again, C",), ("lone",), ("single",)]


@pytest.mark.parametrize("message,vendor", [
    ("x junos@2636.1.1.1.2 y", "juniper"), ("1,2024/01/02 03:04:05,99,TRAFFIC,end", "paloalto"),
    ("devname=FG1 logid=\"0001\" msg", "fortinet"), ("  ether1 link down", "mikrotik"),
    (" on 5180 AP: yes SSID home", "mikrotik"), ("AA:BB:CC:DD:EE:FF@wlan1: connected", "mikrotik"),
    ("wlan1: lost", "mikrotik"), ("ppp-out1: dialing", "mikrotik"),
    ("dhcp1 deassigned 10.0.0.5 from 00:11:22:33:44:55", "mikrotik"), (" sntp change time a => b", "mikrotik"),
    ("user admin logged in from 10.0.0.2 via winbox", "mikrotik"), ("system,info ready", "mikrotik"),
    ("023543: %SYS-5-CONFIG_I: done", "cisco_like"), ("hello", "unknown")])
def test_vendor(spark, message, vendor):
    assert spark.range(1).select(text.detect_vendor(F.lit(message))).first()[0] == vendor


def test_category_and_security(spark):
    row = spark.range(1).select(
        text.weak_label(F.lit("Authentication to privilege level 15 failed by x")),
        text.is_security_content(F.lit("Authentication to privilege level 15 failed by x"))).first()
    assert tuple(row) == ("AUTH", True)


@pytest.mark.parametrize("value,good", [
    ("10.0.0.1", True), ("256.1.1.1", False), ("01.2.3.4", False), ("::1", True), ("fe80::1:2", True), ("1:2:3", False),
    ("1:2:3:4:5:6:7:8", True), ("1::2::3", False), ("::ffff:10.0.0.1", True), ("host", False), ("", False), (":::", False)])
def test_is_ip(spark, value, good):
    assert spark.range(1).select(text.is_ip(F.lit(value))).first()[0] is good


def test_relay_identity(spark):
    events = frame(spark, [
        (1, "9.9.9.9", "10.1.1.1"), (2, "9.9.9.9", "ACSSERVER"), (3, "9.9.9.9", "localhost"),
        (4, "8.8.8.8", "localhost"), (5, "7.7.7.7", "whatever")],
        "event_id long, source_ip string, reported_hostname string").withColumn("message", F.lit("hi"))
    inventory = frame(spark, [("7.7.7.7", "core", "cisco", "m", "snmp", at(0), at(0)),
                              ("7.7.7.7", "old", "cisco", "m", "snmp", at(0), at(-9))],
                      "ip string, hostname string, vendor string, model string, resolution_method string, "
                      "first_seen timestamp_ntz, last_resolved timestamp_ntz")
    out = enrich.resolve_identity(events, inventory, frame(spark, [("9.9.9.9",)], "ip string"))
    assert sorted(values(out, "event_id", "source_ip", "hostname", "relayed_via", "resolution_method", "vendor_source")) == [
        (1, "10.1.1.1", "10.1.1.1", "9.9.9.9", "unresolved", "unknown"),
        (2, "ACSSERVER", "ACSSERVER", "9.9.9.9", "syslog_reported", "unknown"),
        (3, "9.9.9.9", "9.9.9.9", "", "unresolved", "unknown"),
        (4, "8.8.8.8", "8.8.8.8", "", "unresolved", "unknown"),
        (5, "7.7.7.7", "core", "", "snmp", "snmp")]


def test_relay_time(spark):
    rows = frame(spark, [(1, "9.9.9.9", at(10800), at(0)), (2, "1.1.1.1", at(10800), at(0)), (3, "9.9.9.9", at(600), at(0))],
                 "event_id long, source_ip string, event_time timestamp_ntz, received_at timestamp_ntz")
    out = enrich.fix_relay_timezone(rows, frame(spark, [("9.9.9.9",)], "ip string"))
    assert sorted(values(out, "event_id", "event_time")) == [(1, at(0)), (2, at(10800)), (3, at(600))]


def test_clock_skew_holds_and_releases(spark):
    rows = [(i, "d", at(i * 10), at(i * 10 + (3720 if i < 60 else 0))) for i in range(120)]
    events = frame(spark, rows, "event_id long, source_ip string, event_time timestamp_ntz, received_at timestamp_ntz")
    # arrival order is the order of ids: the late clock does not reorder arrivals
    events = events.withColumn("order_at", F.lit(at(0)).cast("timestamp_ntz"))
    diffs, skew, expected = [], 0.0, {}
    for i, _, event, received in sorted(rows, key=lambda r: (r[3], r[0])):
        diffs = [*diffs, (received - event).total_seconds()][-50:]
        if len(diffs) >= 30:
            mean = sum(diffs) / len(diffs)
            spread = (sum((d - mean) ** 2 for d in diffs) / len(diffs)) ** 0.5
            if abs(mean) >= 300 and spread <= 120:
                skew = mean
            elif abs(mean) < 150:
                skew = 0.0
        expected[i] = round(skew, 3)
    out = enrich.correct_clock_skew(events, slice_rows=40, block_rows=60)
    assert {i: round(s, 3) for i, s in values(out, "event_id", "skew_seconds")} == expected
    assert any(expected.values()) and not all(expected.values())


def test_flapping(spark):
    rows = frame(spark, [(i, at(t), "d", "ether1 link down") for i, t in enumerate((0, 18, 400, 2000))],
                 "event_id long, event_time timestamp_ntz, source_ip string, message string")
    out = signals.interface_flapping(rows, slice_rows=3)
    assert sorted(values(out, "event_id", "interface_flapping")) == [(0, False), (1, False), (2, True), (3, False)]


def test_volume(spark):
    rows, n = [], 0
    for bucket, count in enumerate((3, 3, 3, 3, 3, 3, 60, 3, 3)):
        for j in range(count):
            rows.append((n, at(bucket * 600 + j * 5), "d"))
            n += 1
    out = signals.volume_spike(frame(spark, rows, "event_id long, event_time timestamp_ntz, source_ip string"))
    hit = {r.event_time.minute // 10 for r in out.where("volume_spike").collect()}
    assert hit == {1} and out.where("volume_spike").first().event_time.hour == 1


def test_sequence_experiment(spark):
    names = ["A", "B", "C"] * 260 + ["Z"] + ["A", "B", "C"] * 20
    rows = [(i, at(i), "d", "v", n) for i, n in enumerate(names)]
    events = frame(spark, rows, "event_id long, event_time timestamp_ntz, source_ip string, vendor string, template_id string")
    pairs = sequence.transitions(events, at(900), slice_rows=20)
    vendors = sequence.known_vendors(events)
    done = frame(spark, [("d", at(779))], "source_ip string, last_scored timestamp_ntz")
    scored = sequence.score_transitions(pairs, sequence.transition_model(pairs, vendors, done), vendors, done)
    flagged = scored.where("is_anomaly = 1").collect()
    assert [(r.prev_template_id, r.curr_template_id) for r in flagged] == [("C", "Z")]
    assert round(flagged[0].transition_probability * 100, 2) == 0.38


def test_mix(spark):
    counts = []
    for device in ("big", "small"):
        for w in range(41 if device == "big" else 10):
            odd = device == "big" and w == 40
            for template, n in (("rare", 100),) if odd else (("a", 80 + w % 7), ("b", 20 + w % 5)):
                counts.append((device, at(w * 300), template, n, "v"))
    table = frame(spark, counts, "source_ip string, window_start timestamp_ntz, template_id string, event_count long, vendor string")
    forest = mix.train_mix_models(mix.mix_vectors(table, 3), 3)
    assert forest.groupBy("scope_key").count().count() == 2 and forest.count() == 200
    scored = mix.score_mix_windows(table, forest, k=3)
    assert set(values(scored.select("source_ip", "model_scope").distinct(), "source_ip", "model_scope")) == {
        ("big", "device"), ("small", "vendor")}
    assert (at(40 * 300),) in values(scored.where("is_anomaly = 1 and source_ip = 'big'"), "window_start")


def test_silence(spark):
    now = at(100_000)
    activity = frame(spark, [(d, d, 30, at(0), at(seen), 10.0) for d, seen in (
        ("new", 80_000), ("still", 80_000), ("again", 80_000), ("back", 99_900), ("fine", 99_900))],
        "source_ip string, hostname string, event_count long, first_seen timestamp_ntz, last_seen timestamp_ntz, expected_interval_minutes double")
    prior = frame(spark, [(d, d, 10.0, at(70_000), at(71_000), n) for d, n in (
        ("still", now - timedelta(minutes=239)), ("again", now - timedelta(minutes=240)), ("back", at(71_000)), ("gone", at(71_000)))],
        "source_ip string, hostname string, expected_interval_minutes double, last_seen_at timestamp_ntz, silence_started_at timestamp_ntz, last_notified_at timestamp_ntz")
    out = silence.silence_transitions(activity, prior, now)
    assert sorted(values(out, "source_ip", "transition", "notify")) == [
        ("again", "still_silent", True), ("back", "recovered", True), ("gone", "unchanged", False),
        ("new", "newly_silent", True), ("still", "still_silent", False)]
    assert values(out.where("source_ip = 'back'"), "minutes") == [((99_900 - 70_000) / 60,)]
    assert {r[0] for r in values(silence.state_after(out), "source_ip")} == {"again", "gone", "new", "still"}


def test_alerts(spark):
    events = frame(spark, [(i, at(-60 * i), "h", "1.1.1.1", "p", "err", "AUTH", 1, f"m{i}") for i in range(5)],
                   "event_id long, event_time timestamp_ntz, hostname string, source_ip string, program string, "
                   "severity string, predicted_category string, is_anomaly int, message string")
    rules = frame(spark, [
        (1, "all", True, 4, 5, 10, None, None, None, None, None, False, None),
        (2, "two", True, 2, 3, 10, "h", None, None, "err", None, True, None),
        (3, "none", True, 60, 1, 10, None, None, "other", None, None, False, None),
        (4, "cool", True, 60, 1, 10, None, None, None, None, None, False, at(-599)),
        (5, "off", False, 60, 1, 10, None, None, None, None, None, False, None)],
        "id long, name string, enabled boolean, window_minutes int, threshold long, cooldown_minutes int, hostname string, source_ip string, "
        "program string, severity string, predicted_category string, only_anomalies boolean, last_triggered_at timestamp_ntz")
    out = alerts.evaluate_alerts(events, rules, at(0))
    assert sorted(values(out, "id", "matched_count", "fires", "sample_message")) == [
        (1, 5, True, "m4"), (2, 3, True, "m2"), (3, 0, False, ""), (4, 5, False, "m4")]


def test_cursor_never_splits_a_tie(spark):
    rows = frame(spark, [(i, at(t)) for i, t in enumerate((1, 2, 2, 2, 2, 3))], "event_id long, received_at timestamp_ntz")
    now = at(10_000)
    assert [len(state.cursor_batch(rows, at(c), now, 3).collect()) for c in (0, 1, 2, 3)] == [1, 4, 1, 0]


def test_scopes(spark):
    devices = frame(spark, [("10.1.2.3",), ("10.9.9.9",), ("11.0.0.1",)], "ip string")
    scopes = frame(spark, [(1, "10.0.0.0/8", "v2c"), (2, "10.1.0.0/16", "v2c"), (3, "10.1.2.3", "v3")],
                   "scope_id long, ip_or_cidr string, version string")
    assert sorted(values(enrich.match_scope(devices, scopes), "ip", "scope_id", "is_exact_host")) == [
        ("10.1.2.3", 3, True), ("10.9.9.9", 1, False)]
    assert enrich.match_scope(devices, scopes, best_only=False).count() == 4


@pytest.mark.parametrize("phrase,verdict,reason", [
    ("volume spike", "resolved", "volume_spike"), ("spike", "ambiguous", None),
    ("ethernet flap", "resolved", "interface_flapping"), ("wireless drops", "none", None), ("link drops", "resolved", "interface_flapping")])
def test_reason_phrases(spark, phrase, verdict, reason):
    out = resolve.resolve_reasons(frame(spark, [(phrase,)], "phrase string"))
    assert values(out, "verdict", "reason") == [(verdict, reason)]


def test_contains_join(spark):
    needles = ["a", "AB", "node-1", "ode", "zzz", "%", "node-11x"]
    hays = ["node-1", "node-11", "Node-2", "ab%c", "x"]
    out = contains_join(frame(spark, [(n,) for n in needles], "n string"), "n",
                        frame(spark, [(h,) for h in hays], "h string"), "h")
    assert set(values(out, "n", "h")) == {(n, h) for n in needles for h in hays if n.lower() in h.lower()}


def test_drain(spark):
    rows = frame(spark, [(i, at(i), m) for i, m in enumerate(
        ["user alice logged in from home", "user bob logged in from work", "disk full", "user carol logged in from home"])],
        "event_id long, event_time timestamp_ntz, message string")
    by_id = {r.event_id: r for r in templates.mine_templates(rows, "drain", depth=3).collect()}
    assert by_id[2].template == "disk full" and by_id[0].template == "user <*> logged in from <*>"
    assert by_id[0].template_id == by_id[1].template_id == by_id[3].template_id and by_id[0].template_size == 3


def drain_by_definition(messages, most, similarity=0.4):
    """Templates of one leaf: wildcards where tokens are many, then all that share enough tokens, one by one."""
    lists = sorted({tuple(m.split(" ")) for m in messages})
    wild = [len({t[i] for t in lists}) > most for i in range(len(lists[0]))]
    groups = [[t] for t in sorted({tuple("<*>" if w else x for w, x in zip(wild, t)) for t in lists})]
    near = lambda a, b: sum(x == y != "<*>" for x, y in zip(a, b)) >= similarity * len(a)
    while True:
        pair = next(((i, j) for j in range(len(groups)) for i in range(j) if any(near(a, b) for a in groups[i] for b in groups[j])), None)
        if pair is None:
            return {" ".join(x[0] if len(set(x)) == 1 else "<*>" for x in zip(*g)) for g in groups}
        groups[pair[0]] += groups.pop(pair[1])


@pytest.mark.parametrize("kinds,length", [("abcdef", 5), ("abcdefghijklmnopqrstuvwxyz", 3)])
def test_drain_leaf_by_definition(spark, kinds, length):
    """Clusters by the definition, in any partitioning and order."""
    rng = random.Random(5)
    messages = ["go " + " ".join(rng.choice(kinds) + rng.choice("xyz") for _ in range(length)) for _ in range(70)]
    want = drain_by_definition(messages, templates.MOST_TOKENS)
    for seed in (1, 2):
        random.Random(seed).shuffle(messages)
        rows = frame(spark, [(i, at(i), m) for i, m in enumerate(messages)], "event_id long, event_time timestamp_ntz, message string")
        found = {r.template for r in templates.mine_templates(rows.repartition(7), "drain", depth=3).collect()}
        assert found == want


def test_drain_of_a_full_leaf_is_linear(spark):
    """Unlike messages of one leaf: none meets another, and what varies too much becomes a wildcard."""
    words = F.concat(F.lit("go "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.translate(
        F.hex(F.xxhash64(F.col("id"), i)), "0123456789", "ghijklmnop")), " "))
    rows = spark.range(30_000).select(F.col("id").alias("event_id"), words.alias("message"))
    rows = rows.unionByName(rows.limit(10).select("event_id", F.concat(F.lit("go a b c d e "), (F.col("event_id") % 3).cast("string")).alias("message")))
    found = {r.template: r["count"] for r in templates.mine_templates(rows, "drain", depth=3).groupBy("template").count().collect()}
    assert found == {"go <*> <*> <*> <*> <*> <*>": 30_010}


def test_drain_generalises_further_where_templates_stay_many(spark, monkeypatch):
    monkeypatch.setattr(templates, "MOST_TEMPLATES", 5)
    rng = random.Random(2)
    messages = ["go " + " ".join(rng.choice("abcdefghij") for _ in range(4)) + rng.choice([" end", " fin"]) for _ in range(300)]
    rows = frame(spark, [(i, at(i), m) for i, m in enumerate(messages + ["other thing"])], "event_id long, event_time timestamp_ntz, message string")
    found = {r.template for r in templates.mine_templates(rows, "drain", depth=3, similarity=0.5).collect()}
    assert found == {"go <*> <*> <*> <*> end", "go <*> <*> <*> <*> fin", "other thing"}


def test_templates_keep_null_messages(spark):
    rows = frame(spark, [(1, at(1), None), (2, at(2), "a 1")], "event_id long, event_time timestamp_ntz, message string")
    for mode in ("mask", "drain"):
        assert templates.mine_templates(rows, mode).count() == 2


def test_flapping_keeps_rows_of_repeated_ids(spark):
    line = "ether1 link down"
    rows = frame(spark, [(7, at(0), "10.0.0.1", line)] * 2 + [(8, at(60), "10.0.0.1", line), (9, at(90), "10.0.0.1", "other")],
                 "event_id long, event_time timestamp_ntz, source_ip string, message string")
    out = signals.interface_flapping(rows).collect()
    assert len(out) == 4 and [r.interface_flapping for r in out if r.event_id == 8] == [True]


def test_alerts_reach_back_as_far_as_the_rules(spark):
    rules = frame(spark, [(1, "slow", 4320, 1, True, False, 10, None, None, None, None, None, None)],
                  "id long, name string, window_minutes int, threshold int, enabled boolean, only_anomalies boolean, cooldown_minutes int, "
                  "last_triggered_at timestamp_ntz, hostname string, source_ip string, program string, severity string, predicted_category string")
    events = frame(spark, [(1, at(0), "h", "10.0.0.1", "p", "err", "SYSTEM", 0, "m")],
                   "event_id long, event_time timestamp_ntz, hostname string, source_ip string, program string, severity string, "
                   "predicted_category string, is_anomaly int, message string")
    row = alerts.evaluate_alerts(events, rules, at(2 * 86400)).collect()[0]
    assert row.matched_count == 1 and row.fires


def test_second_backup_keeps_the_first(spark, tmp_path):
    def days(*numbers):
        return frame(spark, [(n, datetime(2024, 1, n), "h", "err", "m") for n in numbers],
                     "event_id long, event_time timestamp_ntz, hostname string, severity string, message string")

    first = tables.backup_partitions(days(1, 2), str(tmp_path / "b"), datetime(2024, 3, 1), 10).collect()
    second = tables.backup_partitions(days(3), str(tmp_path / "b"), datetime(2024, 3, 1), 10).collect()
    assert len(first) == 2 and [str(r.event_date) for r in second] == ["2024-01-03"]
    assert spark.read.option("header", True).csv(str(tmp_path / "b")).count() == 3


def test_audit_list_filters_before_it_cuts(spark):
    audit = frame(spark, [(i, 1, "login", f"t{i}", at(i)) for i in range(50)] + [(99, 1, "rule.edit", "x", at(-1))],
                  "id long, actor_id long, action string, target string, created_at timestamp_ntz")
    users = frame(spark, [(1, "a")], "id long, username string")
    assert [r.id for r in summary.audit_list(audit, users, contains="rule", n=5).collect()] == [99]
    assert [r.id for r in summary.audit_list(audit, users, n=3).collect()] == [49, 48, 47]


def test_knn_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = docs.orderBy("doc_id").limit(20).withColumnRenamed("doc_id", "query_id")
    exact = retrieval.knn_exact(docs, asked, 10).select("query_id", "doc_id")
    approx = retrieval.knn_approx(docs, asked, 10).select("query_id", "doc_id")
    assert exact.intersect(approx).count() >= 0.9 * exact.count()
