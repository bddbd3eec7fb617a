from checks.base import RELAYS, ip, with_lab

T = "TIMESTAMP '2024-01-31'"


def minutes(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 1000000.0 / 60.0)"


ACT = f"""act AS (SELECT source_ip, arg_min(hostname, event_time) AS hostname, count(*) AS event_count,
    min(event_time) AS first_seen, max(event_time) AS last_seen,
    {minutes('min(event_time)', 'max(event_time)')} / (count(*) - 1) AS expected_interval_minutes
  FROM lab WHERE event_time >= TIMESTAMP '2024-01-01' GROUP BY 1 HAVING count(*) >= 20)"""
SIL = f"""sil AS (SELECT *, {minutes('last_seen', T)} AS silence_minutes,
    {minutes('last_seen', T)} > greatest(30.0, 3 * expected_interval_minutes) AS silent FROM act)"""
STATE = f"""st AS (SELECT {ip('s_suppkey')} AS source_ip, 'node-' || s_suppkey AS hostname,
    CAST(60 + s_nationkey AS DOUBLE) AS expected_interval_minutes,
    TIMESTAMP '2024-01-27' - to_hours(s_nationkey) AS last_seen_at,
    TIMESTAMP '2024-01-27' + to_minutes(10 * s_nationkey) AS silence_started_at,
    CASE WHEN s_nationkey % 3 <> 0 THEN {T} - to_minutes(30 * s_nationkey) END AS last_notified_at
  FROM supplier WHERE s_suppkey % 2 = 0)"""
TRANS = f"""tr AS (SELECT coalesce(a.source_ip, s.source_ip) AS source_ip, a.hostname AS ah, a.expected_interval_minutes AS ai,
    a.last_seen AS al, a.silence_minutes AS sm, s.*  EXCLUDE (source_ip),
    CASE WHEN a.source_ip IS NULL THEN 'unchanged' WHEN a.silent AND s.source_ip IS NULL THEN 'newly_silent'
         WHEN a.silent THEN 'still_silent' WHEN s.source_ip IS NOT NULL THEN 'recovered' END AS transition,
    (s.last_notified_at IS NULL OR {minutes('s.last_notified_at', T)} >= 240) AS again
  FROM sil a FULL JOIN st s ON a.source_ip = s.source_ip),
tr2 AS (SELECT source_ip, transition,
    CASE transition WHEN 'unchanged' THEN FALSE WHEN 'still_silent' THEN again ELSE TRUE END AS notify,
    round(CASE WHEN transition IN ('newly_silent', 'still_silent') THEN sm
         WHEN transition = 'recovered' THEN {minutes('last_seen_at', 'al')} END, 6) AS minutes,
    CASE WHEN transition IN ('newly_silent', 'still_silent') THEN ah WHEN transition = 'unchanged' THEN hostname END AS hostname,
    round(CASE WHEN transition IN ('newly_silent', 'still_silent') THEN ai WHEN transition = 'unchanged' THEN expected_interval_minutes END, 6) AS expected_interval_minutes,
    CASE WHEN transition IN ('newly_silent', 'still_silent') THEN al WHEN transition = 'unchanged' THEN last_seen_at END AS last_seen_at,
    CASE WHEN transition = 'newly_silent' THEN {T} WHEN transition IN ('still_silent', 'unchanged') THEN silence_started_at END AS silence_started_at,
    CASE WHEN transition = 'newly_silent' OR (transition = 'still_silent' AND again) THEN {T}
         WHEN transition IN ('still_silent', 'unchanged') THEN last_notified_at END AS last_notified_at
  FROM tr WHERE transition IS NOT NULL)"""

BUCKET = "make_timestamp(epoch_us(event_time) // 14400000000 * 14400000000)"
ANOM = f"""an AS (SELECT *, {BUCKET} AS bucket FROM lab WHERE is_anomaly = 1)"""
COUNTS = f"""bc AS (SELECT bucket, count(DISTINCT hostname) AS device_count FROM an
    WHERE event_time BETWEEN TIMESTAMP '2024-01-24' AND {T} GROUP BY 1),
bl AS (SELECT coalesce(median(c), 0.0) AS baseline FROM (SELECT count(DISTINCT hostname) AS c FROM an
    WHERE event_time BETWEEN TIMESTAMP '2024-01-17' AND TIMESTAMP '2024-01-24' GROUP BY bucket)),
el AS (SELECT bucket, device_count FROM bc, bl WHERE device_count >= greatest(5.0, 1.5 * baseline)),
sp AS (SELECT bucket, device_count, CAST(sum(b) OVER (ORDER BY bucket) AS BIGINT) AS span FROM (
    SELECT *, CASE WHEN bucket - lag(bucket) OVER (ORDER BY bucket) <= INTERVAL 240 MINUTE THEN 0 ELSE 1 END AS b FROM el)),
topsp AS (SELECT span, max(device_count) AS peak_devices, min(bucket) AS f FROM sp GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 5),
se AS (SELECT an.*, sp.span, t.peak_devices FROM an JOIN sp USING (bucket) JOIN topsp t ON t.span = sp.span
    WHERE event_time BETWEEN TIMESTAMP '2024-01-24' AND {T})"""

RULES = f"""rules AS (SELECT CAST(n_nationkey AS BIGINT) AS id, 'rule ' || n_name AS name, n_nationkey % 6 <> 5 AS enabled,
    CAST(57 * (1 + n_nationkey) AS INTEGER) AS window_minutes, CAST(1 + n_nationkey % 4 AS BIGINT) AS threshold,
    CAST(10 * n_nationkey AS INTEGER) AS cooldown_minutes,
    CASE WHEN n_nationkey % 8 = 7 THEN 'node-' || n_nationkey END AS hostname,
    CASE WHEN n_nationkey % 9 = 8 THEN {ip('n_nationkey')} END AS source_ip,
    CASE WHEN n_nationkey % 3 = 1 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'kernel' ELSE 'sshd' END END AS program,
    CASE WHEN n_nationkey % 5 = 2 THEN 'info' END AS severity,
    CASE WHEN n_nationkey % 4 = 3 THEN 'HARDWARE' END AS predicted_category,
    n_nationkey % 4 = 2 AS only_anomalies,
    CASE WHEN n_nationkey % 3 = 0 THEN {T} - to_minutes(15 * n_nationkey) END AS last_triggered_at FROM nation)"""
AT = "TIMESTAMP '2024-01-30 23:00:00'"
EVAL = f"""ev2 AS (SELECT r.id, r.name, r.window_minutes, r.threshold, {AT} - to_minutes(r.window_minutes) AS window_start,
    {AT} AS window_end, count(e.event_id) AS matched_count,
    coalesce(arg_min(e.message, e.event_time), '') AS sample_message,
    (r.last_triggered_at IS NOT NULL AND epoch_us({AT}) - epoch_us(r.last_triggered_at) < CAST(r.cooldown_minutes AS BIGINT) * 60000000) AS in_cooldown
  FROM rules r LEFT JOIN lab e ON e.event_time >= {AT} - to_minutes(r.window_minutes) AND e.event_time <= {AT}
    AND (r.hostname IS NULL OR r.hostname = e.hostname) AND (r.source_ip IS NULL OR r.source_ip = e.source_ip)
    AND (r.program IS NULL OR r.program = e.program) AND (r.severity IS NULL OR r.severity = e.severity)
    AND (r.predicted_category IS NULL OR r.predicted_category = e.predicted_category)
    AND (NOT r.only_anomalies OR e.is_anomaly = 1)
  WHERE r.enabled GROUP BY r.id, r.name, r.window_minutes, r.threshold, r.last_triggered_at, r.cooldown_minutes),
evald AS (SELECT *, (NOT in_cooldown AND matched_count >= threshold) AS fires FROM ev2)"""
HIST = """hist AS (SELECT o_orderkey AS id, o_custkey % 28 AS rule_id, o_orderdate + to_seconds(o_orderkey % 86400) AS triggered_at,
    o_orderdate AS window_start, o_orderdate + to_seconds(o_orderkey % 86400) AS window_end,
    o_custkey % 50 + 1 AS matched_count, o_orderpriority AS sample_message FROM orders)"""
DIG = "event_time BETWEEN TIMESTAMP '2024-01-27 12:00:00' AND TIMESTAMP '2024-01-30 12:00:00'"
TOPDEV = f"""topdev AS (SELECT source_ip, arg_min(hostname, event_time) AS hostname, count(*) AS event_count FROM lab
  WHERE {DIG} GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10)"""
REAS = f"reas AS (SELECT unnest(anomaly_reasons) AS reason FROM lab WHERE {DIG}), rc AS (SELECT reason, count(*) AS event_count FROM reas GROUP BY 1)"

SQL = {
    "device_activity": with_lab("SELECT * REPLACE (round(expected_interval_minutes, 6) AS expected_interval_minutes) FROM act", ACT),
    "silent_devices": with_lab("""SELECT * EXCLUDE (silent) REPLACE (round(expected_interval_minutes, 6) AS expected_interval_minutes,
      round(silence_minutes, 6) AS silence_minutes) FROM sil WHERE silent""", ACT, SIL),
    "silence_transitions": with_lab("SELECT * FROM tr2", ACT, SIL, STATE, TRANS),
    "silence_state_after": with_lab("SELECT * EXCLUDE (transition, notify, minutes) FROM tr2 WHERE transition <> 'recovered'",
                                    ACT, SIL, STATE, TRANS),
    "list_silent": f"WITH {STATE} SELECT *, round({minutes('silence_started_at', T)}, 6) AS silent_minutes FROM st WHERE contains(hostname, 'node-1')",
    "bucket_device_counts": with_lab("SELECT * FROM bc", ANOM, COUNTS),
    "bucket_baseline": with_lab("SELECT * FROM bl", ANOM, COUNTS),
    "elevated_spans": with_lab("SELECT bucket, device_count, span FROM sp", ANOM, COUNTS),
    "correlate_incidents": with_lab("""SELECT min(event_time) AS incident_start, max(event_time) AS incident_end, count(*) AS event_count,
        array_to_string(list_sort(list_distinct(list(hostname))), ',') AS devices_affected,
        array_to_string(list_sort(list_distinct(flatten(list(anomaly_reasons)))), ',') AS anomaly_reasons_seen,
        max(peak_devices) AS peak_devices, arg_min(hostname, event_time) AS root_hostname,
        arg_min(source_ip, event_time) AS root_source_ip, arg_min(vendor, event_time) AS root_vendor,
        array_to_string(list_sort(arg_min(anomaly_reasons, event_time)), ',') AS root_reasons,
        (SELECT round(baseline, 1) FROM bl) AS baseline_devices FROM se GROUP BY span""", ANOM, COUNTS),
    "incident_events": with_lab("""SELECT * FROM (SELECT span, CAST(row_number() OVER (PARTITION BY span ORDER BY event_time, event_id) AS INTEGER) AS number,
        event_time, hostname, source_ip, vendor, array_to_string(list_sort(anomaly_reasons), ',') AS anomaly_reasons FROM se)
      WHERE number <= 50""", ANOM, COUNTS),
    "evaluate_alerts": with_lab("SELECT * FROM evald", RULES, EVAL),
    "fire_alerts": with_lab(f"""SELECT r.id, CASE WHEN e.fires THEN {AT} ELSE r.last_triggered_at END AS last_triggered_at,
        h.firings, h.last_firing FROM rules r LEFT JOIN evald e USING (id)
      LEFT JOIN (SELECT rule_id, count(*) AS firings, max(triggered_at) AS last_firing FROM (
        SELECT rule_id, triggered_at FROM hist UNION ALL SELECT id, {AT} FROM evald WHERE fires) GROUP BY 1) h ON h.rule_id = r.id""",
      RULES, EVAL, HIST),
    "alert_history": f"WITH {HIST} SELECT * FROM hist WHERE rule_id = 5 ORDER BY triggered_at DESC, id DESC LIMIT 200",
    "alert_history_report": f"WITH {HIST}, {RULES} SELECT hist.*, rules.name AS rule_name FROM hist JOIN rules ON rules.id = rule_id",
    "list_rules": f"WITH {RULES} SELECT * FROM rules WHERE contains(lower(name), 'nation_1')",
    "list_relays": f"WITH {RELAYS} SELECT * FROM rel WHERE contains(ip, '10.0.0.')",
    "digest_totals": with_lab(f"SELECT count(*) AS total_events, count(*) FILTER (is_anomaly = 1) AS anomaly_events FROM lab WHERE {DIG}"),
    "digest_reasons": with_lab("SELECT * FROM rc", REAS),
    "digest_top_devices": with_lab("SELECT * FROM topdev", TOPDEV),
    "digest_alerts": f"""WITH {HIST}, {RULES} SELECT name, matched_count, triggered_at FROM hist JOIN rules ON rules.id = rule_id
      WHERE triggered_at BETWEEN TIMESTAMP '1998-05-31' AND TIMESTAMP '1998-06-30'""",
    "digest_silent": f"WITH {STATE} SELECT source_ip, hostname, silence_started_at FROM st",
    "digest_lines": with_lab(f"""SELECT '1 total' AS section, CAST(0 AS BIGINT) AS position, 'Total events: ' || count(*) AS text FROM lab WHERE {DIG}
      UNION ALL SELECT '2 anomalous', 0, 'Anomalous events: ' || count(*) FILTER (is_anomaly = 1) FROM lab WHERE {DIG}
      UNION ALL SELECT '3 reasons', -event_count, reason || ': ' || event_count FROM rc
      UNION ALL SELECT '4 devices', -event_count, hostname || ' (' || source_ip || '): ' || event_count || ' events' FROM topdev
      UNION ALL SELECT '5 alerts', 0, '(none)'
      UNION ALL SELECT '6 silent', epoch_us(silence_started_at), hostname || ' (' || source_ip || ') -- silent since ' ||
        strftime(silence_started_at, '%Y-%m-%d %H:%M:%S') FROM st""", REAS, TOPDEV, STATE),
}
