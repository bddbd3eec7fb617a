from checks.base import ip, with_lab

_IDENT = "arg_max(hostname, event_time) AS hostname, arg_max(vendor, event_time) AS vendor"
_SPAN = "count(*) AS {n}, min(event_time) AS first_seen, max(event_time) AS last_seen"
SPAN, ASPAN = _SPAN.format(n="event_count"), _SPAN.format(n="anomaly_event_count")
EXPLODED = "x AS (SELECT *, unnest(anomaly_reasons) AS anomaly_reason FROM lab WHERE is_anomaly = 1)"
DRS = f"drs AS (SELECT source_ip, anomaly_reason, {_IDENT}, {SPAN} FROM x GROUP BY 1, 2)"
ACKS = f"""acks AS (SELECT {ip('s_suppkey')} AS source_ip,
  CASE WHEN s_nationkey % 2 = 0 THEN 'always_severe' ELSE 'security_content' END AS anomaly_reason,
  'seen by ' || s_name AS note, CASE WHEN s_nationkey % 5 <> 0 THEN CAST(s_nationkey AS BIGINT) END AS acknowledged_by,
  TIMESTAMP '2024-01-01' + to_hours(s_nationkey) AS acknowledged_at FROM supplier)"""
AUDIT = """aud AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey % 40 END AS actor_id,
  CASE o_orderstatus WHEN 'F' THEN 'alert_rule.create' WHEN 'O' THEN 'anomaly.acknowledge'
    ELSE 'relay_source_ip.delete' END AS action,
  'rule-' || o_custkey AS target, o_orderpriority AS details, o_orderdate AS created_at FROM orders)"""
REQ = """req AS (SELECT source_ip, anomaly_reason, 'checked ' || hostname AS note,
  event_count % 25 AS actor_id FROM drs)"""
_AT = "TIMESTAMP '2024-01-31'"

SQL = {
    "device_reason_summary": with_lab("SELECT * FROM drs", EXPLODED, DRS),
    "device_total_anomalies": with_lab(
        f"SELECT source_ip, {_IDENT}, {ASPAN} FROM lab WHERE is_anomaly = 1 GROUP BY 1"),
    "vendor_total_anomalies": with_lab(
        f"SELECT vendor, count(DISTINCT source_ip) AS device_count, {ASPAN} FROM lab WHERE is_anomaly = 1 GROUP BY 1"),
    "vendor_reason_summary": with_lab(
        f"SELECT vendor, anomaly_reason, count(DISTINCT source_ip) AS device_count, {SPAN} FROM x GROUP BY 1, 2", EXPLODED),
    "device_category_summary": with_lab(
        f"SELECT source_ip, predicted_category, {_IDENT}, {SPAN} FROM lab GROUP BY 1, 2"),
    "vendor_category_summary": with_lab(
        f"SELECT vendor, predicted_category, count(DISTINCT source_ip) AS device_count, {SPAN} FROM lab GROUP BY 1, 2"),
    "summary_with_acks": with_lab("""
      SELECT d.*, a.source_ip IS NOT NULL AS acknowledged, lower(n.n_name) AS acknowledged_by,
             a.acknowledged_at, a.note
      FROM drs d LEFT JOIN acks a USING (source_ip, anomaly_reason)
      LEFT JOIN nation n ON n.n_nationkey = a.acknowledged_by""", EXPLODED, DRS, ACKS),
    "acknowledge": with_lab(f"""
      SELECT 'ack' AS kind, COALESCE(r.source_ip, a.source_ip) AS source_ip,
        COALESCE(r.anomaly_reason, a.anomaly_reason) AS anomaly_reason,
        CASE WHEN r.source_ip IS NOT NULL THEN r.note ELSE a.note END AS note,
        CASE WHEN r.source_ip IS NOT NULL THEN r.actor_id ELSE a.acknowledged_by END AS actor_id,
        CASE WHEN r.source_ip IS NOT NULL THEN {_AT} ELSE a.acknowledged_at END AS at
      FROM acks a FULL JOIN req r ON a.source_ip = r.source_ip AND a.anomaly_reason = r.anomaly_reason
      UNION ALL SELECT 'anomaly.acknowledge', source_ip, anomaly_reason, note, actor_id, {_AT} FROM req""",
      EXPLODED, DRS, ACKS, REQ),
    "unacknowledge": with_lab(f"""
      SELECT 'ack' AS kind, source_ip, anomaly_reason, note, acknowledged_by AS actor_id, acknowledged_at AS at
      FROM acks WHERE (source_ip, anomaly_reason) NOT IN (SELECT (source_ip, anomaly_reason) FROM req)
      UNION ALL SELECT 'anomaly.unacknowledge', source_ip, anomaly_reason, NULL, actor_id, {_AT}
      FROM req WHERE (source_ip, anomaly_reason) IN (SELECT (source_ip, anomaly_reason) FROM acks)""",
      EXPLODED, DRS, ACKS, REQ),
    "reason_ranking": with_lab(
        "SELECT * FROM drs WHERE anomaly_reason = 'always_severe' ORDER BY event_count DESC, source_ip LIMIT 10",
        EXPLODED, DRS),
    "reason_ranking_vendors": with_lab(f"""
      SELECT vendor, anomaly_reason, count(DISTINCT source_ip) AS device_count, {SPAN} FROM x
      WHERE anomaly_reason = 'security_content' GROUP BY 1, 2 ORDER BY event_count DESC, vendor LIMIT 10""", EXPLODED),
    "other_devices": with_lab("""SELECT * FROM drs WHERE anomaly_reason = 'always_severe'
      AND source_ip <> '10.0.0.8' ORDER BY event_count DESC, source_ip LIMIT 10""", EXPLODED, DRS),
    "audit_list": f"""WITH {AUDIT}, top AS (SELECT * FROM aud
        WHERE action = 'alert_rule.create' AND created_at >= TIMESTAMP '1996-01-01'
          AND (contains(lower(action), 'rule') OR contains(lower(target), 'rule'))
        ORDER BY created_at DESC, id DESC LIMIT 500)
      SELECT t.*, lower(n_name) AS actor_username FROM top t LEFT JOIN nation ON n_nationkey = actor_id""",
    "audit_actions": f"WITH {AUDIT} SELECT DISTINCT action FROM aud",
}
