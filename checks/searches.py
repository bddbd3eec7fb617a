from checks.base import with_lab

AS_OF = "TIMESTAMP '2024-01-31'"
ROLLUP = """mins AS (SELECT date_trunc('minute', event_time) AS minute, hostname, vendor, severity, predicted_category,
  count(*) AS event_count, CAST(sum(is_anomaly) AS BIGINT) AS anomaly_count,
  count(*) FILTER (resolution_method = 'unresolved') AS unresolved_count FROM lab GROUP BY ALL)"""
PERIODS = """p AS (SELECT * FROM (VALUES
  ('today', TIMESTAMP '2024-01-29', TIMESTAMP '2024-01-29 15:30:00'),
  ('yesterday', TIMESTAMP '2024-01-28', TIMESTAMP '2024-01-29'),
  ('this week', TIMESTAMP '2024-01-22 15:30:00', TIMESTAMP '2024-01-29 15:30:00'),
  ('last week', TIMESTAMP '2024-01-15 15:30:00', TIMESTAMP '2024-01-22 15:30:00'),
  ('this month', TIMESTAMP '2023-12-30 15:30:00', TIMESTAMP '2024-01-29 15:30:00'),
  ('last month', TIMESTAMP '2023-11-30 15:30:00', TIMESTAMP '2023-12-30 15:30:00'),
  ('this hour', TIMESTAMP '2024-01-29 14:30:00', TIMESTAMP '2024-01-29 15:30:00'),
  ('last hour', TIMESTAMP '2024-01-29 13:30:00', TIMESTAMP '2024-01-29 14:30:00'),
  ('3 day(s) ago', TIMESTAMP '2024-01-26', TIMESTAMP '2024-01-27')) t(period, period_start, period_end))"""


def _counts(where: str = "TRUE") -> str:
    return f"""pc AS (SELECT p.*, count(e.event_id) AS event_count
      FROM p LEFT JOIN (SELECT * FROM lab WHERE {where}) e
        ON e.event_time BETWEEN p.period_start AND p.period_end GROUP BY ALL)"""


SQL = {
    "filter_events": with_lab(f"""SELECT event_id, event_time, source_ip, hostname, vendor, program, message FROM lab
      WHERE event_time BETWEEN TIMESTAMP '2024-01-10' AND {AS_OF} AND severity = 'err'
        AND contains(lower(message), 'failed by') AND list_contains(anomaly_reasons, 'security_content') AND is_anomaly = 1"""),
    "search_events": with_lab(f"""SELECT event_id, event_time, hostname, severity, message,
        array_to_string(anomaly_reasons, ',') AS reasons,
        (SELECT count(*) FROM f) > 70 AS has_more
      FROM f ORDER BY event_time DESC, hostname, severity, event_id LIMIT 50 OFFSET 20""",
      f"""f AS (SELECT * FROM lab WHERE event_time BETWEEN TIMESTAMP '2024-01-05' AND {AS_OF}
        AND contains(lower(message), 'ether'))"""),
    "count_events": with_lab(f"""SELECT count(*) AS event_count FROM lab
      WHERE event_time BETWEEN TIMESTAMP '2024-01-03' AND {AS_OF} AND vendor = 'mikrotik' AND predicted_category = 'HARDWARE'"""),
    "aggregate_events": with_lab("""SELECT vendor, program, severity, count(*) AS event_count FROM lab
      GROUP BY ALL ORDER BY event_count DESC, vendor, program, severity LIMIT 40"""),
    "filter_options": with_lab("""SELECT DISTINCT 'vendor' AS field, vendor AS value FROM lab WHERE event_time >= TIMESTAMP '2024-01-01'
      UNION SELECT DISTINCT 'program', program FROM lab WHERE event_time >= TIMESTAMP '2024-01-01'"""),
    "period_counts": with_lab("SELECT * FROM pc", PERIODS, _counts()),
    "period_trend": with_lab("""SELECT a.period AS earlier, b.period AS later, a.event_count AS earlier_count,
        b.event_count AS later_count, b.event_count - a.event_count AS delta,
        CASE WHEN a.event_count <> 0 THEN round(abs(b.event_count - a.event_count) / a.event_count * 100, 1)
             WHEN b.event_count = a.event_count THEN 0.0 END AS percent,
        CASE WHEN b.event_count > a.event_count THEN 'increased' WHEN b.event_count < a.event_count THEN 'decreased'
             ELSE 'same' END AS direction
      FROM pc a, pc b WHERE a.period = 'last week' AND b.period = 'this week'""", PERIODS, _counts("severity = 'err'")),
    "list_devices": with_lab("""SELECT *, count(*) OVER () > 65 AS has_more FROM d WHERE contains(lower(hostname), 'node') AND contains(lower(vendor), 'o')
      ORDER BY event_count DESC, source_ip LIMIT 60 OFFSET 5""",
      """d AS (SELECT source_ip, arg_max(hostname, event_time) AS hostname, arg_max(vendor, event_time) AS vendor,
        arg_max(vendor_source, event_time) AS vendor_source, arg_max(model, event_time) AS model,
        arg_max(resolution_method, event_time) AS resolution_method, min(event_time) AS first_seen_in_window,
        max(event_time) AS last_seen, count(*) AS event_count
        FROM lab WHERE event_time >= TIMESTAMP '2024-01-01' AND contains(source_ip, '10.0') GROUP BY 1)"""),
    "resolution_summary": with_lab("""SELECT *, round(device_count * 100.0 / sum(device_count) OVER (), 1) AS share_percent
      FROM (SELECT resolution_method, count(DISTINCT source_ip) AS device_count FROM lab
            WHERE event_time >= TIMESTAMP '2024-01-26' GROUP BY 1)"""),
    "events_by_minute": with_lab("SELECT * FROM mins", ROLLUP),
    "volume_by_severity": with_lab("""SELECT minute, severity, CAST(sum(event_count) AS BIGINT) AS value FROM mins
      WHERE minute BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20' GROUP BY 1, 2""", ROLLUP),
    "volume_by_category": with_lab("""SELECT minute, predicted_category, CAST(sum(event_count) AS BIGINT) AS value FROM mins
      WHERE minute BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20' GROUP BY 1, 2""", ROLLUP),
    "recent_anomalies": with_lab("""SELECT CAST(coalesce(sum(anomaly_count), 0) AS BIGINT) AS anomalies FROM mins
      WHERE minute >= TIMESTAMP '2024-01-29'""", ROLLUP),
    "resolution_share": with_lab("""SELECT resolution_method, count(*) AS events FROM lab
      WHERE event_time >= TIMESTAMP '2024-01-29' GROUP BY 1"""),
    "top_error_hosts": with_lab("""SELECT hostname, vendor, resolution_method, predicted_category, count(*) AS events
      FROM lab WHERE event_time >= TIMESTAMP '2024-01-21' AND severity IN ('err', 'crit', 'alert', 'emerg')
      GROUP BY ALL ORDER BY events DESC, 1, 2, 3, 4 LIMIT 25"""),
}
