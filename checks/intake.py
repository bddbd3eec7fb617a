from checks.base import EV, INVENTORY, LABELLED, with_lab
from checks.summaries import ACKS, DRS, EXPLODED

_TIES = "tie AS (SELECT * REPLACE (make_timestamp(epoch_us(received_at) // 1800000000 * 1800000000) AS received_at) FROM lab)"


def _cut(where: str, n: int) -> str:
    return f"""r AS (SELECT * FROM tie WHERE {where}),
      c AS (SELECT received_at, sum(count(*)) OVER (ORDER BY received_at) AS upto, row_number() OVER (ORDER BY received_at) AS rn
            FROM r GROUP BY received_at)
      SELECT event_id, received_at, source_ip, message FROM r
      WHERE received_at IN (SELECT received_at FROM c WHERE upto <= {n} OR rn = 1)"""


def _cursor(where: str, n: int) -> str:
    return "WITH " + ",\n".join([EV, INVENTORY, LABELLED, _TIES]) + ",\n" + _cut(where, n)


_ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')"
DOCS = """docs AS (SELECT sha256(strftime(event_time, '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN epoch_us(event_time) % 1000000 = 0 THEN '' ELSE strftime(event_time, '.%f') END || '|' || source_ip || '|' || program
    || '|' || coalesce(CAST(pid AS VARCHAR), 'None') || '|' || template_id || '|' || message) AS doc_id, event_time, source_ip,
  '[' || severity || '] ' || program || ' on ' || hostname || ' (' || vendor || ') category=' || predicted_category
    || CASE WHEN is_anomaly = 1 THEN ' anomaly(' || array_to_string(anomaly_reasons, ',') || ')' ELSE '' END
    || ': ' || message AS embedding_text FROM lab)"""

SQL = {
    "read_raw": "WITH " + EV + """ SELECT strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, source_ip, reported_hostname,
        facility, severity, program, CAST(pid AS VARCHAR) AS pid, message, raw
      FROM ev JOIN (SELECT event_id, k FROM seed) USING (event_id) WHERE k % 10 > 3""",
    "write_events": with_lab("""SELECT * REPLACE (array_to_string(anomaly_reasons, ',') AS anomaly_reasons), CAST(event_time AS DATE) AS event_date
      FROM (SELECT * EXCLUDE (pv) FROM lab)"""),
    "export_events": with_lab(f"""SELECT {_ISO.format(c='event_time')} AS event_time, source_ip, hostname, vendor, severity, program,
        coalesce(CAST(pid AS VARCHAR), '') AS pid, message, predicted_category, printf('%.4f', predicted_confidence) AS predicted_confidence,
        CAST(is_anomaly AS VARCHAR) AS is_anomaly, array_to_string(anomaly_reasons, '|') AS anomaly_reasons, resolution_method,
        false AS truncated FROM lab"""),
    "export_events_xml": with_lab(f"""SELECT {_ISO.format(c='event_time')} AS event_time, source_ip, hostname, program, message,
        array_to_string(anomaly_reasons, '|') AS anomaly_reasons FROM lab WHERE severity = 'err'"""),
    "export_table": with_lab(f"""SELECT d.source_ip, d.hostname, d.vendor, d.anomaly_reason, CAST(event_count AS VARCHAR) AS event_count,
        {_ISO.format(c='first_seen')} AS first_seen, CASE WHEN a.source_ip IS NOT NULL THEN 'true' ELSE 'false' END AS acknowledged,
        coalesce(lower(n_name), '') AS acknowledged_by, coalesce({_ISO.format(c='acknowledged_at')}, '') AS acknowledged_at,
        coalesce(note, '') AS note
      FROM drs d LEFT JOIN acks a USING (source_ip, anomaly_reason) LEFT JOIN nation ON n_nationkey = a.acknowledged_by""",
      EXPLODED, DRS, ACKS),
    "backup_partitions": "SELECT CAST(ts AS DATE) AS event_date, count(*) AS row_count FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1",
    "purge_partitions": "SELECT event_id, ts AS event_time, CAST(ts AS DATE) AS event_date FROM events WHERE ts >= TIMESTAMP '2024-01-16'",
    "latest_version": with_lab("""SELECT source_ip, program, arg_max(severity, event_time) AS severity, arg_max(message, event_time) AS message,
        max(event_time) AS event_time, arg_max(event_id, event_time) AS event_id FROM lab GROUP BY 1, 2"""),
    "keyed_upsert": with_lab("""SELECT coalesce(o.source_ip, n.source_ip) AS source_ip, coalesce(o.program, n.program) AS program,
        coalesce(n.n, o.n) AS n, coalesce(n.last_seen, o.last_seen) AS last_seen
      FROM o FULL JOIN n ON o.source_ip = n.source_ip AND o.program = n.program WHERE n.n IS NULL OR n.n % 3 <> 0""",
      "o AS (SELECT source_ip, program, count(*) AS n, max(event_time) AS last_seen FROM lab WHERE event_time < TIMESTAMP '2024-01-20' GROUP BY 1, 2)",
      "n AS (SELECT source_ip, program, count(*) AS n, max(event_time) AS last_seen FROM lab WHERE event_time >= TIMESTAMP '2024-01-28' GROUP BY 1, 2)"),
    "cursor_batch": _cursor("received_at > TIMESTAMP '2024-01-12' AND received_at <= TIMESTAMP '2024-01-30 23:20:00'", 200),
    "cursor_batch_anomalies": _cursor("received_at >= TIMESTAMP '2024-01-24' AND received_at <= TIMESTAMP '2024-01-30 23:20:00' AND is_anomaly = 1", 100),
    "cursor_range": _cursor("received_at > TIMESTAMP '2024-01-05' AND received_at <= TIMESTAMP '2024-01-06'", 150),
    "upsert_index": with_lab("""SELECT DISTINCT doc_id, event_time, source_ip,
        CASE WHEN event_time >= TIMESTAMP '2024-01-20' THEN embedding_text ELSE 'stale' END AS embedding_text FROM docs""", DOCS),
    "load_training": with_lab("""SELECT event_id, message, CASE WHEN severity = 'crit' THEN 'SYSTEM' ELSE predicted_category END AS label
      FROM lab WHERE event_id % 17 <> 0"""),
    "run_query": with_lab("""SELECT *, false AS truncated FROM q""",
      "q AS (SELECT source_ip, severity, count(*) AS n, max(event_time) AS latest FROM lab WHERE vendor <> 'unknown' GROUP BY 1, 2)"),
}
