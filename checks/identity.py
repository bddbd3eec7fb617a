from checks.base import (EV, INVENTORY, LABELLED, RANK, RELAYED, RELAYS, USABLE, category, ip, vendor, with_ev, with_lab)
from checks.intake import DOCS

T = "TIMESTAMP '2024-01-31'"
_IDENTITY = "event_id, source_ip, hostname, reported_hostname, relayed_via, vendor, vendor_source, model, resolution_method"
_IP4 = r"regexp_full_match(reported_hostname, '((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)')"
RESOLVED = f"""moved AS (
  SELECT e.*, (r.ip IS NOT NULL AND reported_hostname <> source_ip AND {_IP4}) AS as_ip,
    (r.ip IS NOT NULL AND reported_hostname <> '' AND NOT {_IP4} AND lower(reported_hostname) NOT IN ('localhost', 'localhost.localdomain')
      AND reported_hostname IS DISTINCT FROM ri.hostname) AS as_name
  FROM rev e LEFT JOIN rel r ON r.ip = e.source_ip LEFT JOIN inv ri ON ri.ip = r.ip),
moved2 AS (SELECT * REPLACE (CASE WHEN as_ip OR as_name THEN reported_hostname ELSE source_ip END AS source_ip),
    CASE WHEN as_ip OR as_name THEN source_ip ELSE '' END AS relayed_via, {vendor('message')} AS pv FROM moved),
res AS (SELECT m.*, (i.ip IS NOT NULL AND NOT as_name) AS known,
    CASE WHEN i.ip IS NOT NULL AND NOT as_name THEN i.hostname WHEN as_name OR {USABLE} THEN reported_hostname ELSE source_ip END AS hostname,
    CASE WHEN i.ip IS NOT NULL AND NOT as_name THEN i.vendor ELSE pv END AS vendor,
    CASE WHEN i.ip IS NOT NULL AND NOT as_name THEN 'snmp' WHEN pv <> 'unknown' THEN 'passive' ELSE 'unknown' END AS vendor_source,
    CASE WHEN i.ip IS NOT NULL AND NOT as_name THEN i.model ELSE '' END AS model,
    CASE WHEN i.ip IS NOT NULL AND NOT as_name THEN i.resolution_method WHEN as_name OR {USABLE} THEN 'syslog_reported' ELSE 'unresolved' END AS resolution_method
  FROM moved2 m LEFT JOIN inv i ON i.ip = m.source_ip)"""
PEND = f"""pend AS (SELECT {ip('c_custkey')} AS ip, {T} - to_hours(c_nationkey + 30) AS first_seen,
    CASE WHEN c_custkey % 5 <> 0 THEN {T} - to_hours(2 * c_nationkey) END AS last_attempt, CAST(c_nationkey % 6 AS INTEGER) AS attempt_count,
    CASE c_custkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'no_credential' ELSE 'unreachable' END AS status FROM customer)"""
POLL = f"""poll AS (SELECT {ip('c_custkey')} AS ip, CASE c_custkey % 4 WHEN 0 THEN 'no_scope' WHEN 1 THEN 'failed' ELSE 'answered' END AS outcome,
    CASE WHEN c_custkey % 4 = 2 THEN 'sys-' || c_custkey END AS hostname, c_name AS description,
    CASE WHEN c_custkey % 4 = 2 THEN CASE c_nationkey % 5 WHEN 0 THEN 'cisco' WHEN 1 THEN 'juniper' WHEN 2 THEN 'mikrotik'
      WHEN 3 THEN 'hp' ELSE 'unknown' END ELSE 'unknown' END AS vendor,
    {T} - to_minutes(c_nationkey) AS attempted_at FROM customer WHERE c_custkey % 4 <> 3)"""
_NUM = "(CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT))"
SCOPES = f"""sc AS (SELECT s_suppkey AS scope_id, CASE s_suppkey % 4 WHEN 0 THEN {ip('s_suppkey')}
      WHEN 1 THEN '10.0.' || (s_suppkey // 256 % 256) || '.0/24' WHEN 2 THEN {ip('s_suppkey')} || '/28'
      ELSE '10.0.0.0/' || (8 + s_suppkey % 9) END AS ip_or_cidr, CASE WHEN s_suppkey % 5 = 0 THEN 'v3' ELSE 'v2c' END AS version FROM supplier),
net AS (SELECT *, CAST(coalesce(nullif(split_part(ip_or_cidr, '/', 2), ''), '32') AS INTEGER) AS prefix_length,
    {_NUM.format("split_part(ip_or_cidr, '/', 1)")} AS n FROM sc),
rng AS (SELECT *, n // CAST(2 ** (32 - prefix_length) AS BIGINT) * CAST(2 ** (32 - prefix_length) AS BIGINT) AS lo,
    (n // CAST(2 ** (32 - prefix_length) AS BIGINT) + 1) * CAST(2 ** (32 - prefix_length) AS BIGINT) - 1 AS hi FROM net),
dev AS (SELECT DISTINCT source_ip AS ip, {_NUM.format('source_ip')} AS d FROM ev),
cand AS (SELECT ip, scope_id, ip_or_cidr, version, prefix_length, prefix_length = 32 AS is_exact_host,
    CAST(row_number() OVER (PARTITION BY ip ORDER BY prefix_length DESC, scope_id) AS INTEGER) AS candidate
  FROM dev JOIN rng ON d BETWEEN lo AND hi)"""
SHIFTED = """sh AS (SELECT rev.* REPLACE (rev.event_time + to_seconds(CASE WHEN k % 10 < 2 THEN 10800 WHEN k % 10 = 2 THEN 600 ELSE 0 END) AS event_time)
  FROM rev JOIN (SELECT event_id, k FROM seed) USING (event_id))"""
SKEW = """d AS (SELECT event_id, event_time, source_ip, received_at, (epoch_us(received_at) - epoch_us(event_time)) / 1000000.0 AS diff FROM ev),
w AS (SELECT *, avg(diff) OVER f AS m, stddev_pop(diff) OVER f AS s, count(*) OVER f AS n FROM d
  WINDOW f AS (PARTITION BY source_ip ORDER BY received_at, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, CASE WHEN n >= 30 AND abs(m) >= 300 AND s <= 120 THEN m WHEN n >= 30 AND abs(m) < 150 THEN 0.0 END AS signal FROM w),
h AS (SELECT *, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY source_ip ORDER BY received_at, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS skew FROM g)"""
SEGMENTS = """sg AS (SELECT e.event_id * 2 + i.idx AS event_id, e.event_time,
    e.received_at + to_seconds(CASE WHEN event_type = 'signup' THEN 2 * CASE WHEN k % 2 = 0 THEN 1 - i.idx ELSE i.idx END ELSE 0 END) AS received_at,
    source_ip, reported_hostname, k, u, event_type, i.idx, e.event_id % 50 AS mid, program, message, raw,
    lpad(CAST(e.event_id % 50 AS VARCHAR), 10, '0') || ' ' || CASE WHEN k % 5 = 1 THEN '1' ELSE '2' END || ' ' || i.idx || ' ' AS head,
    CASE WHEN i.idx = 0 THEN 'part one of ' || k || ',' ELSE ' part two of ' || u END AS content
  FROM ev e JOIN (SELECT event_id, k, u, event_type FROM seed) USING (event_id), (VALUES (0), (1)) i(idx)
  WHERE i.idx = 0 OR (event_type = 'signup' AND k % 5 > 1)),
pa AS (SELECT *, coalesce(epoch_us(received_at) - epoch_us(lag(received_at) OVER o) > 10000000, TRUE) AS starts FROM sg
  WHERE event_type = 'signup' AND k % 5 <> 1 WINDOW o AS (PARTITION BY source_ip, reported_hostname, mid ORDER BY received_at, event_id)),
ps AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY source_ip, reported_hostname, mid ORDER BY received_at, event_id) AS grp FROM pa)"""


def drain(source: str, columns: str) -> str:
    """CTEs and query: templates of `source` (event_id, masked), as one leaf per token count and two leading tokens."""
    tokens = r"list_filter(regexp_split_to_array(masked, '\s+'), lambda t: t <> '')"
    head = r"list_transform(toks[1:2], lambda t: CASE WHEN regexp_matches(t, '[0-9]|<\*>') THEN '<*>' ELSE t END)"
    return rf"""dm AS (SELECT masked, {tokens} AS toks FROM (SELECT DISTINCT masked FROM {source})),
dl AS (SELECT masked, toks, len(toks) || ' ' || array_to_string({head}, ' ') AS leaf FROM dm),
dn AS (SELECT leaf FROM dl GROUP BY 1 HAVING count(*) > 32),
dt AS (SELECT masked, leaf, unnest(range(1, len(toks) + 1)) AS place, unnest(toks) AS token FROM dl),
dw AS (SELECT leaf, place FROM dt WHERE leaf IN (SELECT leaf FROM dn) GROUP BY 1, 2 HAVING count(DISTINCT token) > 32),
dg AS (SELECT dl.masked, dl.leaf, list_transform(toks, lambda t, i: CASE WHEN list_contains(coalesce(w, []), i) THEN '<*>' ELSE t END) AS toks
  FROM dl LEFT JOIN (SELECT leaf, list(place) AS w FROM dw GROUP BY 1) USING (leaf)),
du AS (SELECT DISTINCT leaf, toks FROM dg),
dp AS (SELECT a.leaf, a.toks AS x, b.toks AS y FROM du a JOIN du b ON a.leaf = b.leaf AND a.toks <> b.toks
  AND len(list_filter(list_zip(a.toks, b.toks), lambda p: p[1] = p[2] AND p[1] <> '<*>')) >= 0.4 * len(a.toks)),
dr AS (SELECT leaf, toks AS x, toks AS y FROM du UNION SELECT dr.leaf, dr.x, dp.y FROM dr JOIN dp ON dr.leaf = dp.leaf AND dr.y = dp.x),
dc AS (SELECT leaf, x AS toks, min(y) AS least FROM dr GROUP BY 1, 2),
df AS (SELECT leaf, least, place, CASE WHEN count(DISTINCT token) = 1 THEN min(token) ELSE '<*>' END AS token FROM (
  SELECT leaf, least, unnest(range(1, len(toks) + 1)) AS place, unnest(toks) AS token FROM dc) GROUP BY 1, 2, 3),
dx AS (SELECT leaf, least, string_agg(token, ' ' ORDER BY place) AS template FROM df GROUP BY 1, 2),
dy AS (SELECT dg.masked, leaf, coalesce(template, '') AS template FROM dg JOIN dc USING (leaf, toks) LEFT JOIN dx USING (leaf, least)),
dz AS (SELECT event_id, md5(leaf || chr(9) || template) AS template_id, template FROM {source} JOIN dy USING (masked))
SELECT {columns}, count(*) OVER (PARTITION BY template_id) AS template_size FROM dz"""


SQL = {
    "normalize_record": with_ev(f"""SELECT event_id, CASE WHEN k % 10 < 2 THEN received_at ELSE event_time END AS event_time, received_at,
        CASE WHEN k % 11 = 0 THEN 'unknown' ELSE source_ip END AS source_ip,
        CASE WHEN k % 12 = 0 THEN '' ELSE reported_hostname END AS reported_hostname,
        CASE WHEN k % 13 = 0 THEN 'unknown' ELSE facility END AS facility, severity,
        CAST({RANK} AS INTEGER) AS severity_num,
        CASE WHEN k % 15 = 0 THEN 'unknown' ELSE program END AS program,
        CASE WHEN k % 7 < 2 THEN NULL ELSE pid END AS pid, message, raw
      FROM (SELECT * REPLACE (CASE WHEN k % 14 = 0 THEN 'info' ELSE severity END AS severity) FROM ev JOIN (SELECT event_id, k FROM seed) USING (event_id))"""),
    "severity_rank": with_ev(f"""SELECT event_id, severity, CAST({RANK} AS INTEGER) AS severity_num FROM (
        SELECT event_id, CASE WHEN event_id % 3 = 0 THEN upper(severity) WHEN event_id % 7 = 0 THEN 'strange' ELSE severity END AS severity FROM ev)"""),
    "weak_label": with_ev(f"SELECT event_id, {category('message')} AS predicted_category FROM ev"),
    "detect_vendor": with_ev(f"SELECT event_id, {vendor('message')} AS vendor FROM ev"),
    "join_inventory": with_lab(f"SELECT {_IDENTITY} FROM lab"),
    "resolve_identity": with_ev(f"SELECT {_IDENTITY} FROM res", RELAYED, INVENTORY, RELAYS, RESOLVED),
    "pending_queue": with_ev(f"""SELECT source_ip AS ip, min(received_at) AS first_seen, CAST(0 AS INTEGER) AS attempt_count, 'pending' AS status
      FROM res WHERE NOT known AND NOT as_name AND source_ip NOT IN (SELECT ip FROM pend WHERE status = 'unreachable') GROUP BY 1""",
      RELAYED, INVENTORY, RELAYS, RESOLVED, PEND),
    "pending_due": f"""WITH {PEND} SELECT * FROM pend WHERE status = 'pending' OR last_attempt IS NULL
      OR epoch_us({T}) - epoch_us(last_attempt) >= 86400000000""",
    "advance_pending": f"""WITH {PEND}, {POLL} SELECT p.ip, p.first_seen, CASE WHEN outcome IS NULL THEN last_attempt ELSE {T} END AS last_attempt,
        CAST(CASE WHEN outcome IS NULL THEN attempt_count ELSE attempt_count + 1 END AS INTEGER) AS attempt_count,
        CASE WHEN outcome IS NULL THEN status WHEN outcome = 'no_scope' THEN 'no_credential'
             WHEN attempt_count + 1 >= 5 THEN 'unreachable' ELSE 'pending' END AS status
      FROM pend p LEFT JOIN poll USING (ip) WHERE outcome IS NULL OR outcome <> 'answered'""",
    "match_scope": with_ev("SELECT * FROM cand WHERE candidate = 1", SCOPES),
    "match_scope_candidates": with_ev("SELECT * FROM cand", SCOPES),
    "vendor_from_oid": f"WITH {POLL} SELECT ip, vendor FROM poll",
    "refresh_inventory": f"""WITH {INVENTORY}, {PEND}, {POLL}, fresh AS (
        SELECT p.ip, p.hostname, p.vendor, p.description AS model, 'snmp' AS resolution_method,
          coalesce(i.first_seen, q.first_seen) AS first_seen, attempted_at AS last_resolved
        FROM poll p LEFT JOIN inv i USING (ip) LEFT JOIN pend q USING (ip) WHERE outcome = 'answered')
      SELECT * FROM fresh UNION ALL SELECT * FROM inv WHERE ip NOT IN (SELECT ip FROM fresh)""",
    "fix_relay_timezone": with_ev("""SELECT event_id, CASE WHEN rel.ip IS NOT NULL AND epoch_us(event_time) - epoch_us(received_at) > 1800000000
          AND abs(epoch_us(event_time) - epoch_us(received_at) - 10800000000) < abs(epoch_us(event_time) - epoch_us(received_at))
        THEN event_time - INTERVAL 3 HOUR ELSE event_time END AS event_time FROM sh LEFT JOIN rel ON rel.ip = source_ip""",
      RELAYED, RELAYS, SHIFTED),
    "correct_clock_skew": with_ev("""SELECT event_id, make_timestamp(epoch_us(event_time) + CAST(round(skew * 1000000) AS BIGINT)) AS event_time,
        round(skew, 6) AS skew_seconds FROM h""", SKEW),
    "reassemble_multipart": with_ev("""SELECT event_id, event_time, source_ip, program, message, raw FROM sg WHERE event_type <> 'signup'
      UNION ALL SELECT event_id, event_time, source_ip, 'CSCOacs_Passed', content, head || content FROM sg WHERE event_type = 'signup' AND k % 5 = 1
      UNION ALL SELECT arg_min(event_id, (idx, received_at)), arg_min(event_time, (idx, received_at)), source_ip, 'CSCOacs_Passed',
        string_agg(content, '' ORDER BY idx), string_agg(head || content, chr(10) ORDER BY idx)
      FROM ps GROUP BY source_ip, reported_hostname, mid, grp""", SEGMENTS),
    "embedding_text": with_lab("SELECT event_id, embedding_text FROM (SELECT event_id, docs.embedding_text FROM lab JOIN docs USING (event_time, source_ip))", DOCS),
    "doc_id": with_lab("SELECT event_id, doc_id FROM lab JOIN docs USING (event_time, source_ip)", DOCS),
    "mine_templates": with_ev("""SELECT event_id, md5(t) AS template_id, t AS template, count(*) OVER (PARTITION BY t) AS template_size
      FROM (SELECT event_id, regexp_replace(message, '[0-9]+', '<*>', 'g') AS t FROM ev)"""),
    "mine_templates_drain": "WITH RECURSIVE " + EV + ",\nde AS (SELECT event_id, regexp_replace(message, '[0-9]+', '<*>', 'g') AS masked FROM ev),\n"
        + drain("de", "event_id, template_id, template"),
    "mine_templates_drain_documents": "WITH RECURSIVE de AS (SELECT doc_id AS event_id, regexp_replace(coalesce(text, ''), '[0-9]+', '<*>', 'g') AS masked "
        "FROM documents),\n" + drain("de", "event_id, template_id"),
    "padded_window": with_ev("""SELECT source_ip, max(event_time) - INTERVAL 10 MINUTE AS window_start,
        least(max(event_time) + INTERVAL 15 MINUTE, TIMESTAMP '2024-01-30 12:00:00') AS window_end FROM ev GROUP BY 1"""),
    "local_time": "SELECT event_id, ts AS event_time, ts + INTERVAL 2 HOUR AS local_time, ts AS back_in_utc, CAST(120 AS INTEGER) AS offset_minutes FROM events",
}
