from checks.base import SECURE, SEVERE, with_ev, with_lab

SPIKE = """ss AS (SELECT event_id, coalesce(severity_num < min(severity_num) OVER (PARTITION BY source_ip ORDER BY event_time
    RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), FALSE) AS severity_spike FROM lab)"""
RARE = "rt AS (SELECT event_id, row_number() OVER (PARTITION BY template_id ORDER BY event_time, event_id) <= 5 AS rare_template FROM lab)"
VOLUME = """vb AS (SELECT source_ip, epoch_us(event_time) // 86400000000 AS bucket, count(*) AS events, min(event_time) AS f, max(event_time) AS l
    FROM lab GROUP BY 1, 2),
vw AS (SELECT source_ip, bucket, events, sum(events) OVER w / greatest(date_diff('minute', min(f) OVER w, max(l) OVER w), 1) AS rate FROM vb
    WINDOW w AS (PARTITION BY source_ip ORDER BY bucket RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)),
vs AS (SELECT source_ip, bucket, events, rate AS baseline_per_minute, coalesce(events / 1440.0 >= 3 * rate, FALSE) AS spiking FROM vw),
vo AS (SELECT event_id, EXISTS (SELECT 1 FROM vs WHERE vs.source_ip = lab.source_ip AND spiking
    AND vs.bucket + 1 = epoch_us(event_time) // 86400000000) AS volume_spike FROM lab)"""
FLAP = """fd AS (SELECT event_id, event_time, source_ip, regexp_extract(trim(message), '\\b(ether\\d+) link (up|down)\\b', 1) AS iface FROM lab
    WHERE regexp_matches(message, '\\bether\\d+ link down\\b')),
fw AS (SELECT event_id, count(*) OVER (PARTITION BY source_ip, iface ORDER BY event_time
    RANGE BETWEEN INTERVAL 172800 SECOND PRECEDING AND CURRENT ROW) >= 3 AS flap FROM fd),
fl AS (SELECT event_id, coalesce(flap, FALSE) AS interface_flapping FROM lab LEFT JOIN fw USING (event_id))"""
WCOUNT = """dv AS (SELECT source_ip, coalesce(max(vendor) FILTER (vendor <> 'unknown'), 'unknown') AS dvendor FROM lab
    WHERE event_time >= TIMESTAMP '2024-01-01' AND event_time < TIMESTAMP '2024-01-31' GROUP BY 1),
wc AS (SELECT source_ip, make_timestamp(epoch_us(event_time) // 21600000000 * 21600000000) AS window_start, template_id,
    count(*) AS event_count, any_value(dvendor) AS vendor FROM lab JOIN dv USING (source_ip)
    WHERE event_time >= TIMESTAMP '2024-01-01' AND event_time < TIMESTAMP '2024-01-31' GROUP BY 1, 2, 3)"""
VECTORS = """wd AS (SELECT DISTINCT source_ip, vendor, window_start FROM wc),
scopes AS (SELECT 'device' AS model_scope, source_ip AS scope_key FROM wd GROUP BY 2 HAVING count(*) >= 30
    UNION ALL SELECT 'vendor', vendor FROM wd WHERE vendor <> 'unknown' GROUP BY 2 HAVING count(*) >= 30),
scoped AS (SELECT s.*, wc.* FROM wc JOIN scopes s ON scope_key = CASE WHEN model_scope = 'device' THEN source_ip ELSE vendor END),
top AS (SELECT * FROM (SELECT model_scope, scope_key, template_id, row_number() OVER (PARTITION BY model_scope, scope_key
    ORDER BY sum(event_count) DESC, template_id) AS slot FROM scoped GROUP BY 1, 2, 3) WHERE slot <= 4)"""
PAIRS = """pr AS (SELECT * FROM (SELECT source_ip, event_id, event_time AS transition_time,
    lag(template_id) OVER (PARTITION BY source_ip ORDER BY event_time, event_id) AS prev_template_id, template_id AS curr_template_id
    FROM lab WHERE event_time >= TIMESTAMP '2024-01-01') WHERE prev_template_id IS NOT NULL)"""
MODEL = """kv AS (SELECT source_ip, max(vendor) AS vendor FROM lab WHERE vendor <> 'unknown' GROUP BY 1),
cp AS (SELECT DISTINCT lab.source_ip, TIMESTAMP '2024-01-24' AS last_scored FROM lab JOIN seed USING (event_id) WHERE u % 5 <> 0),
prior AS (SELECT pr.* FROM pr LEFT JOIN cp USING (source_ip) WHERE last_scored IS NULL OR transition_time <= last_scored),
cnt AS (SELECT 'device' AS model_scope, source_ip AS scope_key, prev_template_id, curr_template_id, count(*) AS transitions FROM prior GROUP BY ALL
    UNION ALL SELECT 'vendor', vendor, prev_template_id, curr_template_id, count(*) FROM prior JOIN kv USING (source_ip) GROUP BY ALL),
mdl AS (SELECT c.*, CAST(sum(transitions) OVER (PARTITION BY model_scope, scope_key, prev_template_id) AS BIGINT) AS prev_total, vocabulary
    FROM cnt c JOIN (SELECT model_scope, scope_key, count(DISTINCT curr_template_id) AS vocabulary FROM cnt GROUP BY 1, 2
      HAVING sum(transitions) >= CASE WHEN model_scope = 'device' THEN 40 ELSE 200 END) USING (model_scope, scope_key))"""
SCORED = """nw AS (SELECT pr.*, coalesce(kv.vendor, 'unknown') AS vendor FROM pr LEFT JOIN cp USING (source_ip) LEFT JOIN kv USING (source_ip)
    WHERE last_scored IS NULL OR transition_time > last_scored),
ch AS (SELECT nw.*, s.model_scope, s.scope_key, s.vocabulary FROM nw JOIN (SELECT DISTINCT model_scope, scope_key, vocabulary FROM mdl) s
    ON s.scope_key = CASE WHEN s.model_scope = 'device' THEN nw.source_ip ELSE nw.vendor END
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY s.model_scope) = 1),
pb AS (SELECT ch.*, (coalesce(m.transitions, 0) + 1.0) / (coalesce(t.prev_total, 0) + greatest(ch.vocabulary, 1)) AS p FROM ch
    LEFT JOIN mdl m ON m.model_scope = ch.model_scope AND m.scope_key = ch.scope_key AND m.prev_template_id = ch.prev_template_id AND m.curr_template_id = ch.curr_template_id
    LEFT JOIN (SELECT DISTINCT model_scope, scope_key, prev_template_id, prev_total FROM mdl) t
      ON t.model_scope = ch.model_scope AND t.scope_key = ch.scope_key AND t.prev_template_id = ch.prev_template_id)"""

SQL = {
    "rare_template": with_lab("SELECT * FROM rt", RARE),
    "always_severe": with_ev(f"SELECT event_id, {SEVERE} AS always_severe FROM ev"),
    "security_content": with_ev(f"SELECT event_id, {SECURE} AS security_content FROM ev"),
    "severity_spike": with_lab("SELECT * FROM ss", SPIKE),
    "volume_spike": with_lab("SELECT * FROM vo", VOLUME),
    "volume_buckets": with_lab("SELECT * REPLACE (round(baseline_per_minute, 6) AS baseline_per_minute) FROM vs", VOLUME),
    "interface_flapping": with_lab("SELECT * FROM fl", FLAP),
    "inline_reasons": with_lab(f"""SELECT event_id, array_to_string(r, ',') AS reasons, CAST(len(r) > 0 AS INTEGER) AS is_anomaly FROM (
        SELECT event_id, list_filter([CASE WHEN rare_template THEN 'rare_template' END, CASE WHEN {SEVERE} THEN 'always_severe' END,
          CASE WHEN {SECURE} THEN 'security_content' END, CASE WHEN severity_spike THEN 'severity_spike' END,
          CASE WHEN volume_spike THEN 'volume_spike' END, CASE WHEN interface_flapping THEN 'interface_flapping' END], lambda x: x IS NOT NULL) AS r
        FROM lab JOIN rt USING (event_id) JOIN ss USING (event_id) JOIN vo USING (event_id) JOIN fl USING (event_id))""",
      RARE, SPIKE, VOLUME, FLAP),
    "retag_by_rule": with_lab("""SELECT event_id, array_to_string(CASE WHEN hit THEN list_append(anomaly_reasons, 'security_content') ELSE anomaly_reasons END, ',') AS reasons,
        CASE WHEN hit THEN 1 ELSE is_anomaly END AS is_anomaly FROM (SELECT *, NOT list_contains(anomaly_reasons, 'security_content')
          AND (regexp_matches(message, 'authentication.{0,40}failed', 'i') OR regexp_matches(message, 'login\\s+success', 'i')) AS hit FROM lab)"""),
    "window_template_counts": with_lab("SELECT * FROM wc", WCOUNT),
    "mix_vectors": with_lab("""SELECT model_scope, scope_key, source_ip, window_start, slot, round(n / window_events, 6) AS share, window_events FROM (
        SELECT *, CAST(sum(n) OVER (PARTITION BY model_scope, scope_key, source_ip, window_start) AS BIGINT) AS window_events FROM (
          SELECT s.model_scope, s.scope_key, source_ip, window_start, CAST(coalesce(slot, 0) AS INTEGER) AS slot, sum(event_count) AS n
          FROM scoped s LEFT JOIN top t ON t.model_scope = s.model_scope AND t.scope_key = s.scope_key AND t.template_id = s.template_id GROUP BY 1, 2, 3, 4, 5))""",
      WCOUNT, VECTORS),
    "transitions": with_lab("SELECT * FROM pr", PAIRS),
    "transition_model": with_lab("SELECT * FROM mdl", PAIRS, MODEL),
    "score_transitions": with_lab("""SELECT source_ip, event_id, transition_time, prev_template_id, curr_template_id, vendor, model_scope,
        round(p, 6) AS transition_probability, CAST(p < 0.02 AS INTEGER) AS is_anomaly FROM pb""", PAIRS, MODEL, SCORED),
    "scoring_checkpoint": with_lab("SELECT source_ip, max(transition_time) AS last_scored FROM pb GROUP BY 1", PAIRS, MODEL, SCORED),
    "unusual_transition": with_lab("SELECT event_id, 'unusual_transition' AS reason FROM pb WHERE p < 0.02", PAIRS, MODEL, SCORED),
    "apply_tags": with_lab("""SELECT event_id, array_to_string(r, ',') AS reasons, CAST(len(r) > 0 AS INTEGER) AS is_anomaly FROM (
        SELECT event_id, list_concat(anomaly_reasons, list_filter([
          CASE WHEN event_id % 10 = 0 AND NOT list_contains(anomaly_reasons, 'always_severe') THEN 'always_severe' END,
          CASE WHEN event_id IN (SELECT event_id FROM pb WHERE p < 0.02) THEN 'unusual_transition' END], lambda x: x IS NOT NULL)) AS r FROM lab)""",
      PAIRS, MODEL, SCORED),
    "list_anomaly_windows": with_lab("""SELECT window_start, source_ip, coalesce(hostname, source_ip) AS hostname, vendor, 'device' AS model_scope,
        -event_count / 10.0 AS anomaly_score, CAST(1 AS INTEGER) AS is_anomaly, event_count, count(*) OVER () > 160 AS has_more
      FROM (SELECT source_ip, vendor, window_start, CAST(sum(event_count) AS BIGINT) AS event_count FROM wc GROUP BY 1, 2, 3)
      LEFT JOIN (SELECT source_ip, arg_max(hostname, event_time) AS hostname FROM lab WHERE event_time >= TIMESTAMP '2024-01-24' GROUP BY 1) USING (source_ip)
      WHERE window_start >= TIMESTAMP '2024-01-15' AND event_count >= 2 ORDER BY event_count DESC, source_ip, window_start LIMIT 150 OFFSET 10""", WCOUNT),
}
