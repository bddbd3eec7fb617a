from checks.base import INVENTORY, RANK, RELAYS, SECURE, SEVERE, category, with_ev, with_lab
from checks.detect import FLAP, RARE, SQL as DETECTED
from checks.identity import RESOLVED, SKEW
from checks.intake import DOCS
from checks.searches import ROLLUP
from checks.watch import EVAL, RULES


def ingested(more: str = "") -> str:
    """The usable raw lines, labelled."""
    return with_ev(f"""SELECT event_time, source_ip, hostname, vendor, CAST({RANK} AS INTEGER) AS severity_num, message,
        {category('message')} AS predicted_category,
        array_to_string(list_filter([CASE WHEN {SEVERE} THEN 'always_severe' END, CASE WHEN {SECURE} THEN 'security_content' END],
          lambda x: x IS NOT NULL), ',') AS reasons{more}
      FROM res JOIN (SELECT event_id, k FROM seed) USING (event_id) WHERE k % 10 > 3""",
      "rev AS (SELECT * FROM ev)", INVENTORY, RELAYS, RESOLVED)


SQL = {
    "stream_ingest": ingested(", CAST(event_time AS DATE) AS event_date"),
    "stream_events": DETECTED["inline_reasons"],
    "stream_tail": ingested(),
    "stream_rollup": with_lab("SELECT * FROM mins", ROLLUP),
    "stream_windowed_rollup": with_lab("""SELECT * FROM mins WHERE minute + INTERVAL 1 MINUTE <=
      (SELECT max(event_time) - INTERVAL 10 MINUTE FROM lab)""", ROLLUP),
    "stream_index": with_lab("""SELECT DISTINCT doc_id, docs.event_time, docs.source_ip, embedding_text FROM docs
      JOIN lab ON lab.event_time = docs.event_time AND lab.source_ip = docs.source_ip
      WHERE is_anomaly = 1 AND received_at <= TIMESTAMP '2024-01-29 23:20:00'""", DOCS),
    "stream_alerts": with_lab("SELECT * FROM evald WHERE fires", RULES, EVAL),
    "stream_rare_template": with_lab("SELECT event_id FROM rt WHERE rare_template", RARE),
    "stream_flapping": with_lab("SELECT event_id FROM fl WHERE interface_flapping", FLAP),
    "stream_clock_skew": with_ev("SELECT event_id, round(skew, 6) AS skew_seconds FROM h", SKEW),
}
