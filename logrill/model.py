"""Table schemas and closed vocabularies."""

# ---- fixed values: severities, ranks, categories, anomaly reasons ----
SEVERITY_RANK = {
    "emerg": 0, "alert": 1, "crit": 2, "err": 3,
    "warning": 4, "notice": 5, "info": 6, "debug": 7,
}
DEFAULT_SEVERITY_RANK = 6
ALWAYS_SEVERE = ("emerg", "alert", "crit", "err")
CATEGORIES = (
    "AUTH", "NETWORK", "HARDWARE", "SECURITY", "SYSTEM", "APPLICATION", "CONFIG", "UNKNOWN",
)
ANOMALY_REASONS = (
    "rare_template", "always_severe", "security_content", "severity_spike",
    "volume_spike", "unusual_template_mix", "unusual_transition", "interface_flapping",
)
# ---- end of fixed values ----

# Schemas as DDL text, declared and never inferred.
RAW = (
    "timestamp string, source_ip string, reported_hostname string, facility string, "
    "severity string, program string, pid string, message string, raw string"
)

EVENTS = (
    "event_id long, event_time timestamp_ntz, received_at timestamp_ntz, source_ip string, "
    "hostname string, reported_hostname string, relayed_via string, vendor string, "
    "vendor_source string, model string, resolution_method string, facility string, "
    "severity string, severity_num int, program string, pid long, message string, "
    "template_id string, template string, predicted_category string, "
    "predicted_confidence double, is_anomaly int, anomaly_reasons array<string>, raw string"
)

DEVICE_INVENTORY = (
    "ip string, hostname string, vendor string, model string, resolution_method string, "
    "first_seen timestamp_ntz, last_resolved timestamp_ntz"
)

WINDOW_SCORES = (
    "window_start timestamp_ntz, source_ip string, vendor string, model_scope string, "
    "anomaly_score double, is_anomaly int, event_count long"
)

TRANSITION_SCORES = (
    "transition_time timestamp_ntz, source_ip string, vendor string, model_scope string, "
    "prev_template_id string, curr_template_id string, transition_probability double, "
    "is_anomaly int"
)

ALERT_RULES = (
    "id long, name string, enabled boolean, window_minutes int, threshold long, "
    "cooldown_minutes int, hostname string, source_ip string, program string, severity string, "
    "predicted_category string, only_anomalies boolean, last_triggered_at timestamp_ntz"
)

SILENCE_STATE = (
    "source_ip string, hostname string, expected_interval_minutes double, "
    "last_seen_at timestamp_ntz, silence_started_at timestamp_ntz, last_notified_at timestamp_ntz"
)

PENDING_IPS = (
    "ip string, first_seen timestamp_ntz, last_attempt timestamp_ntz, attempt_count int, status string"
)
