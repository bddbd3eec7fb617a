"""The fixture mapping and the labelled events, in DuckDB SQL."""

SECURITY = (
    r"\b(denied|blocked|intrusion|attack|malware|firewall|iptables|unauthorized|violation)\b"
    r"|\bauthentication\b[^.]{0,40}\bfailed\b|\blogin\s+failed\b"
)


def ip(u: str) -> str:
    return f"'10.' || (({u}) // 65536 % 256) || '.' || (({u}) // 256 % 256) || '.' || (({u}) % 256)"


SEED = """seed AS (
  SELECT event_id, ts AS event_time, user_id AS u, event_type,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events)"""

_NAME = ("CASE WHEN u % 7 = 0 THEN '' WHEN u % 7 = 1 THEN 'localhost' "
         "ELSE 'dev-' || u END")

_MESSAGE = """CASE event_type
    WHEN 'error' THEN CASE k % 4
      WHEN 0 THEN '%LINK-3-UPDOWN: Interface Gi0/' || k || ' changed state to down'
      WHEN 1 THEN 'ether' || (k % 3) || ' link down'
      WHEN 2 THEN 'Authentication to privilege level 15 failed by user' || u
      ELSE 'fan tray ' || k || ' temperature high' END
    WHEN 'click' THEN 'ether' || (k % 3) || CASE WHEN k % 2 = 0 THEN ' link up' ELSE ' link down' END
    WHEN 'view' THEN 'wlan1: client ' || k || ' disconnected, poor signal'
    WHEN 'signup' THEN ' login success for user' || u || ' from 10.0.0.' || k
    ELSE CASE WHEN k % 10 = 0 THEN 'configuration saved by admin'
      ELSE 'assigned 192.168.0.' || k || ' to 00:11:22:33:44:' || lpad(CAST(k AS VARCHAR), 2, '0') END
  END"""


def _ev(name: str, reported: str) -> str:
    return f"""{name} AS (
  SELECT event_id, event_time,
    event_time + to_seconds(CASE WHEN u % 13 = 0 THEN 3720 ELSE 0 END + k % 40) AS received_at,
    {ip('u')} AS source_ip, {reported} AS reported_hostname,
    'local' || (k % 8) AS facility,
    CASE WHEN event_type = 'error' AND k < 10 THEN 'crit' WHEN event_type = 'error' AND k < 40 THEN 'err'
         WHEN event_type = 'error' THEN 'warning' WHEN event_type = 'purchase' THEN 'notice'
         WHEN event_type = 'view' THEN 'debug' ELSE 'info' END AS severity,
    CASE event_type WHEN 'error' THEN 'kernel' WHEN 'click' THEN 'interface,info'
         WHEN 'view' THEN 'wireless,debug' WHEN 'signup' THEN 'sshd' ELSE 'dhcpd' END AS program,
    CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(1000 + k AS BIGINT) END AS pid,
    {_MESSAGE} AS message, {_MESSAGE} AS raw
  FROM seed)"""


EV = SEED + ",\n" + _ev("ev", _NAME)
RELAYED = _ev("rev", f"""CASE WHEN u % 11 = 3 THEN CASE k % 5 WHEN 0 THEN '172.16.0.' || k
      WHEN 1 THEN {ip('u')} WHEN 2 THEN 'localhost' WHEN 3 THEN 'node-' || u ELSE 'ACS-' || k END
    ELSE {_NAME} END""")

INVENTORY = f"""inv AS (
  SELECT {ip('s_suppkey')} AS ip, 'node-' || s_suppkey AS hostname,
    CASE s_nationkey % 4 WHEN 0 THEN 'cisco' WHEN 1 THEN 'juniper' WHEN 2 THEN 'mikrotik' ELSE 'unknown' END AS vendor,
    s_name AS model, 'snmp' AS resolution_method,
    TIMESTAMP '2023-12-01' + to_days(s_nationkey) AS first_seen,
    TIMESTAMP '2024-01-01' + to_hours(s_nationkey) AS last_resolved
  FROM supplier WHERE s_suppkey % 3 <> 0)"""

RELAYS = f"""rel AS (
  SELECT {ip('s_suppkey')} AS ip, 'relay ' || s_name AS note FROM supplier WHERE s_suppkey % 11 = 3)"""

RANK = """CASE lower(severity) WHEN 'emerg' THEN 0 WHEN 'alert' THEN 1 WHEN 'crit' THEN 2 WHEN 'err' THEN 3
    WHEN 'warning' THEN 4 WHEN 'notice' THEN 5 WHEN 'info' THEN 6 WHEN 'debug' THEN 7 ELSE 6 END"""


def category(message: str) -> str:
    rules = [
        ("AUTH", r"\b(login|logout|authentication|password|pam_unix|sshd|session opened|session closed)\b"),
        ("SECURITY", SECURITY),
        ("HARDWARE", r"\b(link (up|down)|interface (up|down)|fan|temperature|psu|power supply|disk (fail|error)|hardware)\b"),
        ("NETWORK", r"\b(bgp|ospf|route|routing|neighbor|link-flap|packet loss|timeout|unreachable|vlan|spanning.tree)\b"),
        ("CONFIG", r"\b(config(uration)? (changed|applied|saved|reload)|commit|rollback)\b"),
        ("APPLICATION", r"\b(exception|stack trace|service (started|stopped|crashed)|failed to start)\b"),
        ("SYSTEM", r"\b(kernel|cron|systemd|reboot|shutdown|out of memory|oom)\b"),
    ]
    whens = " ".join(f"WHEN regexp_matches({message}, '{p}', 'i') THEN '{n}'" for n, p in rules)
    return f"CASE {whens} ELSE 'UNKNOWN' END"


def vendor(message: str) -> str:
    m = f"regexp_replace({message}, '^\\s+|\\s+$', '', 'g')"
    rules = [
        ("juniper", r"junos@2636\.1\.1\.1\.2", "c"),
        ("paloalto", r"^\d+,\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2},\d+,(TRAFFIC|THREAT|SYSTEM|CONFIG|HIPMATCH|GLOBALPROTECT|CORRELATION)", "c"),
        ("fortinet", r'\bdevname=\S+.*\blogid="?\d+"?', "c"),
        ("mikrotik", r"\bether\d+ link (up|down)\b", "c"),
        ("mikrotik", r"\bon \d+ AP: (yes|no) SSID\b", "c"),
        ("mikrotik", r"[0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2}){5}@wlan\d+\b", "i"),
        ("mikrotik", r"\bwlan\d+:\s", "i"),
        ("mikrotik", r"\bppp-(in|out)\d+:", "c"),
        ("mikrotik", r"\b(de)?assigned \d{1,3}(\.\d{1,3}){3} (to|from) [0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2}){5}\b", "c"),
        ("mikrotik", r"^sntp change time .+ => .+", "i"),
        ("mikrotik", r"\blogged (in|out) from \S+ via \w+\b", "c"),
        ("mikrotik", r"^[a-z0-9]+(,[a-z0-9]+)*,(info|warning|error|critical|debug)\b", "c"),
        ("cisco_like", r"%[A-Z0-9_]+-\d-[A-Z0-9_]+:", "c"),
    ]
    whens = " ".join(f"WHEN regexp_matches({m}, '{p}', '{o}') THEN '{v}'" for v, p, o in rules)
    return f"CASE {whens} ELSE 'unknown' END"


SEVERE = "lower(severity) IN ('emerg', 'alert', 'crit', 'err')"
SECURE = f"regexp_matches(message, '{SECURITY}', 'i')"
USABLE = "(reported_hostname <> '' AND reported_hostname <> source_ip AND lower(reported_hostname) NOT IN ('localhost', 'localhost.localdomain'))"

LABELLED = f"""lab AS (
  SELECT e.*, '' AS relayed_via,
    CASE WHEN i.ip IS NOT NULL THEN i.hostname WHEN {USABLE} THEN reported_hostname ELSE source_ip END AS hostname,
    CASE WHEN i.ip IS NOT NULL THEN i.vendor ELSE pv END AS vendor,
    CASE WHEN i.ip IS NOT NULL THEN 'snmp' WHEN pv <> 'unknown' THEN 'passive' ELSE 'unknown' END AS vendor_source,
    CASE WHEN i.ip IS NOT NULL THEN i.model ELSE '' END AS model,
    CASE WHEN i.ip IS NOT NULL THEN i.resolution_method WHEN {USABLE} THEN 'syslog_reported' ELSE 'unresolved' END AS resolution_method,
    CAST({RANK} AS INTEGER) AS severity_num,
    regexp_replace(message, '[0-9]+', '<*>', 'g') AS template,
    md5(regexp_replace(message, '[0-9]+', '<*>', 'g')) AS template_id,
    {category('message')} AS predicted_category, CAST(0.0 AS DOUBLE) AS predicted_confidence,
    list_filter([CASE WHEN {SEVERE} THEN 'always_severe' END,
                 CASE WHEN {SECURE} THEN 'security_content' END], lambda x: x IS NOT NULL) AS anomaly_reasons,
    CAST(({SEVERE} OR {SECURE}) AS INTEGER) AS is_anomaly
  FROM (SELECT *, {vendor('message')} AS pv FROM ev) e LEFT JOIN inv i ON e.source_ip = i.ip)"""


def with_ev(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([EV, *ctes]) + "\n" + body


def with_lab(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([EV, INVENTORY, LABELLED, *ctes]) + "\n" + body
