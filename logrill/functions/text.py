"""Column expressions over message text and device identity."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logrill.functions.clock import col
from logrill.model import ALWAYS_SEVERE, DEFAULT_SEVERITY_RANK, SEVERITY_RANK

# ---- fixed values: category rules, first match wins ----
CATEGORY_RULES = (
    ("AUTH", r"\b(login|logout|authentication|password|pam_unix|sshd|session opened|session closed)\b"),
    ("SECURITY",
     r"\b(denied|blocked|intrusion|attack|malware|firewall|iptables|unauthorized|violation)\b"
     r"|\bauthentication\b[^.]{0,40}\bfailed\b|\blogin\s+failed\b"),
    ("HARDWARE",
     r"\b(link (up|down)|interface (up|down)|fan|temperature|psu|power supply|disk (fail|error)|hardware)\b"),
    ("NETWORK",
     r"\b(bgp|ospf|route|routing|neighbor|link-flap|packet loss|timeout|unreachable|vlan|spanning.tree)\b"),
    ("CONFIG", r"\b(config(uration)? (changed|applied|saved|reload)|commit|rollback)\b"),
    ("APPLICATION", r"\b(exception|stack trace|service (started|stopped|crashed)|failed to start)\b"),
    ("SYSTEM", r"\b(kernel|cron|systemd|reboot|shutdown|out of memory|oom)\b"),
)
# ---- fixed values: vendor signatures (vendor, ignore case, pattern), first match wins ----
VENDOR_SIGNATURES = (
    ("juniper", False, r"junos@2636\.1\.1\.1\.2"),
    ("paloalto", False,
     r"^\d+,\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2},\d+,(TRAFFIC|THREAT|SYSTEM|CONFIG|HIPMATCH|GLOBALPROTECT|CORRELATION)"),
    ("fortinet", False, r"\bdevname=\S+.*\blogid=\"?\d+\"?"),
    ("mikrotik", False, r"\bether\d+ link (up|down)\b"),
    ("mikrotik", False, r"\bon \d+ AP: (yes|no) SSID\b"),
    ("mikrotik", True, r"[0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2}){5}@wlan\d+\b"),
    ("mikrotik", True, r"\bwlan\d+:\s"),
    ("mikrotik", False, r"\bppp-(in|out)\d+:"),
    ("mikrotik", False, r"\b(de)?assigned \d{1,3}(\.\d{1,3}){3} (to|from) [0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2}){5}\b"),
    ("mikrotik", True, r"^sntp change time .+ => .+"),
    ("mikrotik", False, r"\blogged (in|out) from \S+ via \w+\b"),
    ("mikrotik", False, r"^[a-z0-9]+(,[a-z0-9]+)*,(info|warning|error|critical|debug)\b"),
    ("cisco_like", False, r"%[A-Z0-9_]+-\d-[A-Z0-9_]+:"),
)
# ---- fixed values: enterprise number prefixes ----
VENDOR_OID_PREFIXES = (
    ("1.3.6.1.4.1.9.", "cisco"),
    ("1.3.6.1.4.1.2636.", "juniper"),
    ("1.3.6.1.4.1.12356.", "fortinet"),
    ("1.3.6.1.4.1.2011.", "huawei"),
    ("1.3.6.1.4.1.25461.", "paloalto"),
    ("1.3.6.1.4.1.30065.", "arista"),
    ("1.3.6.1.4.1.14988.", "mikrotik"),
    ("1.3.6.1.4.1.11.", "hp"),
    ("1.3.6.1.4.1.14823.", "aruba"),
    ("1.3.6.1.4.1.674.", "dell"),
    ("1.3.6.1.4.1.41112.", "ubiquiti"),
    ("1.3.6.1.4.1.8072.", "net-snmp"),
)
GENERIC_HOSTNAMES = ("localhost", "localhost.localdomain")
IGNORE_MESSAGE_PATTERN = r"\bveth[0-9a-f]{6,}\b"
INTERFACE_STATE_PATTERN = r"\b(ether\d+) link (up|down)\b"
MULTIPART_PATTERN = r"^(\d{10}) (\d+) (\d+) ((?s:.*))$"
MULTIPART_PROGRAM_PREFIX = "CSCOacs_"
# ---- end of fixed values ----

SECURITY_PATTERN = dict(CATEGORY_RULES)["SECURITY"]

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_H = r"[0-9A-Fa-f]{1,4}"
_TAIL4 = rf"{_OCTET}(\.{_OCTET}){{3}}"


def first_match(text: Column, rules, default: str) -> Column:
    """First label whose pattern occurs in the text, as one CASE expression."""
    expr = None
    for label, pattern in rules:
        hit = text.rlike(pattern)
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return expr.otherwise(default)


def strip(c) -> Column:
    """Trim white space of any kind, not only blanks."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^\s+|\s+$", "")


def severity_rank(c) -> Column:
    name = F.lower(F.coalesce(col(c), F.lit("")))
    expr = None
    for label, rank in SEVERITY_RANK.items():
        expr = F.when(name == label, rank) if expr is None else expr.when(name == label, rank)
    return expr.otherwise(DEFAULT_SEVERITY_RANK).cast("int")


def weak_label(c) -> Column:
    return first_match(
        F.coalesce(col(c), F.lit("")), [(n, "(?i)" + p) for n, p in CATEGORY_RULES], "UNKNOWN"
    )


def detect_vendor(c) -> Column:
    rules = [(v, ("(?i)" if ci else "") + p) for v, ci, p in VENDOR_SIGNATURES]
    return first_match(strip(c), rules, "unknown")


def is_always_severe(c) -> Column:
    return F.lower(F.coalesce(col(c), F.lit(""))).isin(*ALWAYS_SEVERE)


def is_security_content(c) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike("(?i)" + SECURITY_PATTERN)


def interface_name(c) -> Column:
    """Interface named by an up/down message, else empty."""
    return F.regexp_extract(strip(c), INTERFACE_STATE_PATTERN, 1)


def interface_state(c) -> Column:
    return F.regexp_extract(strip(c), INTERFACE_STATE_PATTERN, 2)


def contains_ci(c, needle) -> Column:
    """Case-insensitive literal substring (no wildcards)."""
    n = needle if isinstance(needle, Column) else F.lit(needle)
    return F.contains(F.lower(col(c)), F.lower(n))


def is_ip(c) -> Column:
    """Well-formed IPv4 or IPv6 address text."""
    text = F.coalesce(col(c), F.lit(""))
    return text.rlike(IPV4_PATTERN) | is_ipv6(text)


def is_ipv6(text: Column) -> Column:
    """At most one ``::``, groups of 1-4 hex digits, eight groups in all."""
    groups = rf"{_H}(:{_H})*"
    tail = rf"(({_H}:)*{_TAIL4}|{groups})"
    shape = rf"^(({groups})?::({tail})?|({_H}:)+({_H}|{_TAIL4}))(%[^%]+)?$"
    body = F.regexp_replace(text, "%.*$", "")
    # a dotted tail stands for two groups
    flat = F.regexp_replace(body, rf"{_TAIL4}$", "0:0")
    hextets = F.size(F.filter(F.split(flat, ":"), lambda g: g != ""))
    compressed = F.contains(text, F.lit("::"))
    return text.rlike(shape) & F.when(compressed, hextets <= 7).otherwise(hextets == 8)


def ipv4_number(c) -> Column:
    """IPv4 text as a long, null when the text is no IPv4 address."""
    text = col(c)
    parts = F.split(text, r"\.")
    number = reduce(
        lambda acc, i: acc * 256 + F.try_element_at(parts, F.lit(i + 1)).try_cast("long"),
        range(4),
        F.lit(0).cast("long"),
    )
    return F.when(text.rlike(IPV4_PATTERN), number)


def vendor_from_oid(c) -> Column:
    oid = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^\.+", "")
    oid = F.regexp_replace(oid, r"^iso\.", "1.")
    expr = None
    # no prefix in the table is a prefix of another, so order cannot matter
    for prefix, vendor in VENDOR_OID_PREFIXES:
        hit = F.startswith(oid, F.lit(prefix))
        expr = F.when(hit, vendor) if expr is None else expr.when(hit, vendor)
    return expr.otherwise("unknown")


def mask_template(c) -> Column:
    """Message with every digit run masked: a template that never drifts."""
    return F.regexp_replace(col(c), "[0-9]+", "<*>")


def embedding_text(severity="severity", program="program", hostname="hostname", vendor="vendor",
                   category="predicted_category", is_anomaly="is_anomaly",
                   reasons="anomaly_reasons", message="message") -> Column:
    """``[sev] program on host (vendor) category=… anomaly(a,b): message``."""
    why = F.when(F.size(reasons) > 0, F.array_join(reasons, ",")).otherwise("unknown")
    return F.concat(
        F.lit("["), col(severity), F.lit("] "), col(program), F.lit(" on "), col(hostname),
        F.lit(" ("), col(vendor), F.lit(")"),
        F.when(F.coalesce(col(category), F.lit("")) != "", F.concat(F.lit(" category="), col(category)))
        .otherwise(""),
        F.when(col(is_anomaly) == 1, F.concat(F.lit(" anomaly("), why, F.lit(")"))).otherwise(""),
        F.lit(": "), col(message),
    )


def iso_compact(c) -> Column:
    """ISO text whose fraction is left out when it is zero."""
    whole = F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(col(c), "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat_ws(".", whole, fraction))


def doc_id(event_time="event_time", source_ip="source_ip", program="program", pid="pid",
           template_id="template_id", message="message") -> Column:
    """Content hash that makes index writes idempotent; a missing pid is ``None``."""
    return F.sha2(
        F.concat_ws(
            "|", iso_compact(event_time), col(source_ip), col(program),
            F.coalesce(col(pid).cast("string"), F.lit("None")), col(template_id), col(message),
        ),
        256,
    )
