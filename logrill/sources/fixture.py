"""The given benchmark tables seen as log events, devices and control tables.

Every table here is a projection of a given parquet table, so it grows with it.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logrill.functions import text
from logrill.functions.clock import col, from_micros, micros, plus_seconds
from logrill.operators import enrich
from logrill.session import utc

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def device_ip(u) -> Column:
    """10.x.y.z of a numeric id."""
    n = col(u)
    return F.concat_ws(
        ".", F.lit("10"),
        (F.floor(n / 65536) % 256).cast("string"),
        (F.floor(n / 256) % 256).cast("string"),
        (n % 256).cast("string"),
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows with the two numbers the mapping works from: device u, key k."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("event_time"), F.col("user_id").alias("u"), "event_type",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )


def _message() -> Column:
    k, u = F.col("k"), F.col("u")
    ks, us = k.cast("string"), u.cast("string")
    iface = F.concat(F.lit("ether"), (k % 3).cast("string"))
    error = (
        F.when(k % 4 == 0, F.concat(F.lit("%LINK-3-UPDOWN: Interface Gi0/"), ks,
                                    F.lit(" changed state to down")))
        .when(k % 4 == 1, F.concat(iface, F.lit(" link down")))
        .when(k % 4 == 2, F.concat(F.lit("Authentication to privilege level 15 failed by user"), us))
        .otherwise(F.concat(F.lit("fan tray "), ks, F.lit(" temperature high")))
    )
    purchase = F.when(k % 10 == 0, "configuration saved by admin").otherwise(
        F.concat(F.lit("assigned 192.168.0."), ks, F.lit(" to 00:11:22:33:44:"),
                 F.lpad(ks, 2, "0"))
    )
    return (
        F.when(F.col("event_type") == "error", error)
        .when(F.col("event_type") == "click",
              F.concat(iface, F.when(k % 2 == 0, " link up").otherwise(" link down")))
        .when(F.col("event_type") == "view",
              F.concat(F.lit("wlan1: client "), ks, F.lit(" disconnected, poor signal")))
        .when(F.col("event_type") == "signup",
              F.concat(F.lit(" login success for user"), us, F.lit(" from 10.0.0."), ks))
        .otherwise(purchase)
    )


def _severity() -> Column:
    k, kind = F.col("k"), F.col("event_type")
    return (
        F.when((kind == "error") & (k < 10), "crit").when((kind == "error") & (k < 40), "err")
        .when(kind == "error", "warning").when(kind == "purchase", "notice")
        .when(kind == "view", "debug").otherwise("info")
    )


def _program() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "error", "kernel").when(kind == "click", "interface,info")
        .when(kind == "view", "wireless,debug").when(kind == "signup", "sshd").otherwise("dhcpd")
    )


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed log events before any enrichment."""
    k, u = F.col("k"), F.col("u")
    delay = F.when(u % 13 == 0, 3720).otherwise(0) + k % 40
    return seeds(spark, sf_dir).select(
        "event_id", "event_time", plus_seconds("event_time", delay).alias("received_at"),
        device_ip("u").alias("source_ip"),
        F.when(u % 7 == 0, "").when(u % 7 == 1, "localhost")
        .otherwise(F.concat(F.lit("dev-"), u.cast("string"))).alias("reported_hostname"),
        F.concat(F.lit("local"), (k % 8).cast("string")).alias("facility"),
        _severity().alias("severity"), _program().alias("program"),
        F.when(k % 3 != 0, 1000 + k).cast("long").alias("pid"),
        _message().alias("message"), _message().alias("raw"),
    )


def relayed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events where every 11th device is a relay that forwards for others:
    another address, its own address, a placeholder, its own name or an appliance name."""
    k, u = F.col("k"), F.col("u")
    ks = k.cast("string")
    forwarded = (
        F.when(k % 5 == 0, F.concat(F.lit("172.16.0."), ks))
        .when(k % 5 == 1, device_ip("u"))
        .when(k % 5 == 2, "localhost")
        .when(k % 5 == 3, F.concat(F.lit("node-"), u.cast("string")))
        .otherwise(F.concat(F.lit("ACS-"), ks))
    )
    names = seeds(spark, sf_dir).where(u % 11 == 3).select(
        "event_id", forwarded.alias("forwarded_name"))
    return (
        log_events(spark, sf_dir).join(names, "event_id", "left")
        .withColumn("reported_hostname", F.coalesce("forwarded_name", "reported_hostname"))
        .drop("forwarded_name")
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").where(key % 3 != 0).select(
        device_ip("s_suppkey").alias("ip"),
        F.concat(F.lit("node-"), key.cast("string")).alias("hostname"),
        F.element_at(F.array(*[F.lit(v) for v in ("cisco", "juniper", "mikrotik", "unknown")]),
                     (F.col("s_nationkey") % 4 + 1).cast("int")).alias("vendor"),
        F.col("s_name").alias("model"), F.lit("snmp").alias("resolution_method"),
        from_micros(F.lit(1_701_388_800_000_000) + F.col("s_nationkey").cast("long") * F.lit(86_400_000_000))
        .alias("first_seen"),
        from_micros(F.lit(1_704_067_200_000_000) + F.col("s_nationkey") * F.lit(3_600_000_000))
        .alias("last_resolved"),
    )


def relays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 11 == 3).select(
        device_ip("s_suppkey").alias("ip"), F.concat(F.lit("relay "), F.col("s_name")).alias("note"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with identity, vendor, template, category and the two stateless reasons."""
    from logrill.operators import signals

    located = enrich.join_inventory(log_events(spark, sf_dir), inventory(spark, sf_dir))
    severe, security = text.is_always_severe("severity"), text.is_security_content("message")
    labelled = located.withColumns({
        "severity_num": text.severity_rank("severity"),
        "template": text.mask_template("message"),
        "predicted_category": text.weak_label("message"),
        "predicted_confidence": F.lit(0.0),
        "anomaly_reasons": signals.reasons_array(
            {"always_severe": severe, "security_content": security}),
    })
    return labelled.withColumns({
        "template_id": F.md5("template"),
        "is_anomaly": (F.size("anomaly_reasons") > 0).cast("int"),
    })


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.lower("n_name").alias("username"))


def acknowledgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_nationkey").cast("long")
    return table(spark, sf_dir, "supplier").select(
        device_ip("s_suppkey").alias("source_ip"),
        F.when(n % 2 == 0, "always_severe").otherwise("security_content").alias("anomaly_reason"),
        F.concat(F.lit("seen by "), F.col("s_name")).alias("note"),
        F.when(n % 5 != 0, n.cast("long")).alias("acknowledged_by"),
        from_micros(F.lit(1_704_067_200_000_000) + n * F.lit(3_600_000_000)).alias("acknowledged_at"),
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(c % 7 != 0, c % 40).alias("actor_id"),
        F.when(F.col("o_orderstatus") == "F", "alert_rule.create")
        .when(F.col("o_orderstatus") == "O", "anomaly.acknowledge")
        .otherwise("relay_source_ip.delete").alias("action"),
        F.concat(F.lit("rule-"), c.cast("string")).alias("target"),
        F.col("o_orderpriority").alias("details"), F.col("o_orderdate").alias("created_at"),
    )


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per nation, with the filters switched on by the bits of its key."""
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(
        n.cast("long").alias("id"), F.concat(F.lit("rule "), F.col("n_name")).alias("name"),
        (n % 6 != 5).alias("enabled"), (F.lit(57) * (1 + n)).cast("int").alias("window_minutes"),
        (1 + n % 4).cast("long").alias("threshold"), (F.lit(10) * n).cast("int").alias("cooldown_minutes"),
        F.when(n % 8 == 7, F.concat(F.lit("node-"), n.cast("string"))).alias("hostname"),
        F.when(n % 9 == 8, device_ip("n_nationkey")).alias("source_ip"),
        F.when(n % 3 == 1, F.when(n % 2 == 0, "kernel").otherwise("sshd")).alias("program"),
        F.when(n % 5 == 2, "info").alias("severity"),
        F.when(n % 4 == 3, "HARDWARE").alias("predicted_category"),
        (n % 4 == 2).alias("only_anomalies"),
        F.when(n % 3 == 0, from_micros(F.lit(1_706_659_200_000_000) - n * F.lit(900_000_000)))
        .alias("last_triggered_at"),
    )


def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert history: one firing per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 28).alias("rule_id"),
        plus_seconds("o_orderdate", F.col("o_orderkey") % 86400).alias("triggered_at"),
        F.col("o_orderdate").alias("window_start"),
        plus_seconds("o_orderdate", F.col("o_orderkey") % 86400).alias("window_end"),
        (F.col("o_custkey") % 50 + 1).alias("matched_count"),
        F.col("o_orderpriority").alias("sample_message"),
    )


def silence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices marked silent by an earlier run."""
    n = F.col("s_nationkey").cast("long")
    start = F.lit(1_706_313_600_000_000)  # 2024-01-27
    return table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 2 == 0).select(
        device_ip("s_suppkey").alias("source_ip"),
        F.concat(F.lit("node-"), F.col("s_suppkey").cast("string")).alias("hostname"),
        (60 + n).cast("double").alias("expected_interval_minutes"),
        from_micros(start - n * F.lit(3_600_000_000)).alias("last_seen_at"),
        from_micros(start + n * F.lit(600_000_000)).alias("silence_started_at"),
        F.when(n % 3 != 0, from_micros(F.lit(1_706_659_200_000_000) - n * F.lit(1_800_000_000)))
        .alias("last_notified_at"),
    )


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses waiting for an identity."""
    n, c = F.col("c_nationkey").cast("long"), F.col("c_custkey")
    as_of = F.lit(1_706_659_200_000_000)
    return table(spark, sf_dir, "customer").select(
        device_ip("c_custkey").alias("ip"),
        from_micros(as_of - (n + 30) * F.lit(3_600_000_000)).alias("first_seen"),
        F.when(c % 5 != 0, from_micros(as_of - n * F.lit(7_200_000_000))).alias("last_attempt"),
        (n % 6).cast("int").alias("attempt_count"),
        F.when(c % 3 == 0, "pending").when(c % 3 == 1, "no_credential").otherwise("unreachable")
        .alias("status"),
    )


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credential scopes: networks and single hosts of growing width."""
    n = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        n.alias("scope_id"),
        F.when(n % 4 == 0, device_ip("s_suppkey"))
        .when(n % 4 == 1, F.concat(F.lit("10.0."), (F.floor(n / 256) % 256).cast("string"), F.lit(".0/24")))
        .when(n % 4 == 2, F.concat(device_ip("s_suppkey"), F.lit("/28")))
        .otherwise(F.concat(F.lit("10.0.0.0/"), (8 + n % 9).cast("string"))).alias("ip_or_cidr"),
        F.when(n % 5 == 0, "v3").otherwise("v2c").alias("version"),
    )


def polled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of polling devices: answered with an identity, or not."""
    c, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    return table(spark, sf_dir, "customer").where(c % 4 != 3).select(
        device_ip("c_custkey").alias("ip"),
        F.when(c % 4 == 0, "no_scope").when(c % 4 == 1, "failed").otherwise("answered").alias("outcome"),
        F.when(c % 4 == 2, F.concat(F.lit("sys-"), c.cast("string"))).alias("hostname"),
        F.when(c % 4 == 2, F.concat(F.lit(".1.3.6.1.4.1."), F.element_at(
            F.array(*[F.lit(v) for v in ("9", "2636", "14988", "11", "77")]),
            (n % 5 + 1).cast("int")), F.lit(".1.2"))).alias("object_id"),
        F.col("c_name").alias("description"),
        from_micros(F.lit(1_706_659_200_000_000) - n * F.lit(60_000_000)).alias("attempted_at"),
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw string records with the gaps and bad values real lines have."""
    k = F.col("k")
    base = log_events(spark, sf_dir).join(seeds(spark, sf_dir).select("event_id", "k"), "event_id")
    return base.select(
        "event_id", "received_at",
        F.when(k % 10 == 0, "not a time").when(k % 10 != 1, F.date_format(
            "event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("timestamp"),
        F.when(k % 11 != 0, F.col("source_ip")).alias("source_ip"),
        F.when(k % 12 != 0, F.col("reported_hostname")).alias("reported_hostname"),
        F.when(k % 13 != 0, F.col("facility")).alias("facility"),
        F.when(k % 14 != 0, F.col("severity")).alias("severity"),
        F.when(k % 15 != 0, F.col("program")).alias("program"),
        F.when(k % 7 == 0, "abc").when(k % 7 == 1, "").otherwise(F.col("pid").cast("string")).alias("pid"),
        F.col("message"), F.when(k % 4 != 0, F.col("raw")).alias("raw"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, among them blank, broken, message-less and container ones."""
    k = F.col("k")
    base = log_events(spark, sf_dir).join(seeds(spark, sf_dir).select("event_id", "k"), "event_id")
    stamp = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    rest = ["source_ip", "reported_hostname", "facility", "severity", "program",
            F.col("pid").cast("string").alias("pid")]
    veth = F.concat(F.lit("veth88671e0: Link DOWN "), k.cast("string")).alias("message")
    return base.select(
        F.when(k % 10 == 0, '{"message": "cut o')
        .when(k % 10 == 1, F.to_json(F.struct(stamp, *rest)))
        .when(k % 10 == 2, F.to_json(F.struct(stamp, veth, *rest)))
        .when(k % 10 == 3, "")
        .otherwise(F.to_json(F.struct(stamp, *rest, "message", "raw"))).alias("value"))


def shifted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relayed events, some of them stamped three hours or ten minutes ahead."""
    k = F.col("k")
    base = relayed_events(spark, sf_dir).join(seeds(spark, sf_dir).select("event_id", "k"), "event_id")
    ahead = F.when(k % 10 < 2, 3 * 3600).when(k % 10 == 2, 600).otherwise(0)
    return base.withColumn("event_time", plus_seconds("event_time", ahead)).drop("k")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose signup messages arrive as numbered parts, some lost, some whole."""
    k = F.col("k")
    base = log_events(spark, sf_dir).join(
        seeds(spark, sf_dir).select("event_id", "k", "u", "event_type"), "event_id")
    split = F.col("event_type") == "signup"
    last = F.when(split & (k % 5 > 1), 1).otherwise(0)
    parts = base.withColumn("idx", F.explode(F.sequence(F.lit(0), last)))
    total = F.when(k % 5 == 1, "1").otherwise("2")
    content = F.when(F.col("idx") == 0, F.concat(F.lit("part one of "), k.cast("string"), F.lit(","))
                     ).otherwise(F.concat(F.lit(" part two of "), F.col("u").cast("string")))
    line = F.concat_ws(" ", F.lpad((F.col("event_id") % 50).cast("string"), 10, "0"), total,
                       F.col("idx").cast("string"), content)
    late = F.when(split, F.when(k % 2 == 0, 1 - F.col("idx")).otherwise(F.col("idx")) * 2).otherwise(0)
    return parts.select(
        (F.col("event_id") * 2 + F.col("idx")).alias("event_id"), "event_time",
        plus_seconds("received_at", late).alias("received_at"), "source_ip", "reported_hostname",
        "facility", "severity", F.when(split, "CSCOacs_Passed").otherwise(F.col("program")).alias("program"),
        "pid", F.when(split, F.concat(F.lit(" "), line)).otherwise(F.col("message")).alias("message"),
        F.when(split, line).otherwise(F.col("raw")).alias("raw"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per kind of event that occurs."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_type").distinct().select(
        kind.alias("query_id"),
        F.when(kind == "view", "which device has the most wireless disconnections")
        .when(kind == "click", "top devices with interface link problems, mikrotik")
        .when(kind == "error", "how many authentication failures for cisco happened")
        .when(kind == "signup", "what are the recent login successes for sshd")
        .otherwise("show addresses assigned to clients").alias("question"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase per event: loose names of reasons, or the message itself."""
    k = F.col("k")
    base = log_events(spark, sf_dir).join(seeds(spark, sf_dir).select("event_id", "k"), "event_id")
    named = ("volume spike", "spike", "ethernet flap", "wireless drops", "severe templates",
             "Rare_Template", "unusual transitions", "security", "radio disconnect")
    phrase = F.element_at(F.array(*[F.lit(n) for n in named]), k % 12 + 1)
    return base.select("event_id", F.when(k % 12 < len(named), phrase).otherwise(F.col("message")).alias("phrase"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer per device that states its event count, wrongly for each third."""
    counts = seeds(spark, sf_dir).groupBy("u").agg(F.count("*").alias("n"))
    name = F.concat(F.lit("XR-200-dev-"), F.col("u").cast("string"))
    n = F.col("n").cast("string")
    said = (F.col("n") + F.when(F.col("u") % 3 == 0, 7).otherwise(0)).cast("string")
    text_ = F.concat(F.lit("The top 10 logs: "), name, F.lit(" had "), n, F.lit(" warning-severity events, a total of "),
                     said, F.lit("."))
    return counts.select(
        F.col("u").alias("answer_id"), F.lit("show me 10 logs, top 10 please").alias("question"),
        text_.alias("text"), F.array(name, F.lit("10.0.0.1")).alias("identifiers"), F.col("n").alias("value"))
