"""Record normalisation, device identity, clocks and multi-part messages."""

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logrill.functions import text
from logrill.functions.clock import MICROS, from_micros, micros, ntz, plus_seconds, seconds_between
from logrill.functions.hotkeys import BLOCK_ROWS, SLICE_ROWS, Running, in_row_blocks, numbered, previous, running, slicing
from logrill.operators.state import keyed_upsert, latest_version
from logrill.session import materialize


def normalize_record(raw: DataFrame, received_at="received_at") -> DataFrame:
    """Raw strings -> typed event columns with the defaults for missing fields."""
    def default(name, value):
        return F.coalesce(F.col(name), F.lit(value))

    moment = F.coalesce(
        F.try_to_timestamp("timestamp").cast("timestamp_ntz"), ntz(F.col(received_at)))
    return raw.select(
        *[c for c in raw.columns if c in ("event_id",)],
        moment.alias("event_time"), F.col(received_at).alias("received_at"),
        default("source_ip", "unknown").alias("source_ip"),
        default("reported_hostname", "").alias("reported_hostname"),
        default("facility", "unknown").alias("facility"),
        default("severity", "info").alias("severity"),
        text.severity_rank(default("severity", "info")).alias("severity_num"),
        default("program", "unknown").alias("program"),
        text.strip("pid").try_cast("long").alias("pid"),
        F.col("message"), F.coalesce("raw", "message").alias("raw"),
    )


def _usable_name(name, ip):
    return (name != "") & (name != ip) & ~F.lower(name).isin(*text.GENERIC_HOSTNAMES)


def _identified(df: DataFrame, inventory: DataFrame) -> DataFrame:
    """Look ``source_ip`` up in the inventory; fall back to the reported name.

    A plain equi-join: Spark broadcasts the inventory while its statistics say it
    is small and otherwise shuffles, splitting noisy devices (AQE skew join).
    """
    known = latest_version(inventory, ["ip"], ["last_resolved"]).select(
        F.col("ip").alias("source_ip"), F.col("hostname").alias("_host"),
        F.col("vendor").alias("_vendor"), F.col("model").alias("_model"),
        F.col("resolution_method").alias("_method"), F.lit(True).alias("_known"),
    )
    reported = F.coalesce("reported_hostname", F.lit(""))
    by_name = F.coalesce("_by_name", F.lit(False)) if "_by_name" in df.columns else F.lit(False)
    is_known = F.col("_known").isNotNull() & ~by_name
    passive = F.col("_passive")
    usable = _usable_name(reported, F.col("source_ip"))
    # the signatures are only tried on devices the inventory does not know
    out = df.join(known, "source_ip", "left").withColumn(
        "_passive", F.when(~is_known, text.detect_vendor("message"))).withColumns({
        "hostname": F.when(is_known, F.col("_host")).when(by_name | usable, reported)
        .otherwise(F.col("source_ip")),
        "vendor": F.when(is_known, F.col("_vendor")).otherwise(passive),
        "vendor_source": F.when(is_known, "snmp").when(passive != "unknown", "passive")
        .otherwise("unknown"),
        "model": F.when(is_known, F.col("_model")).otherwise(""),
        "resolution_method": F.when(is_known, F.col("_method"))
        .when(by_name | usable, "syslog_reported").otherwise("unresolved"),
    })
    if "relayed_via" not in df.columns:
        out = out.withColumn("relayed_via", F.lit(""))
    return out.drop("_host", "_vendor", "_model", "_method", "_known", "_by_name", "_passive")


def join_inventory(events: DataFrame, inventory: DataFrame) -> DataFrame:
    """Identity of directly connected devices."""
    return _identified(events, inventory)


def resolve_identity(events: DataFrame, inventory: DataFrame, relays: DataFrame) -> DataFrame:
    """Identity with relays: behind a relay the reported address or name counts."""
    known = latest_version(inventory, ["ip"], ["last_resolved"])
    named_relays = relays.select("ip").distinct().join(
        known.select("ip", F.col("hostname").alias("_relay_name")), "ip", "left"
    ).select(F.col("ip").alias("source_ip"), "_relay_name", F.lit(True).alias("_relay"))

    reported = F.coalesce("reported_hostname", F.lit(""))
    relay = F.col("_relay").isNotNull()
    as_ip = relay & (reported != F.col("source_ip")) & text.is_ip(reported)
    as_name = (
        relay & (reported != "") & ~text.is_ip(reported)
        & ~F.lower(reported).isin(*text.GENERIC_HOSTNAMES)
        & ~F.coalesce(reported == F.col("_relay_name"), F.lit(False))
    )
    moved = events.join(named_relays, "source_ip", "left").withColumns({
        "_by_name": as_name, "_moved": as_ip | as_name,
    })
    moved = moved.withColumns({
        "relayed_via": F.when(F.col("_moved"), F.col("source_ip")).otherwise(""),
        "source_ip": F.when(F.col("_moved"), reported).otherwise(F.col("source_ip")),
    }).drop("_relay", "_relay_name", "_moved")
    return _identified(moved, inventory)


def pending_queue(events: DataFrame, queue: DataFrame) -> DataFrame:
    """New queue entries: addresses without verified identity, first seen when."""
    unresolved = events.where(
        (F.col("vendor_source") != "snmp")
        & ((F.col("relayed_via") == "") | text.is_ip("source_ip")))
    seen = unresolved.groupBy(F.col("source_ip").alias("ip")).agg(
        F.min("received_at").alias("first_seen"))
    return seen.join(queue.select("ip"), "ip", "left_anti").select(
        "ip", "first_seen", F.lit(None).cast("timestamp_ntz").alias("last_attempt"),
        F.lit(0).alias("attempt_count"), F.lit("pending").alias("status"))


def pending_due(queue: DataFrame, as_of, retry_hours: int = 24) -> DataFrame:
    """Entries to try now: pending ones always, others once the wait is over."""
    waited = F.col("last_attempt").isNull() | (
        seconds_between("last_attempt", ntz(as_of)) >= retry_hours * 3600)
    return queue.where(
        (F.col("status") == "pending")
        | (F.col("status").isin("no_credential", "unreachable") & waited))


def advance_pending(queue: DataFrame, attempts: DataFrame, as_of, max_attempts: int = 5) -> DataFrame:
    """Queue after a round of attempts (ip, outcome in no_scope | failed | answered)."""
    tried = F.col("attempt_count") + 1
    changes = queue.join(attempts.select("ip", "outcome"), "ip").select(
        "ip", "first_seen", ntz(as_of).alias("last_attempt"), tried.alias("attempt_count"),
        F.when(F.col("outcome") == "no_scope", "no_credential")
        .when(tried >= max_attempts, "unreachable").otherwise("pending").alias("status"),
        (F.col("outcome") == "answered").alias("_answered"),
    )
    return keyed_upsert(queue, changes, ["ip"], deleted="_answered")


def match_scope(devices: DataFrame, scopes: DataFrame, best_only: bool = True, part_rows: int = 4096,
                block_rows: int = 512) -> DataFrame:
    """Scopes (addresses or IPv4 networks) that contain each device, narrowest first.

    Containment as an equi-join: a device has one network number per prefix
    length, 33 in all, and a scope has exactly one (length, number).
    """
    parts = F.split("ip_or_cidr", "/")
    length = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), F.lit(32))
    nets = scopes.select(
        "scope_id", "ip_or_cidr", "version", length.alias("prefix_length"),
        text.ipv4_number(F.element_at(parts, 1)).alias("_number"),
    ).where(F.col("_number").isNotNull()).withColumn(
        "_net", F.floor(F.col("_number") / F.pow(F.lit(2.0), 32 - F.col("prefix_length"))).cast("long")
    ).drop("_number")
    numbers = (
        devices.select("ip").distinct().withColumn("_number", text.ipv4_number("ip"))
        .where(F.col("_number").isNotNull())
        .withColumn("prefix_length", F.explode(F.sequence(F.lit(0), F.lit(32))))
        .select("ip", "prefix_length", F.floor(
            F.col("_number") / F.pow(F.lit(2.0), 32 - F.col("prefix_length"))).cast("long").alias("_net"))
    )
    net = ["prefix_length", "_net"]
    nets = nets.withColumn("_nth", F.row_number().over(Window.partitionBy(*net).orderBy("scope_id")))
    exact_host = (F.col("prefix_length") == 32).alias("is_exact_host")
    if best_only:  # one scope per network, so at most 33 rows per device
        narrowest = Window.partitionBy("ip").orderBy(F.desc("prefix_length"))
        best = numbers.join(nets.where("_nth = 1"), net).withColumn("candidate", F.row_number().over(narrowest))
        return best.where("candidate = 1").select(
            "ip", "scope_id", "ip_or_cidr", "version", "prefix_length", exact_host, "candidate")
    sizes = nets.groupBy(*net).agg(F.count("*").alias("_size"))
    before = Window.partitionBy("ip").orderBy(F.desc("prefix_length")).rowsBetween(Window.unboundedPreceding, -1)
    met = materialize(numbers.join(sizes, net).withColumn(
        "_before", F.coalesce(F.sum("_size").over(before), F.lit(0)).cast("int")), "nets")
    # whole blocks of a network's scopes meet whole parts of its devices; pairs are made after the shuffle
    parts = met.groupBy(*net).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("_parts"))
    blocks = nets.join(parts, net).groupBy(*net, "_parts", F.floor((F.col("_nth") - 1) / block_rows).alias("_block")).agg(
        F.collect_list(F.struct("scope_id", "ip_or_cidr", "version", "_nth")).alias("_scopes")).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    dealt = met.join(parts, net).withColumn("_part", F.pmod(F.xxhash64("ip"), F.col("_parts")).cast("int")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / block_rows))))
    return dealt.join(blocks, [*net, "_part", "_block"]).select(
        "ip", "prefix_length", "_before", F.explode("_scopes").alias("_s")).select(
        "ip", "_s.scope_id", "_s.ip_or_cidr", "_s.version", "prefix_length", exact_host,
        (F.col("_before") + F.col("_s._nth")).alias("candidate"))


def refresh_inventory(inventory: DataFrame, polled: DataFrame, queue: DataFrame) -> DataFrame:
    """Inventory after polling: answered devices get a newer version, the first
    time a device was seen is kept."""
    known = latest_version(inventory, ["ip"], ["last_resolved"])
    first = known.select("ip", F.col("first_seen").alias("_known_since"))
    queued = queue.select("ip", F.col("first_seen").alias("_queued_since"))
    fresh = (
        polled.where(F.col("outcome") == "answered").join(first, "ip", "left").join(queued, "ip", "left")
        .select(
            "ip", F.coalesce(F.nullif(F.col("hostname"), F.lit("")), F.col("ip")).alias("hostname"),
            text.vendor_from_oid("object_id").alias("vendor"),
            F.col("description").alias("model"), F.lit("snmp").alias("resolution_method"),
            F.coalesce("_known_since", "_queued_since", "attempted_at").alias("first_seen"),
            F.col("attempted_at").alias("last_resolved"))
    )
    return latest_version(known.unionByName(fresh), ["ip"], ["last_resolved"])


def fix_relay_timezone(events: DataFrame, relays: DataFrame, offset_hours: float = 3,
                       tolerance_minutes: float = 30) -> DataFrame:
    """Relay traffic stamped in local time: move event times from the future back."""
    marked = events.join(
        relays.select(F.col("ip").alias("source_ip")).distinct().withColumn("_relay", F.lit(True)),
        "source_ip", "left")
    ahead = seconds_between("received_at", "event_time")
    nearer = F.abs(ahead - offset_hours * 3600) < F.abs(ahead)
    wrong = F.col("_relay").isNotNull() & (ahead > tolerance_minutes * 60) & nearer
    shifted = plus_seconds("event_time", -offset_hours * 3600)
    return marked.withColumn(
        "event_time", F.when(wrong, shifted).otherwise(F.col("event_time"))).drop("_relay")


def correct_clock_skew(events: DataFrame, samples: int = 50, min_samples: int = 30,
                       min_seconds: float = 300, max_stddev: float = 120,
                       slice_rows: int = SLICE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Shift event times of devices whose clock is steadily wrong.

    The last ``samples`` differences confirm a skew (large mean, small spread)
    or release it (mean under half the limit); in between the last word holds.
    Frames run in blocks of equal row count, so one device may span many tasks.
    """
    order = ("received_at", "event_id")
    cut = slicing(events, ["source_ip"], *order, slice_rows)
    rows = numbered(events, ["source_ip"], *order, cut=cut)
    rows = rows.withColumn("_diff", seconds_between("event_time", "received_at"))
    blocks = in_row_blocks(rows, "_rn", samples - 1, block_rows)
    frame = Window.partitionBy("source_ip", "_block").orderBy("_rn").rowsBetween(1 - samples, 0)
    mean, spread, count = (F.avg("_diff").over(frame), F.stddev_pop("_diff").over(frame),
                           F.count("_diff").over(frame))
    judged = blocks.withColumns({"_mean": mean, "_spread": spread, "_count": count}).where("_own")
    signal = F.when(
        (F.col("_count") >= min_samples) & (F.abs("_mean") >= min_seconds)
        & (F.col("_spread") <= max_stddev), F.col("_mean")
    ).when((F.col("_count") >= min_samples) & (F.abs("_mean") < min_seconds / 2), F.lit(0.0))
    held = running(judged.withColumn("_signal", signal), ["source_ip"], *order,
                   [Running("skew_seconds", F.col("_signal"), "last")], cut=cut)
    skew = F.coalesce("skew_seconds", F.lit(0.0))
    return (
        held.withColumn("skew_seconds", skew)
        .withColumn("event_time", F.when(F.col("skew_seconds") != 0, plus_seconds(
            "event_time", F.col("skew_seconds"))).otherwise(F.col("event_time")))
        .drop("_rn", "_diff", "_block", "_own", "_mean", "_spread", "_count", "_signal")
    )


def _segments(events: DataFrame) -> DataFrame:
    """Split the ``id total index`` prefix off multi-part messages."""
    body = F.regexp_replace("message", "^ +", "")
    ours = F.startswith(F.coalesce("program", F.lit("")), F.lit(text.MULTIPART_PROGRAM_PREFIX))

    def part(i):
        return F.regexp_extract(body, text.MULTIPART_PATTERN, i)

    total = part(2).try_cast("int")
    return events.withColumns({
        "_part": ours & body.rlike(text.MULTIPART_PATTERN) & (F.coalesce(total, F.lit(0)) >= 1),
        "_mid": part(1), "_total": total, "_idx": part(3).try_cast("int"), "_content": part(4),
    })


def _closed(parts: DataFrame, keys: list[str], timeout_seconds: int) -> DataFrame:
    """Number (``_n``) the messages within each group of parts, in order of arrival.

    A message ends when all its parts are there, or with the first part that
    comes later than the timeout after its first one. A group holds the parts
    of one message id that came without a longer pause. The parts of a group
    pass by in order, and only the open message is held.
    """
    names = [*keys, "received_at", "event_id", "_total", "_idx"]
    rest = [c for c in parts.columns if c not in names]
    packed = parts.select(*names, F.struct(*rest).alias("_rest"))
    ordered = packed.repartition(*keys).sortWithinPartitions(*keys, "received_at", "event_id")
    schema = packed.withColumn("_n", F.lit(0)).schema
    timeout = timeout_seconds * 1_000_000

    def run(batches):
        group, start, seen, n = None, 0, set(), 0
        for batch in batches:
            numbers = []
            at = batch.column("received_at").cast("int64").to_pylist()
            by = zip(*(batch.column(k).to_pylist() for k in keys))
            for key, t, total, idx in zip(by, at, batch.column("_total").to_pylist(), batch.column("_idx").to_pylist()):
                if key != group:
                    group, seen, n = key, set(), 0
                if not n or t - start > timeout or len(seen) >= total:
                    start, seen, n = t, set(), n + 1
                seen.add(idx)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int32())], names=[*batch.schema.names, "_n"])

    return ordered.mapInArrow(run, schema).select(*names, "_rest.*", "_n")


def reassemble_multipart(events: DataFrame, timeout_seconds: int = 10,
                         slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Join the parts of split messages, in index order and without separator.

    Parts of one (device, reported name, message id) form a message until all
    are there or the timeout after its first part is over; missing parts leave
    it shorter, and a part that comes later begins the next message.
    """
    columns = events.columns
    helpers = ["_part", "_mid", "_total", "_idx", "_content"]
    tagged = _segments(events)
    whole = tagged.where(~F.col("_part") | (F.col("_total") == 1))
    whole = whole.withColumn("message", F.when(F.col("_part"), F.col("_content")).otherwise(
        F.col("message"))).select(*columns)

    key = ["source_ip", "reported_hostname", "_mid"]
    order = ("received_at", "event_id")
    parts = tagged.where(F.col("_part") & (F.col("_total") > 1))
    cut = slicing(parts, key, *order, slice_rows)
    parts = previous(parts, key, *order, {"_before": "received_at"}, cut=cut)
    gap = seconds_between("_before", "received_at")
    begins = F.when(gap.isNull() | (gap > timeout_seconds), F.struct(*order))
    parts = running(parts, key, *order, [Running("_group", begins, "last")], cut=cut)

    parts = _closed(parts, [*key, "_group"], timeout_seconds)
    arrival = F.struct(*order)
    record = F.struct(*columns)
    # one row per part number first, so repeats are folded before the join
    latest = parts.groupBy(*key, "_group", "_n", "_idx").agg(
        F.max_by(F.struct("_content", "raw"), arrival).alias("_seg"),
        F.max_by(record, arrival).alias("_newest"), F.min_by(record, arrival).alias("_oldest"),
        F.min(arrival).alias("_first"))
    piece = F.struct("_idx", F.col("_seg._content").alias("content"), F.col("_seg.raw").alias("raw"))
    merged = latest.groupBy(*key, "_group", "_n").agg(
        F.array_sort(F.collect_list(piece)).alias("_pieces"),
        F.max_by("_newest", F.when(F.col("_idx") == 0, F.col("_first"))).alias("_head"),
        F.min_by("_oldest", "_first").alias("_any"))
    base = merged.withColumn("_base", F.coalesce("_head", "_any"))
    joined = base.select("_base.*", "_pieces").withColumns({
        "message": F.array_join(F.transform("_pieces", lambda p: p["content"]), ""),
        "raw": F.array_join(F.transform("_pieces", lambda p: p["raw"]), "\n"),
    }).select(*columns)
    return whole.unionByName(joined)
