"""Keyed streams over several micro-batches equal the batch operators."""

import time
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from logrill.operators import signals
from logrill.plans import streams
from logrill.session import fresh_path, numbers_below
from logrill.sources import fixture as fx
from logrill.streaming import history, jobs, keyed

SF = "/root/testdata/sf0.001"


def _batches(spark, rows, days=11):
    """A file per stretch of days, in time order; one per micro-batch."""
    path = fresh_path(spark, "files")
    stretch = F.floor((F.dayofmonth("event_time") - 1) / days)
    for i in range(31 // days + 1):
        rows.where(stretch == i).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken by modification time
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(spark, stream):
    keyed.use_rocksdb(spark)
    out = fresh_path(spark, "out")
    query = (stream.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", fresh_path(spark, "position")).trigger(availableNow=True).start())
    query.awaitTermination()
    return {tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()}


def test_rare_and_flapping(spark):
    rows = fx.events(spark, SF).select("event_id", "event_time", "received_at", "source_ip", "message", "template_id").cache()
    stream = _batches(spark, rows)
    rare = {(r.event_id,) for r in signals.rare_template(rows).where("rare_template").collect()}
    assert _run(spark, keyed.stream_rare_template(stream)) == rare
    flaps = {(r.event_id,) for r in signals.interface_flapping(rows, 172800, 2).where("interface_flapping").collect()}
    assert flaps and _run(spark, keyed.stream_flapping(stream, 172800, 2)) == flaps


def test_rollup_merges_batches(spark):
    rows = fx.events(spark, SF).cache()
    out = fresh_path(spark, "minutes")
    jobs.stream_rollup(_batches(spark, rows), out, fresh_path(spark, "position"), {"availableNow": True}).awaitTermination()
    from logrill.operators.rollup import events_by_minute
    plain = events_by_minute(rows)
    merged = jobs.read_rollup(spark, out).select(plain.columns)
    assert merged.exceptAll(plain).count() == 0 and merged.count() == plain.count()


def test_lost_part_is_emitted_after_the_timeout(spark):
    keyed.use_rocksdb(spark)
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [(1, t, t, "d", "acs", "CSCOacs_X", "0000000001 2 0 lone", "r")],
        "event_id long, event_time timestamp_ntz, received_at timestamp_ntz, source_ip string, "
        "reported_hostname string, program string, message string, raw string")
    path = fresh_path(spark, "files")
    rows.write.parquet(path)
    stream = keyed.stream_multipart(spark.readStream.schema(rows.schema).parquet(path), 1)
    query = (stream.writeStream.format("memory").queryName("lost_parts").trigger(processingTime="500 milliseconds")
             .option("checkpointLocation", fresh_path(spark, "position")).start())
    deadline = datetime.now() + timedelta(seconds=60)
    while datetime.now() < deadline and not spark.sql("SELECT * FROM lost_parts").count():
        time.sleep(0.5)
    query.stop()
    assert [(r.message, r.complete) for r in spark.sql("SELECT * FROM lost_parts").collect()] == [("lone", False)]


def test_multipart_query_returns_messages_that_lack_a_part(spark):
    rows = streams.stream_multipart(spark, SF).cache()
    keys = ["source_ip", "reported_hostname", "message_id"]
    parts = fx.segments(spark, SF).where("program = 'CSCOacs_Passed'").withColumn("message_id", F.split("raw", " ")[0]).select(keys).distinct()
    assert parts.count() and parts.exceptAll(rows.select(keys).distinct()).count() == 0
    assert rows.where("complete").count() and rows.where("not complete").count()


def _stretches(spark, frames):
    """A stream that takes one frame a batch."""
    path = fresh_path(spark, "files")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken by modification time
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


EVENT = ("event_id long, event_time timestamp_ntz, received_at timestamp_ntz, hostname string, source_ip string, program string, "
         "severity string, predicted_category string, is_anomaly int, message string, vendor string, pid long, template_id string, "
         "anomaly_reasons array<string>")


def _event(i, t, host="h"):
    return (i, t, t, host, "10.0.0.1", "p", "err", "SYSTEM", 1, f"m{i}", "v", None, "t", ["always_severe"])


def test_alerts_fire_once_per_cool_down_and_read_only_new_rows(spark):
    start = datetime(2024, 1, 1)
    rules = spark.createDataFrame(
        [(1, "three in ten minutes", 10, 3, True, False, 15, None, "h", None, None, None, None),
         (2, "any in two hours", 120, 1, True, True, 60, None, None, None, None, None, None),
         (3, "switched off", 60, 1, False, False, 0, None, None, None, None, None, None)],
        "id long, name string, window_minutes int, threshold int, enabled boolean, only_anomalies boolean, cooldown_minutes int, "
        "last_triggered_at timestamp_ntz, hostname string, source_ip string, program string, severity string, predicted_category string")
    minutes = [[0, 1], [6], [8, 30], [26, 27, 28], [29, 31], [90]]
    frames, nows = [], []
    for k, some in enumerate(minutes):
        frames.append(spark.createDataFrame([_event(10 * k + j, start + timedelta(minutes=m)) for j, m in enumerate(some)], EVENT))
        nows.append(start + timedelta(minutes=[5, 10, 15, 29, 40, 95][k], seconds=k))
    taken, out = iter(nows), fresh_path(spark, "alerts")
    jobs.stream_alerts(_stretches(spark, frames), lambda: rules, lambda: next(taken), out, fresh_path(spark, "position"),
                       {"availableNow": True}).awaitTermination()
    fired = sorted((r.v, r.id, r.matched_count) for r in spark.read.parquet(f"{out}/fired").collect())
    # the plain rule: all events so far, at every trigger, with the cool-down kept by hand
    seen, last, want = [], {}, []
    for k, (some, now) in enumerate(zip(minutes, nows)):
        seen += some
        at = int((now - start).total_seconds() // 60)
        for rule, width, least, cool in ((1, 10, 3, 15), (2, 120, 1, 60)):
            n = sum(at - width <= m < at for m in seen)
            if n >= least and (rule not in last or at - last[rule] >= cool):
                want.append((k, rule, n))
                last[rule] = at
    assert fired == want and len({r for _, r, _ in want}) == 2
    assert numbers_below(spark, f"{out}/minutes") == [4, 5] and len(numbers_below(spark, f"{out}/fired")) == 6


def test_index_is_compacted_and_complete(spark):
    start = datetime(2024, 1, 1)
    frames = [spark.createDataFrame([_event(i, start + timedelta(minutes=i)), _event(0, start)], EVENT) for i in range(8)]
    out = fresh_path(spark, "index")
    jobs.stream_index(_stretches(spark, frames), out, fresh_path(spark, "position"), lambda: start + timedelta(minutes=46), 40,
                      trigger={"availableNow": True}, compact_every=3).awaitTermination()
    assert numbers_below(spark, f"{out}/docs") == [6, 7] and numbers_below(spark, f"{out}/waiting") == [6, 7]
    assert sorted(r.message for r in jobs.read_index(spark, out).collect()) == [f"m{i}" for i in range(7)]
    waiting = spark.read.parquet(f"{out}/waiting/v=7").collect()
    assert [r.message for r in waiting] == ["m7"]


def test_a_quiet_stream_is_indexed_by_its_heartbeat(spark):
    start = datetime(2024, 1, 1)
    path, out = fresh_path(spark, "files"), fresh_path(spark, "index")
    spark.createDataFrame([_event(1, start)], EVENT).write.parquet(path)
    began = time.monotonic()
    query = jobs.stream_index(spark.readStream.schema(EVENT).parquet(path), out, fresh_path(spark, "position"),
                              lambda: start + timedelta(minutes=41 if time.monotonic() - began > 6 else 1), 40,
                              trigger={"processingTime": "1 second"}, heartbeat=True)
    found = []
    while not found and time.monotonic() - began < 90:
        assert not query.awaitTermination(2)
        if numbers_below(spark, f"{out}/docs"):
            found = spark.read.parquet(f"{out}/docs").collect()
    query.stop()
    assert [r.message for r in found] == ["m1"]


def test_closed_minutes_and_late_rows(spark):
    """A row behind the watermark is counted as dropped and changes no closed minute."""
    start = datetime(2024, 1, 1)
    rows = lambda *minutes: spark.createDataFrame(
        [(start + timedelta(minutes=m), "h", "v", "err", "SYSTEM", 1, "snmp") for m in minutes],
        "event_time timestamp_ntz, hostname string, vendor string, severity string, predicted_category string, "
        "is_anomaly int, resolution_method string")
    stream = jobs.windowed_rollup(_stretches(spark, [rows(0, 0, 5), rows(30), rows(31), rows(1, 29, 60)]))
    out = fresh_path(spark, "closed")
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "position"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    closed = {(r.minute - start).seconds // 60: r.event_count for r in spark.read.schema(stream.schema).parquet(out).collect()}
    assert closed == {0: 2, 5: 1, 29: 1, 30: 1, 31: 1} and jobs.late_rows(query) == 1


def test_stored_events_equal_the_batch_also_after_a_replay(spark):
    rows = fx.events(spark, SF).cache()
    how = history.Reasons(refresh_seconds=86400, volume_multiplier=3, flap_seconds=172800)
    out, position = fresh_path(spark, "stored"), fresh_path(spark, "position")
    stream = _batches(spark, rows)

    def run():
        history.stream_events(stream, lambda b: b, out, position, how, {"availableNow": True}).awaitTermination()
        return {(r.event_id, ",".join(r.anomaly_reasons), r.is_anomaly) for r in history.read_stored(spark, out).collect()}

    whole = signals.inline_reasons(rows, refresh_seconds=86400, volume_multiplier=3, flap_seconds=172800)
    want = {(r.event_id, ",".join(r.anomaly_reasons), r.is_anomaly) for r in whole.collect()}
    assert {"rare_template", "severity_spike", "volume_spike", "interface_flapping"} <= {x for _, r, _ in want for x in r.split(",")}
    assert run() == want
    last = max(int(f.name) for f in Path(position, "commits").iterdir() if f.name.isdigit())
    assert last >= 2
    for f in (Path(position, "commits", str(last)), Path(position, "commits", f".{last}.crc")):
        f.unlink(missing_ok=True)  # as if the query was lost after its write
    assert run() == want and history.read_stored(spark, out).count() == rows.count()
    assert numbers_below(spark, f"{out}/state/ranks") == [last - 1, last]


def test_identical_lines_have_ids_of_their_own(spark):
    rows = fx.events(spark, SF).drop("event_id").limit(50).cache()
    path, out, position = (fresh_path(spark, n) for n in ("files", "stored", "position"))
    for _ in range(2):
        rows.union(rows).repartition(3).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        history.stream_events(stream, lambda b: b, out, position, trigger={"availableNow": True}).awaitTermination()
    got = history.read_stored(spark, out)
    assert got.count() == 200 == got.select("event_id").distinct().count()
