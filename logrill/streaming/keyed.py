"""Keyed state: rare templates, flapping interfaces, clock skew, message parts.

Each processor keeps a bounded state per key. A key's rows of one micro-batch
meet in one task; the trigger bounds how many those can be.
"""

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from logrill.functions import text
from logrill.functions.clock import micros
from logrill.operators.enrich import _segments

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """Keyed processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _in_order(rows) -> pd.DataFrame:
    parts = list(rows)
    return pd.concat(parts).sort_values(["at", "event_id"]) if parts else pd.DataFrame()


class _Rare(StatefulProcessor):
    def __init__(self, threshold):
        self.threshold = threshold

    def init(self, handle):
        self.seen = handle.getValueState("seen", "n int")

    def handleInputRows(self, key, rows, timerValues):
        have = self.seen.get()[0] if self.seen.exists() else 0
        first = pd.DataFrame()
        for part in rows:  # keep no more rows than can still be rare
            first = pd.concat([first, part]).sort_values(["at", "event_id"]).head(self.threshold - have)
        self.seen.update((have + len(first),))
        yield pd.DataFrame({"event_id": first["event_id"].astype("int64")} if len(first) else
                           {"event_id": pd.Series([], dtype="int64")})

    def close(self):
        pass


def _first_per_template(limit):
    """Drop rows that cannot be among the first of their template in this task."""
    def keep(batches):
        for part in batches:
            ordered = part.sort_values(["at", "event_id"])
            yield ordered.groupby("template_id").head(limit)
    return keep


def stream_rare_template(events: DataFrame, threshold: int = 5) -> DataFrame:
    """Ids of the first events of each template; a counter up to the threshold per key."""
    slim = events.select("template_id", micros("event_time").alias("at"), "event_id")
    few = slim.mapInPandas(_first_per_template(threshold), slim.schema)
    return few.groupBy("template_id").transformWithStateInPandas(
        statefulProcessor=_Rare(threshold), outputStructType="event_id long", outputMode="Append", timeMode="None")


class _Flap(StatefulProcessor):
    def __init__(self, width, downs):
        self.width, self.downs = width, downs

    def init(self, handle):
        self.recent = handle.getValueState("recent", "at array<long>")

    def handleInputRows(self, key, rows, timerValues):
        recent = list(self.recent.get()[0]) if self.recent.exists() else []
        hits = []
        for at, event in _in_order(rows)[["at", "event_id"]].itertuples(index=False):
            recent = [*recent, int(at)][-self.downs:]
            if len(recent) == self.downs and at - recent[0] <= self.width:
                hits.append(int(event))
        self.recent.update((recent,))
        yield pd.DataFrame({"event_id": pd.Series(hits, dtype="int64")})

    def close(self):
        pass


def stream_flapping(events: DataFrame, window_seconds: int = 900, min_downs: int = 3) -> DataFrame:
    """Ids of "down" events of flapping interfaces; the last few times per interface."""
    downs = events.select(
        "source_ip", text.interface_name("message").alias("iface"), text.interface_state("message").alias("state"),
        micros("event_time").alias("at"), "event_id").where("state = 'down'").drop("state")
    return downs.groupBy("source_ip", "iface").transformWithStateInPandas(
        statefulProcessor=_Flap(window_seconds * 1_000_000, min_downs), outputStructType="event_id long",
        outputMode="Append", timeMode="None")


class _Skew(StatefulProcessor):
    def __init__(self, samples, min_samples, min_seconds, max_stddev):
        self.samples, self.min_samples = samples, min_samples
        self.min_seconds, self.max_stddev = min_seconds, max_stddev

    def init(self, handle):
        self.kept = handle.getValueState("kept", "diffs array<double>, skew double")

    def handleInputRows(self, key, rows, timerValues):
        diffs, skew = self.kept.get() if self.kept.exists() else ([], 0.0)
        diffs, out = list(diffs), []
        for diff, event in _in_order(rows)[["diff", "event_id"]].itertuples(index=False):
            diffs = [*diffs, float(diff)][-self.samples:]
            if len(diffs) >= self.min_samples:
                values = pd.Series(diffs)
                if abs(values.mean()) >= self.min_seconds and values.std(ddof=0) <= self.max_stddev:
                    skew = float(values.mean())
                elif abs(values.mean()) < self.min_seconds / 2:
                    skew = 0.0
            out.append((int(event), skew))
        self.kept.update((diffs, skew))
        yield pd.DataFrame(out, columns=["event_id", "skew_seconds"])

    def close(self):
        pass


def stream_clock_skew(events: DataFrame, samples: int = 50, min_samples: int = 30, min_seconds: float = 300,
                      max_stddev: float = 120) -> DataFrame:
    """(event_id, skew_seconds); the last samples and the confirmed skew per device."""
    slim = events.select(
        "source_ip", "event_id", micros("received_at").alias("at"),
        ((micros("received_at") - micros("event_time")) / 1e6).alias("diff"))
    return slim.groupBy("source_ip").transformWithStateInPandas(
        statefulProcessor=_Skew(samples, min_samples, min_seconds, max_stddev),
        outputStructType="event_id long, skew_seconds double", outputMode="Append", timeMode="None")


_PART_OUTPUT = "source_ip string, reported_hostname string, message_id string, message string, raw string, parts int, complete boolean"


class _Parts(StatefulProcessor):
    """The open message of a key is one value: read once and written once for a key and micro-batch,
    and not at all where a message is complete within its first one."""

    def __init__(self, timeout_ms):
        self.timeout = timeout_ms

    def init(self, handle):
        self.handle = handle
        self.open = handle.getValueState("open", "total int, parts array<struct<idx: int, content: string, raw: string>>")

    def _joined(self, key, parts, complete):
        kept = [parts[i] for i in sorted(parts)]
        return Row(source_ip=key[0], reported_hostname=key[1], message_id=key[2], message="".join(p[0] for p in kept),
                   raw="\n".join(p[1] for p in kept if p[1] is not None), parts=len(kept), complete=complete)

    def _read(self):
        total, parts = self.open.get() or (None, [])
        return total, {p[0]: (p[1], p[2]) for p in parts}

    def handleInputRows(self, key, rows, timerValues):
        total, parts = self._read()
        timed = had = total is not None
        for row in sorted(rows, key=lambda r: (r["at"] is None, r["at"] or 0, r["event_id"] is None, r["event_id"] or 0)):
            if total is None:
                total = row["total"]
            parts[row["idx"]] = row["content"], row["raw"]
            if len(parts) >= total:
                yield self._joined(key, parts, True)
                total, parts = None, {}
                if timed and self.timeout:
                    for timer in list(self.handle.listTimers()):
                        self.handle.deleteTimer(timer)
                timed = False
        if total is not None:
            self.open.update((total, [(i, *p) for i, p in parts.items()]))
            if self.timeout and not timed:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout)
        elif had:
            self.open.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        total, parts = self._read()
        if total is not None:
            self.open.clear()
            yield self._joined(key, parts, False)

    def close(self):
        pass


def stream_multipart(events: DataFrame, timeout_seconds: int | None = 10) -> DataFrame:
    """Split messages joined as their parts arrive; after the timeout what is there.

    Without a timeout, parts wait for the missing ones however long it takes."""
    parts = _segments(events).where("_part").select(
        "source_ip", "reported_hostname", F.col("_mid").alias("message_id"), F.col("_total").alias("total"),
        F.col("_idx").alias("idx"), F.col("_content").alias("content"), "raw",
        micros("received_at").alias("at"), "event_id")
    return parts.groupBy("source_ip", "reported_hostname", "message_id").transformWithState(
        statefulProcessor=_Parts(timeout_seconds and timeout_seconds * 1000), outputStructType=_PART_OUTPUT, outputMode="Append",
        timeMode="ProcessingTime" if timeout_seconds else "None")
