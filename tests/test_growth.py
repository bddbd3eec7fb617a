"""Steps that grow with their input, not with pairs of it: hand-made rows, small limits, plain Python beside them."""

import ipaddress
import random
import re
import time
from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from logrill.functions.matching import contains_join
from logrill.operators import classify, enrich, mix, resolve, retrieval, sequence, templates, vectorindex
from logrill.session import discard, materialize
from logrill.sources import tables
from logrill.streaming import keyed


def test_names_with_common_words(spark, monkeypatch):
    hosts = [f"dev-{i}" for i in range(40)] + [f"node-{i}" for i in range(40)] + ["depot-dev-3", "other", "Node-DEV-77"]
    names = [f"depot DEV-{i}" for i in range(60)] + [f"NODE dev {i:03}" for i in range(30)] + [
        "nowhere 39", "lost other", "other lost node", "the 977", "xx yy", "a b", "depot_depot", "dev-7", "ODE-1", "", None]
    monkeypatch.setattr(resolve._by_words, "__defaults__", (3,))
    laid = []
    monkeypatch.setattr(resolve, "contains_join", lambda needles, *rest: laid.append(needles) or contains_join(needles, *rest))
    got = {r.name: (r.verdict, r.hostname, r.match_count, r.stage) for r in resolve.resolve_hostnames(
        spark.createDataFrame([(n,) for n in names], "name string"),
        spark.createDataFrame([(h,) for h in hosts], "hostname string")).collect()}

    def expected(name):
        found, stage = {h for h in hosts if h == name}, "exact"
        if not found and name:
            found, stage = {h for h in hosts if name.lower() in h.lower()}, "substring"
        if not found:
            words = [w.lower() for w in re.split(r"[\s_-]+", name or "") if len(w) >= 3]
            found, stage = {h for h in hosts if any(w in h.lower() for w in words)}, "words"
        n = len(found)
        return ("none" if not n else "resolved" if n == 1 else "ambiguous", min(found) if n == 1 else None, n, stage if n else None)

    assert got == {n: expected(n) for n in names}
    asked = laid[1].select("_word").collect()  # a word is looked up once, however many names have it
    assert len(asked) == len(set(asked)) < len(names)


def test_scopes_of_wide_networks(spark):
    rng = random.Random(5)
    scopes = [(i, rng.choice([f"10.0.0.0/{rng.randint(8, 12)}", f"10.{i % 3}.0.0/16", f"10.0.1.{i % 9}", f"10.0.1.{i % 9}/28", "bad"]))
              for i in range(70)]
    ips = [f"10.{i % 4}.1.{i}" for i in range(50)] + ["11.0.0.1", "name", None]
    nets = spark.createDataFrame([(i, c, "v3") for i, c in scopes], "scope_id long, ip_or_cidr string, version string")
    devices = spark.createDataFrame([(ip,) for ip in ips + ips[:9]], "ip string")
    expected = {}
    for ip in ips[:51]:
        found = []
        for i, c in scopes:
            if c != "bad" and ipaddress.ip_address(ip) in (net := ipaddress.ip_network(c, strict=False)):
                found.append((-net.prefixlen, i, c))
        expected.update({(ip, at): (i, c, -p, p == -32) for at, (p, i, c) in enumerate(sorted(found), 1)})

    def rows(**how):
        found = enrich.match_scope(devices, nets, **how).collect()
        return len(found), {(r.ip, r.candidate): (r.scope_id, r.ip_or_cidr, r.prefix_length, r.is_exact_host) for r in found}

    assert rows(best_only=False, part_rows=7, block_rows=3) == (len(expected), expected)
    best = {k: v for k, v in expected.items() if k[1] == 1}
    assert rows() == (len(best), best)


class _State:
    """A value state and a handle that count what is asked of them."""

    def __init__(self):
        self.value, self.calls, self.timers = None, [], []

    def getValueState(self, name, schema):
        self.calls.append("state")
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def listTimers(self):
        return list(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_parts_use_state_only_for_open_messages():
    state, parts = _State(), keyed._Parts(10)
    parts.init(state)

    def send(*rows):
        state.calls.clear()
        found = list(parts.handleInputRows(("d", "h", "7"), iter([Row(
            at=at, event_id=at, total=2, idx=idx, content=f"c{idx}", raw=None if idx > 5 else f"r{idx}") for at, idx in rows]), state))
        return [(r.message, r.raw, r.parts, r.complete) for r in found]

    assert send((2, 0), (1, 1), (3, 1), (4, 0)) == [("c0c1", "r0\nr1", 2, True)] * 2
    assert state.calls == ["get"] and not state.timers
    assert send((5, 1)) == [] and state.calls == ["get", "update"] and state.timers == [1010]
    assert send((6, 1)) == [] and state.timers == [1010]
    assert send((7, 0), (8, 6)) == [("c0c1", "r0\nr1", 2, True)] and state.timers == [1010]
    assert [(r.message, r.complete) for r in parts.handleExpiredTimer(("d", "h", "7"), state, None)] == [("c6", False)]
    assert state.value is None and list(parts.handleExpiredTimer(("d", "h", "7"), state, None)) == []


def test_scores_of_windows_are_made_once(spark, monkeypatch):
    start = datetime(2024, 1, 1)
    rows = [(f"d{d}", start + timedelta(hours=h), f"t{(d * h) % 4}", 1 + h % 3, "v") for d in range(3) for h in range(8)]
    counts = spark.createDataFrame(
        rows, "source_ip string, window_start timestamp_ntz, template_id string, event_count long, vendor string")
    vectors = mix.mix_vectors(counts, 3, 5, 5)
    forest = mix.train_mix_models(vectors, 3, trees=5, sample=8).cache()
    whole = mix.forest_scores(vectors, forest, 3).collect()
    parts = mix.forest_scores(vectors, forest, 3, part_rows=5).collect()  # the vendor's windows are several parts
    assert sorted(whole) == sorted(parts) and len(whole) == 48

    made = []
    monkeypatch.setattr(mix, "materialize", lambda df, name: made.append(name) or materialize(df, name))
    judged = mix.score_mix_windows(counts, forest, None, 3, 5, 5)
    assert "mix-scores" in made and judged.count() == 24
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" not in plan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_model_of_transitions_is_not_broadcast(spark):
    pairs = spark.createDataFrame(
        [(ip, i, datetime(2024, 1, 1) + timedelta(minutes=i), f"t{i % 3}", f"t{(i + (i % 5 == 0)) % 3}")
         for ip in ("a", "b", None) for i in range(40)],
        "source_ip string, event_id long, transition_time timestamp_ntz, prev_template_id string, curr_template_id string")
    vendors = spark.createDataFrame([("a", "cisco"), ("b", "cisco")], "source_ip string, vendor string")
    done = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 20))], "source_ip string, last_scored timestamp_ntz")
    model = materialize(sequence.transition_model(pairs, vendors, done, 10, 10), "model")
    scored = sequence.score_transitions(pairs, model, vendors, done)
    assert not [line for line in _plan(scored).splitlines() if "BroadcastHashJoin" in line and "scope_key" in line]
    got = sorted((r.source_ip, r.event_id, r.model_scope) for r in scored.collect())
    # what was never scored both trains and is new; a device without a name has no model
    assert got == [("a", i, "device") for i in range(21, 40)] + [("b", i, "device") for i in range(40)]
    per = {(r.model_scope, r.scope_key, r.prev_template_id, r.curr_template_id): r for r in model.collect()}
    for r in scored.collect():
        known = per.get(("device", r.source_ip, r.prev_template_id, r.curr_template_id))
        total = next(m.prev_total for key, m in per.items() if key[:3] == ("device", r.source_ip, r.prev_template_id))
        assert abs(r.transition_probability - ((known.transitions if known else 0) + 1) / (total + 3)) < 1e-12


def test_vectors_stay_arrow_and_off_the_driver(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)] + [(300, [0.0] * 4)]
    rows += [(i + 400, rows[i][1]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    asked = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    exact = retrieval.knn_exact(docs, asked, 5, query_rows=8, doc_rows=32)
    assert "MapInArrow" in _plan(exact) and "Broadcast" not in _plan(exact)
    near = vectorindex.nearest(docs, asked, 5)
    assert "Broadcast" not in _plan(near)
    found = [{(r.query_id, r.rank): (r.doc_id, r.score) for r in x.collect()} for x in (exact, near)]
    assert found[0] == found[1] and len(found[0]) == 5 * asked.count()


def test_two_classes_share_a_machine(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(("up", "down", "fan", "route") if i % 3 else ("login", "fan", "denied", "up")) for _ in range(6)),
             "GOOD" if i % 3 else "BAD") for i in range(300)]
    model = classify.train_classifier(spark.createDataFrame(rows, "event_id long, message string, label string"))
    assert [len(machines) for machines, _ in model.folds] == [1] * classify.FOLDS
    said = {r.event_id: r for r in model.predict(spark.createDataFrame(rows, "event_id long, message string, label string")).collect()}
    assert sum(said[i].predicted_category == label for i, _, label in rows) > 0.85 * len(rows)
    assert all(0.5 <= r.predicted_confidence <= 1 for r in said.values())
    assert classify._tree_depth(48) == 3 and classify._tree_depth(1) == 2


def test_events_are_labelled_once_when_written(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 500, 1, 5).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, id) AS event_time", "'h' AS hostname",
        "'err' AS severity", "'10.0.0.1' AS source_ip", "'sshd' AS program")
    tables.write_events(rows.mapInArrow(counted, rows.schema), str(tmp_path / "events"))
    assert seen.value == 500 and spark.read.parquet(str(tmp_path / "events")).count() == 500


def test_small_leaves_move_once(spark, monkeypatch):
    rng = random.Random(11)
    texts = [f"open {rng.choice('abc')}{i} by {rng.choice(('root', 'anna', 'bert'))} at {rng.choice('xyz')}" for i in range(90)]
    texts += [" ".join(rng.choice(("up", "down", "fan", "7", "<*>")) for _ in range(rng.randint(1, 4))) for _ in range(150)] + ["", "  ", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "event_id long, message string")

    def mined():
        return sorted((r.event_id, r.template_id, r.template, r.template_size) for r in templates.mine_templates(rows, "drain").collect())

    spread = []
    monkeypatch.setattr(templates, "_drain_large", lambda *args, large=templates._drain_large: spread.append(1) or large(*args))
    monkeypatch.setattr(templates, "MOST_TEMPLATES", 5)
    whole = mined()
    assert len(whole) == len(texts) and not spread  # leaves of bounded size are mined where they are
    plan = _plan(templates.mine_templates(rows, "drain").select("event_id", "template_id", "template_size"))
    assert not [line for line in plan.splitlines() if "Exchange" in line and "_masked#" in line]
    monkeypatch.setattr(templates, "LEAF_ROWS", 0)
    assert mined() == whole and spread


def test_what_is_written_leaves_no_shuffle(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(files.apply(i).getName()) for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    setting, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffles()
    counted = spark.range(10_000).groupBy((F.col("id") % 100).alias("g")).count()
    written = materialize(counted, "counted")
    for _ in range(20):
        if not (left := shuffles() - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(setting, None) is None
    assert written.count() == counted.count() == 100
    discard(written)
    assert not spark._jvm.java.io.File(written.inputFiles()[0].removeprefix("file:")).exists()
