"""Panes with exact lateness, restarts between batches, and the native streams."""

import json
import random
import time
from datetime import UTC, datetime

from pyspark.sql import functions as F

from tidegauge.operators import materialize, scenario
from tidegauge.plans.config import WindowPolicy
from tidegauge.plans.fixtures import BATCHES, run_panes
from tidegauge.sources.envelope import ENVELOPE
from tidegauge.streaming import native, panes

START = 1783850400000


def panes_of(rows):
    found = rows.where((F.col("window_start_ms") == START) & (F.col("customer_id") == "cust-9009")).orderBy("revision").collect()
    return [(r.transaction_count, r.total_amount, r.pane_timing, r.pane_nonspeculative_index, r.pane_is_first) for r in found]


def test_on_time_late_and_too_late(spark, tmp_path):
    policy = WindowPolicy(period_seconds=60, enable_early=False)
    assert panes_of(run_panes(spark, str(tmp_path / "a"), BATCHES, policy)) == [(3, 7_500_000, "ON_TIME", 0, True), (4, 10_000_000, "LATE", 1, False)]


def test_early_panes_and_late_duplicates(spark, tmp_path):
    duplicate = (("txn-001", "cust-9009", 5, 2_000_000),)
    batches = (BATCHES[0], BATCHES[1], duplicate, BATCHES[2])
    policy = WindowPolicy(period_seconds=60)
    assert panes_of(run_panes(spark, str(tmp_path / "b"), batches, policy)) == [(3, 7_500_000, "EARLY", -1, True), (3, 7_500_000, "ON_TIME", 0, False), (4, 10_000_000, "LATE", 1, False)]


def test_stream_of_alerts(spark, tmp_path):
    scenario.envelope_of(scenario.demo_events(spark)).write.parquet(f"{tmp_path}/raw")
    envelope = spark.readStream.schema(ENVELOPE).parquet(f"{tmp_path}/raw")
    out, counters = f"{tmp_path}/out", native.Counters()
    spark.streams.addListener(counters)
    native.start_alerts(native.events_of(envelope), lambda b, n: b.write.mode("append").parquet(out), f"{tmp_path}/c1", once=True).awaitTermination()
    native.start_invalid(envelope, lambda b, n: b.collect() and None, f"{tmp_path}/c0", once=True).awaitTermination()
    alerts = [json.loads(bytes(r.value)) for r in spark.read.parquet(out).collect()]
    last = {a["idempotency_key"]: a["transaction_count"] for a in sorted(alerts, key=lambda a: a["revision"])}
    assert sorted(last.values()) == [4, 4, 5] and len({(a["idempotency_key"], a["revision"]) for a in alerts}) == len(alerts)
    view = materialize.AlertView(spark, f"file://{tmp_path}/view")
    spark.read.parquet(out).select("key", "value", F.lit("a").alias("topic"), F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"), F.lit(None).cast("timestamp").alias("timestamp")).write.parquet(f"{tmp_path}/alerts")
    stream = spark.readStream.schema(ENVELOPE).parquet(f"{tmp_path}/alerts")
    native.start_materializer(stream, view, f"{tmp_path}/c2", once=True).awaitTermination()
    assert view.snapshot().count() == 3
    native.start_materializer(spark.readStream.schema(ENVELOPE).parquet(f"{tmp_path}/alerts"), view, f"{tmp_path}/c3", once=True).awaitTermination()
    assert view.version() == 1
    deadline = time.monotonic() + 30
    while counters.total["valid_records"] < 8 and time.monotonic() < deadline:  # the listener hears of batches a little later
        time.sleep(0.2)
    spark.streams.removeListener(counters)
    assert counters.total["valid_records"] == 8 and counters.total["alerts_emitted"] == len(alerts)


def test_revisions_rise_and_the_view_follows(spark, tmp_path):
    """A window grows over three runs of the query, each from its checkpoint: the view shows the last state."""
    view, seen = materialize.AlertView(spark, f"file://{tmp_path}/view"), []
    schema = "event_id string, customer_id string, event_ts timestamp, amount bigint, partition int, offset bigint"

    def take(batch, n):
        alerts = materialize.decode_alerts(batch.select("key", "value", F.lit(0).alias("partition"), F.lit(n).cast("bigint").alias("offset")))
        view.upsert(alerts)
        seen.extend((r.revision, json.loads(r.alert_json)["transaction_count"], json.loads(r.alert_json)["pane_timing"]) for r in alerts.collect())

    for n, ids in enumerate(((0, 1, 2, 3, 4), (5, 6), (6, 7))):
        rows = [(f"e{i}", "c", datetime(2026, 8, 9, 20, 0, i, tzinfo=UTC), 10, 0, 10 * n + i) for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/input")
        native.start_alerts(spark.readStream.schema(schema).parquet(f"{tmp_path}/input"), take, f"{tmp_path}/c", WindowPolicy(period_seconds=60), once=True).awaitTermination()
    assert seen == [(0, 5, "EARLY"), (1, 7, "EARLY"), (2, 8, "EARLY")]
    assert [json.loads(r.alert_json)["transaction_count"] for r in view.snapshot().collect()] == [8]


class Held:
    """Spark's state of one key in plain memory; calls are counted."""

    def __init__(self):
        self.own, self.timers, self.calls = {}, set(), 0

    def __getattr__(self, name):
        if name not in ("get", "update", "clear", "getValue", "updateValue", "containsKey", "registerTimer"):
            raise AttributeError(name)

        def call(*args):
            self.calls += 1
            if name in ("get", "getValue"):
                return self.own.get(args)
            if name in ("update", "updateValue"):
                self.own[args[:-1]] = args[-1]
            elif name == "containsKey":
                return args in self.own
            elif name == "registerTimer":
                self.timers.add(args[0])
            else:
                self.own.clear()

        return call


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def processor(early, **sizes):
    made = panes.PaneProcessor(1000, 500, early, 1501, **sizes)
    made.head, made.held, made.seen, made.handle = Held(), Held(), Held(), Held()
    return made


def fired(rows):
    return sorted((r.customer_id, r.revision, r.transaction_count, r.total_amount, r.pane_timing, r.pane_nonspeculative_index, r.pane_is_first) for r in rows)


def plain_panes(batches, early):
    """The same for each customer alone; batches of (logical watermark, rows), a window from 0 to 1000."""
    out, own = [], {}
    for now, rows in batches:
        late = now is not None and now >= 1000
        here = []
        for who, event, amount, _, _ in sorted(rows, key=lambda r: r[3:]) if now is None or now <= 1500 else ():
            x = own.setdefault(who, {"seen": {}, "fired": 0, "settled": 0, "on": False})
            here.append((who, x))
            if late and x["seen"] and not x["on"]:
                out.append((who, x["fired"], len(x["seen"]), sum(x["seen"].values()), "ON_TIME", x["settled"], x["fired"] == 0))
                x |= {"fired": x["fired"] + 1, "settled": x["settled"] + 1, "on": True}
            if event in x["seen"]:
                continue
            x["seen"][event], x["new"] = amount, True
            if late:
                out.append((who, x["fired"], len(x["seen"]), sum(x["seen"].values()), "LATE", x["settled"], x["fired"] == 0))
                x |= {"fired": x["fired"] + 1, "settled": x["settled"] + 1, "on": True}
        for who, x in here:
            if x.pop("new", False) and not late and early:
                out.append((who, x["fired"], len(x["seen"]), sum(x["seen"].values()), "EARLY", -1, x["fired"] == 0))
                x["fired"] += 1
        for who, x in own.items():
            if late and not x["on"]:
                out.append((who, x["fired"], len(x["seen"]), sum(x["seen"].values()), "ON_TIME", x["settled"], x["fired"] == 0))
                x |= {"fired": x["fired"] + 1, "settled": x["settled"] + 1, "on": True}
        if now is not None and now > 1500:
            own.clear()
    return sorted(out)


def test_customers_of_a_bucket_are_alone_in_their_panes():
    draw = random.Random(7)
    for case in range(60):
        early = case % 2 == 0
        made, out, batches, timers = processor(early, shard_customers=draw.choice((1, 3, 50)), shard_ids=draw.choice((1, 2, 64))), [], [], set()
        for now in sorted(draw.choice((0, 400, 999, 1000, 1300, 1500, 1501)) for _ in range(5)):
            rows = [(draw.choice(("a", "b", "\u00e9", *map(str, range(draw.choice((3, 40)))))), f"e{draw.randrange(6)}", draw.randrange(1, 9), draw.randrange(2), i) for i in range(draw.randrange(30))]
            draw.shuffle(rows)
            batches.append((now or None, rows))
            at = At(now - 1501 + 5000 if now else 0)  # the window lies 5000 later than in plain_panes
            if rows:
                out += made.handleInputRows((0, 5000), [(0, 5000, *r) for r in rows], at)
            for timer in sorted(t for t in made.handle.timers if now and t <= at.ms):
                made.handle.timers.discard(timer)
                out += made.handleExpiredTimer((0, 5000), at, None)
        assert fired(out) == plain_panes(batches, early)
        if batches[-1][0] == 1501:
            assert not (made.head.own or made.held.own or made.seen.own)


def test_state_calls_do_not_grow_with_rows():
    """Each call is a message to another process: 300 customers with five events each were 7,000 of them."""
    made = processor(False)
    rows = [(0, 0, f"c{i % 300}", f"e{i}", 1, 0, i) for i in range(1500)]
    for n, at in ((0, 0), (1, 0), (2, 1)):
        list(made.handleInputRows((0, 0), rows[500 * n : 500 * n + 500], At(at)))
    assert sum(x.calls for x in (made.head, made.held, made.seen, made.handle)) < 30


def test_a_batch_of_alerts_is_made_once(spark, tmp_path):
    """However often the view looks at a batch, the stream's stateful step runs once."""
    count = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            count.add(b.num_rows)
            yield b

    view, schema = materialize.AlertView(spark, f"file://{tmp_path}/view"), "event_id string, customer_id string, event_ts timestamp, amount bigint, partition int, offset bigint"
    take = lambda batch, n: view.upsert(materialize.decode_alerts(batch.mapInArrow(counted, batch.schema).select("key", "value", F.lit(0).alias("partition"), F.lit(n).cast("bigint").alias("offset"))))
    for n in range(2):
        rows = [(f"e{10 * n + i}", f"c{i % 2}", datetime(2026, 8, 9, 20, 0, i, tzinfo=UTC), 10, 0, 10 * n + i) for i in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/input")
        events = spark.readStream.schema(schema).parquet(f"{tmp_path}/input")
        native.start_alerts(events, take, f"{tmp_path}/c", WindowPolicy(period_seconds=60), once=True).awaitTermination()
    assert [(json.loads(r.alert_json)["transaction_count"], r.revision) for r in view.snapshot().collect()] == [(10, 1)] * 2
    assert count.value == 4 and not [x for x in view._names() if x.startswith(".batch")]
