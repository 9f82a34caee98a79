"""Windows, dedup, aggregates, the rule, the demonstration scenario, skew and the materialised view."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidegauge.functions.serde import alert_records
from tidegauge.operators import materialize, scenario, skew, velocity
from tidegauge.operators.ingest import valid_events, validated
from tidegauge.plans.catalog import skew_report
from tidegauge.plans.config import PipelineConfig, WindowPolicy, config_of, parse_args
from tidegauge.sources.envelope import first_records, kafka_read_options, kafka_write_options, publish_in_order, read_envelope

EVENT = "event_id string, customer_id string, event_ts timestamp, amount bigint, partition int, offset bigint"


def events(spark, rows):
    return spark.createDataFrame([(e, who, datetime.fromtimestamp(t, UTC), a, 0, i) for i, (e, who, t, a) in enumerate(rows)], EVENT)


def starts(df):
    return sorted(r.window_start_ms // 1000 for r in velocity.with_bounds(df).collect())


def test_six_windows(spark):
    one = events(spark, [("a", "c", 125, 1)])
    assert starts(velocity.assign_windows(one)) == [70, 80, 90, 100, 110, 120]
    assert starts(velocity.assign_windows(one, WindowPolicy(period_seconds=60))) == [120]
    assert starts(velocity.assign_windows(events(spark, [("a", "c", 120, 1)]))) == [70, 80, 90, 100, 110, 120]


@pytest.mark.parametrize("rows, n", [([("e", "a", 125, 1)] * 2, 6), ([("e", "a", 125, 1), ("e", "b", 125, 1)], 12), ([("e", "a", 125, 1), ("e", "a", 195, 1)], 12), ([("e", "a", 125, 1), ("e", "a", 135, 1)], 7)])
def test_dedup_by_window(spark, rows, n):
    assert velocity.deduplicate(velocity.assign_windows(events(spark, rows))).count() == n


def test_first_arrival_wins(spark):
    rows = velocity.velocity(events(spark, [("e", "a", 125, 5), ("e", "a", 125, 9), ("e", "a", 130, 11)])).collect()
    by = {r.window_start_ms: (r.transaction_count, r.total_amount) for r in rows}
    assert by == {s * 1000: (1, 5) for s in range(70, 130, 10)} | {130_000: (1, 11)}


def test_counters(spark):
    row = velocity.assignment_counts(velocity.assign_windows(events(spark, [("e", "a", 125, 1)] * 3))).first()
    assert (row.unique_window_assignments, row.duplicate_window_assignments) == (6, 12)


@pytest.mark.parametrize("count, total, conditions", [(3, 9_999_999, None), (0, 0, None), (4, 1_000_000, ["transaction_count"]), (1, 10_000_000, ["total_amount"]), (4, 10_000_000, ["transaction_count", "total_amount"])])
def test_rule_boundaries(spark, count, total, conditions):
    pane = spark.createDataFrame([("c", count, total, 0, 60_000)], "customer_id string, transaction_count bigint, total_amount bigint, window_start_ms bigint, window_end_ms bigint")
    found = velocity.create_velocity_alerts(pane).collect()
    assert [list(r.triggered_conditions) for r in found] == ([conditions] if conditions else [])
    if conditions:
        assert found[0].window_end == "1970-01-01T00:01:00.000Z" and found[0].alert_id == "velocity|c|0|60000" and tuple(found[0].asDict()) == velocity.ALERT_FIELDS


@pytest.mark.parametrize("count, total", [(0, 1), (1, 0)])
def test_inconsistent_aggregate(spark, count, total):
    pane = spark.createDataFrame([("c", count, total, 0, 60_000)], "customer_id string, transaction_count bigint, total_amount bigint, window_start_ms bigint, window_end_ms bigint")
    with pytest.raises(Exception, match="positive count and amount"):
        velocity.create_velocity_alerts(pane).collect()


@pytest.mark.parametrize("customer, count, total, end, text", [("c", -1, 5, 9, "non-negative"), ("c", 5, -1, 9, "non-negative"), (" ", 5, 5, 9, "non-empty"), ("c", 5, 5, 0, "greater than window start")])
def test_impossible_aggregates(spark, customer, count, total, end, text):
    pane = spark.createDataFrame([(customer, count, total, 0, end)], "customer_id string, transaction_count bigint, total_amount bigint, window_start_ms bigint, window_end_ms bigint")
    with pytest.raises(Exception, match=text):
        velocity.create_velocity_alerts(pane).collect()


@pytest.mark.parametrize("bad", [0, -1, True, 1.5])
def test_thresholds_are_checked(spark, bad):
    with pytest.raises(ValueError):
        velocity.create_velocity_alerts(spark.range(0), bad)


def test_demo_scenario(spark, tmp_path):
    rows = scenario.demo_events(spark).withColumn("value", scenario.event_json(scenario.demo_events(spark))).withColumnRenamed("offset", "sequence")
    publish_in_order(rows.select("sequence", "customer_id", "event_ts", "value"), str(tmp_path / "raw"))
    envelope = read_envelope(spark, "parquet", str(tmp_path / "raw"))
    assert envelope.count() == 8 and first_records(envelope, 3).count() == 3
    alerts = velocity.create_velocity_alerts(velocity.velocity(valid_events(validated(envelope))))
    found = {bytes(r.key).decode(): json.loads(bytes(r.value)) for r in alert_records(alerts).collect()}
    key = "velocity|cust-velocity-001|17863055{}|17863056{}"
    assert {k: (a["transaction_count"], a["total_amount"]) for k, a in found.items()} == {key.format("80000", "40000"): (4, 8_000_000), key.format("90000", "50000"): (5, 10_500_000), "velocity|cust-velocity-001|1786305600000|1786305660000": (4, 8_000_000)}


def test_cycles(spark):
    rows = scenario.demo_events(spark, cycles=2).orderBy("offset").collect()
    assert len(rows) == 16 and (rows[8].event_ts - rows[0].event_ts).total_seconds() == 180 and rows[8].event_id == "evt-normal-001-20260809T200250Z"


def test_build_event():
    event = scenario.build_event("e", "c", datetime(2026, 1, 1, tzinfo=UTC), 5, "transfer", "api")
    assert event["event_time"] == "2026-01-01T00:00:00.000Z" and scenario.kafka_key(event) == b"c"
    with pytest.raises(ValueError, match="event_id must.*; payload.amount must"):
        scenario.build_event(" ", "c", datetime(2026, 1, 1, tzinfo=UTC), 0, "transfer", "api")
    with pytest.raises(ValueError, match="timezone"):
        scenario.build_event("e", "c", datetime(2026, 1, 1), 5, "transfer", "api")


def test_skew(spark):
    rows = {(r.scenario, r.partition): (r.event_count, r.unique_key_count) for r in skew.partition_summary(skew.reference_scenarios(spark)).collect()}
    assert [rows["balanced", p][0] for p in range(3)] == [92, 116, 92] and [rows["hot_key", p] for p in range(3)] == [(258, 19), (20, 20), (22, 22)]
    empty = skew.partition_summary(spark.createDataFrame([("s", "k")], "scenario string, customer_id string"), 5).collect()
    assert sorted(r.event_count for r in empty) == [0, 0, 0, 0, 1]
    seen = spark.createDataFrame([("s", "k", 2), ("s", "l", 2)], "scenario string, customer_id string, at int")
    assert skew.scenario_summary(skew.partition_summary(seen, 3, "at")).first().max_partition == 2
    with pytest.raises(Exception, match="out of range"):
        skew.partition_summary(seen, 2, "at").collect()
    with pytest.raises(ValueError, match="at least one record"):
        skew.partition_summary(spark.createDataFrame([], "scenario string, customer_id string"))
    assert skew_report(spark, "").count() == 15


@pytest.mark.parametrize("args", [{"events": 0}, {"hot_share": 0.0}, {"hot_share": 1.0}, {"events": 1, "hot_share": 0.9}])
def test_skew_arguments(spark, args):
    with pytest.raises(ValueError):
        skew.reference_scenarios(spark, **args)


def messages(spark, *rows):
    data = [(b"k", json.dumps({"idempotency_key": "k", "revision": r, "transaction_count": n}).encode(), "alerts", 0, i, None) for i, (r, n) in enumerate(rows)]
    return spark.createDataFrame(data, "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp")


def test_revisions(spark, tmp_path):
    view = materialize.AlertView(spark, f"file://{tmp_path}/view")
    assert view.upsert(materialize.decode_alerts(messages(spark, (0, 4), (1, 5)))) == 2
    assert view.upsert(materialize.decode_alerts(messages(spark, (0, 4), (1, 5)))) == 0
    again = materialize.AlertView(spark, f"file://{tmp_path}/view")
    assert [(r.revision, json.loads(r.alert_json)["transaction_count"]) for r in again.ordered().collect()] == [(1, 5)]
    assert again.upsert(materialize.decode_alerts(messages(spark, (2, 6), (1, 5), (2, 999)))) == 1
    assert json.loads(again.ordered().first().alert_json)["transaction_count"] == 6
    applied = materialize.applied(materialize.decode_alerts(messages(spark, (2, 6), (1, 5), (2, 999)))).orderBy("arrival").collect()
    assert [r.applied for r in applied] == [True, False, False]


def test_a_crash_leaves_the_view_before_or_after(spark, tmp_path, monkeypatch):
    view = materialize.AlertView(spark, f"file://{tmp_path}/view", buckets=3)
    view.upsert(materialize.decode_alerts(messages(spark, (0, 4))))

    def state():
        return [(r.revision, json.loads(r.alert_json)["transaction_count"]) for r in materialize.AlertView(spark, f"file://{tmp_path}/view", buckets=3).ordered().collect()]

    class Crash:
        def __init__(self, fs, at):
            self.fs, self.at = fs, at

        def __getattr__(self, name):
            if name == self.at:
                raise KeyboardInterrupt
            return getattr(self.fs, name)

    for step, want in (("create", (0, 4)), ("rename", (0, 4)), ("delete", (2, 8))):
        broken = materialize.AlertView(spark, f"file://{tmp_path}/view", buckets=3)
        broken._fs = Crash(broken._fs, step)
        with pytest.raises(KeyboardInterrupt):
            broken.upsert(materialize.decode_alerts(messages(spark, (2, 8))))
            broken.upsert(materialize.decode_alerts(messages(spark, (3, 9))))
        assert state()[0][0] >= want[0] if step == "delete" else state() == [want]
    assert view.upsert(materialize.decode_alerts(messages(spark, (9, 1)))) == 1 and state() == [(9, 1)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    view = materialize.AlertView(spark, f"file://{tmp_path}/view", buckets=8)

    def alerts(*rows):
        return spark.createDataFrame([(k, r, "{}", (0, i)) for i, (k, r) in enumerate(rows)], "idempotency_key string, revision bigint, alert_json string, arrival struct<partition:int,offset:bigint>")

    assert view.upsert(alerts(*[(f"k{i}", 0) for i in range(50)])) == 50
    assert view.upsert(alerts(("k7", 2**40), ("k7", 1), ("k8", 0))) == 1 and view.version() == 2
    assert {r.idempotency_key: r.revision for r in view.ordered().collect()} == {f"k{i}": 0 for i in range(50)} | {"k7": 2**40}
    assert list(view._manifest(2).values()).count(2) == 1 and view.upsert(alerts(("k7", 3))) == 0 and view.version() == 2


@pytest.mark.parametrize("value", [b'{"idempotency_key":"k","revision":1} x', b'{"idempotency_key":"k","revision":1}{}', b"\xff", b'{"idempotency_key":"k","revision":1.0}', b"1,2"])
def test_alerts_are_decoded_strictly(spark, value):
    rows = spark.createDataFrame([(b"k", value, 0, 0)], "key binary, value binary, partition int, offset bigint")
    with pytest.raises(Exception, match="alert"):
        materialize.decode_alerts(rows).collect()


def test_large_revisions(spark):
    rows = spark.createDataFrame([(b"k", b'{"idempotency_key":"k","revision":9223372036854775807}', 0, 0)], "key binary, value binary, partition int, offset bigint")
    assert materialize.decode_alerts(rows).first().revision == 2**63 - 1


def test_consumer(spark, tmp_path, capsys):
    from tidegauge.streaming import tools

    def run(*more):
        tools.main(["materialize", "--source", "parquet", "--path", f"{tmp_path}/alerts", "--view", f"file://{tmp_path}/view", "--timeout-seconds", "1", *more])
        return capsys.readouterr().out.strip().split("\n")

    messages(spark, (0, 4), (2, 6), (1, 5)).write.parquet(f"{tmp_path}/alerts")
    out = run()
    assert [x.split(" value=")[0] for x in out if x.startswith("ALERT")] == [f"ALERT partition=0 offset={i} key=k materialized={m}" for i, m in enumerate(("updated", "updated", "unchanged"))]
    assert out[-1].startswith("MATERIALIZED_KEYS=1 MESSAGES_READ=3 MATERIALIZED_UPDATES=2 ")
    assert run()[-1].startswith("MATERIALIZED_KEYS=1 MESSAGES_READ=0 MATERIALIZED_UPDATES=0 ")  # the checkpoint knows what was read
    assert run("--max-messages", "2")[-1].startswith("MATERIALIZED_KEYS=1 MESSAGES_READ=2 MATERIALIZED_UPDATES=0 ")


def test_session_must_be_in_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Asuncion")
    try:
        with pytest.raises(ValueError, match="UTC"):
            validated(scenario.envelope_of(scenario.demo_events(spark)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("key, alert", [(b"other", {"idempotency_key": "k", "revision": 1}), (b"k", {"idempotency_key": "k", "revision": -1}), (b"k", {"idempotency_key": "k", "revision": True}), (b"k", {"idempotency_key": "k", "revision": "1"}), (b"k", [1]), (None, {})])
def test_bad_alerts_fail(spark, key, alert):
    rows = spark.createDataFrame([(key, json.dumps(alert).encode(), "alerts", 0, 0, None)], "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp")
    with pytest.raises(Exception, match="alert"):
        materialize.latest_alerts(materialize.decode_alerts(rows)).collect()


@pytest.mark.parametrize("args, kind", [({"size_seconds": 0}, ValueError), ({"period_seconds": 0}, ValueError), ({"period_seconds": 61}, ValueError), ({"allowed_lateness_seconds": -1}, ValueError), ({"early_firing_delay_seconds": 0}, ValueError), ({"enable_early": 1}, TypeError)])
def test_window_policy(args, kind):
    with pytest.raises(kind):
        WindowPolicy(**args)


@pytest.mark.parametrize("args, kind", [({"input_topic": " "}, ValueError), ({"max_num_records": 0}, ValueError), ({"max_num_records": True}, ValueError), ({"smoke_mode": 1}, TypeError), ({"mode": "x"}, ValueError)])
def test_pipeline_config(args, kind):
    with pytest.raises(kind):
        PipelineConfig(**args)


def test_arguments():
    args, rest = parse_args(["--max-num-records", "8", "--smoke-mode", "--spark.executor.cores=2", "--spark.x", "y"])
    assert config_of(args).max_num_records == 8 and config_of(args).smoke_mode and rest == {"spark.executor.cores": "2", "spark.x": "y"}


def test_kafka_options():
    assert kafka_read_options("b", "t", "g", committed_only=True)["kafka.isolation.level"] == "read_committed"
    assert kafka_write_options("b", "t")["kafka.acks"] == "all"


def test_bounded_run(spark):
    from tidegauge.streaming.runner import run_bounded

    envelope = scenario.envelope_of(scenario.demo_events(spark))
    alerts, invalid = run_bounded(envelope)
    assert alerts.count() == 3 and invalid.count() == 0


def test_tools(spark, tmp_path, capsys):
    from tidegauge.streaming import tools

    assert tools.main(["produce", "--dry-run", "--cycles", "2", "--base-time", "2026-08-09T19:59:50+00:00"]) == 0
    assert capsys.readouterr().out.count("key=cust-velocity-001") == 14
    messages(spark, (0, 4), (1, 5)).write.parquet(f"{tmp_path}/alerts")
    args = ["materialize", "--source", "parquet", "--path", f"{tmp_path}/alerts", "--view", f"file://{tmp_path}/view", "--max-messages", "2"]
    for updates in (2, 0):
        assert tools.main(args) == 0
        assert f"MATERIALIZED_KEYS=1 MESSAGES_READ=2 MATERIALIZED_UPDATES={updates}" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        tools.main(["materialize", "--max-messages", "0"])
