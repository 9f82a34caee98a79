"""The query catalogue over the driver's tables, and the same queries in SQL."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contract as c
from ..functions.serde import alert_records, invalid_records
from ..operators import skew, velocity
from ..operators.ingest import invalid_events, valid_events, validated
from ..operators.materialize import AlertView, applied, decode_alerts, latest_alerts
from ..operators.scenario import DEMO_BASE, demo_events, envelope_of
from ..sources.envelope import ENVELOPE, first_records
from ..streaming import native
from ..streaming import panes as exact
from .config import WindowPolicy

#: Users act some times a day in the events table: windows of a day, every four hours.
DAILY = WindowPolicy(size_seconds=86_400, period_seconds=14_400)
COUNT, AMOUNT = 4, 50_000
TYPES = {"purchase": "card_purchase", "signup": "cash_deposit", "click": "transfer", "view": "cash_withdrawal", "error": "error"}
BOUNDED_READ = 100


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as transactions, in order of arrival. Type "error" and amounts of 0 break the contract."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), F.col("event_type"))
    channel = F.element_at(F.array(*[F.lit(x) for x in c.CHANNELS]), (F.col("event_id") % 5 + 1).cast("int"))
    return events.select(
        F.concat(F.lit("evt-"), F.col("event_id")).alias("event_id"),
        F.concat(F.lit("cust-"), F.col("user_id")).alias("customer_id"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        F.floor(F.col("value") * 100).cast("bigint").alias("amount"),
        F.lit(c.CURRENCY).alias("currency"),
        kind.alias("transaction_type"),
        channel.alias("channel"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
    )


def with_duplicates(events: DataFrame, more: int = 0) -> DataFrame:
    """Each seventeenth event arrives again later, with a different amount if more is given."""
    again = events.where(F.col("offset") % 17 == 0)
    return events.unionByName(again.withColumns({"offset": F.col("offset") + 1_000_000_000, "amount": F.col("amount") + more}))


def well_formed(events: DataFrame) -> DataFrame:
    """Transactions that keep the contract, by the typed columns."""
    return events.where((F.col("amount") > 0) & F.col("transaction_type").isin(*c.TRANSACTION_TYPES))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope_of(transactions(spark, sf_dir))


def tx_validate_valid(spark, d):
    rows = valid_events(validated(raw(spark, d)))
    return rows.select("event_id", "customer_id", F.unix_millis("event_ts").alias("event_ms"), "amount", "currency", "transaction_type", "channel")


def tx_validate_invalid(spark, d):
    return invalid_events(validated(raw(spark, d))).select("error_stage", F.array_join("errors", "; ").alias("errors"), "event_id", "kafka_key", "raw_value")


def tx_error_counts(spark, d):
    return invalid_events(validated(raw(spark, d))).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def tx_invalid_records(spark, d):
    rows = invalid_records(invalid_events(validated(raw(spark, d))))
    return rows.select(F.decode("key", "UTF-8").alias("key"), F.sha2("value", 256).alias("value_sha256"))


def tx_record_counters(spark, d):
    rows = validated(raw(spark, d))
    return rows.agg(F.count_if(F.size("errors") == 0).alias("valid_records"), F.count_if(F.size("errors") > 0).alias("invalid_records"))


#: Ways in which broken() breaks a record, by the event's number modulo their count; 0 leaves it whole.
WAYS = 28


def broken(spark: SparkSession, d: str) -> DataFrame:
    """The events table as raw records that break the contract in one way each, the last way in all."""
    way = F.col("event_id") % WAYS
    customer = F.concat(F.lit("cust-"), F.col("user_id"))

    def chosen(usual, ways: dict):
        """usual, but for records of the ways given (texts of JSON, or columns)."""
        out = None
        for k, x in ways.items():
            x = F.lit(x) if isinstance(x, str) else x
            out = F.when(way == k, x) if out is None else out.when(way == k, x)
        return out.otherwise(usual)

    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    payload = F.concat(
        F.lit('{"amount":'), chosen(F.lit("5"), {18: "0", 19: '"5"', 20: "5.0", 21: "true", 22: "92233720368547758080", 27: "-1"}),
        F.lit(',"currency":'), chosen(F.lit('"PYG"'), {23: '"USD"', 27: "1"}),
        F.lit(',"transaction_type":'), chosen(F.lit('"transfer"'), {24: "[]", 27: '"gift"'}),
        F.lit(',"channel":'), chosen(F.lit('"web"'), {25: '"tv"', 27: "null"}), F.lit("}"),
    )
    value = F.concat(
        F.lit('{"schema_version":'), chosen(F.lit('"1.0"'), {9: '"2.0"', 10: "1.0", 27: "null"}),
        F.lit(',"event_id":'), chosen(quoted(F.concat(F.lit("evt-"), F.col("event_id"))), {11: '" \\u00a0"', 12: "7", 27: '""'}),
        F.lit(',"customer_id":'), chosen(quoted(customer), {13: '"  "', 27: "[]"}),
        F.lit(',"event_time":'), chosen(F.lit('"2026-08-08T19:14:11.000Z"'), {14: '" "', 15: '"yesterday"', 16: '"2026-08-08T19:14:11"', 27: "0"}),
        F.lit(',"payload":'), chosen(payload, {17: "null"}), F.lit("}"),
    )
    value = chosen(F.encode(value, "UTF-8"), {4: F.lit(None).cast("binary"), 5: F.unhex(F.lit("FF")), 6: F.encode(F.lit('{"schema_version":'), "UTF-8"), 7: F.encode(F.concat(value, F.lit(" x")), "UTF-8"), 8: F.encode(F.lit("[1]"), "UTF-8")})
    key = chosen(F.encode(customer, "UTF-8"), {1: F.lit(None).cast("binary"), 2: F.unhex(F.lit("FF")), 3: F.encode(F.lit(" "), "UTF-8"), 26: F.encode(F.lit("another-customer"), "UTF-8")})
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select(key.alias("key"), value.alias("value"), F.lit("raw").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"))


def tx_contract_errors(spark, d):
    """The errors of every record of broken(), in order."""
    return validated(broken(spark, d)).select("offset", F.array_join("errors", "; ").alias("errors"), F.col("f_event_id").alias("event_id"))


def tx_invalid_hash_keys(spark, d):
    """Keys of invalid records without an event id: those whose value is missing or no object."""
    rows = broken(spark, d)
    rows = rows.where((F.col("offset") % WAYS).isin(4, 8))
    return invalid_records(invalid_events(validated(rows))).select(F.decode("key", "UTF-8").alias("key"))


def tx_event_times(spark, d):
    """Event times in the forms of ISO 8601 that hold, each as the instant that it names."""
    at = F.col("ts").cast("timestamp")
    forms = ("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd HH:mm:ss,SSS'+00'", "yyyy-MM-dd'T'HH:mm'+0000'", "yyyyMMdd'T'HHmmss'Z'", "yyyyMMdd'T'HHmm'+00:00'", "yyyy-MM-dd'T'HH'Z'", "yyyy-MM-dd'T'HH:mm:ss'+03:00'")
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.explode(F.array(*[F.struct(F.lit(i).alias("form"), F.date_format(at, x).alias("text")) for i, x in enumerate(forms)])).alias("x"))
    return events.select("event_id", "x.form", F.unix_millis(c.in_range(c.instant(F.col("x.text")))).alias("ms"))


def tx_bounded_read(spark, d):
    rows = valid_events(validated(first_records(raw(spark, d), BOUNDED_READ)))
    return rows.select("event_id", "customer_id", "amount")


def tx_window_assign(spark, d):
    return velocity.with_bounds(velocity.assign_windows(transactions(spark, d), DAILY)).select("event_id", "window_start_ms", "window_end_ms")


def tx_window_tumbling(spark, d):
    rows = velocity.velocity(well_formed(transactions(spark, d)), WindowPolicy(size_seconds=86_400, period_seconds=86_400))
    return rows.select("customer_id", "window_start_ms", "window_end_ms", "transaction_count", "total_amount")


def tx_dedup_window(spark, d):
    rows = velocity.with_bounds(velocity.deduplicate(velocity.assign_windows(with_duplicates(transactions(spark, d)), DAILY)))
    return rows.select("customer_id", "event_id", "window_start_ms", "offset")


def tx_dedup_conflict(spark, d):
    rows = velocity.velocity(well_formed(with_duplicates(transactions(spark, d), more=7)), DAILY)
    return rows.groupBy("customer_id").agg(F.sum("transaction_count").alias("assignments"), F.sum("total_amount").alias("amount"))


def tx_assignment_counters(spark, d):
    return velocity.assignment_counts(velocity.assign_windows(with_duplicates(transactions(spark, d)), DAILY))


def tx_velocity_agg(spark, d):
    return velocity.velocity(well_formed(with_duplicates(transactions(spark, d))), DAILY).select("customer_id", "window_start_ms", "window_end_ms", "transaction_count", "total_amount")


def _alerts(spark, d, count=COUNT, amount=AMOUNT):
    return velocity.create_velocity_alerts(velocity.velocity(well_formed(with_duplicates(transactions(spark, d))), DAILY), count, amount)


def _flat(alerts: DataFrame) -> DataFrame:
    """Alerts with nested fields as plain ones."""
    names = [x for x in velocity.ALERT_FIELDS if x not in ("thresholds", "triggered_conditions")]
    return alerts.select(*names, F.col("thresholds.transaction_count").alias("threshold_count"), F.col("thresholds.total_amount").alias("threshold_amount"), F.array_join("triggered_conditions", ",").alias("triggered"))


def tx_velocity_alerts(spark, d):
    return _flat(_alerts(spark, d))


def tx_velocity_alerts_count_only(spark, d):
    return _flat(_alerts(spark, d, amount=10**15))


def tx_velocity_alerts_amount_only(spark, d):
    return _flat(_alerts(spark, d, count=10**9))


def tx_alert_counters(spark, d):
    rows = velocity.velocity(well_formed(with_duplicates(transactions(spark, d))), DAILY)
    hit = (F.col("transaction_count") >= COUNT) | (F.col("total_amount") >= AMOUNT)
    return rows.agg(F.count_if(hit).alias("alerts_emitted"), F.count_if(~hit).alias("below_threshold_evaluations"))


def tx_alert_json_key(spark, d):
    rows = alert_records(_alerts(spark, d))
    return rows.select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"), F.sha2("value", 256).alias("value_sha256"))


def revisions(spark, d) -> DataFrame:
    """Alerts as they would arrive: a key for each user, revisions out of order and repeated."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.concat(F.lit("velocity|cust-"), F.col("user_id")).alias("idempotency_key"), (F.col("event_id") % 7).cast("bigint").alias("revision"), F.concat(F.lit('{"n":'), F.col("event_id"), F.lit("}")).alias("alert_json"), F.struct(F.lit(0).alias("partition"), F.col("event_id").alias("offset")).alias("arrival"))


def tx_materialize_latest(spark, d):
    return latest_alerts(revisions(spark, d))


def tx_materialize_applied(spark, d):
    return applied(revisions(spark, d)).groupBy("idempotency_key").agg(F.count_if("applied").alias("applied"), F.count(F.lit(1)).alias("messages"))


def _folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one; without one set, a local one serves a session of one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/tidegauge-{uuid.uuid4().hex}"


def tx_materialize_view(spark, d):
    """The durable view after the revisions came in two halves, the second one twice."""
    view, rows = AlertView(spark, f"{_folder(spark)}/view"), revisions(spark, d)
    for half in (0, 1, 1):
        view.upsert(rows.where(F.col("arrival.offset") % 2 == half))
    return view.ordered()


def skew_partition_summary(spark, d):
    return skew.partition_summary(skew.reference_scenarios(spark))


def skew_scenario_summary(spark, d):
    rows = skew.scenario_summary(skew.partition_summary(skew.reference_scenarios(spark)))
    return rows.select("scenario", "total_events", "unique_keys", "max_partition", F.round("max_partition_share", 4).alias("max_share"), F.round("max_to_mean_ratio", 2).alias("max_to_mean"))


def skew_report(spark, d):
    return spark.createDataFrame([(i, x) for i, x in enumerate(skew.render_report(spark).split("\n"))], "line int, text string")


def skew_events_summary(spark, d):
    """How the events table's customers would spread over twelve partitions."""
    rows = transactions(spark, d).select(F.lit("events").alias("scenario"), "customer_id")
    return skew.partition_summary(rows, 12)


def skew_scenario_events(spark, d):
    """The events that would be published for both scenarios."""
    rows = skew.scenario_events(skew.reference_scenarios(spark), int(DEMO_BASE.timestamp()) * 1_000_000)
    return rows.select("event_id", "customer_id", c.format_event_time(F.col("event_ts")).alias("event_time"), "amount", "currency", "transaction_type", "channel")


def demo_scenario_alerts(spark, d):
    rows = valid_events(validated(envelope_of(demo_events(spark))))
    alerts = alert_records(velocity.create_velocity_alerts(velocity.velocity(rows)))
    return alerts.select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


def _stream(spark: SparkSession, rows: DataFrame, schema: str) -> DataFrame:
    """A bounded frame read again as a stream of files."""
    path = f"{_folder(spark)}/input"
    rows.write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


TRANSACTION = "event_id string, customer_id string, event_ts timestamp, amount bigint, currency string, transaction_type string, channel string, partition int, offset bigint"


def stream_velocity_agg(spark, d):
    """The last state of each window from Spark's streaming aggregation."""
    at = _folder(spark)
    events = _stream(spark, well_formed(with_duplicates(transactions(spark, d))).select("event_id", "customer_id", "event_ts", "amount", "currency", "transaction_type", "channel", "partition", "offset"), TRANSACTION)
    out = native.streaming_velocity(events, WindowPolicy(size_seconds=86_400, period_seconds=14_400, allowed_lateness_seconds=400 * 86_400))
    query = out.writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{at}/out")).start()
    query.awaitTermination()
    last = F.max_by(F.struct("transaction_count", "total_amount"), "batch").alias("last")
    return spark.read.parquet(f"{at}/out").groupBy("customer_id", "window_start_ms", "window_end_ms").agg(last).select("customer_id", "window_start_ms", "window_end_ms", "last.*")


def stream_validate(spark, d):
    """Invalid records of a stream of raw records."""
    at = _folder(spark)
    envelope = _stream(spark, raw(spark, d), ENVELOPE)
    native.start_invalid(envelope, lambda b, n: b.write.mode("append").parquet(f"{at}/out"), f"{at}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.decode("key", "UTF-8").alias("key"), F.sha2("value", 256).alias("value_sha256"))


def stream_pane_contract(spark, d):
    """Panes of the temporal fixture, one file a batch: on time (3), late (4), too late dropped."""
    from .fixtures import run_panes

    rows = run_panes(spark, f"{_folder(spark)}/panes")
    return rows.where(F.col("window_start_ms") == 1783850400000).select("customer_id", "transaction_count", "total_amount", "revision", "pane_timing", "pane_nonspeculative_index")


def stream_panes(spark, d):
    """On-time panes of the events table: all rows in one batch, closed by a later row of another customer."""
    at = _folder(spark)
    rows = well_formed(with_duplicates(transactions(spark, d))).select("event_id", "customer_id", "event_ts", "amount", "partition", "offset")
    rows.write.parquet(f"{at}/input")
    last = rows.agg(F.max("event_ts")).first()[0]
    tick = rows.limit(1).select(F.lit("tick").alias("event_id"), F.lit("tick").alias("customer_id"), (F.lit(last) + F.expr("interval 4 days")).alias("event_ts"), F.lit(1).cast("bigint").alias("amount"), F.lit(0).alias("partition"), F.lit(2_000_000_000).cast("bigint").alias("offset"))
    schema = "event_id string, customer_id string, event_ts timestamp, amount bigint, partition int, offset bigint"
    policy = WindowPolicy(size_seconds=86_400, period_seconds=86_400, enable_early=False)
    out = exact.panes(spark.readStream.schema(schema).parquet(f"{at}/input"), policy)
    for _ in range(2):  # the second run closes the windows
        out.writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{at}/out")).start().awaitTermination()
        tick.write.mode("append").parquet(f"{at}/input")
    return spark.read.parquet(f"{at}/out").where("customer_id <> 'tick'").select("customer_id", "window_start_ms", "window_end_ms", "transaction_count", "total_amount", "revision", "pane_timing")


def stream_alert_revisions(spark, d):
    """What the view holds after a stream of alerts: first arrivals in three batches, of which the first one closes all windows.

    So a window fires on time if it has events in the first batch, and late for each event that follows; the last pane's
    revision is what the view keeps. The query begins anew from its checkpoint for each batch.
    """
    at = _folder(spark)
    view = AlertView(spark, f"{at}/view")
    rows = well_formed(with_duplicates(transactions(spark, d))).select("event_id", "customer_id", "event_ts", "amount", "partition", "offset")
    last = rows.agg(F.max("event_ts")).first()[0] or datetime(1970, 1, 1)
    tick = spark.createDataFrame([("tick", "tick", 1, 0, 2_000_000_000)], "event_id string, customer_id string, amount bigint, partition int, offset bigint").withColumn("event_ts", F.lit(last) + F.expr("interval 4 days"))
    schema = "event_id string, customer_id string, event_ts timestamp, amount bigint, partition int, offset bigint"
    policy = WindowPolicy(size_seconds=86_400, period_seconds=86_400, allowed_lateness_seconds=4000 * 86_400, enable_early=False)

    def take(batch: DataFrame, n: int) -> None:
        view.upsert(decode_alerts(batch.select("key", "value", F.lit(0).alias("partition"), F.lit(n).cast("bigint").alias("offset"))))

    part = F.when(F.col("offset") >= 1_000_000_000, 2).otherwise(F.col("offset") % 3)
    for n in range(3):
        own = rows.where(part == n)
        (own.unionByName(tick.select(*own.columns)) if n == 0 else own).write.mode("append").parquet(f"{at}/input")
        events = spark.readStream.schema(schema).parquet(f"{at}/input")
        native.start_alerts(events, take, f"{at}/checkpoint", policy, once=True, count_threshold=2, amount_threshold=AMOUNT).awaitTermination()
    alert = F.from_json("alert_json", "transaction_count bigint, total_amount bigint")
    return view.snapshot().select("idempotency_key", "revision", alert.alias("a")).select("idempotency_key", "revision", "a.transaction_count", "a.total_amount")


QUERIES = {
    f.__name__: f
    for f in (
        tx_validate_valid, tx_validate_invalid, tx_error_counts, tx_invalid_records, tx_contract_errors, tx_invalid_hash_keys, tx_event_times, tx_record_counters, tx_bounded_read, tx_window_assign, tx_window_tumbling,
        tx_dedup_window, tx_dedup_conflict, tx_assignment_counters, tx_velocity_agg, tx_velocity_alerts, tx_velocity_alerts_count_only,
        tx_velocity_alerts_amount_only, tx_alert_counters, tx_alert_json_key, tx_materialize_latest, tx_materialize_applied, tx_materialize_view,
        skew_partition_summary, skew_scenario_summary, skew_report, skew_events_summary, skew_scenario_events, demo_scenario_alerts, stream_velocity_agg, stream_validate,
        stream_pane_contract, stream_panes, stream_alert_revisions,
    )
}

_TX = """
tx AS (
  SELECT 'evt-' || event_id AS event_id, 'cust-' || user_id AS customer_id, epoch_us(ts) // 1000 AS ms, CAST(floor(value * 100) AS BIGINT) AS amount,
    CASE event_type WHEN 'purchase' THEN 'card_purchase' WHEN 'signup' THEN 'cash_deposit' WHEN 'click' THEN 'transfer' WHEN 'view' THEN 'cash_withdrawal' ELSE 'error' END AS transaction_type,
    (['api', 'atm', 'branch', 'mobile', 'web'])[event_id % 5 + 1] AS channel, event_id AS arrival, ts
  FROM events
),
dup AS (SELECT * FROM tx UNION ALL SELECT event_id, customer_id, ms, amount, transaction_type, channel, arrival + 1000000000, ts FROM tx WHERE arrival % 17 = 0),
good AS (SELECT * FROM dup WHERE amount > 0 AND transaction_type <> 'error'),
json AS (
  SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS event_time,
    concat_ws('; ', CASE WHEN amount <= 0 THEN 'payload.amount must be a positive integer' END,
      CASE WHEN transaction_type = 'error' THEN 'payload.transaction_type must be one of [''card_purchase'', ''cash_deposit'', ''cash_withdrawal'', ''transfer'']' END) AS errors
  FROM tx
),
body AS (
  SELECT *, '{"customer_id":"' || customer_id || '","event_id":"' || event_id || '","event_time":"' || event_time || '","payload":{"amount":' || amount || ',"channel":"' || channel || '","currency":"PYG","transaction_type":"' || transaction_type || '"},"schema_version":"1.0"}' AS raw_value
  FROM json
),
steps AS (SELECT unnest(range(0, 6)) AS k)
"""
_WINDOWS = "SELECT t.*, (t.ms // 14400000 - k) * 14400000 AS window_start_ms, (t.ms // 14400000 - k) * 14400000 + 86400000 AS window_end_ms FROM {of} t, steps"
_UNIQUE = f"w AS ({_WINDOWS.format(of='{of}')}), u AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY customer_id, window_start_ms, event_id ORDER BY arrival) = 1)"
_AGG = _UNIQUE.format(of="good") + ", agg AS (SELECT customer_id, window_start_ms, window_end_ms, count(*) AS transaction_count, CAST(sum(amount) AS BIGINT) AS total_amount FROM u GROUP BY ALL)"


def _alert_sql(count: int, amount: int) -> str:
    return f"""WITH {_TX}, {_AGG}
SELECT '1.0' AS schema_version, key AS alert_id, key AS idempotency_key, 'velocity' AS alert_type, 'velocity-v1' AS rule_version, customer_id,
  strftime(make_timestamp(window_start_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS window_start, strftime(make_timestamp(window_end_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS window_end,
  transaction_count, total_amount, 'PYG' AS currency, CAST(0 AS INTEGER) AS revision, 'ON_TIME' AS pane_timing, CAST(0 AS INTEGER) AS pane_nonspeculative_index, true AS pane_is_first, false AS pane_is_last,
  'ACCUMULATING' AS accumulation_mode, CAST({count} AS BIGINT) AS threshold_count, CAST({amount} AS BIGINT) AS threshold_amount,
  concat_ws(',', CASE WHEN transaction_count >= {count} THEN 'transaction_count' END, CASE WHEN total_amount >= {amount} THEN 'total_amount' END) AS triggered
FROM (SELECT *, 'velocity|' || customer_id || '|' || window_start_ms || '|' || window_end_ms AS key FROM agg)
WHERE transaction_count >= {count} OR total_amount >= {amount}"""


_INVALID_JSON = """'{"error_stage":"ingestion_validation","errors":["' || replace(errors, '; ', '","') || '"],"event_id":"' || event_id || '","kafka_key":"' || customer_id || '","raw_value":"' || replace(raw_value, '"', chr(92) || '"') || '"}'"""
_INVALID = f"WITH {_TX} SELECT 'invalid|' || event_id AS key, sha256({_INVALID_JSON}) AS value_sha256 FROM body WHERE errors <> ''"
_VELOCITY = f"WITH {_TX}, {_AGG} SELECT * FROM agg"
_ALERT_JSON = """'{"accumulation_mode":"ACCUMULATING","alert_id":"' || alert_id || '","alert_type":"velocity","currency":"PYG","customer_id":"' || customer_id || '","idempotency_key":"' || alert_id || '","pane_is_first":true,"pane_is_last":false,"pane_nonspeculative_index":0,"pane_timing":"ON_TIME","revision":0,"rule_version":"velocity-v1","schema_version":"1.0","thresholds":{"total_amount":' || threshold_amount || ',"transaction_count":' || threshold_count || '},"total_amount":' || total_amount || ',"transaction_count":' || transaction_count || ',"triggered_conditions":["' || replace(triggered, ',', '","') || '"],"window_end":"' || window_end || '","window_start":"' || window_start || '"}'"""
_DEMO = """'{"accumulation_mode":"ACCUMULATING","alert_id":"' || key || '","alert_type":"velocity","currency":"PYG","customer_id":"cust-velocity-001","idempotency_key":"' || key || '","pane_is_first":true,"pane_is_last":false,"pane_nonspeculative_index":0,"pane_timing":"ON_TIME","revision":0,"rule_version":"velocity-v1","schema_version":"1.0","thresholds":{"total_amount":10000000,"transaction_count":4},"total_amount":' || total || ',"transaction_count":' || n || ',"triggered_conditions":' || conditions || ',"window_end":"' || ends || '","window_start":"' || starts || '"}'"""
_REVISIONS = "r AS (SELECT 'velocity|cust-' || user_id AS idempotency_key, CAST(event_id % 7 AS BIGINT) AS revision, '{\"n\":' || event_id || '}' AS alert_json, event_id AS arrival FROM events)"
# CRC-32 by a table of 256 entries, itself made bit by bit
_CRC = """WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_SCENARIOS = f"""{_CRC}, records AS (
  SELECT 'balanced' AS scenario, i, printf('cust-balanced-%03d', i) AS customer_id FROM range(300) r(i)
  UNION ALL SELECT 'hot_key', i, CASE WHEN i < 240 THEN 'cust-hot-001' ELSE printf('cust-cold-%03d', i - 240) END FROM range(300) r(i)
), placed AS (SELECT *, CAST({_crc('customer_id')} % 3 AS INTEGER) AS partition FROM records, crc_table),
counts AS (SELECT scenario, partition, count(*) AS event_count, count(DISTINCT customer_id) AS unique_key_count FROM placed GROUP BY ALL)"""
_SKEW_TOTALS = "totals AS (SELECT scenario, CAST(sum(event_count) AS BIGINT) AS total_events, CAST(sum(unique_key_count) AS BIGINT) AS unique_keys, arg_max(partition, event_count * 10 - partition) AS max_partition, max(event_count) AS most FROM counts GROUP BY scenario)"
_PERCENT = "printf('%.2f%%', CAST(100.0 * {} / {} AS DOUBLE))"
_REPORT = f"""{_SCENARIOS}, {_SKEW_TOTALS}, lines AS (
  SELECT 0 AS line, 'SKEW_ANALYSIS_START mode=simulate partitions=3 events_per_scenario=300 hot_key_share=0.80' AS text
  UNION ALL SELECT CASE scenario WHEN 'balanced' THEN 1 ELSE 6 END, printf('SCENARIO name=%s total_events=%d unique_keys=%d', scenario, total_events, unique_keys) FROM totals
  UNION ALL SELECT CASE c.scenario WHEN 'balanced' THEN 2 ELSE 7 END + partition, printf('PARTITION scenario=%s id=%d events=%d unique_keys=%d share=', c.scenario, partition, event_count, unique_key_count) || {_PERCENT.format('event_count', 'total_events')} FROM counts c JOIN totals USING (scenario)
  UNION ALL SELECT CASE scenario WHEN 'balanced' THEN 5 ELSE 10 END, printf('SUMMARY scenario=%s max_partition=%d max_share=', scenario, max_partition) || {_PERCENT.format('most', 'total_events')} || printf(' max_to_mean=%.2f', CAST(3.0 * most / total_events AS DOUBLE)) FROM totals
  UNION ALL SELECT 11, printf('HOT_KEY key=%s events=%d partition=%d share=', customer_id, count(*), partition) || {_PERCENT.format('count(*)', '300')} FROM placed WHERE customer_id = 'cust-hot-001' GROUP BY customer_id, partition
  UNION ALL SELECT 12, printf('COMPARISON max_share_delta_pp=%.2f', CAST(100.0 * (max(most) - min(most)) / 300 AS DOUBLE)) FROM totals
  UNION ALL SELECT 13, 'CONCLUSION more_partitions_distribute_distinct_keys_but_do_not_split_one_hot_key'
  UNION ALL SELECT 14, 'SKEW_ANALYSIS_EXIT_CODE=0'
) SELECT CAST(line AS INTEGER) AS line, text FROM lines"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: What each way of broken() should be told, by its number.
_TOLD = {
    1: c.KEY_NULL, 2: c.KEY_NOT_UTF8, 3: f"{c.KEY_BLANK}; {c.KEY_MISMATCH}", 4: c.VALUE_NOT_BYTES, 5: c.VALUE_NOT_UTF8, 6: c.VALUE_NOT_JSON, 7: c.VALUE_NOT_JSON, 8: c.NOT_AN_OBJECT,
    9: c.VERSION_WRONG, 10: c.VERSION_WRONG, 11: c.EVENT_ID_BLANK, 12: c.EVENT_ID_BLANK, 13: c.CUSTOMER_ID_BLANK, 14: c.TIME_BLANK, 15: "Invalid isoformat string: 'yesterday'", 16: c.TIME_NO_ZONE,
    17: c.PAYLOAD_NOT_OBJECT, 18: c.AMOUNT_WRONG, 19: c.AMOUNT_WRONG, 20: c.AMOUNT_WRONG, 21: c.AMOUNT_WRONG, 22: c.AMOUNT_LARGE, 23: c.CURRENCY_WRONG, 24: c.TYPE_WRONG, 25: c.CHANNEL_WRONG, 26: c.KEY_MISMATCH,
    27: "; ".join([c.VERSION_WRONG, c.EVENT_ID_BLANK, c.CUSTOMER_ID_BLANK, c.TIME_BLANK, c.AMOUNT_WRONG, c.CURRENCY_WRONG, c.TYPE_WRONG, c.CHANNEL_WRONG]),
}
_BREAKS = f"""SELECT event_id AS "offset", CASE event_id % {WAYS} {' '.join(f'WHEN {k} THEN {_quoted(x)}' for k, x in _TOLD.items())} ELSE '' END AS errors,
  CASE WHEN event_id % {WAYS} IN (4, 5, 6, 7, 8, 12) THEN NULL WHEN event_id % {WAYS} = 11 THEN ' ' || chr(160) WHEN event_id % {WAYS} = 27 THEN '' ELSE 'evt-' || event_id END AS event_id
FROM events"""
_HASH_KEYS = f"""SELECT 'invalid|sha256:' || sha256('{{"error_stage":"ingestion_validation","errors":["' || CASE event_id % {WAYS} WHEN 4 THEN {_quoted(c.VALUE_NOT_BYTES)} ELSE {_quoted(c.NOT_AN_OBJECT)} END || '"],"event_id":null,"kafka_key":"cust-' || user_id || '","raw_value":' || CASE event_id % {WAYS} WHEN 4 THEN 'null' ELSE '"[1]"' END || '}}') AS key
FROM events WHERE event_id % {WAYS} IN (4, 8)"""
_TIMES = """SELECT event_id, CAST(form AS INTEGER) AS form, epoch_ms(CASE form WHEN 0 THEN date_trunc('milliseconds', ts) WHEN 1 THEN date_trunc('milliseconds', ts) WHEN 2 THEN date_trunc('minute', ts) WHEN 3 THEN date_trunc('second', ts)
  WHEN 4 THEN date_trunc('minute', ts) WHEN 5 THEN date_trunc('hour', ts) ELSE date_trunc('second', ts) - INTERVAL 3 HOUR END) AS ms FROM events, range(7) f(form)"""
_LAST_REVISIONS = f"""WITH {_TX}, u AS (SELECT customer_id, event_id, ms // 86400000 * 86400000 AS w, min(arrival) AS arrival, arg_min(amount, arrival) AS amount FROM good GROUP BY ALL),
b AS (SELECT *, CASE WHEN arrival >= 1000000000 THEN 2 ELSE arrival % 3 END AS batch FROM u)
SELECT 'velocity|' || customer_id || '|' || w || '|' || (w + 86400000) AS idempotency_key, CAST(max(CASE WHEN batch = 0 THEN 1 ELSE 0 END) + count(*) FILTER (batch > 0) - 1 AS BIGINT) AS revision, count(*) AS transaction_count, CAST(sum(amount) AS BIGINT) AS total_amount
FROM b GROUP BY customer_id, w HAVING count(*) >= 2 OR sum(amount) >= {AMOUNT}"""

SQL = {
    "tx_validate_valid": f"WITH {_TX} SELECT event_id, customer_id, ms AS event_ms, amount, 'PYG' AS currency, transaction_type, channel FROM json WHERE errors = ''",
    "tx_validate_invalid": f"WITH {_TX} SELECT 'ingestion_validation' AS error_stage, errors, event_id, customer_id AS kafka_key, raw_value FROM body WHERE errors <> ''",
    "tx_error_counts": f"WITH {_TX} SELECT error, count(*) AS n FROM (SELECT unnest(string_split(errors, '; ')) AS error FROM json WHERE errors <> '') GROUP BY error",
    "tx_invalid_records": _INVALID,
    "tx_contract_errors": _BREAKS,
    "tx_invalid_hash_keys": _HASH_KEYS,
    "tx_event_times": _TIMES,
    "tx_record_counters": f"WITH {_TX} SELECT count(*) FILTER (errors = '') AS valid_records, count(*) FILTER (errors <> '') AS invalid_records FROM json",
    "tx_bounded_read": f"WITH {_TX} SELECT event_id, customer_id, amount FROM (SELECT * FROM json ORDER BY arrival LIMIT {BOUNDED_READ}) WHERE errors = ''",
    "tx_window_assign": f"WITH {_TX}, w AS ({_WINDOWS.format(of='tx')}) SELECT event_id, window_start_ms, window_end_ms FROM w",
    "tx_window_tumbling": f"WITH {_TX} SELECT customer_id, ms // 86400000 * 86400000 AS window_start_ms, (ms // 86400000 + 1) * 86400000 AS window_end_ms, count(*) AS transaction_count, CAST(sum(amount) AS BIGINT) AS total_amount FROM good WHERE arrival < 1000000000 GROUP BY ALL",
    "tx_dedup_window": f"WITH {_TX}, {_UNIQUE.format(of='dup')} SELECT customer_id, event_id, window_start_ms, arrival AS \"offset\" FROM u",
    "tx_dedup_conflict": f"WITH {_TX} SELECT customer_id, 6 * count(*) AS assignments, CAST(6 * sum(amount) AS BIGINT) AS amount FROM (SELECT customer_id, CASE WHEN amount > 0 THEN amount ELSE amount + 7 END AS amount FROM tx WHERE transaction_type <> 'error' AND (amount > 0 OR arrival % 17 = 0)) GROUP BY customer_id",
    "tx_assignment_counters": f"WITH {_TX} SELECT 6 * count(*) AS unique_window_assignments, CAST(6 * sum(CASE WHEN arrival % 17 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_window_assignments FROM tx",
    "tx_velocity_agg": _VELOCITY,
    "tx_velocity_alerts": _alert_sql(COUNT, AMOUNT),
    "tx_velocity_alerts_count_only": _alert_sql(COUNT, 10**15),
    "tx_velocity_alerts_amount_only": _alert_sql(10**9, AMOUNT),
    "tx_alert_counters": f"WITH {_TX}, {_AGG} SELECT count(*) FILTER (transaction_count >= {COUNT} OR total_amount >= {AMOUNT}) AS alerts_emitted, count(*) FILTER (NOT (transaction_count >= {COUNT} OR total_amount >= {AMOUNT})) AS below_threshold_evaluations FROM agg",
    "tx_alert_json_key": f"SELECT alert_id AS key, {_ALERT_JSON} AS value, sha256({_ALERT_JSON}) AS value_sha256 FROM ({_alert_sql(COUNT, AMOUNT)})",
    "tx_materialize_latest": f"WITH {_REVISIONS} SELECT idempotency_key, revision, alert_json FROM r QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY revision DESC, arrival) = 1",
    "tx_materialize_applied": f"WITH {_REVISIONS}, b AS (SELECT *, max(revision) OVER (PARTITION BY idempotency_key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r) SELECT idempotency_key, count(*) FILTER (revision > coalesce(before, -1)) AS applied, count(*) AS messages FROM b GROUP BY idempotency_key",
    "tx_materialize_view": f"WITH {_REVISIONS} SELECT idempotency_key, revision, alert_json FROM r QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY revision DESC, arrival % 2, arrival) = 1",
    "skew_partition_summary": f"{_SCENARIOS} SELECT scenario, partition, event_count, unique_key_count FROM counts",
    "skew_scenario_summary": f"{_SCENARIOS}, {_SKEW_TOTALS} SELECT scenario, total_events, unique_keys, max_partition, round(CAST(most AS DOUBLE) / total_events, 4) AS max_share, round(CAST(most * 3 AS DOUBLE) / total_events, 2) AS max_to_mean FROM totals",
    "skew_report": _REPORT,
    "skew_events_summary": f"{_CRC}, k AS (SELECT 'cust-' || user_id AS customer_id, count(*) AS n FROM events GROUP BY 1), placed AS (SELECT CAST({_crc('customer_id')} % 12 AS INTEGER) AS partition, n FROM k, crc_table), counts AS (SELECT partition, CAST(sum(n) AS BIGINT) AS n, count(*) AS u FROM placed GROUP BY 1) SELECT 'events' AS scenario, CAST(p AS INTEGER) AS partition, coalesce(n, 0) AS event_count, coalesce(u, 0) AS unique_key_count FROM range(12) t(p) LEFT JOIN counts ON counts.partition = p",
    "skew_scenario_events": f"{_SCENARIOS} SELECT printf('evt-skew-%s-%04d', scenario, i) AS event_id, customer_id, strftime(TIMESTAMP '2026-08-09 19:59:50' + to_hours(CASE scenario WHEN 'balanced' THEN 0 ELSE 1 END) + to_milliseconds(i), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS event_time, CAST(100000 AS BIGINT) AS amount, 'PYG' AS currency, 'transfer' AS transaction_type, 'api' AS channel FROM records",
    "demo_scenario_alerts": f"SELECT key, {_DEMO} AS value FROM (VALUES "
    "('velocity|cust-velocity-001|1786305580000|1786305640000', 4, 8000000, '[\"transaction_count\"]', '2026-08-09T19:59:40.000Z', '2026-08-09T20:00:40.000Z'), "
    "('velocity|cust-velocity-001|1786305590000|1786305650000', 5, 10500000, '[\"transaction_count\",\"total_amount\"]', '2026-08-09T19:59:50.000Z', '2026-08-09T20:00:50.000Z'), "
    "('velocity|cust-velocity-001|1786305600000|1786305660000', 4, 8000000, '[\"transaction_count\"]', '2026-08-09T20:00:00.000Z', '2026-08-09T20:01:00.000Z')) t(key, n, total, conditions, starts, ends)",
    "stream_velocity_agg": _VELOCITY,
    "stream_validate": _INVALID,
    "stream_pane_contract": "SELECT * FROM (VALUES ('cust-9009', CAST(3 AS BIGINT), CAST(7500000 AS BIGINT), CAST(0 AS INTEGER), 'ON_TIME', CAST(0 AS INTEGER)), ('cust-9009', 4, 10000000, 1, 'LATE', 1)) t(customer_id, transaction_count, total_amount, revision, pane_timing, pane_nonspeculative_index)",
    "stream_panes": f"WITH {_TX} SELECT customer_id, ms // 86400000 * 86400000 AS window_start_ms, (ms // 86400000 + 1) * 86400000 AS window_end_ms, count(*) AS transaction_count, CAST(sum(amount) AS BIGINT) AS total_amount, CAST(0 AS INTEGER) AS revision, 'ON_TIME' AS pane_timing FROM good WHERE arrival < 1000000000 GROUP BY ALL",
    "stream_alert_revisions": _LAST_REVISIONS,
}
