"""The demonstration scenario and typed event building."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contract as c

DEMO_BASE = datetime(2026, 8, 9, 19, 59, 50, tzinfo=UTC)
CYCLE_SPACING_SECONDS = 180

# Label, name, customer, seconds after the base time, amount, type, channel; in order of publication.
DEMO = (
    ("normal", "normal-001", "cust-normal-001", 5, 350000, "card_purchase", "web"),
    ("velocity-1", "velocity-001", "cust-velocity-001", 0, 2500000, "transfer", "mobile"),
    ("velocity-2", "velocity-002", "cust-velocity-001", 20, 2500000, "transfer", "mobile"),
    ("out-of-order-newer-first", "velocity-004", "cust-velocity-001", 50, 2500000, "transfer", "api"),
    ("out-of-order-older-after", "velocity-003", "cust-velocity-001", 40, 2500000, "transfer", "atm"),
    ("intentional-duplicate", "velocity-002", "cust-velocity-001", 20, 2500000, "transfer", "mobile"),
    ("advance-event-time", "velocity-005", "cust-velocity-001", 120, 100000, "transfer", "branch"),
    ("late-candidate", "velocity-late-001", "cust-velocity-001", 10, 500000, "transfer", "api"),
)


def event_json(df: DataFrame) -> F.Column:
    """Canonical JSON of typed events: event_id, customer_id, event_ts, amount, currency, transaction_type, channel."""
    payload = F.struct("amount", "channel", "currency", "transaction_type")
    return F.to_json(F.struct("customer_id", "event_id", c.format_event_time(F.col("event_ts")).alias("event_time"), payload.alias("payload"), F.lit(c.SCHEMA_VERSION).alias("schema_version")), {"ignoreNullFields": "false"})


def envelope_of(events: DataFrame, topic: str = "bank.transactions.raw") -> DataFrame:
    """Typed events with partition and offset as raw records keyed by customer."""
    return events.select(F.encode("customer_id", "UTF-8").alias("key"), F.encode(event_json(events), "UTF-8").alias("value"), F.lit(topic).alias("topic"), "partition", "offset", F.col("event_ts").alias("timestamp"))


def demo_events(spark: SparkSession, base: datetime = DEMO_BASE, cycles: int = 1, spacing_seconds: float = CYCLE_SPACING_SECONDS) -> DataFrame:
    """The scenario's events, cycle after cycle. cycles must be positive; an endless producer calls this again and again."""
    if base.tzinfo is None:
        raise ValueError("base_time must include timezone information")
    if cycles <= 0:
        raise ValueError("cycles must be positive")
    if spacing_seconds <= 0:
        raise ValueError("cycle_spacing_seconds must be positive")
    rows = [(i, *row) for i, row in enumerate(DEMO)]
    demo = spark.createDataFrame(rows, "step int, label string, name string, customer_id string, seconds int, amount bigint, transaction_type string, channel string")
    start = F.timestamp_micros(F.lit(int(base.timestamp()) * 1_000_000 + base.microsecond) + (F.col("cycle") * spacing_seconds * 1_000_000).cast("bigint"))
    every = spark.range(cycles).withColumnRenamed("id", "cycle").join(F.broadcast(demo))  # eight rows
    stamp = F.date_format("start", "yyyyMMdd'T'HHmmss'Z'")
    return every.withColumn("start", start).select(
        F.concat_ws("-", F.lit("evt"), "name", stamp).alias("event_id"), "customer_id", (F.col("start") + F.make_dt_interval(secs=F.col("seconds"))).alias("event_ts"), "amount", F.lit(c.CURRENCY).alias("currency"),
        "transaction_type", "channel", F.lit(0).alias("partition"), (F.col("cycle") * len(DEMO) + F.col("step")).alias("offset"), "label",
    )


def build_event(event_id: str, customer_id: str, event_time: datetime, amount: int, transaction_type: str, channel: str, currency: str = c.CURRENCY) -> dict:
    """One event for producers; all that is wrong with it is raised at once."""
    if event_time.tzinfo is None or event_time.utcoffset() is None:
        raise ValueError(c.TIME_NO_ZONE)
    wrong = [
        text
        for holds, text in (
            (isinstance(event_id, str) and event_id.strip(), c.EVENT_ID_BLANK),
            (isinstance(customer_id, str) and customer_id.strip(), c.CUSTOMER_ID_BLANK),
            (isinstance(amount, int) and not isinstance(amount, bool) and amount > 0, c.AMOUNT_WRONG),
            (currency == c.CURRENCY, c.CURRENCY_WRONG),
            (transaction_type in c.TRANSACTION_TYPES, c.TYPE_WRONG),
            (channel in c.CHANNELS, c.CHANNEL_WRONG),
        )
        if not holds
    ]
    if wrong:
        raise ValueError("; ".join(wrong))
    at = event_time.astimezone(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    payload = {"amount": amount, "currency": currency, "transaction_type": transaction_type, "channel": channel}
    return {"schema_version": c.SCHEMA_VERSION, "event_id": event_id, "customer_id": customer_id, "event_time": at, "payload": payload}


def kafka_key(event: dict) -> bytes:
    customer = event.get("customer_id")
    if not isinstance(customer, str) or not customer.strip():
        raise ValueError(c.CUSTOMER_ID_BLANK)
    return customer.encode()


def shifted(base: datetime, cycle: int, spacing_seconds: float = CYCLE_SPACING_SECONDS) -> datetime:
    return base + timedelta(seconds=cycle * spacing_seconds)
