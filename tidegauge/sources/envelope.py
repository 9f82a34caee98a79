"""Sources and sinks. Whatever the source, rows have the raw envelope's columns; (partition, offset) is the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp"

# Topics and delivery settings.
INPUT_TOPIC = "bank.transactions.raw"
INVALID_TOPIC = "bank.transactions.invalid"
ALERT_TOPIC = "risk.alerts.velocity"
PRODUCER = {"acks": "all", "enable.idempotence": "true", "max.in.flight.requests.per.connection": "5", "delivery.timeout.ms": "30000"}


def kafka_read_options(bootstrap_servers: str, topic: str, group: str | None = None, committed_only: bool = False, from_beginning: bool = True) -> dict[str, str]:
    """Options of Spark's Kafka source; the query's checkpoint takes the place of committed offsets."""
    options = {"kafka.bootstrap.servers": bootstrap_servers, "subscribe": topic, "startingOffsets": "earliest" if from_beginning else "latest", "failOnDataLoss": "true", "kafka.allow.auto.create.topics": "false"}
    if group:
        options["kafka.group.id"] = group
    if committed_only:
        options["kafka.isolation.level"] = "read_committed"
    return options


def kafka_write_options(bootstrap_servers: str, topic: str, client_id: str | None = None) -> dict[str, str]:
    return {"kafka.bootstrap.servers": bootstrap_servers, "topic": topic} | {f"kafka.{k}": v for k, v in PRODUCER.items()} | ({"kafka.client.id": client_id} if client_id else {})


def read_envelope(spark: SparkSession, source: str, path: str | None = None, streaming: bool = False, **options: str) -> DataFrame:
    """source: kafka (options as kafka_read_options), parquet or json (path; JSON texts of key and value in base64)."""
    reader = spark.readStream if streaming else spark.read
    if source == "kafka":
        return reader.format("kafka").options(**options).load().select("key", "value", "topic", "partition", "offset", "timestamp")
    if source not in ("parquet", "json"):
        raise ValueError(f"source must be kafka, parquet or json, not {source}")
    return reader.schema(ENVELOPE).options(**options).format(source).load(path)


def first_records(envelope: DataFrame, count: int) -> DataFrame:
    """The first records in order of arrival, for bounded reads."""
    if isinstance(count, bool) or not isinstance(count, int) or count <= 0:
        raise ValueError("max_num_records must be a positive integer")
    return envelope.orderBy("partition", "offset").limit(count)


def write_records(records: DataFrame, sink: str, target: str, **options: str) -> None:
    """Batch write of key and value: to Kafka (target: topic) or to files (target: folder)."""
    if sink == "kafka":
        records.write.format("kafka").options(**options, topic=target).save()
    else:
        records.write.format(sink).options(**options).mode("append").save(target)


def publish_in_order(events: DataFrame, path: str, topic: str = INPUT_TOPIC) -> None:
    """Events (sequence, customer_id, event_ts, value) as envelope files, one file a record in order of sequence. For scenarios of a few records, whose order of arrival matters."""
    rows = events.select(F.encode("customer_id", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value"), F.lit(topic).alias("topic"), F.lit(0).alias("partition"), F.col("sequence").cast("bigint").alias("offset"), F.col("event_ts").alias("timestamp"))
    for r in rows.select("offset").distinct().orderBy("offset").collect():
        rows.where(F.col("offset") == r.offset).coalesce(1).write.mode("append").parquet(path)
