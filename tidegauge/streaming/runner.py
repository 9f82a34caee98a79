"""The pipeline's entry point: python -m tidegauge.streaming.runner --mode event_time --bootstrap-servers ..."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.serde import alert_records, invalid_records
from ..operators.ingest import invalid_events, valid_events, validated
from ..operators.velocity import create_velocity_alerts, velocity
from ..plans.config import PipelineConfig, WindowPolicy, config_of, parse_args
from ..sources.envelope import first_records, kafka_read_options, kafka_write_options, read_envelope, write_records
from . import native


def run_bounded(envelope: DataFrame, policy: WindowPolicy = WindowPolicy()) -> tuple[DataFrame, DataFrame]:
    """Alert and invalid records (key, value) of a bounded frame: one on-time pane a window."""
    rows = validated(envelope)
    return alert_records(create_velocity_alerts(velocity(valid_events(rows), policy))), invalid_records(invalid_events(rows))


def start(spark: SparkSession, config: PipelineConfig, checkpoint: str, policy: WindowPolicy | None = None) -> list:
    """The streaming queries over Kafka. Alerts keep state; invalid records do not, and go on if alerts stop."""
    policy = policy or WindowPolicy(enable_early=not config.smoke_mode)
    source = kafka_read_options(config.bootstrap_servers, config.input_topic, config.consumer_group)
    to = {topic: kafka_write_options(config.bootstrap_servers, topic) for topic in (config.alert_topic, config.invalid_topic)}
    write = lambda topic: lambda batch, n: write_records(batch, "kafka", topic, **{k: v for k, v in to[topic].items() if k != "topic"})
    envelope = read_envelope(spark, "kafka", streaming=True, **source)
    spark.streams.addListener(native.Counters())
    alerts = native.start_alerts(native.events_of(envelope), write(config.alert_topic), f"{checkpoint}/alerts", policy)
    return [alerts, native.start_invalid(envelope, write(config.invalid_topic), f"{checkpoint}/invalid")]


def main(argv: Sequence[str] | None = None) -> int:
    args, settings = parse_args(argv)
    config = config_of(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("tidegauge").config("spark.sql.session.timeZone", "UTC").config(map=settings).getOrCreate()
    if config.mode == "bounded" or config.max_num_records:
        envelope = read_envelope(spark, "kafka", **kafka_read_options(config.bootstrap_servers, config.input_topic, config.consumer_group))
        alerts, invalid = run_bounded(first_records(envelope, config.max_num_records) if config.max_num_records else envelope)
        for rows, topic in ((alerts, config.alert_topic), (invalid, config.invalid_topic)):
            write_records(rows, "kafka", topic, **{k: v for k, v in kafka_write_options(config.bootstrap_servers, topic).items() if k != "topic"})
        return 0
    checkpoint = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not checkpoint:
        raise SystemExit("set spark.checkpoint.dir to a folder that the cluster shares")
    queries = start(spark, config, f"{checkpoint.rstrip('/')}/{config.consumer_group}")
    try:
        spark.streams.awaitAnyTermination()
    except KeyboardInterrupt:
        logging.info("Stopping.")
        for query in queries:
            query.stop()
        return 130
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
