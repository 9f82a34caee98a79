"""Command-line tools beside the pipeline: the demonstration producer and the alert materialiser.

python -m tidegauge.streaming.tools produce --dry-run
python -m tidegauge.streaming.tools materialize --source parquet --path alerts/ --view view/
"""

from __future__ import annotations

import argparse
import itertools
import json
import sys
import time
from collections import Counter
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.materialize import AlertView, applied, decode_alerts
from ..operators.scenario import demo_events, envelope_of, shifted
from ..sources.envelope import ALERT_TOPIC, INPUT_TOPIC, first_records, kafka_read_options, kafka_write_options, read_envelope, write_records


def _session(name: str) -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def produce(argv: Sequence[str]) -> int:
    """Publish the scenario's eight records in order, cycle after cycle; --cycles 0 goes on until interrupted."""
    parser = argparse.ArgumentParser(prog="tidegauge-produce")
    # Flags, defaults and messages.
    parser.add_argument("--bootstrap-servers", default="localhost:9092")
    parser.add_argument("--topic", default=INPUT_TOPIC)
    parser.add_argument("--client-id", default="synthetic-transactions-v1")
    parser.add_argument("--base-time")
    parser.add_argument("--interval-seconds", type=float, default=0.25)
    parser.add_argument("--cycles", type=int, default=1)
    parser.add_argument("--cycle-spacing-seconds", type=float, default=180.0)
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    for wrong, text in ((args.interval_seconds < 0, "--interval-seconds must be non-negative"), (args.cycles < 0, "--cycles must be non-negative"), (args.cycle_spacing_seconds <= 0, "--cycle-spacing-seconds must be positive")):
        if wrong:
            parser.error(text)
    base = datetime.fromisoformat(args.base_time) if args.base_time else datetime.now(UTC).replace(microsecond=0)
    spark = _session("tidegauge-produce")
    try:
        for cycle in range(args.cycles) if args.cycles else itertools.count():
            rows = envelope_of(demo_events(spark, shifted(base, cycle, args.cycle_spacing_seconds)), args.topic)
            for r in rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "offset").orderBy("offset").collect():  # eight rows
                print(f"cycle={cycle + 1} key={r.key} value={r.value}")
                if not args.dry_run:
                    one = rows.where(F.col("offset") == r.offset).select("key", "value")
                    options = kafka_write_options(args.bootstrap_servers, args.topic, args.client_id)
                    write_records(one, "kafka", args.topic, **{k: v for k, v in options.items() if k != "topic"})
                    time.sleep(args.interval_seconds)
    except KeyboardInterrupt:
        print("Stopped by user.")
    return 0


def materialize(argv: Sequence[str]) -> int:
    """Consume alert records into the durable view, a line for each, until none comes for a while; then print the view."""
    parser = argparse.ArgumentParser(prog="tidegauge-materialize")
    # Flags, defaults, messages and the form of the lines.
    parser.add_argument("--source", choices=("kafka", "parquet", "json"), default="kafka")
    parser.add_argument("--path")
    parser.add_argument("--bootstrap-servers", default="localhost:9092")
    parser.add_argument("--topic", default=ALERT_TOPIC)
    parser.add_argument("--consumer-group", default="velocity-alert-materializer-v1")
    parser.add_argument("--max-messages", type=int)
    parser.add_argument("--timeout-seconds", type=float, default=10.0)
    parser.add_argument("--from-beginning", action="store_true")
    parser.add_argument("--view", default="data/materialized-alerts")
    args = parser.parse_args(argv)
    if args.max_messages is not None and args.max_messages <= 0:
        parser.error("--max-messages must be positive")
    if args.timeout_seconds <= 0:
        parser.error("--timeout-seconds must be positive")
    spark = _session("tidegauge-materialize")
    options = kafka_read_options(args.bootstrap_servers, args.topic, args.consumer_group, committed_only=True, from_beginning=args.from_beginning) if args.source == "kafka" else {}
    view, read = AlertView(spark, args.view), Counter()

    def take(batch: DataFrame, n: int = 0) -> None:
        alerts = decode_alerts(batch).persist()
        for r in applied(alerts, view.snapshot()).orderBy("arrival").toLocalIterator():
            value = json.dumps(json.loads(r.alert_json), ensure_ascii=False, sort_keys=True)
            print(f"ALERT partition={r.arrival.partition} offset={r.arrival.offset} key={r.idempotency_key} materialized={'updated' if r.applied else 'unchanged'} value={value}")
            read["messages"] += 1
        read["updates"] += view.upsert(alerts)
        alerts.unpersist()

    if args.max_messages:
        take(first_records(read_envelope(spark, args.source, args.path, **options), args.max_messages))
    else:  # a batch commits to the checkpoint after it is in the view
        rows = read_envelope(spark, args.source, args.path, streaming=True, **options)
        until = time.monotonic() + args.timeout_seconds
        while time.monotonic() < until:
            before = read["messages"]
            rows.writeStream.option("checkpointLocation", f"{args.view.rstrip('/')}-offsets/{args.consumer_group}").foreachBatch(take).trigger(availableNow=True).start().awaitTermination()
            if read["messages"] > before:
                until = time.monotonic() + args.timeout_seconds
            else:
                time.sleep(min(1.0, max(0.0, until - time.monotonic())))
    keys = 0
    for r in view.ordered().toLocalIterator():
        print(json.dumps({r.idempotency_key: json.loads(r.alert_json)}, ensure_ascii=False, sort_keys=True))
        keys += 1
    print(f"MATERIALIZED_KEYS={keys} MESSAGES_READ={read['messages']} MATERIALIZED_UPDATES={read['updates']} STATE={args.view}")
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    name, *rest = list(sys.argv[1:] if argv is None else argv) or [""]
    tools = {"produce": produce, "materialize": materialize}
    if name not in tools:
        raise SystemExit("usage: produce | materialize, then --help")
    return tools[name](rest)


if __name__ == "__main__":
    raise SystemExit(main())
