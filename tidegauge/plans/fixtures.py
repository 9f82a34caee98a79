"""The temporal fixture: a window of one customer, its late and its too late events, one file a batch."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..streaming.panes import panes
from .config import WindowPolicy

BASE = datetime(2026, 7, 12, 10, 0, tzinfo=UTC)
SCHEMA = "event_id string, customer_id string, event_ts timestamp, amount bigint, partition int, offset bigint"

# Batches of (event, customer, seconds after the base, amount).
BATCHES = (
    (("txn-001", "cust-9009", 5, 2_000_000), ("txn-002", "cust-9009", 20, 2_500_000), ("txn-002", "cust-9009", 20, 2_500_000), ("txn-004", "cust-9009", 50, 3_000_000)),
    (("tick-1", "clock", 60, 1),),
    (("txn-003", "cust-9009", 35, 2_500_000),),
    (("tick-2", "clock", 91, 1),),
    (("txn-006", "cust-9009", 45, 99_000_000),),
)


def run_panes(spark: SparkSession, folder: str, batches=BATCHES, policy: WindowPolicy | None = None) -> DataFrame:
    """Each batch is a file and a run of the query from its checkpoint, so the query restarts between any two."""
    policy = policy or WindowPolicy(enable_early=False)
    offset = 0
    for batch in batches:
        rows = [(e, who, BASE + timedelta(seconds=s), amount, 0, offset + i) for i, (e, who, s, amount) in enumerate(batch)]
        offset += len(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/input")
        source = spark.readStream.schema(SCHEMA).parquet(f"{folder}/input")
        query = panes(source, policy).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        query.foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{folder}/out")).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")
