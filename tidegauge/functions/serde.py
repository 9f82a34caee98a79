"""Canonical JSON and Kafka records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contract import present


def _ordered(column: Column, kind: T.DataType) -> Column:
    """A struct with its fields, and theirs, in alphabetical order."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_ordered(column[n], kind[n].dataType).alias(n) for n in sorted(kind.names)])
    return column


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """Compact JSON with sorted keys, nulls kept, non-ASCII as it is."""
    return F.to_json(F.struct(*[_ordered(F.col(n), df.schema[n].dataType).alias(n) for n in sorted(columns)]), {"ignoreNullFields": "false"})


def alert_records(alerts: DataFrame) -> DataFrame:
    """key and value (bytes) of alerts, keyed by idempotency_key."""
    return alerts.select(F.encode("idempotency_key", "UTF-8").alias("key"), F.encode(canonical_json(alerts, alerts.columns), "UTF-8").alias("value"))


def invalid_records(invalid: DataFrame) -> DataFrame:
    """key and value (bytes) of invalid records: keyed by event_id, or by the value's digest where there is none."""
    value = F.encode(canonical_json(invalid, ["error_stage", "errors", "event_id", "kafka_key", "raw_value"]), "UTF-8")
    key = F.when(present(F.col("event_id")), F.concat(F.lit("invalid|"), F.col("event_id"))).otherwise(F.concat(F.lit("invalid|sha256:"), F.sha2(value, 256)))
    return invalid.select(F.encode(key, "UTF-8").alias("key"), value.alias("value"))
