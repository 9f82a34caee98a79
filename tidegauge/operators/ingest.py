"""Decode, validate and split raw records; each record comes out once, valid or invalid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contract as c


ALLOW_DUPLICATES = "spark.sql.variant.allowDuplicateKeys"


def validated(envelope: DataFrame) -> DataFrame:
    """The envelope with the fields of its events (f_...) and errors. Of equal keys in an object the last holds: the session must allow them (and does from here on, as for UTC, which is only checked)."""
    spark = envelope.sparkSession
    c.check_utc(spark)
    if spark.conf.get(ALLOW_DUPLICATES, "false") != "true":
        spark.conf.set(ALLOW_DUPLICATES, "true")
    key, value = F.col("key").cast("string"), F.col("value").cast("string")
    key_ok = F.col("key").isNotNull() & F.is_valid_utf8(key)
    value_ok = F.col("value").isNotNull() & F.is_valid_utf8(value)
    rows = envelope.withColumns({"key_text": F.when(key_ok, key), "value_ok": value_ok})
    rows = rows.withColumn("parsed", F.when(F.col("value_ok"), c.strict_json(value))).withColumn("event", c.unwrapped(F.col("parsed"), value))
    rows = rows.withColumn("parts", F.try_variant_get("event", "$", c.EVENT)).withColumn("inner", F.try_variant_get("parts.payload", "$", c.PAYLOAD)).withColumn("amount_kind", c.kind(F.col("inner.amount")))
    event = F.col("event")
    about_key = c.collected(
        (F.col("key").isNull(), c.KEY_NULL),
        (F.col("key").isNotNull() & F.col("key_text").isNull(), c.KEY_NOT_UTF8),
        (F.col("key_text").isNotNull() & ~c.present(F.col("key_text")), c.KEY_BLANK),
    )
    about_value = c.collected(
        (F.col("value").isNull(), c.VALUE_NOT_BYTES),
        (F.col("value").isNotNull() & ~F.col("value_ok"), c.VALUE_NOT_UTF8),
        (F.col("value_ok") & event.isNull(), c.VALUE_NOT_JSON),
    )
    rows = rows.withColumns(c.fields(F.col("parts"), F.col("inner"), F.col("amount_kind")))
    rows = rows.withColumn("instant", c.instant(F.col("f_time"))).withColumn("f_at", c.in_range(F.col("instant")))
    mismatch = c.collected((F.col("key_text").isNotNull() & c.present(F.col("f_customer_id")) & (F.col("key_text") != F.col("f_customer_id")), c.KEY_MISMATCH))
    inside = F.when(event.isNotNull(), c.event_errors()).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("errors", F.concat(about_key, about_value, inside, mismatch)).drop("value_ok", "event", "key_text", "parsed", "parts", "inner", "amount_kind", "instant")


def _only(rows: DataFrame, holds: F.Column, *fields: F.Column) -> DataFrame:
    """The fields of rows that hold.

    A filter would be pushed below the columns it reads and parse each record again for every rule; what a
    generator has made is only looked at after it.
    """
    made = rows.select(F.explode_outer(F.when(holds, F.array(F.struct(*fields)))).alias("row"))
    return made.where("row is not null").select("row.*")


def valid_events(rows: DataFrame) -> DataFrame:
    """Typed transactions of validated rows without errors, at their event time."""
    return _only(
        rows,
        F.size("errors") == 0,
        F.col("f_event_id").alias("event_id"),
        F.col("f_customer_id").alias("customer_id"),
        F.col("f_at").alias("event_ts"),
        F.col("f_amount").alias("amount"),
        F.col("f_currency").alias("currency"),
        F.col("f_type").alias("transaction_type"),
        F.col("f_channel").alias("channel"),
        F.col("partition"),
        F.col("offset"),
    )


def invalid_events(rows: DataFrame) -> DataFrame:
    """Diagnostic records of validated rows with errors."""
    return _only(
        rows,
        F.size("errors") > 0,
        F.lit(c.ERROR_STAGE).alias("error_stage"),
        F.col("errors"),
        F.col("f_event_id").alias("event_id"),
        F.make_valid_utf8(F.col("key").cast("string")).alias("kafka_key"),
        F.make_valid_utf8(F.col("value").cast("string")).alias("raw_value"),
    )
