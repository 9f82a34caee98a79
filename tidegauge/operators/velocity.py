"""Windows, dedup, aggregation and the velocity rule, alike for bounded and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contract import CURRENCY, SCHEMA_VERSION, iso_millis, present
from ..plans.config import WindowPolicy

# Fixed values of rule velocity-v1.
RULE_VERSION = "velocity-v1"
COUNT_THRESHOLD = 4
AMOUNT_THRESHOLD = 10_000_000
ALERT_FIELDS = (
    "schema_version", "alert_id", "idempotency_key", "alert_type", "rule_version", "customer_id", "window_start", "window_end",
    "transaction_count", "total_amount", "currency", "thresholds", "triggered_conditions", "revision", "pane_timing",
    "pane_nonspeculative_index", "pane_is_first", "pane_is_last", "accumulation_mode",
)


def assign_windows(events: DataFrame, policy: WindowPolicy = WindowPolicy()) -> DataFrame:
    """Each event once for each window that holds it: epoch-aligned, start included and end not."""
    sizes = [f"{policy.size_seconds} seconds"] + ([f"{policy.period_seconds} seconds"] if policy.period_seconds != policy.size_seconds else [])
    return events.withColumn("window", F.window("event_ts", *sizes))


def with_bounds(windowed: DataFrame) -> DataFrame:
    """window as window_start_ms and window_end_ms."""
    return windowed.withColumns({"window_start_ms": F.unix_millis("window.start"), "window_end_ms": F.unix_millis("window.end")}).drop("window")


def deduplicate(windowed: DataFrame) -> DataFrame:
    """The first arrival (partition, offset) of each event_id for each customer and window.

    Bounded frames: an aggregate, partial before the shuffle, so repeats of a hot customer merge early.
    Streams: Spark's stateful dropDuplicates, within the window's watermark. It keeps the row that Spark meets first, which
    need not be the first arrival where repeats of an id differ; streaming/panes.py decides by arrival.
    """
    keys = ["customer_id", "window", "event_id"]
    if windowed.isStreaming:
        return windowed.dropDuplicates(keys)
    rest = [x for x in windowed.columns if x not in keys]
    first = F.min_by(F.struct(*rest), F.struct("partition", "offset")).alias("first")
    return windowed.groupBy(*keys).agg(first).select(*keys, "first.*").select(*windowed.columns)


def aggregate(unique: DataFrame) -> DataFrame:
    """transaction_count and total_amount by customer and window."""
    return unique.groupBy("customer_id", "window").agg(F.count(F.lit(1)).alias("transaction_count"), F.sum("amount").alias("total_amount"))


def velocity(events: DataFrame, policy: WindowPolicy = WindowPolicy()) -> DataFrame:
    """Counts and totals over deduplicated events, with window bounds in milliseconds."""
    if events.isStreaming:
        return with_bounds(aggregate(deduplicate(assign_windows(events, policy))))
    # equal event ids in one window are merged before the windows multiply rows: rows of one id and time share all windows
    keys = ["customer_id", "event_id", "event_ts"]
    first = F.min_by(F.struct("amount", "partition", "offset"), F.struct("partition", "offset")).alias("first")
    early = events.groupBy(*keys).agg(first).select(*keys, "first.*")
    return with_bounds(aggregate(deduplicate(assign_windows(early, policy))))


# Error texts.
CUSTOMER_BLANK = "customer_id must be a non-empty string"
WINDOW_EMPTY = "window end must be greater than window start"
NEGATIVE = "{} must be a non-negative integer"
ONE_ZERO = "aggregate must contain positive count and amount or the neutral state (0, 0)"


def alert_key(customer: str = "customer_id"):
    """The key that all revisions of a window's alert share; a blank customer or an empty window is an error."""
    key = F.concat_ws("|", F.lit("velocity"), F.col(customer), F.col("window_start_ms"), F.col("window_end_ms"))
    wrong = F.when(~present(F.col(customer)), F.lit(CUSTOMER_BLANK)).when(F.col("window_end_ms") <= F.col("window_start_ms"), F.lit(WINDOW_EMPTY))
    return F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(key)


def triggered(count_threshold: int, amount_threshold: int):
    return F.filter(F.array(F.when(F.col("transaction_count") >= count_threshold, F.lit("transaction_count")), F.when(F.col("total_amount") >= amount_threshold, F.lit("total_amount"))), lambda x: x.isNotNull())


def evaluated(panes: DataFrame) -> DataFrame:
    """Drops neutral aggregates (0, 0); a negative or missing number, or exactly one zero, is an error."""
    n, total = F.col("transaction_count"), F.col("total_amount")
    wrong = (
        F.when(n.isNull() | (n < 0), F.lit(NEGATIVE.format("transaction_count")))
        .when(total.isNull() | (total < 0), F.lit(NEGATIVE.format("total_amount")))
        .when((n == 0) != (total == 0), F.lit(ONE_ZERO))
    )
    checked = panes.withColumn("transaction_count", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("bigint")).otherwise(n))
    return checked.where("transaction_count > 0")


def create_velocity_alerts(panes: DataFrame, count_threshold: int = COUNT_THRESHOLD, amount_threshold: int = AMOUNT_THRESHOLD) -> DataFrame:
    """Alerts of aggregates that reach a threshold. Without pane columns every aggregate is its window's only, on-time pane."""
    for name, x in (("transaction_count_threshold", count_threshold), ("total_amount_threshold", amount_threshold)):
        if isinstance(x, bool) or not isinstance(x, int) or x <= 0:
            raise ValueError(f"{name} must be a positive integer")
    if "pane_timing" not in panes.columns:
        panes = panes.withColumns({"revision": F.lit(0), "pane_timing": F.lit("ON_TIME"), "pane_nonspeculative_index": F.lit(0), "pane_is_first": F.lit(True), "pane_is_last": F.lit(False)})
    key = alert_key()
    found = evaluated(panes).where((F.col("transaction_count") >= count_threshold) | (F.col("total_amount") >= amount_threshold))
    return found.withColumns(
        {
            "schema_version": F.lit(SCHEMA_VERSION),
            "alert_id": key,
            "idempotency_key": key,
            "alert_type": F.lit("velocity"),
            "rule_version": F.lit(RULE_VERSION),
            "window_start": iso_millis(F.col("window_start_ms")),
            "window_end": iso_millis(F.col("window_end_ms")),
            "currency": F.lit(CURRENCY),
            "thresholds": F.struct(F.lit(count_threshold).cast("bigint").alias("transaction_count"), F.lit(amount_threshold).cast("bigint").alias("total_amount")),
            "triggered_conditions": triggered(count_threshold, amount_threshold),
            "accumulation_mode": F.lit("ACCUMULATING"),
        }
    ).select(*ALERT_FIELDS)


def alert_counts(count_threshold: int = COUNT_THRESHOLD, amount_threshold: int = AMOUNT_THRESHOLD) -> tuple:
    """Counters alerts_emitted and below_threshold_evaluations, over evaluated aggregates."""
    hit = (F.col("transaction_count") >= count_threshold) | (F.col("total_amount") >= amount_threshold)
    return F.count_if(hit).alias("alerts_emitted"), F.count_if(~hit).alias("below_threshold_evaluations")


def assignment_counts(windowed: DataFrame) -> DataFrame:
    """unique_window_assignments and duplicate_window_assignments."""
    groups = windowed.groupBy("customer_id", "window", "event_id").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.count(F.lit(1)).alias("unique_window_assignments"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_window_assignments"))
