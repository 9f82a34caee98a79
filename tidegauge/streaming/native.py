"""The streaming queries: alerts of panes, invalid records, the materialiser, and counts by Spark's own operators.

Alerts come from the panes of panes.py, so their revisions rise with each pane of a window. Alerts and invalid
records are a query each: each reads the source, and each goes on if the other stops. streaming_velocity is the plain
aggregate: its watermark is the largest event time less the lateness, and Spark drops late rows by the watermark of the batch
before, so a row later than allowed may still count in the batch right after time has advanced.
"""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.serde import alert_records, invalid_records
from ..operators.ingest import invalid_events, valid_events, validated
from ..operators.materialize import AlertView, decode_alerts
from ..operators.velocity import AMOUNT_THRESHOLD, COUNT_THRESHOLD, alert_counts, create_velocity_alerts, velocity
from ..plans.config import WindowPolicy
from .panes import panes

Write = Callable[[DataFrame, int], None]


class Counters(StreamingQueryListener):
    """Sums of what queries observe, logged as they change: valid_records, invalid_records, alerts_emitted, below_threshold_evaluations."""

    def __init__(self) -> None:
        self.total: Counter = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for row in event.progress.observedMetrics.values():
            self.total.update({k: v for k, v in row.asDict().items() if v})
        logging.info("counters %s", dict(self.total))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def streaming_velocity(events: DataFrame, policy: WindowPolicy = WindowPolicy()) -> DataFrame:
    """Counts and totals of windows as they change (output mode update)."""
    return velocity(events.withWatermark("event_ts", f"{policy.allowed_lateness_seconds} seconds"), policy)


def start_alerts(events: DataFrame, write: Write, checkpoint: str, policy: WindowPolicy = WindowPolicy(), once: bool = False, count_threshold: int = COUNT_THRESHOLD, amount_threshold: int = AMOUNT_THRESHOLD) -> StreamingQuery:
    """Alerts of each pane as key and value, batch by batch."""
    fired = panes(events, policy).observe("alerts", *alert_counts(count_threshold, amount_threshold))
    alerts = create_velocity_alerts(fired, count_threshold, amount_threshold)
    writer = alerts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: write(alert_records(batch), n))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{policy.early_firing_delay_seconds} seconds")).start()


def start_invalid(envelope: DataFrame, write: Write, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Invalid records as key and value, batch by batch."""
    rows = validated(envelope)
    counted = rows.observe("records", F.count_if(F.size("errors") == 0).alias("valid_records"), F.count_if(F.size("errors") > 0).alias("invalid_records"))
    writer = invalid_records(invalid_events(counted)).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def events_of(envelope: DataFrame) -> DataFrame:
    return valid_events(validated(envelope))


def start_materializer(envelope: DataFrame, view: AlertView, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the view up to date; a batch commits after its snapshot is in place, and taking it in again changes nothing."""
    writer = envelope.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: view.upsert(decode_alerts(batch)) and None)
    return (writer.trigger(availableNow=True) if once else writer).start()
