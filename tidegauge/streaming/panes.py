"""Exact panes: a stateful processor with its own watermark, revisions and per-window lateness.

Spark's watermark trails by more than any window stays open, so Spark drops nothing that the domain accepts;
the processor works with the logical watermark, Spark's plus that delay. An EARLY pane comes with each batch
that touched an open window (if enabled), ON_TIME when the watermark reaches its end, LATE with each late
event, and an event is dropped once the watermark is past end plus lateness. A duplicate fires no pane.
Panes accumulate; revision numbers all panes of a window, the non-speculative index those from ON_TIME on.
A window whose first event is already late begins with a LATE pane of index 0.

Every call of Spark's state costs a message to another process, so customers of a window share state by bucket, in
shards of some hundreds: a batch reads and writes the shards that its rows touch, once each. A shard's text holds each
customer's first few event ids; further ones are states of their own, looked up one by one.
"""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Iterator
from operator import itemgetter

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.velocity import assign_windows, with_bounds
from ..plans.config import WindowPolicy

# The processor is first loaded by a Python process that does not get the context's files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PANES = "customer_id string, window_start_ms bigint, window_end_ms bigint, transaction_count bigint, total_amount bigint, revision int, pane_timing string, pane_nonspeculative_index int, pane_is_first boolean, pane_is_last boolean"

#: Buckets of customers; a checkpoint keeps to the number that it began with.
BUCKETS = 256
#: Customers of a shard (up to twice as many), and event ids of a customer that its shard's text holds.
SHARD_CUSTOMERS = 256
SHARD_IDS = 64
ROW = ("bucket", "window_start_ms", "customer_id", "event_id", "amount", "partition", "offset")
FIELDS = itemgetter(*map(ROW.index, ("customer_id", "event_id", "amount")))
ARRIVAL = itemgetter(*map(ROW.index, ("partition", "offset")))
PANE = Row(*(x.split()[0] for x in PANES.split(", ")))
#: Places in what a shard holds of a customer: the last is whether further ids are states of their own.
COUNT, TOTAL, FIRED, SETTLED, ON_TIME, IDS, FURTHER = range(7)


class PaneProcessor(StatefulProcessor):
    """State of a bucket's window: its customers and shards; by shard, of each customer the count, total, panes fired, non-speculative panes, whether on time has fired, and event ids seen."""

    def __init__(self, size_ms: int, lateness_ms: int, early: bool, delay_ms: int, shard_customers: int = SHARD_CUSTOMERS, shard_ids: int = SHARD_IDS):
        self.size, self.lateness, self.early, self.delay = size_ms, lateness_ms, early, delay_ms
        self.shard_customers, self.shard_ids = shard_customers, shard_ids

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "customers bigint, shards int")
        self.held = handle.getMapState("held", "shard int", "customers binary")
        self.seen = handle.getMapState("seen", "customer_id string, event_id string", "there boolean")

    def _watermark(self, timers) -> int | None:
        at = timers.getCurrentWatermarkInMs()
        return at + self.delay if at > 0 else None

    def _load(self, shard: int) -> dict:
        found = self.held.getValue((shard,))
        return {who: rest for who, *rest in json.loads(bytes(found[0]))} if found else {}

    def _keep(self, shard: int, customers: dict) -> None:
        self.held.updateValue((shard,), (json.dumps([(who, *rest) for who, rest in customers.items()]).encode(),))

    def _shard(self, customer: str | None, shards: int) -> int:
        return zlib.crc32((customer or "").encode()) % shards if shards > 1 else 0

    def _spread(self, loaded: dict, shards: int, more: int) -> dict:
        """All customers of a window dealt over more shards."""
        dealt: dict = {s: {} for s in range(more)}
        for s in range(shards):
            for who, own in (loaded[s] if s in loaded else self._load(s)).items():
                dealt[self._shard(who, more)][who] = own
        return dealt

    def _pane(self, who, start: int, own: list, timing: str) -> Row:
        """The pane of what is held of a customer, which then holds that it was fired."""
        fired, settled = own[FIRED], own[SETTLED]
        own[FIRED] += 1
        if timing != "EARLY":
            own[SETTLED] += 1
            own[ON_TIME] = True
        return PANE(who, start, start + self.size, own[COUNT], own[TOTAL], fired, timing, -1 if timing == "EARLY" else settled, fired == 0, False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self._watermark(timerValues)
        start = key[1]
        end = start + self.size
        expiry = end + self.lateness
        if now is not None and now > expiry:
            return
        known = self.head.get()
        customers, shards = known or (0, 1)
        closed = now is not None and now >= end
        loaded: dict = {}
        changed: dict = {}
        for row in sorted(rows, key=ARRIVAL):
            who, event, amount = FIELDS(row)
            shard = self._shard(who, shards)
            if shard not in loaded:
                loaded[shard] = self._load(shard)
            own = loaded[shard].get(who)
            if own is None:
                own = loaded[shard][who] = [0, 0, 0, 0, False, [], False]
                customers += 1
            if closed and not own[ON_TIME] and own[COUNT]:  # timers fire after the rows of a batch
                yield self._pane(who, start, own, "ON_TIME")
            if event in own[IDS] or own[FURTHER] and self.seen.containsKey((who, event)):
                continue
            if len(own[IDS]) < self.shard_ids:
                own[IDS].append(event)
            else:
                own[FURTHER] = True
                self.seen.updateValue((who, event), (True,))
            own[COUNT] += 1
            own[TOTAL] += amount
            if closed:
                yield self._pane(who, start, own, "LATE")
            else:
                changed[who] = own
        if self.early:
            for who, own in changed.items():
                yield self._pane(who, start, own, "EARLY")
        more = shards
        while customers > 2 * more * self.shard_customers:
            more *= 4
        if more > shards:
            loaded = self._spread(loaded, shards, more)
        for shard, held in loaded.items():
            self._keep(shard, held)
        if known != (customers, more):
            self.head.update((customers, more))
        if not known:
            if not closed:
                self.handle.registerTimer(max(1, end - self.delay))
            self.handle.registerTimer(max(1, expiry - self.delay + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.head.get()
        if not known:
            return
        now = self._watermark(timerValues)
        start = key[1]
        end = start + self.size
        if now is None or now < end:
            return
        over = now > end + self.lateness
        for shard in range(known[1]):
            held = self._load(shard)
            fire = [(who, own) for who, own in held.items() if own[COUNT] and not own[ON_TIME]]
            for who, own in fire:
                yield self._pane(who, start, own, "ON_TIME")
            if fire and not over:
                self._keep(shard, held)
        if over:
            self.seen.clear()
            self.held.clear()
            self.head.clear()

    def close(self) -> None:
        pass


def panes(events: DataFrame, policy: WindowPolicy = WindowPolicy(), buckets: int = BUCKETS, shard_customers: int = SHARD_CUSTOMERS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """A streaming frame of panes (output mode update). Needs the RocksDB state store, which the session uses from here on."""
    delay = policy.size_seconds + policy.allowed_lateness_seconds + 1
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    bucket = F.pmod(F.xxhash64("customer_id"), F.lit(buckets)).cast("int")
    windowed = with_bounds(assign_windows(events.withWatermark("event_ts", f"{delay} seconds"), policy)).withColumn("bucket", bucket).select(*ROW)
    processor = PaneProcessor(policy.size_seconds * 1000, policy.allowed_lateness_seconds * 1000, policy.enable_early, delay * 1000, shard_customers, shard_ids)
    return windowed.groupBy("bucket", "window_start_ms").transformWithState(processor, PANES, "Update", "EventTime")
