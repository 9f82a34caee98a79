"""Blocked Bloom filters: keys are 64-bit hashes, every key's bits lie in one block.

Two kinds are made here. key_filter knows the keys it was given. repeated_blocks knows the slots that several
keys have set: a key with a slot of its own came once. Tasks send the slots they set, packed by block, and the
owner of a block merges them as they stream by, so a filter costs a few bytes a key to make.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mix64

BLOCK_BITS = 1 << 16
#: Bits set for a key, unless told otherwise; four places of 16 bits fit into 64.
PROBES = 4
#: Keys that a task holds before it sends the slots they set.
KEYS_HELD = 1 << 20


class Shape:
    """Number of blocks for a number of keys, within a bound in bytes. A filter at its bound only flags more keys."""

    def __init__(self, keys: int, bits_per_key: int = 16, max_bytes: int = 64 << 20, probes: int = PROBES):
        wanted = max(1, math.ceil(keys * bits_per_key / BLOCK_BITS))
        self.blocks, self.probes = max(1, min(wanted, max_bytes * 8 // BLOCK_BITS)), probes

    def block_of(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) % np.uint64(self.blocks)).astype(np.int64)

    def bits_of(self, keys: np.ndarray) -> np.ndarray:
        """(keys, probes) positions inside the block."""
        return places_of(mix64(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)), self.probes)


def places_of(spots: np.ndarray, probes: int) -> np.ndarray:
    """(keys, probes) positions that 64-bit values stand for, 16 bits each."""
    return np.stack([(spots >> np.uint64(16 * i)) & np.uint64(BLOCK_BITS - 1) for i in range(probes)], axis=1).astype(np.int64)


def packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """A whole filter as one array of bytes; contains() takes many keys at once."""

    def __init__(self, shape: Shape, parts: list[tuple[int, bytes]]):
        self.shape = shape
        table = np.zeros((shape.blocks, BLOCK_BITS // 8), np.uint8)
        for block, data in parts:
            table[block] = np.frombuffer(data, np.uint8)
        self.table = table

    def contains(self, keys: np.ndarray) -> np.ndarray:
        block, hit = self.shape.block_of(keys), np.ones(len(keys), bool)
        bits = self.shape.bits_of(keys)
        for i in range(self.shape.probes):
            at = bits[:, i]
            hit &= (self.table[block, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return hit


Sent = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]


def _slots(sent: Sent):
    """Slots that a task's keys set: block, slots (16 bits each) and whether several of the task's keys set each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def send() -> pa.RecordBatch:
            slot, n = np.unique(np.concatenate(held), return_counts=True)
            block, at = slot // BLOCK_BITS, (slot % BLOCK_BITS).astype(np.uint16)
            cut = np.flatnonzero(np.diff(block)) + 1
            rows = [(int(b[0]), a.tobytes(), np.packbits(m > 1).tobytes()) for b, a, m in zip(np.split(block, cut), np.split(at, cut), np.split(n, cut))]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["block", "slots", "several"])

        for batch in batches:
            for block, places in sent(batch):
                slots = (block * BLOCK_BITS)[:, None] + places
                slots.sort(axis=1)
                held.append(slots[np.concatenate([np.ones((len(slots), 1), bool), slots[:, 1:] != slots[:, :-1]], axis=1)])  # a key's equal slots count once
                size += len(slots)
                if size >= KEYS_HELD:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    return run


def _merged(repeats: bool):
    """The bits of each block, from rows sorted by block: slots that were set, or with repeats those set by several keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, more = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.frombuffer(packed(more if repeats else once), "<i8")], pa.list_(pa.int64()))], names=["block", "words"])

        for batch in batches:
            for block, slots, several in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    if now is not None:
                        yield done()
                    now, once, more = block, np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
                at = np.frombuffer(slots, np.uint16)
                more[at] |= once[at] | np.unpackbits(np.frombuffer(several, np.uint8), count=len(at)).astype(bool)
                once[at] = True
        if now is not None:
            yield done()

    return run


def _blocks(keys: DataFrame, sent: Sent, repeats: bool) -> DataFrame:
    slots = keys.mapInArrow(_slots(sent), "block long, slots binary, several binary")
    return slots.repartition("block").sortWithinPartitions("block").mapInArrow(_merged(repeats), "block long, words array<long>")


def _collected(blocks: DataFrame, shape: Shape) -> Filter:
    # at most shape.blocks rows of 8 KB: the bound that shape was made with
    return Filter(shape, [(r.block, np.array(r.words, "<i8").tobytes()) for r in blocks.toLocalIterator()])


def key_filter(keys: DataFrame, n: int, max_bytes: int) -> Filter:
    """A filter of a long column, at most max_bytes large; each block reaches the driver once."""
    shape = Shape(n, max_bytes=max_bytes)

    def sent(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if batch.num_rows:
            own = batch.column(0).to_numpy().view(np.uint64)
            yield shape.block_of(own), shape.bits_of(own)

    return _collected(_blocks(keys, sent, False), shape)


def repeated_filter(frame: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], shape: Shape) -> Filter:
    """A filter of the 64-bit keys that hashes finds more than once in the frame's batches, and a few that came once."""

    def sent(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for own in hashes(batch):
            yield shape.block_of(own), shape.bits_of(own)

    return _collected(_blocks(frame, sent, True), shape)


def spots(*columns: str) -> tuple[Column, Column]:
    """Two hashes of columns, by which DataFrame functions look a key up: one for its block, one for its places there."""
    return F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)


def repeated_blocks(keys: DataFrame, shape: Shape) -> DataFrame:
    """block and words (64 bits each) of the slots that several keys set. keys: the two columns of spots()."""

    def sent(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if batch.num_rows:
            yield np.mod(batch.column(0).to_numpy(), shape.blocks), places_of(batch.column(1).to_numpy().view(np.uint64), shape.probes)

    return _blocks(keys, sent, True)


def flagged(frame: DataFrame, blocks: DataFrame, shape: Shape, name: str, *columns: str) -> DataFrame:
    """frame with a column name: whether the blocks of repeated_blocks have all slots of the columns' key. The blocks are broadcast: at most shape.blocks of 8 KB."""
    block, places = spots(*columns)
    keyed = frame.withColumns({"__block": F.pmod(block, F.lit(shape.blocks)), "__places": places})
    joined = keyed.join(F.broadcast(blocks), F.col("__block") == F.col("block"), "left")
    hit = F.lit(True)
    for i in range(shape.probes):
        at = F.shiftrightunsigned("__places", 16 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")
        hit = hit & (F.bit_get(F.get("words", F.shiftright(at, 6)), at.bitwiseAND(F.lit(63))) == 1)
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__block", "__places", "block", "words")
