"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash over the last 16 bytes decides where chunks end, so the same passage is cut at the same places
whatever stands before it, and an insertion shifts nothing. Chunks of about 24 bytes are told apart by a
64-bit digest. Chunks that follow each other, and are repeats that follow each other in one other document too (or
earlier in the same one), make a passage; passages of at least ``MIN_BYTES`` are reported and cut out, shorter
ones are chance or common phrases. So a passage stands as a whole in the document named with it.

Pass one folds all digests into a counting filter of bounded size (op3's, with one slot a digest). Pass two
keeps chunks only where neighbours that the filter knows as repeats come to ``MIN_BYTES``: nothing else shuffles.
Of what is left, the document with the smallest doc_id keeps a chunk, by partial aggregation, so a passage in a third
of all documents costs a row for each task; the others are joined with it, and Spark may split large keys.
Passages are put together from rows sorted by document, one at a time. A filter at its bound takes more chunks for
repeats: these shuffle, find no keeper and go. They may lengthen a short stretch of repeats until it is looked at, and
so decide which of several documents is named for a chunk.

Defined cases: null and empty texts have no chunks. Rows of one doc_id, null included, count as one document
and do not repeat each other; equal rows of one doc_id are reported once. A null doc_id keeps a chunk only if no other
does. Offsets count UTF-8 bytes and never cut a character. Content without cuts (periodic, or one letter repeated) is
cut at the smallest hash of each ``MAX_CHUNK`` bytes. An empty table gives an empty result; other columns
are not read, and are kept by dedup_substrings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import ready
from .bloom import Shape, repeated_filter
from .shared import durable, forget, mix64, pick, random_table, release, text_array, text_buffer

WINDOW = 16
MEAN_CHUNK = 24
MIN_CHUNK = 8
MAX_CHUNK = 512
MIN_BYTES = 128
MAX_FILTER_BYTES = 64 << 20
SEGMENT = 8 << 20
_GEAR = (random_table(256, 5) >> np.uint64(32)).astype(np.uint32)


def _gear(raw: np.ndarray) -> np.ndarray:
    """The gear hash of the WINDOW bytes that end at each byte: sum of table[byte] << age."""
    h, age = _GEAR[raw], 1
    while age < WINDOW:
        h[age:] += h[:-age] << np.uint32(age)
        age *= 2
    return h


def chunk_ends(raw: np.ndarray) -> np.ndarray:
    """Ends of a text's chunks; none lies inside a UTF-8 character."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    found = []
    for begin in range(0, n, SEGMENT):  # a long text in stretches, each with the window before it
        first = max(0, begin - WINDOW + 1)
        h = _gear(raw[first : begin + SEGMENT])[begin - first :]
        found.append(np.flatnonzero(h < np.uint32(2**32 // MEAN_CHUNK)) + begin + 1)
    cut = np.concatenate(found)
    cut = cut[cut < n]
    cut = cut[(raw[cut] & 0xC0) != 0x80]
    if len(cut) and (np.diff(cut, prepend=0) < MIN_CHUNK).any():
        kept, last = [], 0
        for c in cut.tolist():
            if c - last >= MIN_CHUNK:
                kept.append(c)
                last = c
        cut = np.array(kept, np.int64)
    ends = np.append(cut, n)
    if (np.diff(ends, prepend=0) > MAX_CHUNK).any():
        out, last = [], 0
        for e in ends.tolist():
            while e - last > MAX_CHUNK:
                last = _least_cut(raw, last)
                out.append(last)
            out.append(e)
            last = e
        ends = np.array(out, np.int64)
    return ends


def _least_cut(raw: np.ndarray, last: int) -> int:
    """The end of the chunk from last, in content without cuts: the last place with the smallest hash that cuts no character."""
    first = max(0, last - WINDOW)
    at = np.arange(last + MIN_CHUNK, last + MAX_CHUNK + 1)
    h = _gear(raw[first : last + MAX_CHUNK])[at - 1 - first].astype(np.int64)
    h[(raw[at] & 0xC0) == 0x80] = 2**33
    return int(at[len(at) - 1 - h[::-1].argmin()])


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        offsets, raw = text_buffer(text_array(batch.column(2)))
        ends, digests = [], []
        for i in range(batch.num_rows):
            own = raw[offsets[i] : offsets[i + 1]]
            cut = chunk_ends(own)
            view = memoryview(own)
            at = cut.tolist()
            ends.append(cut.astype(np.uint32).tobytes())
            digests.append(np.fromiter((digest(view[a:b]) for a, b in zip([0, *at], at)), np.uint64, len(at)).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ends, pa.binary()), pa.array(digests, pa.binary())], names=["doc_id", "row", "ends", "digests"])


def _digests(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The digests of a batch's chunks, 256 texts at a time."""
    for first in range(0, batch.num_rows, 256):
        own = b"".join(batch.column(batch.num_columns - 1).slice(first, 256).to_pylist())
        if own:
            yield np.frombuffer(own, np.uint64)


#: A chunk's place: the lower bits of its text's hash, then its number in the text.
NUMBER_BITS = 24


def _long_runs(hit: np.ndarray, text: np.ndarray, size: np.ndarray, least: int) -> np.ndarray:
    """Which chunks lie in runs of hits, each in one text, of at least so many bytes."""
    begins = np.concatenate([[True], (hit[1:] != hit[:-1]) | (text[1:] != text[:-1])])
    run = np.cumsum(begins) - 1
    total = np.bincount(run, weights=size)
    return hit & (total[run] >= least)


def _spread(told, min_bytes: int, places: bool):
    """Chunks in long runs of repeats: with places a row for each, else one for each digest of a text. Equal rows of a task are looked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set = set()
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                part = whole.slice(first, 256)
                keys = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
                new = [k not in seen and not seen.add(k) for k in keys]
                part = part.filter(pa.array(new))
                digests = [np.frombuffer(x, np.uint64) for x in part.column(3).to_pylist()]
                count = np.array([len(x) for x in digests], np.int64)
                if not count.sum():
                    continue
                key = np.concatenate(digests)
                text = np.repeat(np.arange(part.num_rows), count)
                end = np.concatenate([np.frombuffer(x, np.uint32) for x in part.column(2).to_pylist()]).astype(np.int64)
                number = np.arange(len(end)) - np.repeat(np.cumsum(count) - count, count)
                start = np.where(number == 0, 0, np.roll(end, 1))
                at = np.flatnonzero(_long_runs(told.value.contains(key), text, end - start, min_bytes))
                if not len(at):
                    continue
                key, text, number = key[at], text[at], number[at]
                _, firsts, which, times = np.unique(mix64(key) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_inverse=True, return_counts=True)
                doc, row = part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text))
                if places:
                    again = firsts[which] != np.arange(len(key))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), doc, row, pa.array(number.astype(np.int32)), pa.array(start[at].astype(np.int32)), pa.array(end[at].astype(np.int32)), pa.array(again)], names=["digest", "doc_id", "row", "number", "start", "end", "again"])
                else:
                    place = (row.to_numpy().astype(np.int64) << NUMBER_BITS) + number
                    yield pa.RecordBatch.from_arrays([pa.array(key[firsts].view(np.int64)), doc.take(pa.array(firsts)), pa.array(place[firsts]), pa.array(times)], names=["digest", "doc_id", "place", "times"])

    return run


def _passages(min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # document, row, start, end, keeper; then number and place of the last chunk
        last = (-1, -1)
        for batch in batches:
            out = []
            for doc, row, number, start, end, keeper, place in zip(*(c.to_pylist() for c in batch.columns)):
                if now and now[0] == doc and now[1] == row:
                    if number == last[0]:  # the same chunk of an equal row
                        continue
                    if (number, place) == (last[0] + 1, last[1] + 1) and now[4] == keeper:
                        now[3], last = end, (number, place)
                        continue
                if now and now[3] - now[2] >= min_bytes:
                    out.append(now)
                now, last = [doc, row, start, end, keeper], (number, place)
            yield _rows(out, batch.schema)
        if now and now[3] - now[2] >= min_bytes:
            yield _rows([now], batch.schema)

    return run


def _rows(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    kinds = (schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), schema.field("first_doc_id").type)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "row", "start", "end", "first_doc_id"])


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """doc_id, row (hash of the text), start and end (UTF-8 bytes) of each passage that another document keeps, and that document, first_doc_id."""
    spark = ready(docs)
    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(*pick(docs, doc_id), F.xxhash64(F.col(f"`{text}`")).alias("row"), *pick(docs, text)).toDF("doc_id", "row", "text")
    chunks = durable(given.mapInArrow(_chunked, f"doc_id {kind}, row long, ends binary, digests binary"), "chunks")
    n = chunks.agg(F.sum(F.octet_length("digests"))).first()[0] or 0
    told = spark.sparkContext.broadcast(repeated_filter(chunks.select("digests"), _digests, Shape(n // 8, max_bytes=max_filter_bytes, probes=1)))
    stats = chunks.mapInArrow(_spread(told, min_bytes, False), f"digest long, doc_id {kind}, place long, times long")
    # of rows of one doc_id any may be named for a chunk; a place tells which
    keeper = stats.groupBy("digest").agg(F.sum("times").alias("n"), F.min("doc_id").alias("first_doc_id"), F.coalesce(F.min_by("place", "doc_id"), F.min("place")).alias("place"))
    shared = durable(keeper.where("n > 1").drop("n"), "repeated")
    hits = chunks.mapInArrow(_spread(told, min_bytes, True), f"digest long, doc_id {kind}, row long, number int, start int, end int, again boolean")
    found = hits.join(shared, "digest").where(F.col("again") | ~F.col("doc_id").eqNullSafe(F.col("first_doc_id")))
    ordered = found.select("doc_id", "row", "number", "start", "end", "first_doc_id", "place").repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "number")
    out = durable(ordered.mapInArrow(_passages(min_bytes), f"doc_id {kind}, row long, start long, end long, first_doc_id {kind}"), "passages")
    for done in (chunks, shared):
        forget(done)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(batch.num_columns - 2).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            if text is None or not spans:
                out.append(text)
                continue
            kept, at = [], 0
            for s in sorted(spans, key=lambda s: s["start"]):
                kept.append(text[at : s["start"]])
                at = s["end"]
            out.append(b"".join([*kept, text[at:]]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.binary()).cast(pa.string())], names=batch.schema.names[:-1])


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """The documents, all columns kept, with repeated passages cut out of their texts."""
    names = docs.columns
    spans = repeated_passages(docs, doc_id, text, min_bytes).groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    id_, body = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    joined = held.join(spans, F.col(id_).eqNullSafe(F.col("__id")) & (F.xxhash64(body) == F.col("__row")), "left")
    rest = [c for c in held.columns if c != body]
    schema = T.StructType([held.schema[c] for c in [*rest, body]])
    out = joined.select(*rest, body, "__spans").mapInArrow(_cut, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")
