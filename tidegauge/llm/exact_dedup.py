"""Exact dedup by two-pass Bloom filtering.

Pass one folds every text's hash into a blocked filter of saturating two-valued counters: a slot knows
whether no key, one or several have set it. Each map task sends the slots that it has set, block by block
and packed; the owner of a block merges them as they stream by. What remains is one bit per slot, "set by
several". Pass two holds each row against these bits: a row with any slot that only it has set is the only
one of its text and passes straight through; only the others shuffle and are grouped by their SHA-256.

The filter has 16 bits for each row and at most ``max_filter_bytes`` (64 MB unless told otherwise), which
bounds what is broadcast. A filter at its bound flags more single rows; they shuffle and come out the same.
Texts stay in the JVM: only two hashes of each go through Python, where the filter is made. A group's one
result row meets its rows by join_groups, so the rows of a very frequent text never gather in a task.

Defined cases: a null text counts as empty and equals an empty one. Texts are equal when their bytes are,
after lower-casing A-Z only. The row with the largest doc_id stays (null ids rank lowest); of rows that
repeat both text and doc_id exactly one stays. An empty table gives an empty result. Other columns, whatever
their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import ready
from . import bloom
from .shared import LETTERS, durable, join_groups, lowered, pick

MAX_FILTER_BYTES = 64 << 20


def digest(text: str) -> Column:
    """SHA-256 of the normalised text."""
    return F.unhex(F.sha2(lowered(F.coalesce(F.col(f"`{text}`"), F.lit(""))), 256))


def _maybe_repeated(frame: DataFrame, hashed: DataFrame, max_filter_bytes: int) -> tuple[DataFrame, int]:
    """frame (with __sha) and __maybe, false only for rows that are alone; and the rows of hashed, which has all rows' __sha."""
    ready(frame)
    n = hashed.count()
    shape = bloom.Shape(n, max_bytes=max_filter_bytes)
    blocks = durable(bloom.repeated_blocks(hashed.select(*bloom.spots("__sha")), shape), "filter")
    return bloom.flagged(frame, blocks, shape, "__maybe", "__sha"), n


def exact_dedup_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    table = durable(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), digest(text).alias("__sha")), "digests")
    marked, n = _maybe_repeated(table, table, max_filter_bytes)
    alone = marked.where(~F.col("__maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "__sha")
    again = marked.where("__maybe").drop("__maybe")
    groups = durable(again.groupBy("__sha").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "uid")).alias("best")), "groups")
    shared = join_groups(again, groups, ["__sha"], "group_size", n).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "__sha")
    return alone.unionByName(shared).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("__sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """The documents that stay, with all their columns; only possible repeats are shuffled, merged on the way by partial aggregation."""
    names = docs.columns
    hashed = durable(docs.select(digest(text).alias("__sha")), "digests")
    held = [f"c{i}" for i in range(len(names))]
    order = held[names.index(doc_id)]
    every = docs.select(*[c.alias(h) for c, h in zip(pick(docs, *names), held)], digest(text).alias("__sha"))
    marked, _ = _maybe_repeated(every, hashed, max_filter_bytes)
    alone = marked.where(~F.col("__maybe")).select(*held)
    # of rows with one text and one doc_id, the one with the largest hash of all columns stays
    again = marked.where("__maybe").groupBy("__sha").agg(F.max_by(F.struct(*held), F.struct(order, F.xxhash64(*held))).alias("row")).select("row.*")
    return alone.unionByName(again).select(*[F.col(h).alias(c) for h, c in zip(held, names)])


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), '{LETTERS[0]}', '{LETTERS[1]}') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
