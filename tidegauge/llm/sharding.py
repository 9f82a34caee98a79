"""Sharding by a hypergeometric communication matrix, with DataFrame functions only.

A uniform shuffle with exact shard sizes: rows fall into blocks, the matrix of how many rows each block
sends to each shard is drawn from the exact (multivariate hypergeometric) law, each block is permuted and
cut along its row of the matrix, rows are exchanged, and each shard is permuted again. Row counts of shards
differ by one at most (law ``rows``).

The matrix has blocks x shards counts, whatever the rows hold; blocks grow with the rows (one for
``BLOCK_ROWS``), so the driver draws and tells a few numbers for each. Permutations are orders by hash:
within a block by one hash, within a shard by another, there cut into stretches so that no task sorts a
whole shard. Hashes take in id, text checksum, size and, of rows that repeat all three, a number: so neither
equal ids nor equal rows gather in a block, and reruns agree whatever the partitions.

write_shards moves the rows themselves. Each gets a number of its own in a durable table, by which its shard and
slot find it again, whatever its doc_id.

Defined cases: a null text has 8 bytes and checksum 0, like an empty one; null and repeated doc_ids are
rows like any other; an empty table gives an empty result; other columns are not read, and are kept by write_shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable, numbered

SHARDS = 24
BLOCK_ROWS = 200_000
SEED = 7_070_707


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """counts[b, s] of a uniformly random deal of all rows, given the sums of both sides."""
    rng = np.random.default_rng(seed)
    left, out = np.array(shards, dtype=np.int64), np.zeros((len(blocks), len(shards)), np.int64)
    for b, n in enumerate(blocks):
        rest, need = int(left.sum()), int(n)
        for s in range(len(shards)):
            rest -= int(left[s])
            out[b, s] = rng.hypergeometric(left[s], rest, need) if need and left[s] and max(rest, left[s]) < 10**9 else _large(rng, int(left[s]), rest, need)
            need -= out[b, s]
        left -= out[b]
    return out


def _large(rng, good: int, bad: int, n: int) -> int:
    """Beyond the generator's range of 10**9: inversion of the same law, whose weights follow from the mode's by their ratios.

    Twelve standard deviations and fifty on both sides leave out less than a double can tell.
    """
    if not good or not n:
        return 0
    if not bad:
        return min(good, n)
    total, least, most = good + bad, max(0, n - bad), min(good, n)
    mode = min(most, max(least, (n + 1) * (good + 1) // (total + 2)))
    reach = int(12 * (n * good / total * bad / total * (total - n) / max(1, total - 1)) ** 0.5) + 50
    first, last = max(least, mode - reach), min(most, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    ratio = (good - k) / (k + 1) * ((n - k) / (bad - n + k + 1))  # of the weights of k + 1 and k
    at = mode - first
    weights = np.concatenate([np.cumprod(1 / ratio[:at][::-1])[::-1], [1.0], np.cumprod(ratio[at:])]).cumsum()
    return first + min(last - first, int(np.searchsorted(weights, rng.random() * weights[-1], side="right")))


def _compact(doc_id: str, text: str) -> list:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return [F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")]


def _dealt(table: DataFrame, key: list[str], shards: int, seed: int, block_rows: int) -> DataFrame:
    """shard and slot of each row of a durable table, whose key tells rows apart."""
    spark = table.sparkSession
    total = table.count()
    blocks = max(1, -(-total // block_rows))
    rows = table.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(blocks)).cast("int")).withColumn("h", F.xxhash64(F.lit(seed + 1), *key))
    sizes = {r.block: r.n for r in rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a block
    matrix = communication_matrix([sizes.get(b, 0) for b in range(blocks)], [total // shards + (s < total % shards) for s in range(shards)], seed)
    ends = spark.createDataFrame([(b, [int(x) for x in row]) for b, row in enumerate(matrix.cumsum(axis=1))], "block int, ends array<long>")
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy("h", *key)))
    placed = ranked.join(ends, "block").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("at"))))
    # the second permutation: by another hash, of which the upper part is the stretch of the shard
    stretches = max(1, -(-total // (shards * block_rows)))
    second = F.xxhash64(F.lit(seed + 2), *key)
    dealt = placed.select(*key, "shard", second.alias("h")).withColumn("stretch", F.floor(F.shiftrightunsigned("h", 33) * F.lit(stretches) / F.lit(2**31)).cast("int"))
    dealt = durable(dealt, "dealt")
    counts = dealt.groupBy("shard", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("shard", "stretch").orderBy("h", *key)) - 1)
    return own.join(before, ["shard", "stretch"]).select(*key, "shard", (F.col("before") + F.col("own")).alias("slot"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row."""
    table = durable(numbered(docs.select(*_compact(doc_id, text)), "nth"), "sharding")
    return _dealt(table, ["doc_id", "text_crc32", "size", "nth"], shards, seed, block_rows).drop("nth")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> None:
    """The shuffled rows themselves as Parquet folders shard=0 ..., sorted by slot within each file.

    If docs has a column named shard, the folders' name gets an underscore, or as many as make it new.
    """
    names = docs.columns
    folder = "shard"
    while folder in names:
        folder += "_"
    table = durable(docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("uid", F.monotonically_increasing_id()), "rows")
    where = durable(_dealt(table.select("uid"), ["uid"], shards, seed, block_rows), "places")
    moved = table.join(where, "uid").repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot")
    moved.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    found = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
