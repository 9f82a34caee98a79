"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size says how often each of its documents is taken: the whole part surely, the
fraction as an inclusion probability. Flight: blocks of documents of one source move their probabilities
along the null space of two constraints, the document total and the word total, three documents at a time,
until each is 0 or 1 but for two. What blocks leave open meets in fewer, then in one, which flies on until
``LANDING`` documents are open. Landing: of all ways to round those, the one whose word and document totals
come nearest is taken.

Blocks depend on the documents' hashes and not on partitions, and are sorted and seeded by what they hold,
so reruns agree. Large documents fly first, so the few that are left to round are small. A hot source has many
blocks; each holds about ``BLOCK_ROWS`` compact rows, never texts. Words are counted by DataFrame functions.

Rows that repeat others (id, source and text) are numbered, so that they spread over blocks too. The mix itself
joins each document with its copies; rows that repeat others share what was drawn for all of them, told apart by
partition, so that none of their groups gathers in a task.

Defined cases: a null text has size 0; null sources form one source, ordered last; rows that repeat others
are drawn on their own. A source of size 0 has target 0. Null doc_ids are drawn like others. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import ready
from .shared import durable, join_groups, numbered, pick, release, word_count

#: The weights that sources take in turn, and the most that a target may be of its source.
WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_ROWS = 20_000
#: Blocks whose open documents meet in one at the next level.
FAN = 1000
LANDING = 12
#: A table of sources is collected to the driver; more than these raise an error.
MAX_SOURCES = 100_000
SEED = 20240607


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight, none above most times its size; what is above is shared again by weight."""
    left, out, open_ = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        rate = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if rate * weights[i] > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = rate * weights[i]
            break
        for i in above:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def fly(p: list[float], size: list[float], draw, stop: int) -> None:
    """Move p in place until at most stop of them are strictly between 0 and 1. Each move keeps sum(p) and sum(p * size), and the mean of each p."""
    waiting = iter([i for i, x in enumerate(p) if 0 < x < 1])
    open_ = sum(0 < x < 1 for x in p)
    hold: list[int] = []
    while open_ > stop:
        while len(hold) < 3:
            i = next(waiting, None)
            if i is None:
                return
            hold.append(i)
        a, b, c = hold
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, d in zip(hold, u):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, -p[i] / d), min(down, (p[i] - 1) / d)
        step = up if draw() * (up + down) < down else -down
        kept = []
        for i, d in zip(hold, u):
            p[i] += step * d
            if p[i] < 1e-9:
                p[i] = 0.0
            elif p[i] > 1 - 1e-9:
                p[i] = 1.0
            else:
                kept.append(i)
        open_ -= 3 - len(kept)
        hold = kept


def land(p: list[float], size: list[float]) -> None:
    """Round the few open p in place so that word and document totals come nearest."""
    at = [i for i, x in enumerate(p) if 0 < x < 1]
    if not at:
        return
    s, q = np.array([size[i] for i in at]), np.array([p[i] for i in at])
    ways = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    off = np.abs(ways @ s - q @ s) / max(1.0, s.mean()) + 0.05 * np.abs(ways.sum(1) - q.sum())
    for i, x in zip(at, ways[int(off.argmin())]):
        p[i] = float(x)


def _flown(seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        release()
        rows = rows.sort_values(["size", "h", "doc_id", "nth"], ascending=[False, True, True, True], kind="mergesort", na_position="last").reset_index(drop=True)
        last = bool(rows["blocks"].iloc[0] == 1)
        draw = np.random.default_rng([seed, int(key[0]), int(key[1]), int(rows["blocks"].iloc[0]), len(rows)]).random
        p, size = rows["p"].tolist(), rows["size"].astype(float).tolist()
        fly(p, size, draw, LANDING if last else 2)
        if last:
            land(p, size)
        return rows.assign(p=p)

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, source, h (hash of the row's id, source and text), size, source_size, target and copies of each row."""
    spark = ready(docs)
    id_kind = docs.schema[doc_id].dataType.simpleString()
    size = word_count(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    given = docs.select(*pick(docs, doc_id, source), F.xxhash64(F.lit(seed), *pick(docs, doc_id, source, text)), size).toDF("doc_id", "source", "h", "size")
    sized = durable(numbered(given.withColumn("source", F.col("source").cast("string")), "nth"), "sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    wanted = targets([r.size for r in found], [weights[i % len(weights)] for i in range(len(found))], most)
    plan = []
    for i, (r, t) in enumerate(zip(found, wanted)):
        rate = min(float(most), t / r.size) if r.size else 0.0
        base = int(rate + 1e-12)
        plan.append((i, r.source, r.size, t, base, max(0.0, rate - base), max(1, -(-r.n // block_rows))))
    table = spark.createDataFrame(plan, "sid int, source string, source_size long, target double, base long, p double, blocks long").withColumnRenamed("source", "of")
    units = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("of"))).drop("of")  # MAX_SOURCES rows at most
    cols = ["doc_id", "source", "h", "nth", "size", "source_size", "target", "base", "sid", "blocks", "block", "p"]
    now = units.withColumn("block", F.pmod(F.xxhash64("h", "nth"), "blocks")).select(*cols)
    schema = f"doc_id {id_kind}, source string, h long, nth long, size long, source_size long, target double, base long, sid int, blocks long, block long, p double"
    most_blocks = max([1, *(x[6] for x in plan)])
    done = None
    while True:
        now = durable(now.groupBy("sid", "block").applyInPandas(_flown(seed), schema), "flown")
        settled = now if most_blocks == 1 else now.where((F.col("p") == 0) | (F.col("p") == 1))
        done = settled if done is None else done.unionByName(settled)
        if most_blocks == 1:
            break
        now = now.where((F.col("p") > 0) & (F.col("p") < 1)).withColumns({"block": F.floor(F.col("block") / FAN), "blocks": F.ceil(F.col("blocks") / FAN)})
        most_blocks = -(-most_blocks // FAN)
    return done.select("doc_id", "source", "h", "size", "source_size", "target", (F.col("base") + F.col("p").cast("long")).alias("copies"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **more) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns. Equal rows share what was drawn for them."""
    names = docs.columns
    held = [f"c{i}" for i in range(len(names))]
    key = ["h", held[names.index(doc_id)]]
    drawn = durable(mix(docs, doc_id=doc_id, source=source, text=text, **more).select("h", F.col("doc_id").alias(key[1]), "copies"), "drawn")
    total = drawn.count()
    groups = drawn.groupBy(*key).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__n"))
    groups = durable(groups.where("__copies > 0 or __n > 1"), "copies")
    keyed = docs.select(*[c.alias(h) for c, h in zip(pick(docs, *names), held)], F.xxhash64(F.lit(more.get("seed", SEED)), *pick(docs, doc_id, source, text)).alias("h"))
    joined = join_groups(keyed, groups, key, "__n", total).where("__copies > 0")
    every = joined.where("__n = 1").select(*held, F.col("__copies").alias("__times"))
    if groups.where("__n > 1").limit(1).count():
        every = every.unionByName(_shared_out(joined.where("__n > 1"), key, held))
    return every.withColumn("__again", F.explode(F.array_repeat(F.lit(0), F.col("__times").cast("int")))).select(*[F.col(h).alias(c) for h, c in zip(held, names)])


def _shared_out(joined: DataFrame, key: list[str], held: list[str]) -> DataFrame:
    """Rows of groups of several with __times: of n equal rows each has copies // n, and the first ones have one more.

    Which are first is told by partition and place there: counts by partition first, then ranks within one.
    """
    rows = durable(joined.withColumn("__part", F.spark_partition_id()), "equal")
    counts = rows.groupBy(*key, "__part").agg(F.count(F.lit(1)).alias("__own"))
    before = F.coalesce(F.sum("__own").over(Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("__part").alias("__at"), before.alias("__before"))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*key, "__part").orderBy(F.lit(0))))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key] + [F.col("__part") == F.col("__at")]
    placed = ranked.join(starts, on)
    more = (F.col("__before") + F.col("__rank") <= F.col("__copies") % F.col("__n")).cast("long")
    return placed.select(*held, (F.floor(F.col("__copies") / F.col("__n")) + more).alias("__times"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    taken = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
