"""Helpers that the training-data operators share: durable tables and vectorised text bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words, and a word with the breaks before it.
WORD_BREAKS = (9, 10, 11, 12, 13, 32)
BREAKS_AND_WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"

LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Groups that are broadcast because they are large: at most so many, since each holds that part of all rows.
LARGE_GROUPS = 4096
#: Equal rows that are made again at once.
STRETCH = 100_000

IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[list(WORD_BREAKS)] = True


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir. Where none is set, a local one serves a session of one machine; elsewhere that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        path = "file://" + tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_WRITTEN: WeakKeyDictionary = WeakKeyDictionary()


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and survives lost executors.

    The folder is removed when the driver's JVM ends, or by forget().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, files = _path(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def forget(df: DataFrame) -> None:
    """Remove the folder of a durable frame that nothing reads any more."""
    target, files = _path(df.sparkSession, _WRITTEN.pop(df))
    files.delete(target, True)


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII only, most often, take the short way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, *LETTERS))


def word_count(text: Column) -> Column:
    """Words of a text without null: each, with the breaks before it, becomes one letter, so memory is that of the text."""
    trimmed = F.rtrim(text, F.lit("".join(map(chr, WORD_BREAKS))))
    return F.octet_length(F.regexp_replace(trimmed, BREAKS_AND_WORD, "w")).cast("long")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows with the columns of their group's one row; keys may be null.

    Groups of more than one in LARGE_GROUPS of all rows are broadcast (there can't be more of them than that), so
    no task gets a large group whole; the others are joined by shuffle.
    """
    least = max(2, total // LARGE_GROUPS)
    named = groups.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    drop = [f"__{k}" for k in keys]
    every = rows.join(F.broadcast(named.where(F.col(size) >= least)), on, "left")
    rest = every.where(F.col(size).isNull()).select(*rows.columns).join(named.where(F.col(size) < least), on)
    return every.where(F.col(size).isNotNull()).drop(*drop).unionByName(rest.drop(*drop))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Compact rows with a number (column name: 0, 1 ...) among the rows that equal them in all columns.

    Equal rows are counted, by partial aggregation, and made again, STRETCH of them in a task at most. So numbers
    depend on the rows alone, and later steps can tell and spread rows that are equal.
    """
    columns = rows.columns
    counts = durable(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")), "counts")
    once = counts.where("__n = 1").select(*columns, F.lit(0).cast("long").alias(name))
    again = counts.where("__n > 1").withColumn("__first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(STRETCH).cast("long"))))
    again = again.repartition(*columns, "__first").withColumn(name, F.explode(F.sequence(F.col("__first"), F.least(F.col("__n"), F.col("__first") + STRETCH) - 1)))
    return once.unionByName(again.select(*columns, name))


def pick(df: DataFrame, *names: str) -> list:
    """Columns by exact name, whatever other columns there are."""
    return [F.col(f"`{n}`") for n in names]


def text_array(column: pa.Array) -> pa.Array:
    """A column of texts with nulls as empty texts."""
    return pc.fill_null(column, "")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array without nulls; offsets count from the first byte given."""
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offs else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_table(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


#: What a Python worker remembers between tasks: one operator's memo at a time.
_MEMO: dict = {}


def memo(key, make):
    """The memo of that key, made anew if the worker holds another's."""
    if key not in _MEMO:
        release()
        _MEMO[key] = make()
    return _MEMO[key]


def release() -> None:
    """Forget another operator's memo and give free memory back to the system; workers outlive stages."""
    _MEMO.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only this C library has it
        pass
