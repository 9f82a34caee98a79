"""The durable view of alerts: the highest revision of each key.

Keys lie in ``buckets`` by hash. A batch writes the buckets in which a revision was raised as Parquet under
``root/version=N/bucket=B`` and only then the small file ``root/COMMITTED.N``, which says for every bucket in which
version it lies. The highest complete one of these files holds, and none is taken away before the next is there: a
crash at any step leaves the state before or after the batch, readers never see half a snapshot, and a replayed batch changes
nothing. Everything goes through Hadoop's file system, so root may be any store. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.contract import kind, present, strict_json, unwrapped

SCHEMA = "idempotency_key string, revision bigint, alert_json string"
BUCKETS = 64
KEY_BLANK = "Kafka alert key must be a non-empty string"
KEY_MISMATCH = "Kafka alert key must match idempotency_key"
REVISION_WRONG = "alert revision must be a non-negative integer"
NULL_RECORD = "alert record must contain a non-null key and value"
NOT_AN_OBJECT = "alert value must be a JSON object"


def decode_alerts(envelope: DataFrame) -> DataFrame:
    """idempotency_key, revision, alert_json and arrival of alert records; a record that breaks the contract fails the query."""
    envelope.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last of equal keys holds
    key, value = F.col("key").cast("string"), F.col("value").cast("string")
    rows = envelope.withColumn("alert", F.when(F.is_valid_utf8(value), unwrapped(strict_json(value), value)))
    alert = F.col("alert")
    number = F.when(kind(F.try_variant_get(alert, "$.revision", "variant")) == "BIGINT", F.try_variant_get(alert, "$.revision", "bigint"))
    own = F.when(kind(F.try_variant_get(alert, "$.idempotency_key", "variant")) == "STRING", F.try_variant_get(alert, "$.idempotency_key", "string"))
    wrong = (
        F.when(F.col("key").isNull() | F.col("value").isNull(), F.lit(NULL_RECORD))
        .when(alert.isNull() | ~kind(alert).startswith("OBJECT"), F.lit(NOT_AN_OBJECT))
        .when(~F.is_valid_utf8(key) | ~present(key), F.lit(KEY_BLANK))
        .when(~own.eqNullSafe(key), F.lit(KEY_MISMATCH))
        .when(number.isNull() | (number < 0), F.lit(REVISION_WRONG))
    )
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(key)
    return rows.select(checked.alias("idempotency_key"), number.alias("revision"), value.alias("alert_json"), F.struct("partition", "offset").alias("arrival"))


def latest_alerts(alerts: DataFrame) -> DataFrame:
    """The highest revision of each key; of equal ones the first to arrive."""
    order = F.struct(F.col("revision").alias("r"), (-F.col("arrival.partition")).alias("p"), (-F.col("arrival.offset")).alias("o"))
    best = F.max_by(F.struct("revision", "alert_json"), order).alias("best")
    return alerts.groupBy("idempotency_key").agg(best).select("idempotency_key", "best.revision", "best.alert_json")


def merged(snapshot: DataFrame, alerts: DataFrame) -> DataFrame:
    """The snapshot after the alerts: what is stored stays unless a higher revision came."""
    new = latest_alerts(alerts).toDF("k", "r", "j")
    both = snapshot.join(new, F.col("idempotency_key") == F.col("k"), "full_outer")
    use = F.col("idempotency_key").isNull() | (F.col("r") > F.col("revision"))
    pick = lambda a, b: F.when(use & F.col("k").isNotNull(), F.col(a)).otherwise(F.col(b))
    return both.select(F.coalesce("idempotency_key", "k").alias("idempotency_key"), pick("r", "revision").alias("revision"), pick("j", "alert_json").alias("alert_json"))


def raised(alerts: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """idempotency_key, revision and arrival of the alerts that raised their key's revision, in order of arrival.

    Only the first arrival of each revision can: partial aggregation finds it, so a hot key is one row for each
    revision before anything is sorted.
    """
    first = alerts.groupBy("idempotency_key", "revision").agg(F.min("arrival").alias("arrival"))
    if snapshot is not None:
        first = first.join(snapshot.select("idempotency_key", F.col("revision").alias("stored")), "idempotency_key", "left").where("stored IS NULL OR revision > stored").drop("stored")
    before = F.max("revision").over(Window.partitionBy("idempotency_key").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    return first.withColumn("before", before).where("before IS NULL OR revision > before").drop("before")


def applied(alerts: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """alerts with applied: whether each, in order of arrival, raised its key's revision."""
    hit = raised(alerts, snapshot).withColumn("applied", F.lit(True))
    return alerts.join(hit, ["idempotency_key", "revision", "arrival"], "left").na.fill(False, ["applied"])


class AlertView:
    """The durable view at root."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        at = self._path(self.root)
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _commits(self) -> list[int]:
        return sorted(int(x.split(".")[1]) for x in self._names() if x.startswith("COMMITTED."))

    def version(self) -> int:
        return max(self._commits(), default=0)

    def _manifest(self, version: int) -> dict[int, int]:
        """The version in which each bucket lies."""
        if not version:
            return {}
        return {int(k): int(v) for k, v in (r[0].split() for r in self.spark.read.text(f"{self.root}/COMMITTED.{version}").collect() if r[0])}  # a line a bucket

    def _read(self, manifest: dict[int, int]) -> DataFrame:
        if not manifest:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.root}/version={v}/bucket={b}" for b, v in sorted(manifest.items())])

    def snapshot(self) -> DataFrame:
        return self._read(self._manifest(self.version()))

    def ordered(self) -> DataFrame:
        return self.snapshot().orderBy("idempotency_key")

    def upsert(self, alerts: DataFrame) -> int:
        """Take in decoded alerts; the number that raised a revision. Only buckets with such keys are read and written.

        The alerts are written beside the view first, so that what makes them (a stream's stateful step, most often) runs once.
        """
        for name in self._names():
            if name.startswith(".batch-"):  # of a writer that has crashed
                self._fs.delete(self._path(f"{self.root}/{name}"), True)
        at = f"{self.root}/.batch-{uuid.uuid4().hex}"
        try:
            rows = alerts.withColumn("bucket", F.pmod(F.xxhash64("idempotency_key"), F.lit(self.buckets)).cast("int"))
            rows.write.parquet(at)
            alerts = self.spark.read.schema(rows.schema).parquet(at)
            n = self.version()
            manifest = self._manifest(n)
            touched = {r.bucket for r in alerts.select("bucket").distinct().collect()}  # at most buckets
            higher = raised(alerts, self._read({b: v for b, v in manifest.items() if b in touched}))
            hit = F.pmod(F.xxhash64("idempotency_key"), F.lit(self.buckets)).cast("int")
            counts = {r.bucket: r.n for r in higher.groupBy(hit.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()}
            if counts:
                self._commit(n, manifest, alerts, sorted(counts))
            return sum(counts.values())
        finally:
            self._fs.delete(self._path(at), True)

    def _commit(self, n: int, manifest: dict[int, int], alerts: DataFrame, buckets: list[int]) -> None:
        before = self._read({b: v for b, v in manifest.items() if b in set(buckets)})
        now = merged(before, alerts.where(F.col("bucket").isin(buckets)).drop("bucket"))
        hit = F.pmod(F.xxhash64("idempotency_key"), F.lit(self.buckets)).cast("int")
        now.withColumn("bucket", hit).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/version={n + 1}")
        after = manifest | dict.fromkeys(buckets, n + 1)
        made = self._path(f"{self.root}/.COMMITTED.{n + 1}")
        out = self._fs.create(made, True)
        out.write(bytearray("".join(f"{b} {v}\n" for b, v in sorted(after.items())).encode()))
        out.close()
        if not self._fs.rename(made, self._path(f"{self.root}/COMMITTED.{n + 1}")):
            raise OSError(f"version {n + 1} of {self.root} was not committed")
        self._clean(n, set(manifest.values()) | set(after.values()))

    def _clean(self, before: int, held: set[int]) -> None:
        """Remove what neither this version nor the one before needs; readers under way still use that one."""
        for name in self._names():
            if name.startswith("COMMITTED.") and int(name.split(".")[1]) < before or name.startswith("version=") and int(name.split("=")[1]) not in held:
                self._fs.delete(self._path(f"{self.root}/{name}"), True)
