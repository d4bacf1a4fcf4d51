"""Streams of progress frames and captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.operators.dedup import first_wins


def conflated(frames: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Latest frame of each key (update or complete mode): state is one row a key."""
    return frames.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.max(order[0]).alias(order[0]))


def distinct_stream(rows: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """First row of each key within a watermark; state is dropped as the watermark passes."""
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def windowed(rows: DataFrame, time: str, late: str, size: str, slide: str | None, by: list[str], value: str) -> DataFrame:
    """Counts and sums by event-time window; rows later than ``late`` are dropped."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(rows: DataFrame, time: str, late: str, gap: str, key: str) -> DataFrame:
    """Sessions of each key: rows less than ``gap`` apart."""
    s = rows.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


#: Folders by key hash a keyed table is cut into.
BUCKETS = 64


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The finished versions of each bucket of a keyed table, in order."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    glob = jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")
    found: dict[int, list[int]] = {}
    for done in glob.getFileSystem(conf).globStatus(glob) or []:
        folder = done.getPath().getParent()
        for x in folder.getFileSystem(conf).listStatus(folder):
            if x.getPath().getName().startswith("bucket="):
                found.setdefault(int(x.getPath().getName().split("=")[1]), []).append(int(folder.getName().split("=")[1]))
    return {b: sorted(v) for b, v in found.items()}


def _buckets_of(spark: SparkSession, path: str, versions: dict[int, int], schema: T.StructType) -> DataFrame:
    folders = [f"{path}/v={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The rows a ``keyed_upsert`` has kept: each bucket in its latest version."""
    versions = {b: v[-1] for b, v in _versions(spark, path).items()}
    return spark.read.parquet(*[f"{path}/v={v}/bucket={b}" for b, v in sorted(versions.items())])


def keyed_upsert(path: str, key: Column, newest_by: list[str], buckets: int = BUCKETS):
    """A ``foreachBatch`` function that keeps the latest row of each key as Parquet under ``path``.

    Rows lie in ``buckets`` folders by the hash of their key.  Each batch writes
    version ``v=<batch id>`` of the buckets it touches, from the versions before
    it, so a repeated batch overwrites its own version and nothing is applied
    twice; versions older than the one a batch begins from are removed.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = {r[0] for r in batch.select(bucket.alias("b")).distinct().collect()}  # at most `buckets`
        earlier = {b: [v for v in versions if v < batch_id] for b, versions in _versions(spark, path).items() if b in touched}
        before = _buckets_of(spark, path, {b: v[-1] for b, v in earlier.items() if v}, batch.schema)
        kept = first_wins(before.unionByName(batch), [key], [F.col(c).desc() for c in newest_by])
        # one file a bucket: the rows of a bucket meet in one task anyway
        kept.withColumn("bucket", bucket).repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={batch_id}")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for b, versions in earlier.items():
            for v in versions[:-1]:
                old = jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}/bucket={b}")
                old.getFileSystem(conf).delete(old, True)

    return apply
