"""Mixed timestamp notations to one instant in UTC.

Raw strings are deduplicated with their site's zone and date order into a
dictionary; each distinct value is parsed once, the dictionary is kept as a
Parquet folder that later batches only add to, and the parsed rules are joined
back to the rows, where the forms that lean on the record's own time (stated
distances, day words, dates without year) are resolved in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.text import let
from inkloom.functions.timeparse import parse_written
from inkloom.operators.skew import salted_lookup
from inkloom.session import written

KEYS = ["raw", "zone", "day_first"]
DICTIONARY_SCHEMA = T.StructType(
    [
        T.StructField("raw", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("day_first", T.BooleanType()),
        T.StructField("kind", T.StringType()),
        T.StructField("utc_sec", T.LongType()),
        T.StructField("distance_sec", T.LongType()),
        T.StructField("day_back", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("second_of_day", T.IntegerType()),
    ]
)
#: Years a date without year is looked for before the reference (29 February needs eight).
YEARS_BACK = 8


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    for batch in batches:
        keys = [batch.column(i) for i in range(3)]
        parsed = [parse_written(r, z, d) for r, z, d in zip(*(k.to_pylist() for k in keys))]
        columns = list(zip(*parsed)) if parsed else [[] for _ in types]
        yield pa.RecordBatch.from_arrays(keys + [pa.array(c, type=t) for c, t in zip(columns, types)], names=DICTIONARY_SCHEMA.names)


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, with or without scheme; NULL if there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@\s]*@)?([^/?#:\s]+)", 1))
    return F.when(host == "", None).otherwise(host)


class TimestampDictionary:
    """A growing dictionary of written times, kept as Parquet under ``path``.

    Batches are folders ``batch=N``; a batch holds only keys no earlier batch
    has, so nothing is parsed twice.  An unfinished batch has no ``_SUCCESS``
    and is overwritten by the next call.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.batches = 0

    def entries(self) -> DataFrame:
        """All entries so far."""
        if not self.batches:
            return self.spark.createDataFrame([], DICTIONARY_SCHEMA)
        return self.spark.read.schema(DICTIONARY_SCHEMA).parquet(*[f"{self.path}/batch={i}" for i in range(self.batches)])

    def open(self) -> TimestampDictionary:
        """Count the complete batches of an existing folder."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        while True:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={self.batches}/_SUCCESS")
            if not p.getFileSystem(conf).exists(p):
                return self
            self.batches += 1

    def update(self, keyed: DataFrame) -> DataFrame:
        """Parse the keys of ``keyed`` (columns raw, zone, day_first, n) that are new; returns all entries."""
        new = keyed
        if self.batches:
            known = self.entries().select(*[F.col(k).alias(f"__{k}") for k in KEYS])
            on = [keyed[k].eqNullSafe(F.col(f"__{k}")) for k in KEYS]
            new = keyed.join(known, on[0] & on[1] & on[2], "left_anti")
        parsed = new.select(*KEYS).mapInArrow(_parse_batches, DICTIONARY_SCHEMA)
        parsed.write.mode("overwrite").parquet(f"{self.path}/batch={self.batches}")
        self.batches += 1
        return self.entries()


def _local_to_utc(local_sec: Column, zone: Column) -> Column:
    """UTC second of a wall-clock second; NULL where the zone skipped it or showed it twice."""
    return let(local_sec, lambda local: _local_to_utc_once(local, zone))


def _local_to_utc_once(local_sec: Column, zone: Column) -> Column:
    utc = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local_sec), zone))

    def shows(sec: Column) -> Column:
        return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(sec), zone)) == local_sec

    twice = shows(utc + 3600) | shows(utc - 3600) | shows(utc + 1800) | shows(utc - 1800)
    return F.when(shows(utc) & ~twice, utc)


def _resolved(reference: Column) -> Column:
    """UTC second of a row from its dictionary rule and its reference second."""
    zone = F.col("zone")
    local_ref = F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(reference), zone))
    day_start = F.floor(local_ref / 86400) * 86400
    day_word = _local_to_utc(day_start - F.col("day_back") * 86400 + F.col("second_of_day"), zone)
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(local_ref / 86400).cast("int")))

    def candidate(back: Column) -> Column:
        date = F.try_to_date(F.format_string("%04d-%02d-%02d", (year - back).cast("int"), F.col("month"), F.col("day")), "yyyy-MM-dd")
        local = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.col("second_of_day")
        return F.when(local <= local_ref, local)

    latest = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(YEARS_BACK)), candidate))
    return (
        F.when(F.col("kind") == "instant", F.col("utc_sec"))
        .when(F.col("kind") == "distance", reference - F.col("distance_sec"))
        .when((F.col("kind") == "dayword") & zone.isNotNull(), day_word)
        .when((F.col("kind") == "yearless") & zone.isNotNull(), _local_to_utc(latest, zone))
    )


def normalise_times(
    rows: DataFrame,
    sites: DataFrame,
    dictionary: TimestampDictionary,
    *,
    id_col: str,
    time_col: str,
    url_col: str,
    reference: Column,
) -> DataFrame:
    """One row ``(id, utc_sec)`` per input row; ``utc_sec`` is NULL where no single instant is named.

    ``reference`` is the record's own time in UTC seconds, for "ago", day words
    and dates without year.  ``sites`` has host, zone, day_first, one row per
    host (of repeated hosts the least zone counts).  NULL and empty times, bare
    dates, impossible values, unknown sites with local times and missing
    references give NULL; ties and repeated rows each keep their row; other
    columns of ``rows`` are ignored, whatever their names.  An empty table gives
    an empty result.
    """
    site = sites.groupBy(F.lower(F.trim("host")).alias("__host")).agg(F.min(F.struct("zone", "day_first")).alias("__s"))
    site = site.select("__host", F.col("__s.zone").alias("zone"), F.col("__s.day_first").alias("day_first"))
    slim = rows.select(F.col(id_col).alias("__id"), F.col(time_col).alias("raw"), url_host(F.col(url_col)).alias("__h"), reference.cast("long").alias("__ref"))
    # white space around a value never matters: fewer distinct values
    slim = slim.withColumn("raw", F.nullif(F.regexp_replace("raw", r"^[\s 　]+|[\s 　]+$", ""), F.lit("")))
    named = slim.filter(F.col("raw").isNotNull())
    keyed_rows = named.join(site, F.col("__h") == F.col("__host"), "left").drop("__h", "__host")
    sizes = written(keyed_rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), "time-keys")
    entries = dictionary.update(sizes)
    joined = salted_lookup(keyed_rows, entries, KEYS, sizes, F.xxhash64("__id"))
    solved = joined.select(F.col("__id").alias(id_col), _resolved(F.col("__ref")).alias("utc_sec"))
    blank = slim.filter(F.col("raw").isNull()).select(F.col("__id").alias(id_col), F.lit(None).cast("long").alias("utc_sec"))
    return solved.unionByName(blank)
