"""Session helpers: table access, shared checkpoint folder, written cut points."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context: what broadcasts and caches hold is imported there by name."""
    context = spark.sparkContext
    if getattr(context, "_inkloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    if package.suffix == ".zip" or not package.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="inkloom-")) / "inkloom_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, Path("inkloom") / source.relative_to(package))
    context.addPyFile(str(path))
    context._inkloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, one Parquet file or folder per table."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and Spark runs on this machine alone, a
    folder of this machine is used; it is then set on the context as well.  A
    cluster without a shared folder is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="inkloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder and reading it back.

    Unlike a local checkpoint the copy survives the loss of executors.  It is
    removed when the application ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of the shared folder that nobody uses, removed when the application ends."""
    path = f"{shared_dir(spark)}/inkloom/{label}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    # only paths that exist can be marked
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path
