"""Helpers shared by operators: table access and written cuts of lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the given folder; the schema comes from the file footers."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only in local mode, where driver and executors share
    one machine, a temporary folder stands in when the setting is absent.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='sievework-')}"
    spark.conf.set(CHECKPOINT_KEY, own)
    return own


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _forget() -> None:
    """Deletes the tables of this application when the driver ends; results stay readable until then."""
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the application is already gone; the folder's owner cleans up
            return


def forget_later(spark: SparkSession, path: str) -> None:
    _written.append((spark, path))


def materialise(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a compressed table into the shared folder and reads it back.

    Unlike ``checkpoint()`` the copy is columnar and compressed, so that later readers prune columns. A lost executor
    costs nothing, since the copy does not live on it. ``by`` names a column of few values that becomes a folder each, so
    that a filter on it reads the matching files only.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/sievework-{label}-{uuid.uuid4().hex}"
    forget_later(spark, path)
    writer = df.write.mode("error").option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Setting that names a number of partitions for tables of files and texts, for input that lies in too few parts.
SPREAD_KEY = "spark.sievework.spread"


def spread(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """``df`` over as many partitions as are asked for, by argument or by the setting ``SPREAD_KEY``; without either it stays
    as it is read. The hash of the keys spreads the rows, which a lost task repeats in the same way."""
    wanted = partitions or int(df.sparkSession.conf.get(SPREAD_KEY, "0"))
    return df.repartition(wanted, *keys) if wanted else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package known to the Python workers, once per application.

    Workers on this machine get its folder on their path; those of a cluster get the package as an archive.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent.parent
    if context.master.startswith("local"):
        known = context.environment.get("PYTHONPATH", "")
        if str(root) not in known.split(os.pathsep):
            context.environment["PYTHONPATH"] = os.pathsep.join([str(root), *([known] if known else [])])
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="sievework-"), "sievework"), "zip", root, "sievework")
    context.addPyFile(archive)
