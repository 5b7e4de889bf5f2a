"""Session helpers: shipping the package to executors and cutting lineage durably."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
#: Used only with a local master that names no spark.checkpoint.dir, as in tests.
FALLBACK_DIR = "file:///tmp/checkpoints/heron"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="heron-")
    target = os.path.join(folder, "heron_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted([*PACKAGE.rglob("*.py"), *PACKAGE.rglob("*.ttl")]):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by spark.checkpoint.dir."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Lineage ends at the written files, which any executor can read again, so a lost executor
    costs a re-read and not the work before it. The shuffle files behind it are let go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    free(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that cut() returned, once nothing that is still to run reads them, and let go of shuffle files."""
    free(frames[0].sparkSession)
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read through Spark's own file system layer."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases, whose frames are no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
