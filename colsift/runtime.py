"""Session-level helpers: table access, shared storage, code shipping, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: str | None = None
_SHIPPED: set[str] = set()
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where the setting is absent in local mode (tests) a folder of our own is made and
    removed when the driver ends; a cluster without the setting is an error, as its executors
    share no temporary folder.
    """
    global _OWN_DIR
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="colsift-")
        atexit.register(shutil.rmtree, _OWN_DIR, ignore_errors=True)
    return f"file://{_OWN_DIR}"


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder for a table that an operator writes."""
    path = f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove the tables that operators wrote into the shared folder; results that read them must be consumed before."""
    while _WRITTEN:
        remove(spark, _WRITTEN.pop())


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table that an operator wrote, through Spark's own file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: cuts lineage, keeps columns apart and packed."""
    path = shared_path(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run (once per session)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="colsift-zip-")) / "colsift.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    sc.addPyFile(str(out))
    atexit.register(shutil.rmtree, out.parent, ignore_errors=True)
    _SHIPPED.add(sc.applicationId)


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """Shuffle width of the session, at least ``least``."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
