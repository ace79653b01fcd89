"""Reading the given tables, and writing intermediate tables that survive the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical_obs(col: Column) -> Column:
    """Observation ids are spelled with blanks, capitals or dashes; the canonical form has none of them."""
    return F.lower(F.trim(F.translate(col, "-", "_")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; only a local session may get its own."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="skydrift-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and what reads it
    twice doesn't compute it twice. Columnar and compressed, so it takes less disk than checkpoint().
    An application's tables are in one folder, which is deleted when its driver ends."""
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    if not getattr(spark.sparkContext, "_skydrift_tables", False):
        spark.sparkContext._skydrift_tables = True
        atexit.register(_delete, spark, home)
    path = f"{home}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._skydrift_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone already; the folder then stays
        pass


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more (the older states of a loop)."""
    path = getattr(df, "_skydrift_path", None)
    if path:
        _delete(df.sparkSession, path)
