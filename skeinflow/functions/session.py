"""Session helpers: table access, shared checkpoint folder, guarded broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side whose size was counted may be broadcast.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "skeinflow-checkpoints")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *by: str, compression: str = "none") -> str:
    """Write ``df`` as Parquet into a new folder beside the checkpoints, one subfolder per value of ``by``; the folder's address.

    The folder goes when the application ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).partitionBy(*by).parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def kept(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` written once into the shared folder and read from there, so that each use reads only the columns it needs."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, compression=compression))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is proven to have at most ``rows`` rows, else as it is.

    The count evaluates ``df`` once more: give it a cut or a cheap input.
    """
    return F.broadcast(df) if len(df.select(F.lit(1)).limit(rows + 1).take(rows + 1)) <= rows else df
