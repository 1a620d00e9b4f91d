"""What the operators of this subpackage share: reading, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import re
import secrets
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are what stands between these characters: space and \t to \r.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of (id, small value) that may be broadcast: about 32 MB, whatever the input's size.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, a temporary one on a single machine, and an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there; lineage ends in it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the file system that its path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else df: then Spark shuffles for the join.

    df must be cheap to count: a checkpoint, or a narrow scan.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_of(column: str = "text") -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: By application, the keys that were made because none is set.
_MADE_KEYS: dict[str, str] = {}


def pii_key(spark: SparkSession) -> str:
    """The secret key of surrogates, from spark.pii.key; where it is unset, a public one on a single machine, for test data, and on a cluster a random one, the same for the whole application."""
    context, key = spark.sparkContext, spark.conf.get("spark.pii.key", None)
    if key is None and not re.fullmatch(r"local(-cluster)?(\[.*\])?", context.master):
        key = _MADE_KEYS.setdefault(context.applicationId, secrets.token_hex(32))
    return key or "public test data"
