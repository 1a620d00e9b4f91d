"""Statement files as a stream: each new file is parsed once and appended, in batches that end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import isolation


def ingest_statements(spark: SparkSession, folder: str, out: str, checkpoint: str, errors: str | None = None) -> None:
    """Parses the folder's text files that were not met before into out; returns when they are done.

    Files that can't be read stop nothing: they give no rows, and say why in ``errors`` (by default
    beside out). The source remembers files by the checkpoint, so a second run reads only new ones. A
    batch overwrites its own part of both outputs, so one that is run again after a failure leaves no
    row twice. Spark's scans pass over files of no bytes, so these are in neither output.
    """
    schema = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(folder)
    beside = errors or f"{out.rstrip('/')}-errors"

    def batch(df: DataFrame, epoch: int) -> None:
        isolation.write(isolation.read_statements(df.select(F.col("path").alias("source_file"), "content")), out, beside, epoch)

    files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
