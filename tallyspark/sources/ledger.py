"""The job ledger: append-only events; what is current is the latest by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def successes(ledger: DataFrame, document_type: str, parser: str, version: str) -> DataFrame:
    return ledger.where((F.col("status") == "success") & (F.col("document_type") == document_type) & (F.col("parser_name") == parser) & (F.col("parser_version") == version))


def to_parse(files: DataFrame, ledger: DataFrame, document_type: str, parser: str, version: str, force: bool = False) -> DataFrame:
    """Files whose content no success of this parser and version has."""
    return files if force else files.join(successes(ledger, document_type, parser, version), "file_hash", "left_anti")


def to_reuse(files: DataFrame, ledger: DataFrame, document_type: str, parser: str, version: str) -> DataFrame:
    return files.join(successes(ledger, document_type, parser, version), "file_hash", "left_semi")


def latest_by_hash(ledger: DataFrame) -> DataFrame:
    """The latest success of each content; ties by file name."""
    place = F.row_number().over(Window.partitionBy("file_hash").orderBy(F.desc("processed_at"), F.desc("file_name")))
    return ledger.where("status = 'success'").withColumn("_place", place).where("_place = 1").drop("_place")


def job_status(ledger: DataFrame) -> DataFrame:
    """Files, failures, rows and status of each job."""
    counts = ledger.groupBy("job_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("row_count").alias("rows"))
    return counts.withColumn("status", status(F.col("files"), F.col("failed")))


def status(files: Column, failed: Column) -> Column:
    return F.when(failed == 0, "success").when(failed < files, "partial_success").otherwise("failed")


def history(ledger: DataFrame, limit: int = 50) -> DataFrame:
    return ledger.orderBy(F.desc("processed_at"), F.desc("file_name")).limit(limit)


def event(entries: DataFrame, name: str, seq: int) -> DataFrame:
    """Audit rows to append for entries: what happened (running, done, failed, cleaned) and its place in the order of events."""
    return entries.select("job_id", "file_name", "row_count", F.lit(name).alias("event"), F.lit(seq).alias("seq"))


def current(events: DataFrame) -> DataFrame:
    """The last event of each job and file."""
    place = F.row_number().over(Window.partitionBy("job_id", "file_name").orderBy(F.desc("seq"), "event"))
    return events.withColumn("_place", place).where("_place = 1").drop("_place")
