"""Staging, warehouse and mart layers as Parquet, and their views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = ("staging", "dwh", "mart")


def table_name(name: str) -> str:
    """Letters, digits and _ in lower case; t_ before a digit; ValueError if nothing is left."""
    clean = re.sub(r"[^A-Za-z0-9_]+", "_", name).strip("_").lower()
    if not clean:
        raise ValueError(f"no table name in {name!r}")
    return f"t_{clean}" if clean[0].isdigit() else clean


def path_of(root: str, layer: str, name: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"layer must be one of {LAYERS}")
    return f"{root}/{layer}/{table_name(name)}"


def write(df: DataFrame, root: str, layer: str, name: str, mode: str = "overwrite", by: list[str] | None = None) -> str:
    path = path_of(root, layer, name)
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def register(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A view on what is at path."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(table_name(name))
    return df


def query(spark: SparkSession, sql: str) -> DataFrame:
    """A SQL statement over the registered views."""
    return spark.sql(sql)


def save_table(df: DataFrame, name: str, mode: str) -> None:
    if mode not in ("replace", "append"):
        raise ValueError("mode must be replace or append")
    df.write.mode("overwrite" if mode == "replace" else "append").saveAsTable(table_name(name))


def persist(targets: dict[tuple[str, str], Callable[[], DataFrame]], root: str, wanted: tuple[str, ...] = LAYERS) -> tuple[dict, dict]:
    """Writes each (layer, name) of the wanted layers; a target that fails doesn't stop the others. Paths and errors by target."""
    done, errors = {}, {}
    for (layer, name), make in targets.items():
        if layer in LAYERS and layer not in wanted:
            continue
        try:
            done[layer, name] = write(make(), root, layer, name)
        except Exception as e:  # noqa: BLE001  reported, not swallowed
            errors[layer, name] = str(e)
    return done, errors


def append(df: DataFrame, root: str, name: str) -> str:
    """Adds rows to an audit table (jobs, files, errors, quality, cleanup); columns that it lacks come later, as nulls in older rows."""
    path = f"{root}/audit/{table_name(name)}"
    df.write.mode("append").parquet(path)
    return path


def read_audit(spark: SparkSession, root: str, name: str) -> DataFrame:
    """An audit table with the columns of all its parts."""
    return spark.read.option("mergeSchema", True).parquet(f"{root}/audit/{table_name(name)}")


def export_workbook(tables: dict[str, DataFrame], root: str, by: tuple[str, ...] = ()) -> dict[str, str]:
    """Writes each table of a workbook, parted by the columns of by that it has (account, year); paths by table."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{root}/{table_name(name)}"
        own = [c for c in by if c in df.columns]
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*own) if own else writer).parquet(out[name])
    return out


def export_labels(labels: DataFrame, path: str, key: str, known: DataFrame | None = None) -> int:
    """Adds labels as JSON where their key isn't there yet; ValueError, and nothing is written, if one differs from what is. known: what path holds; None if it is new. The number of new rows."""
    from tallyspark.operators.accounts import differing

    if known is not None:
        changed = differing(labels, known.select(*labels.columns), key)
        if not changed.isEmpty():
            raise ValueError(f"labels differ from those written: {[r[0] for r in changed.limit(5).collect()]}")
        labels = labels.join(known.select(key), key, "left_anti")
    n = labels.count()
    labels.write.mode("append").json(path)
    return n


def cache_write(df: DataFrame, root: str, run: int = 0) -> None:
    """Parsed rows by document type, parser version and run; a run that is repeated is written anew. Files are very many, so they get no folders of their own."""
    df.withColumn("cache_run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_type", "parser_version", "cache_run").parquet(f"{root}/cache")


def cache_read(spark: SparkSession, root: str, document_type: str, version: str) -> DataFrame:
    """What is cached of a type and version, of each file's hash the rows of its last run; only these partitions are read."""
    every = spark.read.parquet(f"{root}/cache").where((F.col("document_type") == document_type) & (F.col("parser_version") == version))
    last = every.groupBy(F.col("source_file_hash").alias("_hash")).agg(F.max("cache_run").alias("_run"))
    return every.join(last, (F.col("source_file_hash") == F.col("_hash")) & (F.col("cache_run") == F.col("_run"))).drop("_hash", "_run", "cache_run")
