"""Files as tables: discovery, decoding, content hashes, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def binary(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """path, content, modificationTime, length of the folder's files with the suffix, at any depth."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(folder)


#: What Windows-1252 has for the bytes 0x80 to 0x9F, of which five are undefined.
_WINDOWS = {chr(x): bytes([x]).decode("cp1252") for x in range(0x80, 0xA0) if x not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def decoded(content: Column) -> Column:
    """UTF-8 (without a byte order mark) where the bytes are valid, else Windows-1252, else Latin-1."""
    latin = F.decode(content, "ISO-8859-1")
    windows = F.when(latin.rlike("[\\x81\\x8d\\x8f\\x90\\x9d]"), latin).otherwise(F.translate(latin, "".join(_WINDOWS), "".join(_WINDOWS.values())))
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(windows)
    return F.regexp_replace(text, "^﻿", "")


def texts(spark: SparkSession, folder: str, suffix: str = "txt") -> DataFrame:
    """source_file, file_hash, content."""
    return binary(spark, folder, suffix).select(F.col("path").alias("source_file"), F.sha2("content", 256).alias("file_hash"), decoded(F.col("content")).alias("content"))


def with_lineage(df: DataFrame, job_id: str, parser: str, version: str, cached: bool = False) -> DataFrame:
    return df.withColumns({"job_id": F.lit(job_id), "parser_name": F.lit(parser), "parser_version": F.lit(version), "loaded_from_cache": F.lit(cached)})


def without_lineage(df: DataFrame) -> DataFrame:
    return df.drop("job_id", "parser_name", "parser_version", "loaded_from_cache")


def period_from_name(name: Column) -> tuple[Column, Column]:
    """Year and month that a file's name tells, as in 'x_2024-05' or 'Mei 2024'; null if it tells none."""
    from tallyspark.functions.parsing import month_number

    # Digits inside a longer number, as an account's, are no year.
    year = F.regexp_extract(name, r"(?<!\d)(20\d{2})(?=(?:(?:0[1-9]|1[0-2])(?:\d{2})?)?(?!\d))", 1).try_cast("int")
    digits = F.regexp_extract(name, r"(?<!\d)20\d{2}[-_ .]?(0[1-9]|1[0-2])(?!\d)", 1).try_cast("int")
    words = F.filter(F.transform(F.split(name, "[^A-Za-z]+"), month_number), lambda m: m.isNotNull())
    return year, F.coalesce(digits, F.get(words, 0))


def account_from_name(name: Column) -> Column:
    """The first run of six digits or more that is no year and month; null if there is none."""
    runs = F.filter(F.regexp_extract_all(name, F.lit(r"(\d{6,})"), F.lit(1)), lambda x: ~x.rlike(r"^20\d{2}(?:0[1-9]|1[0-2])(?:\d{2})?$"))
    return F.get(runs, 0)


def metadata_from_path(path: Column) -> tuple[Column, Column, Column]:
    """Account, year and month that a file's name tells, else its folder's name."""
    parts = F.split(path, "/")
    name, folder = F.element_at(parts, -1), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    (y1, m1), (y2, m2) = period_from_name(name), period_from_name(folder)
    return F.coalesce(account_from_name(name), account_from_name(folder)), F.coalesce(y1, y2), F.coalesce(m1, m2)


def batches(paths: DataFrame, column: str) -> DataFrame:
    """account, year, paths (sorted) of the files that are one workbook."""
    account, year, _ = metadata_from_path(F.col(column))
    return paths.groupBy(account.alias("account"), year.alias("year")).agg(F.array_sort(F.collect_list(column)).alias("paths"))
