"""Fixed schemas and the one way to conform a table to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "LONG": T.LongType(), "DATE": T.DateType(), "TIMESTAMP_NTZ": T.TimestampNTZType(), "MONEY": T.DecimalType(20, 2)}  # exact to the cent


def _schema(text: str) -> T.StructType:
    """'name TYPE, ...' without a session, which StructType.fromDDL would need."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(","))])


#: A credit facility as it is staged: text as it was read.
FACILITY = _schema(
    "source_file STRING, seq INT, nama STRING, nik_npwp STRING, bank STRING, penggunaan STRING, plafond STRING, baki_debet STRING, kol STRING, "
    "awal STRING, jatuh_tempo STRING, rate STRING, no_laporan STRING, keterangan STRING"
)
#: A transaction of a statement.
TRANSACTION = _schema(
    "source_file STRING, account STRING, tanggal DATE, keterangan STRING, kolom3 STRING, direction STRING, amount MONEY, db MONEY, cr MONEY, "
    "saldo MONEY, statement_block STRING, source_line INT, source_sequence INT"
)
ISSUE = _schema("source_file STRING, table_name STRING, rule_name STRING, severity STRING, column_name STRING, row_number INT, message STRING")
LEDGER = _schema("job_id STRING, file_name STRING, file_hash STRING, document_type STRING, parser_name STRING, parser_version STRING, status STRING, row_count LONG, processed_at TIMESTAMP_NTZ")
#: Other names of columns in older files.
ALIASES = {"nik_npwp": "nik"}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns: missing ones are null, others are dropped, values that can't be cast are null."""
    have = {c.lower(): c for c in df.columns}

    def column(f: T.StructField):
        found = have.get(f.name) or have.get(ALIASES.get(f.name, ""))
        return (F.col(f"`{found}`").try_cast(f.dataType) if found else F.lit(None).cast(f.dataType)).alias(f.name)

    return df.select(*(column(f) for f in schema.fields))


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with all columns of the schema: missing ones are added as nulls, its own others stay at the end."""
    have = {c.lower() for c in df.columns}
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in have]
    rest = [c for c in df.columns if c.lower() not in schema.names]
    return df.select("*", *more).select(*schema.names, *rest)
