"""Queries against their SQL on rows that the generated tables seldom or never have."""

from datetime import datetime, timedelta
from decimal import Decimal

import duckdb
import pytest

from tallyspark.plans import pages, readers  # noqa: F401
from tallyspark.plans.queries import ORACLE_SQL, QUERIES
from tallyspark.sources import files

KINDS = ["click", "purchase", "error", "signup", "view"]


def folder(path, tables):
    """A folder of tables, and DuckDB with a view of each."""
    con = duckdb.connect()
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return str(path), con


def plain(v):
    return round(v, 6) if isinstance(v, float) else str(v)


def same(spark, made, name):
    """The query's rows, after they were found equal to the SQL's."""
    sf, con = made
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = df.collect()
    result = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[k]) for k in at) for r in result.fetchall())
    return rows


def events(rows):
    """SQL of events: (event_id, user_id, minute, kind, value)."""
    start = datetime(2024, 1, 2)
    each = ", ".join(f"({e}, {u}, TIMESTAMP '{start + timedelta(minutes=m)}', '{k}', {v}::DOUBLE, '')" for e, u, m, k, v in rows)
    return f"SELECT * FROM (VALUES {each}) AS t(event_id, user_id, ts, event_type, value, props)"


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """Keys of which account numbers are made that hold the digits of a year, or of a year and a month."""
    keys = "SELECT unnest([1, 2, 3, 2000, 2001, 2002, 20210, 12021, 200101, 200203, 920241])::BIGINT AS p_partkey"
    return folder(tmp_path_factory.mktemp("parts"), {"part": keys})


def test_batches_of_accounts_with_the_digits_of_a_year(spark, parts):
    assert {r.year for r in same(spark, parts, "batch_groups")} == {2021, 2022, 2023}


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """Accounts of which some have rows of no amount, on either side, at several places of the event's number."""
    rows = [(u * 100 + n, u, 700 * n + u, KINDS[(u + n) % 5], 0 if u % 3 != 2 and n in (5, 11, 12) else n + u / 100) for u in range(24) for n in range(1, 23)]
    return folder(tmp_path_factory.mktemp("zeros"), {"events": events(rows)})


ZERO_ROWS = [
    "side_repair_simple",
    "isolated_page_rows",
    "frames_union",
    "printed_months",
    "monthly_by_posting",
    "side_repair_gap",
    "best_reader",
    "read_mandiri",
    "read_bri",
    "read_bni",
]


@pytest.mark.parametrize("name", ZERO_ROWS)
def test_rows_of_no_amount(spark, zeros, name):
    assert same(spark, zeros, name)


def test_days_that_pass_a_balance_twice(spark, tmp_path):
    kinds = {"+": "view", "-": "purchase"}
    days = {0: "+5 -5 +3", 3: "+5 -5 +5", 6: "+1 +2 -1", 9: "+0 +0", 12: "+0 +4", 15: "+5 +3 -8", 18: "-9 +4 +3 -3", 21: "+2 +4 -9 +4 +5", 1: "+5 -5 +3"}
    rows = [(u * 100 + n, u, n, kinds[c[0]], c[1:]) for u, day in days.items() for n, c in enumerate(day.split())]
    got = same(spark, folder(tmp_path, {"events": events(rows)}), "same_day_order")
    assert {r.account: r.status for r in got} == {"100": "unresolved", "103": "printed", "106": "chained", "109": "printed", "1012": "unresolved", "1015": "chained", "1018": "chained", "1021": "chained", "101": "printed"}


def test_metadata_of_accounts_with_the_digits_of_a_year(spark, parts):
    assert len(same(spark, parts, "file_metadata")) == 11
    names = ["in/1200205/x.pdf", "in/2024/1200205_x.pdf", "x_202405.pdf", "x_20240531.pdf", "BNI2023 Mei.pdf", "2024-05.pdf", "scan.pdf"]
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    got = rows.select("path", *(c.alias(n) for c, n in zip(files.metadata_from_path(rows.path), ("account", "year", "month"), strict=True))).collect()
    assert {r.path: (r.year, r.month) for r in got} == dict(zip(names, [(None, None), (2024, None), (2024, 5), (2024, None), (2023, 5), (2024, 5), (None, None)], strict=True))


def test_a_table_of_part_files_is_one(spark, tmp_path):
    from tallyspark.plans import more

    one = spark.range(8)
    for name in more._NAMES:
        one.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    assert len(same(spark, (str(tmp_path), duckdb.connect()), "folder_scan")) == 14


def test_rows_without_amounts_and_an_unchanged_balance_go_to_the_marked_side(spark, zeros):
    rows = same(spark, zeros, "side_repair_swap")
    assert {(r.db is None, r.cr is None) for r in rows} == {(False, True), (True, False)}


def test_zeros_of_a_ledger_keep_the_side_of_their_sign(spark, zeros):
    rows = same(spark, zeros, "best_reader")
    assert {r.source_file for r in rows} == {f"BNI-{u}" for u in range(24)}
    assert {(r.debit is None, r.credit is None) for r in rows} == {(False, True), (True, False)}


def rates(spark, *values):
    from tallyspark.operators import dashboards

    return [tuple(r) for r in dashboards.rate_histogram(spark.createDataFrame([(v,) for v in values], "rate double"), bins=4, empty=True).orderBy("bin").collect()]


def test_a_histogram_has_all_its_bins_with_their_edges(spark):
    assert rates(spark, 0.0, 0.5, 0.5, 4.0, 3.0, None) == [(0, 0.0, 1.0, 3), (1, 1.0, 2.0, 0), (2, 2.0, 3.0, 0), (3, 3.0, 4.0, 2)]
    assert rates(spark, 2.0, 2.0, None) == [(0, 2.0, 2.0, 2)] and rates(spark, None) == []
