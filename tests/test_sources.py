import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import detect, layouts, reports
from tallyspark.sources import files, layers
from tallyspark.streaming import incremental


def test_decoding(spark, tmp_path):
    for name, raw in {"a.txt": b"\xef\xbb\xbfabc", "b.txt": "é".encode(), "c.txt": "é€".encode("cp1252"), "d.txt": b"\x81x", "e.csv": b"no"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.source_file[-5:]: r.content for r in files.texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "abc", "b.txt": "é", "c.txt": "é€", "d.txt": "\x81x"}


def test_layers(spark, tmp_path):
    assert layers.table_name("1 My-Table!") == "t_1_my_table"
    with pytest.raises(ValueError):
        layers.path_of("r", "raw", "x")
    done, errors = layers.persist({("mart", "ok"): lambda: spark.range(3), ("dwh", "bad"): lambda: 1 / 0}, str(tmp_path))
    assert layers.register(spark, done["mart", "ok"], "ok").count() == 3 and list(errors) == [("dwh", "bad")]


def test_ingest_reads_each_file_once(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    source.mkdir()
    text = "No. Rekening : {}\nSALDO AWAL 1,000.00\n01/02/24 A B 100.00 DB 900.00\n"
    (source / "1.txt").write_text(text.format(1))
    incremental.ingest_statements(spark, str(source), out, marks)
    (source / "2.txt").write_text(text.format(2))
    incremental.ingest_statements(spark, str(source), out, marks)
    assert sorted(r.account for r in spark.read.parquet(out).collect()) == ["1", "2"]


def test_detection(spark):
    rows = [("BANK  CENTRAL\nASIA", "x", "BCA"), ("nothing", "x", None), ("LAPORAN TRANSAKSI FINANSIAL BANK MANDIRI", "x", "BRI"), ("BANK DKI BANK MANDIRI", "x", None), ("BANK DKI BANK MANDIRI", "mandiri.pdf", "Mandiri")]
    df = spark.createDataFrame(rows, "t string, f string, e string")
    assert [r[0] == r[1] for r in df.select(detect.detect_bank(F.col("t"), F.col("f")), "e").collect()] == [True] * len(rows)


def test_period_from_name(spark):
    df = spark.createDataFrame([("rek_2024-05.pdf",), ("Mutasi Mei 2023",), ("x",)], "n string")
    assert [tuple(r) for r in df.select(*files.period_from_name(F.col("n"))).collect()] == [(2024, 5), (2023, 5), (None, None)]


def test_audit_tables_grow_and_labels_are_never_overwritten(spark, tmp_path):
    root = str(tmp_path)
    layers.append(spark.createDataFrame([("j1", "running")], "job_id string, status string"), root, "Jobs")
    layers.append(spark.createDataFrame([("j1", "done", 3)], "job_id string, status string, files int"), root, "Jobs")
    assert {tuple(r) for r in layers.read_audit(spark, root, "jobs").select("job_id", "status", "files").collect()} == {("j1", "running", None), ("j1", "done", 3)}
    one = spark.createDataFrame([("a", 1)], "id string, n int")
    assert layers.export_labels(one, f"{root}/labels", "id") == 1
    known = spark.read.schema("id string, n int").json(f"{root}/labels")
    assert layers.export_labels(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"), f"{root}/labels", "id", known) == 1
    with pytest.raises(ValueError):
        layers.export_labels(spark.createDataFrame([("a", 9)], "id string, n int"), f"{root}/labels", "id", known)
    done, errors = layers.persist({("staging", "x"): lambda: one, ("mart", "y"): lambda: one, ("nowhere", "z"): lambda: one}, root, wanted=("staging",))
    assert list(done) == [("staging", "x")] and list(errors) == [("nowhere", "z")]
    layers.cache_write(spark.createDataFrame([("t", "1", "h", 5), ("t", "2", "h", 6)], "document_type string, parser_version string, source_file_hash string, n int"), root)
    assert [r.n for r in layers.cache_read(spark, root, "t", "2").collect()] == [6]
    paths = layers.export_workbook({"Summary": spark.createDataFrame([("a", 2024, 1)], "account string, year int, n int")}, root, ("account", "year"))
    assert spark.read.parquet(paths["Summary"]).where("account = 'a' AND year = 2024").count() == 1


def test_tables_are_replaced_or_added_to(spark):
    one, two = (spark.createDataFrame([(k, str(k))], "n int, t string") for k in (1, 2))
    spark.sql("DROP TABLE IF EXISTS saved_rows")
    try:
        layers.save_table(one, "Saved-Rows", "append")  # creates it
        layers.save_table(two, "saved_rows", "append")
        assert sorted(r.n for r in spark.table("saved_rows").collect()) == [1, 2]
        layers.save_table(two, "saved rows", "replace")
        assert [r.n for r in spark.table("saved_rows").collect()] == [2]
        with pytest.raises(ValueError):
            layers.save_table(one, "saved_rows", "upsert")
    finally:
        spark.sql("DROP TABLE IF EXISTS saved_rows")


def test_sheets_and_issues_of_a_workbook(spark, tmp_path):
    monthly = spark.createDataFrame([("a", 2024, 2, "f2"), ("a", 2023, 12, "f9"), ("a", 2024, 2, "f1"), ("a", 2024, 1, "f3")], "account string, year int, month int, source_file string")
    issues = spark.createDataFrame([("kol_range", "ERROR", 3)], "rule_name string, severity string, row_number int")
    got = layouts.sheets(monthly, issues)
    assert [r.source_file for r in got["Summary"].collect()] == ["f9", "f3", "f1", "f2"]
    assert [tuple(r) for r in got["Data_Quality"].collect()] == [("kol_range", "ERROR")]
    assert [tuple(r) for r in layouts.sheets(monthly, issues.where("1 = 0"))["Data_Quality"].collect()] == [("no_issues", "INFO")]
    root = str(tmp_path)
    summary = layers.export_workbook({"Summary": got["Summary"]}, root)["Summary"]
    added = layers.export_workbook({"Data_Quality": got["Data_Quality"]}, root)["Data_Quality"]  # a sheet more, the others stay
    assert spark.read.parquet(summary).count() == 4 and spark.read.parquet(added).count() == 1


def test_report_blocks_equal_plain_reading(spark):
    """Facilities and values of random lines, as rows of lines and as one array, against a loop over the lines."""
    random.seed(9)
    some = [*reports.START, *reports.END[:3], *reports.LABELS[:12], "value one", "  value   two ", "", "Rp 1,00"]
    docs = {f"d{k}": [random.choice(some) for _ in range(random.randint(0, 60))] for k in range(40)}
    want = {}
    for name, lines in docs.items():
        lines, block, own, ended = [" ".join(x.split()) for x in lines], 0, {}, False
        for line in filter(None, lines):
            if line in reports.START:
                block, ended = block + 1, False
            ended = ended or line in reports.END
            if block and not ended:
                own.setdefault(block, []).append(line)
        for b, held in own.items():
            values, at = {}, [i for i, x in enumerate(held) if x in reports.LABELS]
            for i, j in itertools.pairwise([*at, len(held)]):
                values.setdefault(held[i], " ".join(held[i + 1 : min(j, i + 5)]))
            want[name, b] = (held, values)
    rows = spark.createDataFrame([(n, i, x) for n, lines in docs.items() for i, x in enumerate(lines)], "source_file string, line_no int, line string")
    arrays = spark.createDataFrame(list(docs.items()), "source_file string, lines array<string>")
    for given in (rows.repartition(3), arrays):
        assert {(r.source_file, r.block): (r.lines, r["values"]) for r in reports.blocks(given).collect()} == want
