from datetime import datetime
from decimal import Decimal as D

from tallyspark.operators import layouts


def run(spark, bank, *pages):
    rows = [("f", p, i, line) for p, page in enumerate(pages, 1) for i, line in enumerate(page.split("\n"), 1)]
    return layouts.read(spark.createDataFrame(rows, "source_file string, page int, line_no int, line string"), layouts.LAYOUTS[bank]).orderBy("source_row").collect()


def test_bca(spark):
    page = "REKENING GIRO\n TANGGAL KETERANGAN CBG MUTASI SALDO\n 01/01 SALDO AWAL 1,000.00\n 02/01 TRSF 100.00 X 0000 30.00 DB 970.00\n  LANJUT\n 03/01 BUNGA 10.00\nBersambung ke halaman\nlost"
    got = run(spark, "BCA", page, "TANGGAL KETERANGAN CBG MUTASI SALDO\n 04/01 SETOR 1.00 981.00")
    assert [(r.tanggal, r.keterangan, r.debit, r.credit, r.balance, r.page) for r in got] == [
        ("02/01", "TRSF 100.00 X 0000 LANJUT", D("30.00"), None, D("970.00"), 1), ("03/01", "BUNGA", None, D("10.00"), None, 1), ("04/01", "SETOR", None, D("1.00"), D("981.00"), 2)
    ]


def test_bri(spark):
    page = "Tanggal Transaksi Uraian Transaksi Teller\n01/02/24 10:11:12 BIAYA ADM   ABC123   5.00 0.00 95.00\n  lanjutan\n02/02/24 10:11:12 X 0.00 0.00\nSaldo Awal 1"
    got = run(spark, "BRI", page)
    assert (got[0].keterangan, got[0].debit, got[0].credit, got[0].balance, got[0].posting) == ("BIAYA ADM lanjutan", D("5.00"), None, D("95.00"), datetime(2024, 2, 1, 10, 11, 12))
    assert got[1].error == "missing amounts"


def test_bni(spark):
    head = "Tanggal & Waktu      Rincian                  Nominal (IDR)   Saldo (IDR)"
    got = run(spark, "BNI", f"{head}\nSaldo Awal 5\n05 Feb 2024   Transfer                 -1,000     9,000\n10:11:12 WIB  ke Budi                            xx\n06 Feb 2024   Masuk      +50.25   9,050.25\nInformasi Lainnya\nzzz")
    assert [(r.keterangan, r.debit, r.credit, r.balance) for r in got] == [("Transfer ke Budi", D("1000.00"), None, D("9000.00")), ("Masuk", None, D("50.25"), D("9050.25"))]


def test_mandiri(spark):
    got = run(spark, "Mandiri", "05/02/2024 10:11:\n12\nTRANSFER ONE\nREF -  20.00 0.00 80.00\nfooter", "06 Feb 2024,\n10:00:00\nWRAPPED\nREMARK 0.00 20.00 100.00\n07 Feb 2024,\n09:00:00\nunfinished")
    assert [(r.keterangan, r.debit, r.credit, r.balance, r.posting) for r in got[:2]] == [
        ("TRANSFER ONE REF", D("20.00"), None, D("80.00"), datetime(2024, 2, 5, 10, 11, 12)), ("WRAPPED REMARK", None, D("20.00"), D("100.00"), datetime(2024, 2, 6, 10, 0, 0))
    ]
    assert got[2].error == "missing amounts"


def test_dki_of_two_accounts(spark):
    got = run(spark, "DKI", "TABUNGAN MONAS BISNIS - 111\n05 Feb 24 10:11  Tarik DEBIT 5.00 95.00\n lagi\nTAB MONAS - 222\nnot this\n06 Feb 24 10:11  Setor KREDIT 1.00 2.00\nDISCLAIMER\nno")
    assert [(r.account, r.keterangan, r.debit, r.credit) for r in got] == [("111", "Tarik lagi", D("5.00"), None), ("222", "Setor", None, D("1.00"))]
