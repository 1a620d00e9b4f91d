"""Text of credit reports and printed recaps: blocks, labelled values, facilities."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import parsing as P

CREDIT, GUARANTEE = "Kredit/Pembiayaan", "Bank Garansi"
START = [CREDIT, GUARANTEE]
END = ["Agunan", "Penjamin", "Irrecovable L/C", "Surat Berharga", "Fasilitas Lain", "Nomor Laporan", "Operator"]
#: Labels that end a value (fixed values).
LABELS = [
    "Kredit/Pembiayaan", "No Rekening", "Kualitas", "Kualitas / Jumlah", "Kualitas / Jumlah Hari", "Kualitas / Jumlah Hari Tunggakan", "Hari Tunggakan", "Pelapor", "Cabang", "Baki Debet", "Tanggal Update", "No Akad Akhir",
    "Sebab Macet", "Kredit Program Pemerintah", "Cara Restrukturisasi", "Kab/Kota Lokasi Proyek", "Kondisi", "Sektor Ekonomi", "Tanggal Restrukturisasi Akhir", "Suku Bunga/Imbalan", "Jenis Suku Bunga/Imbalan", "No Akad Awal",
    "Realisasi/Pencairan Bulan Berjalan", "Tanggal Awal Kredit", "Tunggakan Pokok", "Kategori Debitur", "Denda", "Valuta", "Tanggal Kondisi", "Jenis Kredit/Pembiayaan", "Nilai Proyek", "Keterangan", "Nama Yang Dijamin", "Nama LJK",
    "Nominal", "Tanggal Mulai", "Tunggakan Bunga", "Tanggal Akad Akhir", "Tanggal Macet", "Tanggal Diterbitkan", "Tanggal Wan Prestasi", "Sifat Kredit/Pembiayaan", "Jumlah Hari Tunggakan", "Akad Kredit/Pembiayaan", "Plafon Awal",
    "Jenis Penggunaan", "Jenis Garansi", "Tujuan Garansi", "Setoran Jaminan", "Frekuensi Restrukturisasi", "Frekuensi Perpanjangan Kredit/", "Pembiayaan", "Plafon", "Tanggal Jatuh Tempo", "Frekuensi Tunggakan", "Tanggal Akad Awal",
    "Nilai dalam Mata Uang Asal",
]


def split(texts: DataFrame) -> DataFrame:
    """source_file, lines (array) of texts (source_file, content)."""
    return texts.select("source_file", F.split("content", "\n").alias("lines"))


def documents(lines: DataFrame) -> DataFrame:
    """source_file, lines: the lines of each document in order, as one array."""
    return lines.groupBy("source_file").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))


def blocks(lines: DataFrame, most: int = 4) -> DataFrame:
    """source_file, block, lines (array) and values of each facility; lines: source_file, line_no, line, or a document's lines as one array, or its text (content).

    A facility goes from a start label to the next one or to a section's end. values: label to the
    lines after its first place up to the next label, at most so many, as one text.
    """
    row = lambda block, held, values: (block, held, list(values.items()))
    return _read(lines, "block bigint, lines array<string>, values map<string, string>", pa.schema([("block", pa.int64()), ("lines", pa.list_(pa.string())), ("values", pa.map_(pa.string(), pa.string()))]), row, most)


def _read(lines: DataFrame, columns: str, schema: pa.Schema, row: Callable[[int, list[str], dict[str, str]], tuple], most: int = 4, kinds: Iterable[str] = START) -> DataFrame:
    """source_file and columns: row() of each facility of these kinds. A document is one row, and nothing is shuffled after its lines are gathered (not at all if they come as one array or text)."""
    if "content" in lines.columns:
        docs = lines.select("source_file", "content")
    else:
        held = documents(lines) if "line_no" in lines.columns else lines
        docs = held.select("source_file", F.array_join(F.transform("lines", lambda x: F.translate(x, "\n", " ")), "\n").alias("content"))
    whole, wanted = pa.schema([("source_file", pa.string()), *schema]), frozenset(kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(at, DOCUMENTS)
                found = [(name, *row(*x)) for name, text in zip(*(c.to_pylist() for c in part.columns)) for x in cut(text, most, wanted)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * len(whole), whole)], schema=whole)

    return docs.mapInArrow(read, f"source_file string, {columns}")


#: Documents whose facilities are held at a time.
DOCUMENTS = 1000
#: What clean lines don't have, and what becomes one space.
_UNCLEAN = re.compile(r"[\x00-\x09\x0b-\x1f\x7f-\x9f]| [ \n]|\n[ \n]|\A[ \n]|[ \n]\Z")
_RUN = re.compile(r"(?:\x1b(?:\[[0-?]*[ -/]*[@-~]|[@-Z\\-_])|[\x00-\x20\x7f-\x9f])+")
_START, _END, _LABELS = frozenset(START), frozenset(END), frozenset(LABELS)
_MARKS = _START | _END | _LABELS


def cut(text: str | None, most: int = 4, kinds: frozenset[str] = _START) -> Iterator[tuple[int, list[str], dict[str, str]]]:
    """(number, lines, values) of a text's facilities of these kinds, numbered with the others; lines as parsing.clean_text makes them and without the blank ones."""
    lines = (text or "").split("\n")
    if _UNCLEAN.search(text or ""):
        lines = [x for x in (_RUN.sub(" ", x).strip(" ") for x in lines) if x]
    if kinds.isdisjoint(lines):
        return
    n, at, end, marks = 0, -1, -1, []

    def facility(upto: int) -> tuple[int, list[str], dict[str, str]]:
        upto = end if end >= 0 else upto
        values: dict[str, str] = {}
        for i, j in zip(marks, [*marks[1:], upto]):
            if lines[i] not in values:
                values[lines[i]] = lines[i + 1] if j - i == 2 and most else " ".join(lines[i + 1 : min(j, i + 1 + most)])
        return n, lines[at:upto], values

    for i in [i for i, x in enumerate(lines) if x in _MARKS]:
        x = lines[i]
        if x in _START:
            if n and lines[at] in kinds:
                yield facility(i)
            n, at, end, marks = n + 1, i, -1, []
        if end < 0 and n:
            if x in _END:
                end = i
            elif x in _LABELS:
                marks.append(i)
    if n and lines[at] in kinds:
        yield facility(len(lines))


def status(condition: str) -> str:
    """Hapus Tagih, Dihapusbukukan, Aktif, or the condition (clean text) as it is; the graver one wins."""
    c = condition.lower()
    if "hapus tagih" in c:
        return "Hapus Tagih"
    if "hapus buku" in c or "dihapusbukukan" in re.sub("[^a-z0-9]", "", c):
        return "Dihapusbukukan"
    return "Aktif" if c == "aktif" or "fasilitas aktif" in c else condition


#: A line that is nothing but an amount in rupiah; a lender's line with its code; a lender's keyword (fixed formats).
CURRENCY = re.compile(r"(?:Rp *)?-?[0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2}")
CODED = re.compile(r"[0-9]{3} *- *(.+)")
LENDER = re.compile(rf"\b(?:{'|'.join(''.join(f'[{c}{c.lower()}]' for c in word) for word in ('PT', 'BANK', 'BPR', 'BPRS', 'FINANCE'))})\b")


def lender(lines: list[str]) -> tuple[str, int]:
    """Name and place in lines (-1 if there is none): 'ddd - name' but not of the bureau, else a line with a lender's keyword."""
    for i, x in enumerate(lines):
        if x[0] in "0123456789" and (coded := CODED.fullmatch(x)) and "IDEB" not in x.upper():
            return coded[1], i
    if not LENDER.search("\n".join(lines)):
        return "", -1
    at = next(i for i, x in enumerate(lines) if LENDER.search(x))
    return re.sub("^[0-9]{3} *- *", "", lines[at]), at


def outstanding(lines: list[str], values: dict[str, str], at: int) -> str:
    """The first amount line after the lender (at) and before No Akad Akhir, else the value of Baki Debet."""
    for x in lines[at + 1 :]:
        if x == "No Akad Akhir":
            break
        if CURRENCY.fullmatch(x):
            return x
    return values.get("Baki Debet", "")


#: Labels whose values become columns.
SAID = [
    "Kualitas", "Jenis Penggunaan", "Plafon", "Plafon Awal", "Tanggal Akad Awal", "Tanggal Awal Kredit", "Tanggal Mulai", "Tanggal Jatuh Tempo", "Suku Bunga/Imbalan", "No Rekening", "No Akad Awal", "No Akad Akhir",
    "Jenis Garansi", "Tujuan Garansi", "Nama Yang Dijamin", "Setoran Jaminan", "Tanggal Diterbitkan", "Tanggal Akad Akhir",
]


def _said(block: int, lines: list[str], values: dict[str, str]) -> tuple:
    name, at = lender(lines)
    return block, lines[0], name, outstanding(lines, values, at), status(values.get("Kondisi", "")), *(values.get(x, "") for x in SAID)


def facilities(lines: DataFrame, kinds: Iterable[str] = START) -> DataFrame:
    """A row for each facility of these kinds that is active, written off, charged off, or graded other than 1; guarantees have columns of their own."""
    texts = ["type", "lender", "amount", "keterangan", *SAID]
    found = _read(lines, "block bigint, " + ", ".join(f"`{x}` string" for x in texts), pa.schema([("block", pa.int64()), *((x, pa.string()) for x in texts)]), _said, kinds=kinds)
    v = lambda label: F.col(f"`{label}`")
    money = lambda label: F.when(v(label).rlike("[0-9]"), P.rupiah(v(label)))
    guarantee = F.col("type") == GUARANTEE
    only = lambda c: F.when(guarantee, c).otherwise("")
    first_date = F.coalesce(*(F.nullif(v(x), F.lit("")) for x in ("Tanggal Akad Awal", "Tanggal Awal Kredit", "Tanggal Mulai")))
    kept = found.withColumns({"kol": F.regexp_extract(v("Kualitas"), r"\b(\d+)\b", 1).try_cast("int"), "baki_debet": money("amount")})
    kept = kept.where(F.col("keterangan").isin("Aktif", "Dihapusbukukan", "Hapus Tagih") | F.coalesce(F.col("kol") != 1, F.lit(False)))
    return kept.select(
        "source_file", F.col("block").cast("int").alias("seq"), F.col("type").alias("jenis_fasilitas"), F.col("lender").alias("bank"), F.when(guarantee, GUARANTEE).otherwise(v("Jenis Penggunaan")).alias("penggunaan"),
        F.greatest(money("Plafon"), money("Plafon Awal")).alias("plafond"), "baki_debet", "kol", P.date(first_date).alias("awal"), P.date(v("Tanggal Jatuh Tempo")).alias("jatuh_tempo"),
        (F.regexp_replace(F.regexp_extract(v("Suku Bunga/Imbalan"), r"([-+]?\d+(?:[.,]\d+)?)", 1), ",", ".").try_cast("double") / 100).alias("rate"), "keterangan",
        v("No Rekening").alias("no_rekening"), v("No Akad Awal").alias("no_akad_awal"), v("No Akad Akhir").alias("no_akad_akhir"), only(v("Jenis Garansi")).alias("jenis_garansi"), only(v("Tujuan Garansi")).alias("tujuan_garansi"),
        only(v("Nama Yang Dijamin")).alias("nama_yang_dijamin"), F.when(guarantee, F.col("baki_debet")).alias("nominal"), F.when(guarantee, money("Setoran Jaminan")).alias("setoran_jaminan"),
        P.date(only(v("Tanggal Diterbitkan"))).alias("tanggal_diterbitkan"), P.date(v("Tanggal Akad Akhir")).alias("tanggal_akad_akhir"),
    )


def without_guarantees(found: DataFrame) -> DataFrame:
    return found.where(F.coalesce(F.trim("jenis_fasilitas"), F.lit("")) != GUARANTEE)


def guarantees(found: DataFrame) -> DataFrame:
    """Bank guarantees with the columns of their own report."""
    return found.where(F.trim("jenis_fasilitas") == GUARANTEE).select(
        "source_file", "seq", "bank", "no_rekening", "no_akad_awal", "no_akad_akhir", "jenis_garansi", "tujuan_garansi", "nama_yang_dijamin", "nominal", "setoran_jaminan", "kol", F.col("awal").alias("tanggal_akad_awal"),
        "tanggal_diterbitkan", "tanggal_akad_akhir", "jatuh_tempo", "keterangan",
    )


def identity_valid(number: Column) -> Column:
    """16 digits that are not all one, with a region, a day of 1 to 31 (40 more for women) and a month."""
    day = F.substring(number, 7, 2).try_cast("int")
    day = F.when(day > 40, day - 40).otherwise(day)
    return F.coalesce(number.rlike(r"^\d{16}$") & ~number.rlike(r"^(\d)\1{15}$") & (F.substring(number, 1, 6).try_cast("int") > 0) & day.between(1, 31) & F.substring(number, 9, 2).try_cast("int").between(1, 12), F.lit(False))


def _numbers(text: Column, pattern: str) -> Column:
    """Runs of so many digits, which spaces, dots and hyphens may part, as digits."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?<!\d)({pattern})(?!\d)"), F.lit(1)), lambda x: F.regexp_replace(x, r"\D", ""))


def _after_label(lines: Column, found: Column, label: str, reach: int) -> Column:
    """The first number on a line with the label or on the lines after it (at most so many, up to the next label)."""

    def at(line: Column, i: Column) -> Column:
        stop = F.array_position(F.transform(F.slice(lines, i + 2, reach), lambda x: x.isin(LABELS)), True).cast("int")
        near = F.slice(found, i + 1, F.when(stop > 0, stop).otherwise(reach + 1))
        return F.when(line.rlike(rf"(?i)\b{label}\b"), F.get(F.filter(near, lambda x: x.isNotNull()), 0))

    return F.get(F.filter(F.transform(lines, at), lambda x: x.isNotNull()), 0)


def identity(lines: Column) -> Column:
    """A debtor's number: the one labelled NIK, else the first valid one, else the tax number labelled NPWP; '' if there is none."""
    nik = F.transform(lines, lambda x: F.get(F.filter(_numbers(x, r"(?:\d[\s.\-]?){16}"), identity_valid), 0))
    npwp = F.transform(lines, lambda x: F.get(F.filter(_numbers(x, r"(?:\d[\s.\-]?){15,16}"), lambda n: n.rlike(r"^\d{15,16}$") & ~n.rlike(r"^(\d)\1+$")), 0))
    return P.once(
        F.struct(lines.alias("lines"), nik.alias("nik"), npwp.alias("npwp")),
        lambda x: F.coalesce(_after_label(x["lines"], x["nik"], "NIK", 3), F.get(F.filter(x["nik"], lambda n: n.isNotNull()), 0), _after_label(x["lines"], x["npwp"], "NPWP", 7), F.lit("")),
    )


def report_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+/IDEB/\d+/\d+)", 1), F.lit(""))


def fallback_rows(documents: DataFrame, found: DataFrame) -> DataFrame:
    """For each document (source_file, nama, no_laporan) without a facility a row that says so, if both name and number are known."""
    none = documents.where("nama <> '' AND no_laporan <> ''").join(found.select("source_file").distinct(), "source_file", "left_anti")
    return none.select("source_file", "nama", "no_laporan", F.lit(0.0).alias("plafond"), F.lit(0.0).alias("baki_debet"), F.lit(0).alias("kol"), F.lit("Tidak ada Fasilitas Aktif").alias("keterangan"))


AMOUNT = r"[+-]?\d[\d,]*\.\d{2}"


#: An amount that may lack its decimals.
INTEGER = r"[+-]?\d[\d,]*(?:\.\d{2})?"


def recap(text: Column, header: list[str], n: int, amount: str = AMOUNT) -> Column:
    """The n amounts of the first line with exactly n of them, within seven lines after the header; null if there is none."""
    lines = F.split(text, "\n", -1)
    heads = F.transform(lines, lambda x: F.forall(F.array(*map(F.lit, header)), lambda h: x.contains(h)))
    at = F.array_position(heads, True).cast("int")
    near = F.slice(lines, F.greatest(at, F.lit(1)) + 1, 7)
    rows = F.filter(F.transform(near, lambda x: F.regexp_extract_all(x, F.lit(f"({amount})"), 1)), lambda a: F.size(a) == n)
    amounts = F.transform(F.get(rows, 0), lambda a: P.us_money(F.regexp_replace(a, r"^[+-]", "")))
    return F.when(at > 0, amounts)


def recap_bounded(text: Column) -> Column:
    """The four amounts of the one line with nothing but four, between the recap's heading and Terbilang; null unless there is exactly one heading and one such line."""
    lines = F.split(text, "\n", -1)
    head = F.transform(lines, lambda x: x.contains("Saldo Awal") & x.contains("Total Transaksi Debet") & x.contains("Total Transaksi Kredit") & x.contains("Saldo Akhir"))
    start = F.array_position(head, True).cast("int")
    tail = F.slice(lines, F.greatest(start, F.lit(1)) + 1, F.size(lines))
    stop = F.array_position(F.transform(tail, lambda x: x.rlike(r"(?i)^\s*Terbilang\b")), True).cast("int")
    inside = F.slice(tail, 1, F.greatest(stop - 1, F.lit(0)))
    rows = F.filter(inside, lambda x: (F.size(F.regexp_extract_all(x, F.lit(f"({AMOUNT})"), 1)) == 4) & (F.trim(F.regexp_replace(x, AMOUNT, "")) == ""))
    good = (F.size(F.filter(head, lambda h: h)) == 1) & (stop > 0) & (F.size(rows) == 1)
    return F.when(good, F.transform(F.regexp_extract_all(F.get(rows, 0), F.lit(f"({AMOUNT})"), 1), P.us_money))


def statement_errors(tx: DataFrame, summaries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys and error of each broken check of a parsed statement: recap, sides, running balance, totals, counts, closing.

    tx has db, cr, saldo; summaries has saldo_awal, saldo_akhir, db_total, cr_total and perhaps
    db_count, cr_count. Statements without errors don't appear.
    """
    from tallyspark.operators.statements import delta, running_balance

    run = running_balance(tx, summaries, keys, order)
    sums = run.groupBy(*keys).agg(
        F.count_if(F.col("db").isNull() & F.col("cr").isNull()).alias("_sides"), F.count_if(~F.col("ok")).alias("_bad"), F.coalesce(F.sum("db"), F.lit(0)).alias("_db"), F.coalesce(F.sum("cr"), F.lit(0)).alias("_cr"),
        F.count("db").alias("_ndb"), F.count("cr").alias("_ncr"), F.coalesce(F.sum(delta()), F.lit(0)).alias("_change"),
    )
    both = summaries.join(sums, keys, "left").na.fill(0, ["_sides", "_bad", "_db", "_cr", "_ndb", "_ncr", "_change"])
    count = lambda side: (F.col(f"{side}_count") != F.col(f"_n{side}")) if f"{side}_count" in summaries.columns else F.lit(False)
    checks = [
        (F.col("saldo_awal") + F.col("cr_total") - F.col("db_total") != F.col("saldo_akhir"), "printed recap is inconsistent"), (F.col("_sides") > 0, "missing debit and credit"), (F.col("_bad") > 0, "printed balance mismatch"),
        (F.col("_db") != F.col("db_total"), "debit total mismatch"), (F.col("_cr") != F.col("cr_total"), "credit total mismatch"), (count("db"), "debit count mismatch"), (count("cr"), "credit count mismatch"),
        (F.col("saldo_awal") + F.col("_change") != F.col("saldo_akhir"), "closing balance mismatch"),
    ]
    return both.select(*keys, F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), m) for c, m in checks)))).alias("error"))
