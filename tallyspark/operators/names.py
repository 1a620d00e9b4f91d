"""The debtor's name on the first page of a credit report, by a cascade of layouts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions import parsing as P

# What is no name (fixed values): whole lines, phrases, and words.
LINES = [
    "INDONESIA", "JAKARTA", "JAKARTA UTARA", "KOTA JAKARTA", "KOTA JAKARTA UTARA", "PENJARINGAN", "KAPUK MUARA", "PLUIT", "BANDUNG", "POSISI DATA TERAKHIR", "NOMOR LAPORAN", "TANGGAL PERMINTAAN", "TANGGAL CETAK", "DATA POKOK DEBITUR",
    "RINGKASAN FASILITAS", "FASILITAS", "KREDIT/PEMBIAYAAN", "KREDIT / PEMBIAYAAN", "INFORMASI DEBITUR", "INFORMASI DIBERIKAN", "NAMA", "NAMA DEBITUR", "NO. IDENTITAS", "NO IDENTITAS", "NOMOR IDENTITAS", "IDENTITAS", "NIK", "NIK /", "NPWP",
    "JENIS KELAMIN", "TEMPAT LAHIR", "TANGGAL LAHIR", "PELAPOR", "OPERATOR",
]
PHRASES = [
    "POSISI DATA", "NOMOR LAPORAN", "TANGGAL PERMINTAAN", "TANGGAL CETAK", "DATA POKOK DEBITUR", "RINGKASAN FASILITAS", "DATA TIDAK DITEMUKAN", "KREDIT/PEMBIAYAAN", "KREDIT / PEMBIAYAAN", "INFORMASI DEBITUR", "INFORMASI DIBERIKAN",
    "SISTEM LAYANAN", "KEUANGAN DENGAN", "OTORITAS JASA KEUANGAN", "SISTEM LAYANAN INFORMASI KEUANGAN", "KODE REF", "KATA KUNCI PENCARIAN", "TEMPAT PENDIRIAN", "TANGGAL AKTE PENDIRIAN", "TANGGAL DIBENTUK",
]
WORDS = [
    "BANK", "FINANCE", "IDEB", "SLIK", "NIK", "NPWP", "LAKI-LAKI", "PEREMPUAN", "PULAU", "KEPULAUAN", "KONSULTAN", "S-1", "RAHASIA", "PERDAGANGAN", "COMMANDITER", "PERSEROAN", "VENOTSCHAP", "WIRASWASTA", "LAIN-LAIN", "RUMAH TANGGA",
    "TANPA GELAR", "WIL", "LJK",
]
_either = lambda words: "|".join(map(re.escape, words))
_NONE = rf"^(?:{_either(LINES)})$|{_either(PHRASES)}|(?<![A-Z0-9])(?:{_either(WORDS)})(?![A-Z0-9])|\d"


def is_name(line: Column) -> Column:
    """Whether a line may be a debtor's name: three letters in a row, no digit, nothing that is known to be something else."""
    return P.once(P.clean_text(line), lambda t: t.rlike("[A-Za-z]{3}") & ~F.upper(t).rlike(_NONE))


def _first(rows: Column, which) -> Column:
    """The text of the first row that which holds for."""
    return F.get(F.filter(rows, which), 0)["text"]


def _at(rows: Column, which) -> Column:
    """The place (from 1) of the first row that which holds for; 0 if there is none."""
    return F.array_position(F.transform(rows, which), True).cast("int")


def _before(rows: Column, *ends: Column) -> Column:
    """The rows before the first of the places that are not 0."""
    stop = F.array_min(F.filter(F.array(*ends), lambda x: x > 0))
    return F.when(stop.isNull(), rows).otherwise(F.slice(rows, 1, F.coalesce(stop, F.lit(1)) - 1))


def _after(rows: Column, at: Column) -> Column:
    return F.when(at > 0, F.slice(rows, at + 1, F.size(rows)))


def _above_nik(rows: Column) -> Column:
    above = F.transform(rows, lambda x, i: F.when(x["text"].rlike(r"(?i)^NIK\b") & (i > 0), F.get(rows, i - 1)))
    return _first(above, lambda x: x["ok"])


def _cascade(rows: Column) -> Column:
    data = P.once(F.slice(rows, F.greatest(_at(rows, lambda x: x["text"] == "Data Pokok Debitur"), F.lit(1)), F.size(rows)), lambda d: _before(d, *(_at(d, lambda x, m=m: x["text"].startswith(m)) for m in ("Ringkasan Fasilitas", "Pemilik / Pengurus", "Nomor Laporan"))))

    def in_data(d: Column) -> Column:
        area = _after(d, _at(d, lambda x: x["text"] == "Nama Debitur"))

        def in_area(a: Column) -> Column:
            country = F.transform(a, lambda x, i: F.when(F.upper(x["text"]) == "INDONESIA", F.get(F.filter(F.slice(a, i + 2, 4), lambda y: y["ok"]), 0)))
            numbered = F.transform(a, lambda x, i: F.when(x["text"].rlike(r"^\d+\s*/"), F.try_element_at(F.filter(F.slice(a, 1, i), lambda y: y["ok"]), F.lit(-1))))
            found = lambda c: F.get(F.filter(c, lambda x: x.isNotNull()), 0)["text"]
            return F.coalesce(found(country), found(numbered), _first(a, lambda x: x["ok"]))

        return F.coalesce(_above_nik(d), P.once(area, in_area))

    header = _before(rows, *(_at(rows, lambda x, m=m: x["text"].startswith(m)) for m in ("Informasi diberikan", "Data Pokok Debitur")))
    shouted = _first(header, lambda x: x["ok"] & (x["text"] == F.upper(x["text"])) & x["text"].contains(" "))
    start = _at(rows, lambda x: x["text"] == "Nama Debitur")
    body = F.when(start > 0, F.slice(rows, F.greatest(start, F.lit(1)), F.size(rows)))

    def in_body(b: Column) -> Column:
        part = _before(b, *(_at(b, lambda x, m=m: x["text"] == m) for m in ("NPWP", "Pemilik / Pengurus", "Ringkasan Fasilitas")))
        return F.coalesce(_first(part, lambda x: x["text"].rlike(r"(?i)^(?:CV|PT|UD|PD|KOPERASI)\b") & ~F.upper(x["text"]).contains("BANK")), _first(F.slice(part, 2, F.size(part)), lambda x: x["ok"]))

    return F.coalesce(P.once(data, in_data), shouted, P.once(body, in_body), _above_nik(rows))


def debtor(lines: Column) -> Column:
    """The debtor's name among the lines of a report's first page (clean and not blank); '' if none is found.

    In turn: above the NIK label of the debtor's data; in that part after Nama Debitur (after the
    country, before a line that begins with a number and a slash, the first); a line in capitals of
    the page's head; a company's name or another one after Nama Debitur; above any NIK label.
    """
    rows = F.transform(lines, lambda x: F.struct(P.clean_text(x).alias("text"), is_name(x).alias("ok")))
    return P.once(P.once(rows, _cascade), lambda name: F.when(F.coalesce(is_name(name), F.lit(False)), name).otherwise(""))
