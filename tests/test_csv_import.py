"""Golden CSV for the import path (S1-S3, C1-C10): hand-made rows, each
covering one odd case, encoded ISO-8859-1 like the source file."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimscope import definitions as D
from claimscope.operators.clean import clean, cleaning_stats, invalid_amounts, sparse_columns
from claimscope.sources.csv_import import import_claims, load_claims, read_claims_csv, write_claims

HEADERS = [h for h, _ in D.CSV_HEADER_MAP]


def _row(admit, amount, date="01/02/2024", dob="15/06/1980", icd="A01", prov="Clinic A"):
    vals = {h: "x" for h in HEADERS}
    vals.update({"ADMIT_ID": admit, "AMOUNT": amount, "CLAIM_PROV_DATE": date, "DOB": dob,
                 "ICD10_CODE": icd, "PROV_NAME": prov, "QUANTITY": "1", "CLAIM_MEMBER_NUMBER": "M" + admit})
    return vals


CASES = [
    _row("1", '"1,200.50"'),
    _row("2", "-"),
    _row("3", " - "),
    _row("4", ""),
    _row("5", "abc"),
    _row("6", "1e5"),
    _row("7", "-75.25"),
    _row("8", "10", date="1/2/2024"),
    _row("9", "10", date="31/02/2024"),
    _row("10", "10", date="2024-01-01"),
    _row("11", "10", date="5/6/24"),
    _row("12", "10", date=""),
    _row("13", "10", icd="NA"),
    _row("14", "10", icd="n/a"),
    _row("15", "10", icd="NULL"),
    _row("16", "10", icd="None"),
    _row("17", "10", prov="Clínica São José"),
    _row("18", "20"),
    _row("18", "20"),
]


@pytest.fixture(scope="module")
def golden(tmp_path_factory):
    d = tmp_path_factory.mktemp("golden")
    path = os.path.join(d, "claims.csv")
    heads = [" AMOUNT " if h == "AMOUNT" else ("PROV_NAME " if h == "PROV_NAME" else h) for h in HEADERS]
    lines = [",".join(heads)] + [",".join(r[h] for h in HEADERS) for r in CASES]
    with open(path, "wb") as f:
        f.write(("\n".join(lines) + "\n").encode("iso-8859-1"))
    return path


@pytest.fixture(scope="module")
def imported(spark, golden):
    typed, rejects = import_claims(spark, golden)
    return {r["admit_id"]: r for r in typed.collect()}, rejects, typed


def test_headers_trimmed(spark, golden):
    raw = read_claims_csv(spark, golden)
    assert "AMOUNT" in raw.columns and "PROV_NAME" in raw.columns


def test_amounts(imported):
    rows, _, _ = imported
    assert rows["1"]["amount"] == Decimal("1200.50")
    for k in ("2", "3", "4", "5"):
        assert rows[k]["amount"] == Decimal("0.00")
    assert rows["6"]["amount"] == Decimal("100000.00")
    assert rows["7"]["amount"] == Decimal("-75.25")


def test_reject_report(imported):
    _, rejects, _ = imported
    ids = {r["ADMIT_ID"] for r in rejects.collect()}
    assert {"2", "3", "4", "5", "6"} <= ids
    assert not ({"1", "7", "8"} & ids)


def test_dates(imported):
    rows, _, _ = imported
    assert rows["1"]["claim_prov_date"] == dt.date(2024, 2, 1)
    assert rows["8"]["claim_prov_date"] == dt.date(2024, 2, 1)
    for k in ("9", "10", "11", "12"):
        assert rows[k]["claim_prov_date"] is None
    assert rows["1"]["dob"] == dt.date(1980, 6, 15)


def test_missing_tokens(imported):
    rows, _, _ = imported
    for k in ("13", "14", "15", "16"):
        assert rows[k]["icd10_code"] is None


def test_latin1_kept(imported):
    rows, _, _ = imported
    assert rows["17"]["prov_name"] == "Clínica São José"


def test_cleaning_removes_duplicates_and_undated(imported):
    _, _, typed = imported
    cleaned = clean(typed)
    st = cleaning_stats(typed, cleaned).first()
    assert st["original_rows"] == len(CASES)
    # one exact duplicate and four undated rows go
    assert st["final_rows"] == len(CASES) - 1 - 4


def test_sparse_columns(spark):
    rows = [(None if i < 79 else 1, None if i < 80 else 1, None if i < 81 else 1, i) for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    assert sparse_columns(df) == ["b", "c"]


def test_write_and_load_partitioned(spark, imported, tmp_path):
    _, _, typed = imported
    out = str(tmp_path / "claims")
    write_claims(typed.where(F.col("claim_prov_date").isNotNull()), out)
    back = load_claims(spark, out)
    assert back.count() == typed.where(F.col("claim_prov_date").isNotNull()).count()
    assert "claim_month" in back.columns


def test_invalid_amounts_on_raw(spark):
    raw = spark.createDataFrame([("1", "12.5"), ("2", "1,000"), ("3", "x")], "ADMIT_ID string, AMOUNT string")
    assert [r[0] for r in invalid_amounts(raw).collect()] == ["3"]


ODD = [
    ("1", '"Clinic ""A"" Ltd"', "12,000,000,000.00", "1"),
    ("2", '"One, Two"', "5.00", "99999999999999"),
    ("3", '"Line one\nline two"', "6.00", "2.0"),
    ("4", "Caf\u00e9", "9,999,999,999.99", "x"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = os.path.join(tmp_path_factory.mktemp("odd"), "claims.csv")
    lines = [",".join(HEADERS)]
    for admit, prov, amount, quantity in ODD:
        v = _row(admit, f'"{amount}"', prov=prov)
        v["QUANTITY"] = quantity
        lines.append(",".join(v[h] for h in HEADERS))
    with open(path, "wb") as f:
        f.write(("\n".join(lines) + "\n").encode("iso-8859-1"))
    return import_claims(spark, path, multi_line=True)


def test_quotes_and_line_ends_inside_fields(odd):
    rows = {r["admit_id"]: r for r in odd[0].collect()}
    assert [rows[k]["prov_name"] for k in "1234"] == ['Clinic "A" Ltd', "One, Two", "Line one\nline two", "Caf\u00e9"]


def test_numbers_out_of_range(odd):
    rows = {r["admit_id"]: r for r in odd[0].collect()}
    assert rows["1"]["amount"] == Decimal("0.00") and rows["4"]["amount"] == Decimal("9999999999.99")
    assert [rows[k]["quantity"] for k in "1234"] == [1, None, 2, None]
    assert {(r["ADMIT_ID"], r["field"]) for r in odd[1].collect()} == {("1", "AMOUNT"), ("2", "QUANTITY"), ("4", "QUANTITY")}


def test_export_doubles_quotes(spark, odd, tmp_path):
    from claimscope.sources.catalog import export_csv
    texts = ['say "hi"', "a,b", "two\nlines", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    path = export_csv(df, f"{tmp_path}/out", single_file=True)
    part = next(p for p in os.listdir(path) if p.endswith(".csv"))
    import csv
    with open(os.path.join(path, part), newline="", encoding="utf-8") as f:
        assert [r[0] for r in csv.reader(f)][1:] == texts
