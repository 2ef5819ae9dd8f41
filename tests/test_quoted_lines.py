"""Quoted line ends over many file splits, and the reject report."""

import csv
import io
import random

import pytest

from claimscope import definitions as D
from claimscope.sources.csv_import import CORRUPT, import_claims, read_claims_csv
from claimscope.sources.quoted_lines import lines, records

HEADERS = [h for h, _ in D.CSV_HEADER_MAP]


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(name, "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset(name)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(path, rows, end="\n", encoding="iso-8859-1"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    path.write_bytes(out.getvalue().encode(encoding))


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_random_quoting_equals_the_one_task_reader(small_splits, tmp_path, seed, end):
    rng = random.Random(seed)
    bits = ["\n", '"', ",", "a", "é", " ", '""', "x\ny", "\n\n", "long " * 60, ",\n"]
    field = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(4))) + "."
    want = []
    (tmp_path / "in").mkdir()
    for f in range(3):
        rows = [[f"{f}-{i}", field(), field()] for i in range(rng.choice([1, 40, 120]))]
        write(tmp_path / "in" / f"{f}.csv", [["id", " b ", "c"], *rows], end)
        want += rows
    spark, path = small_splits, str(tmp_path / "in")
    assert lines(spark, path).select("file", "split").distinct().count() > 20
    got = [tuple(r) for r in read_claims_csv(spark, path, multi_line=True).collect()]
    assert sorted(got) == sorted(map(tuple, want))
    assert read_claims_csv(spark, path, multi_line=True).columns == ["id", "b", "c"]
    if end == "\n":
        one = [tuple(r) for r in spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="ISO-8859-1").collect()]
        assert sorted(got) == sorted(one)


def test_a_field_longer_than_many_splits(small_splits, tmp_path):
    text = "\n".join(f"line {i}, \"q\"" for i in range(500))
    write(tmp_path / "a.csv", [["id", "t"], ["1", "x"], ["2", text], ["3", text], ["4", "y"]])
    got = {r.id: r.t for r in read_claims_csv(small_splits, str(tmp_path / "a.csv"), multi_line=True).collect()}
    assert got == {"1": "x", "2": text, "3": text, "4": "y"}


def test_header_only_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,t\n")
    assert records(spark, str(tmp_path / "a.csv")).collect() == []
    (tmp_path / "b.csv").write_text("id,t\n\n1,a\r\n\r\n2,b")
    assert sorted(r.record for r in records(spark, str(tmp_path / "b.csv")).collect()) == ["1,a", "2,b"]


def line(admit, **other):
    v = dict.fromkeys(HEADERS, "x") | {"ADMIT_ID": admit, "AMOUNT": "1.00", "CLAIM_PROV_DATE": "01/02/2024", "DOB": "15/06/1980", "QUANTITY": "1"} | other
    return [v[h] for h in HEADERS]


@pytest.mark.parametrize("multi_line", [False, True])
def test_rejects_of_every_kind(spark, tmp_path, multi_line):
    rows = [line("ok"), line("amount", AMOUNT="1e5"), line("blank", AMOUNT="-"), line("huge", AMOUNT="99,999,999,999.00"), line("date", CLAIM_PROV_DATE="2024-01-02"),
            line("leap", DOB="29/02/2023"), line("none", DOB="", CLAIM_PROV_DATE="NA", QUANTITY="null"), line("number", QUANTITY="two"), line("both", QUANTITY="two", DOB="x"),
            line("short")[:-2], [*line("long"), "more"]]
    write(tmp_path / "a.csv", [HEADERS, *rows])
    typed, bad = import_claims(spark, str(tmp_path / "a.csv"), multi_line=multi_line)
    got = {(r.ADMIT_ID, r.field, r.value if r.field else None, r.reason) for r in bad.collect()}
    assert got == {("amount", "AMOUNT", "1e5", "not a number"), ("blank", "AMOUNT", "-", "not a number"), ("huge", "AMOUNT", "99999999999.00", "out of range"),
                   ("date", "CLAIM_PROV_DATE", "2024-01-02", "not a date"), ("leap", "DOB", "29/02/2023", "not a date"), ("number", "QUANTITY", "two", "not a number"),
                   ("both", "QUANTITY", "two", "not a number"), ("both", "DOB", "x", "not a date"), ("short", None, None, "wrong number of fields"), ("long", None, None, "wrong number of fields")}
    assert {r.admit_id for r in typed.collect()} == {"ok", "amount", "blank", "huge", "date", "leap", "none", "number", "both"}
    whole = {r[CORRUPT] for r in read_claims_csv(spark, str(tmp_path / "a.csv"), multi_line=multi_line, ragged=True).collect()} - {None}
    assert whole == {",".join(line("short")[:-2]), ",".join(line("long")) + ",more"}
