"""Workbooks and statements written by Spark and read back."""

import datetime
import json
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.tiers import running
from tallyloom.sources import files, workbook

RECORD = "batch_id string, txn_id string, txn_date date, external_ref string, amount_paise long"
DAY = datetime.date(2024, 3, 5)


def read(path):
    out = {}
    for p in sorted(path.glob("*.xlsx")):
        for sheet, line, cells in files.sheet_rows(p.read_bytes()):
            out.setdefault(p.name, {}).setdefault(sheet, []).append(cells)
    return out


def test_books_of_two_sheets(spark, tmp_path):
    rows = [("b1", f"t{i:02d}", DAY, f"V{i:02d}", -100 if i == 0 else 12345600 + i) for i in range(7)]
    rows += [("a/b c", "x", None, 'R<&">\x01', 5), (None, "y", DAY, None, -7)]
    workbook.write_ledger_books(spark, spark.createDataFrame(rows, RECORD), str(tmp_path / "o"))
    got = read(tmp_path / "o")
    assert sorted(got) == ["ledger-a%2Fb+c.xlsx", "ledger-b1.xlsx", "ledger.xlsx"]
    b1 = got["ledger-b1.xlsx"]
    assert [len(b1[s]) for s in (0, 1)] == [4 + 3, 4 + 4]
    assert b1[0][:4] == [["ACME COMMERCE PRIVATE LIMITED"], ["General Ledger Export — Q1 Ledger"], ["Generated by FinBooks v4.2", "", "Page 1 of 1"], ["Date", "Voucher No", "Particulars", "Amount"]]
    assert b1[0][4] == ["05-03-2024", "V00", "Ledger entry V00", "1.00 DR"] and b1[1][4][3] == "1,23,456.03 CR"
    assert len(got["ledger-a%2Fb+c.xlsx"][0]) == 4 and got["ledger-a%2Fb+c.xlsx"][1][4] == ["", 'R<&">', 'Ledger entry R<&">', "0.05 CR"]
    with zipfile.ZipFile(tmp_path / "o" / "ledger-b1.xlsx") as z:
        assert z.testzip() is None and [ElementTree.fromstring(z.read(n)) is not None for n in z.namelist()]
    assert not [p for p in (tmp_path / "o").iterdir() if p.name.startswith(".writing")]


def test_a_batch_of_many_rows_is_several_books(spark, tmp_path):
    rows = [("b", f"t{i:02d}", DAY, f"V{i:02d}", i) for i in range(11)]
    workbook.write_ledger_books(spark, spark.createDataFrame(rows, RECORD), str(tmp_path), most=2)
    got = read(tmp_path)
    assert list(got) == ["ledger-b.2.xlsx", "ledger-b.3.xlsx", "ledger-b.xlsx"]
    cells = [c[1] for name in sorted(got, key=lambda n: (len(n), n)) for s in sorted(got[name]) for c in got[name][s][4:]]
    assert sorted(cells) == [f"V{i:02d}" for i in range(11)] and all(len(s) <= 6 for b in got.values() for s in b.values())


def test_overwrite_append_and_empty(spark, tmp_path):
    one = lambda b, ref: spark.createDataFrame([(b, "t", DAY, ref, 1)], RECORD)
    refs = lambda: {n: [r[1] for s in b.values() for r in s[4:]] for n, b in read(tmp_path).items()}
    workbook.write_ledger_books(spark, one("a", "A"), str(tmp_path))
    workbook.write_ledger_books(spark, one("b", "B"), str(tmp_path), mode="append")
    workbook.write_ledger_books(spark, one("a", "A2"), str(tmp_path), mode="append")
    assert refs() == {"ledger-a.xlsx": ["A2"], "ledger-b.xlsx": ["B"]}
    workbook.write_ledger_books(spark, one("c", "C"), str(tmp_path))
    assert refs() == {"ledger-c.xlsx": ["C"]}
    workbook.write_ledger_books(spark, one("c", "C").limit(0), str(tmp_path), mode="append")
    assert refs() == {"ledger-c.xlsx": ["C"]}


def test_a_failed_job_leaves_the_folder_as_it_was(spark, tmp_path):
    spark.dataSource.register(workbook.Workbooks)
    options = dict(titles=json.dumps(["x"]), above="[]", header='["h"]')
    good = spark.createDataFrame([("a.xlsx", 0, ["1"])], "book string, sheet int, cells array<string>")
    good.write.format("workbooks").options(**options).mode("append").save(str(tmp_path))
    bad = good.unionByName(good.withColumn("cells", F.array(F.raise_error(F.lit("no")).cast("string"))))
    with pytest.raises(Exception):
        bad.write.format("workbooks").options(**options).mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="several tasks"):
        good.unionByName(good).write.format("workbooks").options(**options).mode("append").save(str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.xlsx"]


def test_statement(spark, tmp_path):
    rows = [("b1", f"t{i:03d}", DAY, f"AB{i:03d}C", (-1) ** i * 100 * (i + 1)) for i in range(80)]
    files.write_bank_csv(spark.createDataFrame(rows, RECORD), str(tmp_path / "s"), opening=1_000_000)
    raw = spark.read.csv(str(tmp_path / "s"), header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).collect()
    told = {t for t in files.NARRATIONS for r in raw if r.narration.startswith(t.split("{")[0]) and r.narration.endswith(t.rsplit("}", 1)[1])}
    assert told == set(files.NARRATIONS)
    back = files.read_bank_csv(spark, str(tmp_path / "s")).collect()
    assert sorted((r.external_ref, r.amount_paise) for r in back) == sorted((r[3], r[4]) for r in rows)
    total, seen = 1_000_000, {}
    for _, _, _, ref, amount in rows:
        total += amount
        seen[ref] = f"{total // 100:,}.{total % 100:02d}"
    assert sorted(r.balance for r in raw) == sorted(seen.values())


def test_running_sums(spark):
    rows = [("a", i, i) for i in range(50)] + [(None, 1, 5), (None, 2, None), ("z", 1, None)]
    got = running(spark.createDataFrame(rows, "k string, o long, v long"), ["k"], ["o"], {"s": F.col("v"), "i": F.lit(1)}).collect()
    want = {(k, o): (sum(x or 0 for kk, oo, x in rows if kk == k and oo <= o), sum(x or 0 for kk, _, x in rows if kk == k)) for k, o, _ in rows}
    assert {(r.k, r.o): (r.s, r.s_all) for r in got} == want and max(r.i for r in got) == 50


def test_sheets_are_streamed(tmp_path):
    """The memory of reading does not grow with a sheet's rows."""
    import tracemalloc

    with open(tmp_path / "b.xlsx", "wb") as out:
        book = workbook.Book(out)
        book.start("a")
        for i in range(20_000):
            book.row([str(i), "x", "y"])
        book.close()
    data = (tmp_path / "b.xlsx").read_bytes()
    tracemalloc.start()
    n = sum(len(cells) == 3 and cells[0] == str(line - 1) for _, line, cells in files.sheet_rows(data))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and most < 5_000_000
