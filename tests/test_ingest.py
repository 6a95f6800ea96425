"""The ingest driver, the assertions inside plans and the new queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom import gate_queries, oracles, queries
from tallyloom.functions import scalars as S
from tallyloom.sources import files, ingest

DATA = "/root/testdata/sf0.001"
HEAD = "value_date,narration,debit,credit,balance\n"


def test_ingest_files(spark, tmp_path):
    for name in ("csv", "xlsx"):
        (tmp_path / name).mkdir()
    good = "".join(f'0{1 + i % 9}/02/2024,NEFT/AB{i:03d},,"1,0{i:02d}.00",1\n' for i in range(30))
    bad = "".join(f"01/02/2024,NEFT/X{i},1,2,3\n" for i in range(60))
    (tmp_path / "csv" / "b.csv").write_text(HEAD + good + bad + '01/02/2024,BY TRANSFER,"2.00",,1\n')
    (tmp_path / "xlsx" / "l.xlsx").write_bytes(files.ledger_workbook([("05-03-2024", "V1", "Sale", "1,234.50 DR"), ("06-03-2024", "", "x", "7"), ("06-03-2024", "V3", "x", "oops")]))
    run = lambda batch: ingest.ingest_files(spark, batch, str(tmp_path / "csv"), str(tmp_path / "xlsx"), f"{tmp_path}/sink")
    table = lambda: sorted(map(str, spark.read.parquet(f"{tmp_path}/sink/rows").collect()))
    got = run("b1")
    assert {k: got[k] for k in got if k != "skipped_lines"} == {"bank_rows_parsed": 31, "ledger_rows_parsed": 2, "bank_rows_skipped": 60, "ledger_rows_skipped": 1, "bank_missing_ref": 1, "ledger_missing_ref": 1, "total_rows": 33}
    assert got["skipped_lines"] == list(range(32, 82))
    run("b2")
    before = table()
    assert len(before) == 66 and run("b1") == got and table() == before
    (tmp_path / "csv" / "b.csv").write_text(HEAD + "01/02/2024,NEFT/ONE,,5.00,1\n")
    assert run("b1")["bank_rows_parsed"] == 1
    counts = {r.batch_id: r["count"] for r in spark.read.parquet(f"{tmp_path}/sink/rows").groupBy("batch_id").count().collect()}
    assert counts == {"b1": 3, "b2": 33}


def test_a_leak_fails_the_query(spark):
    rows = spark.createDataFrame([("a", "fine"), ("b", "synthetic:x")], "txn_id string, text string")
    assert rows.where("txn_id = 'a'").where(S.no_leak(F.struct("txn_id", "text"))).count() == 1
    with pytest.raises(Exception, match="answer key"):
        rows.where(S.no_leak(F.struct("txn_id", "text"))).collect()


def test_views_of_the_caller_stay(spark):
    spark.range(3).createOrReplaceTempView("orders")
    queries.rows_by_source(spark, DATA).count()
    assert spark.table("orders").count() == 3
    spark.catalog.dropTempView("orders")


def test_confidence_takes_normal_forms(spark):
    from tallyloom.operators import match as M

    rows = [("g", "a", "gateway", "pay_AB1", 100, None), ("g", "b", "bank", "AB1", 100, None), ("h", "c", "bank", "", 5, None), ("h", "d", "ledger", "ZZ", 5, None)]
    df = spark.createDataFrame(rows, "group_id string, txn_id string, source_kind string, external_ref string, amount_paise long, txn_date date")
    assert {r.group_id: r.confidence_pct for r in M.groups_of(df).collect()} == {"g": 95, "h": 90}


@pytest.mark.parametrize("name", [*gate_queries.QUERIES, "ingest_idempotent", "confidence_histogram"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("orders", "lineitem", "events"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    known, texts = gate_queries.QUERIES | queries.QUERIES, gate_queries.ORACLES | oracles.ORACLES
    got = known[name](spark, DATA)
    want = db.execute(texts[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(got.select(columns).collect()) == key(want[columns].itertuples(index=False))
