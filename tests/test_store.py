"""Tables kept by batch, and the grounding audit as one run."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom import store_queries
from tallyloom.operators import grounding
from tallyloom.operators.store import BatchTable

from .test_reconciliation import DATA

SCHEMA = "batch_id string, id long, text string, version long"


def files_of(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    return BatchTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, "id")


def held(table):
    return sorted((tuple(r)[:3] for r in table.rows().collect()), key=str)


def test_a_batch_is_replaced_alone(spark, table, tmp_path):
    assert held(table) == []
    rows = lambda *r: spark.createDataFrame([(*x, 1) for x in r], SCHEMA)
    first = [("2024-01", 1, "a"), ("2024-01", 2, "b"), ("a/b=c %", 3, None), (None, 4, "d"), ("", 5, "e"), ("1", 6, "f"), ("01", 7, "g")]
    table.replace(rows(*first))
    assert held(table) == sorted(first, key=str)
    before = files_of(tmp_path / "t")
    for _ in range(2):
        table.replace(rows(("2024-01", 9, "z")))
        assert held(table) == sorted([("2024-01", 9, "z"), *first[2:]], key=str)
    after = files_of(tmp_path / "t")
    assert {k for k in before if before[k] != after.get(k)} == {k for k in before if "b2024-01" in k}
    table.remove(rows(("a/b=c %", 0, ""), (None, 0, ""), ("absent", 0, "")))
    assert held(table) == sorted([("2024-01", 9, "z"), *first[4:]], key=str)


def test_rows_are_put_and_dropped_in_their_batches(spark, table, tmp_path):
    rows = lambda *r: spark.createDataFrame([(*x, 1) for x in r], SCHEMA)
    table.replace(rows(("b1", 1, "a"), ("b1", None, "n"), ("b2", 1, "c"), ("b3", 1, "d"), (None, 1, "e")))
    before = files_of(tmp_path / "t")
    put, drop = rows(("b1", None, "N"), ("b1", 5, "new"), ("b4", 1, "first"), (None, 1, "E")), rows(("b2", 1, ""), ("b1", 5, ""), ("b9", 1, ""))
    for _ in range(2):
        table.change(put, drop)
        assert held(table) == sorted([("b1", 1, "a"), ("b1", None, "N"), ("b1", 5, "new"), ("b4", 1, "first"), ("b3", 1, "d"), (None, 1, "E")], key=str)
    after = files_of(tmp_path / "t")
    assert not any("bb2" in k for k in after) and {k for k in before if after.get(k) == before[k]} == {k for k in before if "bb3" in k}
    with pytest.raises(ValueError, match="twice"):
        table.change(rows(("b1", 1, "x"), ("b1", 1, "y")))
    table.change()
    assert len(held(table)) == 6


def test_a_stream_of_changes_may_come_again(spark, table, tmp_path):
    columns = SCHEMA + ", gone boolean"
    source = f"{tmp_path}/in"

    def arrive(*r):
        spark.createDataFrame(r, columns).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint):
        table.follow(spark.readStream.schema(columns).parquet(source), f"{tmp_path}/{checkpoint}").awaitTermination()

    arrive(("b1", 1, "a", 1, False), ("b1", 1, "b", 3, False), ("b1", 1, "old", 2, False), ("b2", 7, "x", 1, False))
    run("c")
    assert held(table) == [("b1", 1, "b"), ("b2", 7, "x")]
    arrive(("b1", 1, "late", 2, False), ("b2", 7, "", 2, True), ("b3", 1, "y", 1, False))
    run("c")
    assert held(table) == [("b1", 1, "b"), ("b3", 1, "y")]
    run("another")  # all changes once more, by a stream that knows nothing of the first
    assert held(table) == [("b1", 1, "b"), ("b3", 1, "y")]


def test_grounding_audit(spark, tmp_path):
    columns = "batch_id string, id string, status string, category string, subcategory string, suggested_action string, confidence double, explanation string, model_raw map<string,string>"
    rows = [("b", f"v{i:02d}", "explained", "gateway_fee", "fee", "write_off", 0.9, f"fee 1{i:02d}.00 synthetic:x", {"a": "1"}) for i in range(40)]
    rows += [("b", "open", "open", "gateway_fee", "fee", "write_off", 0.9, "fee", None), ("b", "blank", "explained", "gateway_fee", "fee", "write_off", 0.9, " ", None), ("c", "c1", "explained", None, None, None, None, "no figures", None)]
    queue = spark.createDataFrame(rows, columns)
    table = BatchTable(spark, f"file://{tmp_path}/t", queue.schema, "id")
    table.replace(queue)
    amounts = [(b, i, (100,), [f"1{int(i[1:]):02d}.00"] if i[1:].isdigit() and int(i[1:]) % 2 else []) for b, i, *_ in rows]
    cases = spark.createDataFrame(amounts, "batch_id string, id string, record struct<amount_paise: long>, universe array<string>")
    cases = cases.withColumn("universe", F.col("universe").cast("array<decimal(30,6)>"))
    seen = f"{tmp_path}/seen"

    def critic(texts):
        out = []
        for text in texts:
            case = json.loads(text)
            assert "synthetic" not in text
            with open(seen, "a") as f:
                f.write(case["variance_id"] + "\n")
            if case["variance_id"] == "c1":
                raise OSError("no critic")
            out.append(json.dumps({"grounded": case["variance_id"] != "v03", "amounts_correct": True, "action_appropriate": True}))
        return out

    got = {r.batch_id: r for r in grounding.audit(table, cases, critic, f"file://{tmp_path}/said", n=50).collect()}
    b, c = got["b"], got["c"]
    assert (b.graded, b.passed, b.failed, b.grounding_pct, b.malformed, b.citing, b.traced, b.disagreements, b.calls) == (40, 39, 1, 97.5, 0, 40, 20, 20, 8)
    assert (c.graded, c.passed, c.malformed, c.citing, c.calls) == (1, 0, 1, 0, 0)
    after = {r.id: r for r in table.rows().collect()}
    assert len(after) == len(rows) and sorted(i for i, r in after.items() if r.subcategory == grounding.FAILED) == ["c1", "v03"]
    v = after["v03"]
    assert (v.status, v.category, v.confidence, v.explanation) == ("open", "unexplained", 0.49, "fee 103.00 synthetic:x")
    assert v.model_raw["a"] == "1" and json.loads(v.model_raw["grounding_audit"])["grounded"] is False and after["c1"].confidence == 0.0
    assert len(open(seen).read().split()) == 41
    draw = lambda n: {r.id for r in grounding.drawn(queue, n).where("batch_id = 'b'").collect()}
    assert len(draw(30)) == 30 and draw(10) < draw(30) and draw(30) == draw(30)


@pytest.mark.parametrize("name", sorted(store_queries.QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(store_queries.ORACLES[name]).df()
    got = store_queries.QUERIES[name](spark, DATA).toPandas()
    assert sorted(want.columns) == sorted(got.columns) and len(got)
    rows = lambda df: sorted(tuple(str(x).removesuffix(" 00:00:00") for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_order_0_in_a_changed_year(spark, tmp_path):
    """Its negative is itself: both rows stay apart."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN o_orderkey = 0 THEN TIMESTAMP '1995-05-02' ELSE o_orderdate END AS o_orderdate) FROM '{DATA}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = con.execute(store_queries.ORACLES["batch_rewrite"]).fetchall()
    got = store_queries.batch_rewrite(spark, str(tmp_path)).select("batch_id", "id", "variance_paise", "status").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and sum(r.id == 0 for r in got) == 2
