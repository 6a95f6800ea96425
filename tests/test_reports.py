import datetime
import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom import report_oracles, report_queries
from tallyloom.functions import review as R
from tallyloom.operators import match as M
from tallyloom.operators import reports as P
from tallyloom.sources import files, payments

from .test_reconciliation import DATA, ROW, column, records


@pytest.mark.parametrize("name", ["queue_counts", "scenario_confusion", "usage_cost", "batch_spans", "batch_list", "stuck_batches", "checked_answers", "verdicts", "amount_check", "ungrounded_replies", "wrong_pairs", "group_variances", "settlement_targets", "range_ingest", "context_lines"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("orders", "lineitem", "events", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    want = con.execute(report_oracles.ORACLES[name]).df()
    got = report_queries.QUERIES[name](spark, DATA).toPandas()
    assert sorted(want.columns) == sorted(got.columns) and len(got)
    rows = lambda df: sorted(tuple(str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_amounts_of_2024(spark, tmp_path):
    """The year of the text is no figure, also where 2024 paise are an amount (order 6's fee)."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN o_orderkey = 6 THEN 1012.0 ELSE o_totalprice END AS o_totalprice) FROM '{DATA}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    con.execute(f"COPY (FROM '{DATA}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    for table in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = con.execute(report_oracles.ORACLES["amount_check"]).fetchall()
    got = report_queries.amount_check(spark, str(tmp_path)).select("txn_id", "cited", "untraced", "all_found").collect()
    assert sorted(map(tuple, got)) == sorted(want) and "gateway_6" in {r.txn_id for r in got}


def test_every_report_has_sql():
    whole_run = {"recon_run", "recon_report", "recon_queue", "recon_scores", "unsettled_banks"}  # rows choose in turn; test_cascade holds them
    assert set(report_queries.QUERIES) - whole_run == set(report_oracles.ORACLES)


def test_labels(spark):
    assert column(spark, ["synthetic:a_b", "synthetic:", "synthetic:a b", "x", None], lambda x: R.scenario(x, F.lit("raw"))) == ["a_b", "raw", "raw", "raw", "raw"]
    assert column(spark, ["It is CLEAN_3WAY", "ok", None], R.quotes_label) == [True, False, False]
    assert column(spark, ["```json\n{}\n```", " {} "], R.unfenced) == ["{}", "{}"]


def test_answers(spark):
    good = {"category": "unexplained", "suggested_action": "write_off", "confidence": 0.9, "explanation": " x ", "subcategory": ""}
    texts = [json.dumps(good), json.dumps(good | {"category": "gateway_fee", "confidence": 3}), json.dumps(good | {"explanation": 5}), "[1]", "", None, json.dumps({k: v for k, v in good.items() if k != "subcategory"})]
    got = column(spark, texts, R.answer)
    assert [(a.category, a.confidence, a.well_formed) for a in got] == [("unexplained", 0.49, True), ("gateway_fee", 1.0, True)] + [("unexplained", 0.0, False)] * 5
    assert got[0].explanation == "x" and got[6].explanation == "x" and got[3].suggested_action == "flag_for_human"
    flags = [v.passed for v in column(spark, ['{"grounded":true,"amounts_correct":true,"action_appropriate":true}', '{"grounded":1,"amounts_correct":true,"action_appropriate":true}', "no", None], R.verdict)]
    assert flags == [True, False, False, False]


def test_figures(spark):
    df = spark.createDataFrame([([1000, 20, None], "fee 10.00, 0.20, 9.80 in 2024, 1,020 and 40 or 77 but 1999.0")], "a array<long>, t string")
    universe = R.amount_universe(F.col("a"), F.array(F.lit(None).cast("long")))
    row = df.select(R.cited(F.col("t"), universe).alias("c"), R.untraced(R.cited(F.col("t"), universe), universe).alias("u")).first()
    assert row.c == ["10.00", "0.20", "9.80", "2024,", "1,020", "1999.0"] and row.u == ["2024,", "1999.0"]
    assert column(spark, [[3, 5]], R.pairwise, "array<long>") == [[6, 0, 8, 2, 10]]


def test_refunds_use_each_original_once(spark):
    day = lambda d: datetime.date(2024, 1, d)
    row = lambda i, paise, d, who="w", ref="r", batch="b": (i, batch, "bank", ref, paise, None, None, None, d and day(d), who, None)
    rows = [row("a1", 500, 1), row("a2", 500, 3), row("r1", -500, 4), row("r2", -500, 5), row("r3", -500, 6), row("a4", 500, 2, None, "xx-1"), row("r4", -500, 2, None, "xx1"), row("r5", -500, None), row("r6", -500, 4, batch="c")]
    got = sorted(map(tuple, M.refund_pairs(spark.createDataFrame(rows, ROW)).collect()))
    assert got == [("r1", "a2", 1), ("r2", "a1", 4), ("r4", "a4", 0)]


def test_empty_references_never_link(spark):
    t = records(spark, [("a", "bank", "", 5, None, None, 1), ("b", "ledger", "", 5, None, None, 1), ("c", "gateway", None, 5, None, None, 1), ("d", "gateway", "", 5, None, None, 1)])
    assert M.candidate_pairs(t, t).count() == 0


def test_null_tax_leaves_forms_out(spark):
    t = records(spark, [("g", "gateway", "AAA", 1000, 20, None, 1), ("k", "bank", "X", 980, None, None, 1), ("l", "ledger", "X", 979, None, None, 1)])
    assert [(r.o, r.label) for r in M.fee_pairs(t, t).collect()] == [("k", "gross_minus_fee")]


def test_group_category(spark):
    df = spark.createDataFrame([(99, datetime.date(2001, 8, 1)), (-100, datetime.date(2001, 8, 1)), (100, datetime.date(2001, 7, 1)), (100, None)], "r long, d date")
    assert [r.c for r in df.select(P.group_category(F.col("r"), F.col("d"), "2001-08-05").alias("c")).collect()] == ["residual_rounding", "timing", "unclassified", "unclassified"]


def test_usage_of_unknown_providers(spark):
    a = spark.createDataFrame([("batch_explained", None, 9, 4), ("batch_explained", "nvidia", 1000, 500), ("batch_failed", "nvidia", 5, 2), ("viewed", "nvidia", None, None), ("batch_explained", "nvidia", None, None)], "action string, provider string, prompt_tokens long, completion_tokens long")
    got = {r.provider: r for r in P.usage(a).collect()}
    assert (got["unknown"].unpriced_tokens, got["unknown"].cost_usd) == (13, 0.0)
    assert (got["nvidia"].calls, got["nvidia"].failed, got["nvidia"].prompt_tokens, round(got["nvidia"].cost_usd, 8)) == (2, 1, 1000, 0.00018)


def test_paged_source(spark):
    items = [{"id": f"p{i}", "amount": i, "created_at": i * 1000} for i in range(250)]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            own = [x for x in items if q["from"] <= x["created_at"] <= q["to"]]
            body = json.dumps({"items": own[q["skip"] : q["skip"] + q["count"]]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(payments.PagedSource)
    read = spark.read.format("paged").schema("id string, amount long, status string").options(url=f"http://127.0.0.1:{server.server_port}/", page="20", **{"from": "0", "to": "249000"})
    rows = read.load().collect()
    server.shutdown()
    assert sorted(r.id for r in rows) == sorted(x["id"] for x in items) and {r.status for r in rows} == {None}


def test_sparse_workbook_cells(spark, tmp_path):
    ns = files._NS[1:-1]
    cell = lambda ref, x: f'<c r="{ref}" t="inlineStr"><is><t>{x}</t></is></c>'
    body = "<row>" + "".join(cell(f"{c}1", x) for c, x in zip("ABCD", ["Date", "Voucher No", "Particulars", "Amount"])) + "</row><row>" + cell("A2", "05-03-2024") + cell("D2", "7.00") + "</row>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for n in (10, 2):
            book.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="{ns}"><sheetData>{body.replace("7.00", f"{n}.00")}</sheetData></worksheet>')
    (tmp_path / "l.xlsx").write_bytes(out.getvalue())
    rows = files.read_ledger_xlsx(spark, str(tmp_path)).orderBy("sheet").collect()
    assert [(r.sheet, r.line, r.amount_paise, r.external_ref) for r in rows] == [(0, 2, 200, ""), (1, 2, 1000, "")]


def test_quoted_line_ends(spark, tmp_path):
    (tmp_path / "b.csv").write_text('value_date,narration,debit,credit,balance\n01/02/2024,"NEFT\nAB12",,5.00,1\n02/02/2024,CD34,1.00,,1\n')
    rows = files.read_bank_csv(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r.line, r.external_ref, r.amount_paise) for r in rows] == [(3, "AB12", 500), (4, "CD34", -100)]


def test_full_queue_makes_its_records_once(spark, monkeypatch):
    from tallyloom import queries

    made, real = [], report_queries.written
    for module in (queries, report_queries):
        monkeypatch.setattr(module, "written", lambda df, what: made.append(what) or real(df, what))
    con = duckdb.connect()
    for table in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    want = con.execute(report_oracles.ORACLES["full_queue"]).fetchall()
    got = report_queries.full_queue(spark, DATA).select("kind", "category", "n", "net_paise").collect()
    assert sorted(map(tuple, got)) == sorted(want) and made == ["txns", "open"]
