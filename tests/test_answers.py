"""The explainer's report, contexts and answers to questions, and the daily summary."""

import datetime
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom import answer_queries
from tallyloom.functions import review as R
from tallyloom.operators import explained, questions
from tallyloom.operators import match as M
from tallyloom.operators import reports as P
from tallyloom.sources import payments

from .test_reconciliation import DATA, column


@pytest.mark.parametrize("name", sorted(answer_queries.QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(answer_queries.ORACLES[name]).df()
    got = answer_queries.QUERIES[name](spark, DATA).toPandas()
    assert sorted(want.columns) == sorted(got.columns) and len(got)
    plain = lambda x: "none" if x is None or x != x else str(x).removesuffix(" 00:00:00")
    rows = lambda df: sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_labels_of_all_records(spark):
    queue = [(1, "a", None, "gateway_fee", "{}"), (2, "a", "g", "gateway_fee", "{}"), (3, None, "g2", "x", "{}"), (4, None, None, None, "{}"), (5, "b", "g3", "", ""), (6, "a", None, "gateway_fee", None), (7, "zz", "none", None, "{}")]
    rows = spark.createDataFrame([("b", i, t, g, c, "many_to_one" if i == 3 else None, 0.5, "x" * 300 if i == 5 else None, m) for i, t, g, c, m in queue], "batch_id string, id long, txn_id string, match_group_id string, category string, subcategory string, confidence double, explanation string, model_raw string")
    members = spark.createDataFrame([("g", "b"), ("g", "a"), ("g2", "c"), ("g3", "b"), ("g3", "b")], "group_id string, txn_id string")
    records = spark.createDataFrame([("a", "synthetic:fee_tax_split", "other"), ("b", None, "genuine_noise"), ("c", "synthetic:", None)], "txn_id string, description string, raw_category string")
    got = {r.id: (r.outcome, r.scenario) for r in explained.graded(rows, members, records).collect()}
    assert got == {1: ("right", "fee_tax_split"), 2: ("ambiguous", None), 3: ("unlabelled", None), 4: ("unlabelled", None), 5: ("wrong", "genuine_noise"), 7: ("unlabelled", None)}
    parts = explained.report(rows, members, records)
    s = parts["summary"].collect()[0]
    assert (s.total, s.classified, s.graded, s.correct, s.accuracy_pct, s.ambiguous, s.unlabelled, s.with_text, s.quotation_pct) == (7, 6, 2, 1, 50.0, 1, 3, 1, 0.0)
    miss = parts["misses"].collect()
    assert [(m.place, m.id, m.predicted, len(m.explanation)) for m in miss] == [(1, 5, "(none)", 200)] and parts["quotes"].count() == 0


SCORE = "batch_id string, total_txns long, matched_txns long, match_rate double, precision double, recall double, f1 double, unexplained_paise long, grounding_pct double"
QUEUE = "batch_id string, id long, variance_paise long, category string, status string, suggested_action string, explanation string"
GROUP = "batch_id string, group_id string, tier int, strategy string, members long, variance_paise long"


def contexts(spark, queue=(), budget=questions.BUDGET):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    scores = [("b", 10, 5, 0.5, 1.0, None, 0.00001, None, 99.5)]
    out = questions.context(frame([("b",), ("empty",)], "batch_id string"), frame(scores, SCORE), frame(list(queue), QUEUE), frame([("b", "g", None, None, 3, None)], GROUP), budget)
    return {r.batch_id: r.context.split("\n") for r in out.collect()}


def test_context(spark):
    queue = [("b", i, (-1) ** i * 100 * i, None, "open", None, " " if i % 2 else "why\nso") for i in range(1, 8)] + [("b", 99, None, "c", None, None, None)]
    got = contexts(spark, queue)
    assert got["b"][:9] == ["RECONCILIATION RUN — batch b", "RUN SCORE", "  total transactions ingested: 10", "  transactions matched into a group: 5", "  match rate: 0.5 (50.00%)", "  precision: 1.0 (100.00%)", "  recall: not recorded", "  f1: 0.00001 (0.00%)", "  explanation grounding rate: 99.5%"]
    assert got["b"][10] == "  uncategorised [open]: 7 variances, total -Rs 4.00 (-400 paise)" and got["b"][11] == "  c [unknown]: 1 variances, total Rs 0.00 (0 paise)"
    assert got["b"][13] == "  1. -Rs 7.00 (-700 paise) — category none, suggested action none" and sum("explanation: why" in x for x in got["b"]) == 2
    assert got["b"][-1] == "  tier ? (?): 1 groups, 3 transactions, residual variance Rs 0.00 (0 paise)"
    assert [x.strip() for x in got["empty"] if x.startswith("  ")] == ["no score recorded for this batch", "the variance queue is empty for this batch", "no open variances", "no match groups recorded for this batch"]
    whole = "\n".join(got["b"])
    assert contexts(spark, queue, len(whole))["b"] == got["b"]
    short = contexts(spark, queue, len(whole) - 1)["b"]
    assert short[-1] == questions.CUT and short[:-1] == got["b"][:-1]


def test_answers_are_asked_twice_at_most(spark, tmp_path):
    rows = spark.createDataFrame([(b, "rows: 12,000") for b in ("good", "second", "never", "silent", "fails")], "batch_id string, context string").withColumn("context", F.concat("batch_id", F.lit(" "), "context"))
    seen = f"{tmp_path}/seen"

    def model(texts):
        name = texts[0].split("RUN:\n\n")[1].split(" ")[0]
        with open(seen, "a") as f:
            f.write(name + "\n")
        again = open(seen).read().split().count(name) > 1
        if name == "fails":
            raise OSError("down")
        return [{"good": "it is 12000.00", "second": "12000" if again else "13000", "never": "14000 or 15", "silent": None}[name]]

    got = {r.batch_id: (r.answer, r.verified, r.attempts, r.untraced) for r in questions.answered(rows, F.lit("how many?"), model, f"file://{tmp_path}/a").collect()}
    refused = questions.REFUSAL
    assert got == {"good": ("it is 12000.00", True, 1, ""), "second": ("12000", True, 2, ""), "never": (refused, False, 2, "14000 15"), "silent": (refused, False, 2, ""), "fails": (refused, False, 2, "")}
    assert sorted(open(seen).read().split()) == sorted(["good"] + 2 * ["second", "never", "silent", "fails"])


def test_facts_quoted(spark):
    pairs = [("₹1,42,900.00", "it is 142900.00 rupees"), ("n/a", "12"), ("12", None), ("12", "3,12.5"), ("7", "6")]
    rows = spark.createDataFrame(pairs, "f string, a string").select(R.quoted(F.col("f"), F.col("a")).alias("q"))
    assert [r.q for r in rows.collect()] == [True, False, False, True, False]
    assert column(spark, ["0.9748", "1", None], lambda x: R.ratio_with_percent(x.cast("double"))) == ["0.9748 (97.48%)", "1.0 (100.00%)", "not recorded"]


def test_day_summary_as_stream(spark, tmp_path):
    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    batches = spark.createDataFrame([(at(1, 1), at(2, 1), "failed"), (at(1, 23), None, None)], "created_at timestamp, completed_at timestamp, status string")
    one = spark.createDataFrame([(at(1, 5),)], "created_at timestamp")
    scores = spark.createDataFrame([(at(2, 0), 5, 50.0), (at(2, 3), None, None), (at(2, 4), 7, 51.0)], "run_at timestamp, unexplained_paise long, grounding_pct double")
    rows = P.activity(batches, one, one.limit(0), scores)
    want = {(datetime.date(2024, 1, 1), 2, 0, 1, 0, 1, 0, 0, None), (datetime.date(2024, 1, 2), 0, 1, 0, 0, 0, 3, 12, 50.5)}
    assert {tuple(r) for r in P.day_summary(rows).collect()} == want
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in").withWatermark("at", "1 day")
    P.day_summary(stream).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("days").collect()} == want


def test_rows_of_a_settlement(spark):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            asked.append((url.path, q))
            if url.path.endswith("/combined"):
                rows = [{"entity_id": f"p{i}", "amount": i, "settlement_id": "s/1" if i % 3 else "other"} for i in range(25)]
                skip, n = int(q["skip"]), int(q["count"])
                reply = {"items": rows[skip : skip + n]}
            else:
                reply = {"id": "x", "created_at": 1709683199} if url.path.endswith("s%2F1") else {}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, schema = f"http://127.0.0.1:{server.server_port}", "entity_id string, amount long, settlement_id string"
    got = payments.settlement_rows(spark, url, "s/1", schema, page=10).collect()
    with pytest.raises(ValueError, match="created_at"):
        payments.settlement_rows(spark, url, "unknown", schema)
    server.shutdown()
    assert sorted(r.amount for r in got) == [i for i in range(25) if i % 3]
    pages = [q for path, q in asked if path.endswith("/combined")]
    assert {(q["year"], q["month"], q["day"]) for q in pages} == {("2024", "3", "5")} and [q["skip"] for q in pages] == ["0", "10", "20"]


def test_declared_currencies_must_agree(spark):
    columns = "txn_id string, batch_id string, source_kind string, external_ref string, amount_paise long, fee_paise long, tax_paise long, net_paise long, txn_date date, counterparty string, settlement_id string, currency string"
    day = datetime.date(2024, 1, 5)
    row = lambda i, kind, amount, currency: (i, "b", kind, i, amount, 0, 0, amount, day, "c", None, currency)
    t = spark.createDataFrame([row("B1", "bank", 100, "INR"), row("B2", "bank", 100, ""), row("p1", "gateway", 10, "INR"), row("p2", "gateway", 10, "USD"), row("p3", "gateway", 10, None), row("p4", "gateway", 10, "")], columns)
    none = spark.createDataFrame([], "txn_id string, group_id string")
    found = lambda t: {(r.bank, r.txn_id) for r in M.rule_candidates(*M.open_settlements(t, none)).collect()}
    every = {(b, p) for b in ("B1", "B2") for p in ("p1", "p2", "p3", "p4")}
    assert found(t) == every - {("B1", "p2")} and found(t.drop("currency")) == every
