"""Streams with restarts against their batch forms."""

import datetime
import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from tallyloom.plans.ledger import audit
from tallyloom.sources import payments
from tallyloom.streaming import live, progress

DATA = "/root/testdata/sf0.001"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_progress_and_silence_with_a_restart(rocksdb, tmp_path):
    """Two files, a restart, a third one; all steps once, and the silences of the batch form."""
    spark, final = rocksdb, ["purchase"]
    rows = audit(spark, DATA).select("batch_id", "step", F.col("created_at").cast("timestamp").alias("created_at")).orderBy("created_at", "step").limit(400).cache()
    cuts = [*rows.select(F.percentile(F.unix_micros("created_at"), F.array(F.lit(0.3), F.lit(0.6))).alias("p")).first().p]
    end = rows.agg(F.max("created_at")).first()[0] + datetime.timedelta(days=2)
    mover = spark.createDataFrame([("mover", "purchase", end), ("mover", "purchase", end + datetime.timedelta(days=1))], rows.schema)
    at = F.unix_micros("created_at")
    parts = [rows.where(at < cuts[0]), rows.where((at >= cuts[0]) & (at < cuts[1])), rows.where(at >= cuts[1]), mover.limit(1), mover]

    def run(own):
        for i, part in own:
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = progress.progress_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), final)
            stream.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out", format="parquet").awaitTermination()

    run(enumerate(parts))
    out = spark.read.parquet(f"{tmp_path}/out").where("batch_id <> 'mover'")
    steps = out.where("kind = 'step'").select("batch_id", "step", "at")
    want = progress.steps_done(rows)
    assert steps.count() == want.count() and steps.select("batch_id", "step").exceptAll(want.select("batch_id", "step")).count() == 0
    silent = out.where("kind = 'idle'").select("batch_id", "at")
    whole = progress.fallen_silent(rows.unionByName(mover), final)
    assert silent.count() > 0 and silent.exceptAll(whole).count() == 0
    last = rows.groupBy("batch_id").agg(F.max("created_at").alias("at"), F.max((F.col("step") == "purchase").cast("int")).alias("over")).where("over = 0")
    assert last.select("batch_id", "at").exceptAll(silent).count() == 0


def test_late_rows_are_kept_apart(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    days = [r.d for r in events.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    day = F.to_date("ts")
    parts = [events.where(day <= days[2]), events.where((day > days[3]) & (day <= days[8])), events.where((day == days[3]) | (day > days[8]))]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        progress.ingest_by_lateness(spark, f"{tmp_path}/in", events.schema, f"{tmp_path}/sink", f"{tmp_path}/cp").awaitTermination()
    late = spark.read.parquet(f"{tmp_path}/sink/late").drop("batch")
    wanted = events.where(day == days[3])
    assert late.count() == wanted.count() > 0 and late.exceptAll(wanted.select(late.columns)).count() == 0
    kept = progress.counted_days(spark, f"{tmp_path}/sink", events.schema)
    assert kept.where(F.col("day") == days[3]).count() == 0
    assert sorted(progress.counted_days(spark, f"{tmp_path}/sink", events.schema, True).collect()) == sorted(live.daily(events).collect())


def test_paged_stream_takes_each_item_once(spark, tmp_path):
    items = [{"id": f"pay_{i}", "amount": 100 + i, "fee": 2, "tax": 1, "email": "a@b", "contact": None, "created_at": 1_700_000_000 + 3600 * i, "status": "captured"} for i in range(60)]

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            own = [x for x in items if q["from"] <= x["created_at"] <= q["to"]]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"items": own[q["skip"] : q["skip"] + q["count"]]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(payments.PagedSource)
    schema = "id string, amount long, fee long, tax long, email string, contact string, created_at long, status string"

    def run(until):
        options = {"url": f"http://127.0.0.1:{server.server_port}/p", "page": "7", "until": str(until), "late": "7200"}
        stream = spark.readStream.format("paged").schema(schema).options(**options).load()
        payments.ingest_payments(spark, stream, "b", f"{tmp_path}/sink", f"{tmp_path}/cp").awaitTermination()
        return sorted(r.external_ref for r in spark.read.parquet(f"{tmp_path}/sink").collect())

    try:
        late = items.pop(29)
        assert run(1_700_000_000 + 3600 * 30) == sorted(x["id"] for x in items[:30])
        items.append(late)  # comes after the cursor has passed its time
        assert run(1_700_000_000 + 3600 * 50) == sorted(x["id"] for x in items if x["created_at"] <= 1_700_000_000 + 3600 * 50)
        assert run(1_700_000_000 + 3600 * 50) == sorted(x["id"] for x in items if x["created_at"] <= 1_700_000_000 + 3600 * 50)
    finally:
        server.shutdown()


def test_looks_again_after_a_while(spark, tmp_path):
    rows = spark.range(10)
    rows.write.parquet(f"{tmp_path}/in")
    query = live.ingest(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", f"{tmp_path}/cursor", "1 second")
    try:
        query.processAllAvailable()
        spark.range(10, 25).write.mode("append").parquet(f"{tmp_path}/in")
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(25))
