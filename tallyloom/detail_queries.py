"""Registered queries that show single things: records, batches and their funnels, times and counts; and made records with their answer key; with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import display as D
from .functions import scalars as S
from .operators import cascade, detail
from .operators import match as M
from .operators import tiers as T
from .operators.shared import written
from .oracles import _BASE, _SHOWN, _WALK
from .plans import scenarios
from .plans.corpus import CORPUS, match_view, txns
from .plans.ledger import AUDIT, VARIANCES, audit, variances
from .queries import AS_OF
from .streaming.activity import activity

NOW = "2024-01-15 12:00:00"


def record_details(spark, d):
    """A record's twelve fields; descriptions and raw hold marks of the answer key before."""
    n = F.col("amount_paise")
    text = F.when(n % 3 == 0, F.concat(F.lit("synthetic:"), "source_kind")).when(n % 3 == 1, F.concat(F.lit("by "), "counterparty"))
    raw = F.when(n % 5 > 0, F.create_map(F.lit("category"), F.lit("x"), F.lit("currency"), F.lit("INR"), F.lit("settlement_id"), F.coalesce("settlement_id", F.lit("none"))))
    t = txns(spark, d).withColumns({"value_date": F.date_sub("txn_date", 1), "description": text, "raw": raw})
    return detail.record_details(t).withColumn("raw", F.to_json("raw"))


def ugliest_rows(spark, d):
    t = _statement(txns(spark, d))
    return detail.ugliest(t, "txn_id", F.col("description"), [F.col("debit"), F.col("credit")]).select("txn_id", "ugliness")


def _statement(t):
    shown = S.rupees(F.col("amount_paise"))
    return t.select("txn_id", F.when(F.col("amount_paise") < 0, shown).alias("debit"), F.when(F.col("amount_paise") >= 0, F.concat(F.lit("Rs. "), shown)).alias("credit"), F.when(F.col("amount_paise") % 2 == 0, F.repeat(F.col("external_ref"), 4)).alias("description"))


def batch_orders(spark, d):
    """The first ten batches in each order, upwards and downwards."""
    v = variances(spark, d)
    waiting = (F.col("status") == "open") & (F.col("category") == "unexplained")
    batches = v.groupBy("batch_id").agg(F.count("*").alias("records"), F.count_if(F.col("status") == "open").alias("open_rows"), F.sum(F.when(waiting, F.abs("variance_paise"))).alias("unexplained_paise"))
    batches = written(batches.withColumn("created_at", F.to_timestamp(F.concat("batch_id", F.lit("-01")))), "batches")
    out = None
    for by in detail.ORDERS:
        for up in (False, True):
            ten = detail.batch_order(batches, by, up).limit(10).withColumn("row", F.monotonically_increasing_id())
            part = ten.select(F.lit(by).alias("ordered_by"), F.lit(up).alias("upwards"), F.row_number().over(W.orderBy("row")).alias("place"), "batch_id")
            out = part if out is None else out.unionByName(part)
    return out


def batch_funnel(spark, d):
    """The funnel of every batch over tiers 1 and 2, with a queue of the open rows and of groups whose amounts differ."""
    t = written(match_view(txns(spark, d)), "txns")
    one = written(M.exact_members(t), "members")
    two = written(M.cluster_members(M.unmatched(t, one)), "members")
    both = one.select("*", F.lit(1).alias("tier"), F.lit("exact").alias("strategy")).unionByName(two.select("*", F.lit(2).alias("tier"), F.lit("reference").alias("strategy")))
    apart = both.groupBy("batch_id", "group_id").agg((F.max("amount_paise") - F.min("amount_paise")).alias("variance_paise")).where("variance_paise <> 0").drop("group_id")
    open_rows = M.variance_queue(t, M.unmatched(t, both), AS_OF).select("batch_id", F.col("amount_paise").alias("variance_paise"))
    return detail.batch_funnel(t, both, open_rows.unionByName(apart))


def shown_times(spark, d):
    """How long ago each event of the audit log was, and times spent, as they are shown."""
    a = audit(spark, d)
    spent = F.when(F.col("id") % 7 > 0, (F.col("id") % 4000).cast("double") / 4)
    return a.select("id", D.time_apart(F.date_trunc("second", "created_at"), F.lit(NOW).cast("timestamp")).alias("apart"), D.time_spent(spent).alias("spent"), D.padded(D.shortened(F.col("step"), "id"), 6).alias("step"))


def shown_counts(spark, d):
    """Counts, ratios and percentages of each batch, as they are shown."""
    v = variances(spark, d).groupBy("batch_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "open").alias("open_rows"), F.sum("variance_paise").alias("net"))
    ratio = F.when(F.col("n") % 5 > 0, F.col("open_rows") / 1024)
    return v.select("batch_id", D.count_text(F.col("net")).alias("net"), D.ratio_text(ratio, 3).alias("ratio"), D.percent_text(ratio, 4).alias("percent"))


def _events(spark, d):
    day = F.col("o_orderdate").cast("date")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("event_id"), F.date_format(day, "yyyy-MM").alias("batch_id"), F.trunc(day, "month").alias("first_day"))


def generated_corpus(spark, d):
    """Records of nine scenarios made from orders: events, records and truth groups per batch and scenario; fails if they don't fit the answer key."""
    e = _events(spark, d)
    return scenarios.verified(scenarios.generated(e), e)


def made_scores(spark, d):
    """All tiers over the made records, scored against their answer key by tier."""
    full = written(scenarios.generated(_events(spark, d)), "made")
    t = written(match_view(full.withColumn("counterparty", F.lit(None).cast("string"))), "txns")
    return T.scores_by_tier(cascade.run(t), full.select("txn_id", "truth_group"))


def tick_activity(spark, d):
    """Payments and refunds that each event of the log, taken as a tick, sets off, and the seconds to the next tick."""
    made = activity(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("tick"), "ts"))
    wait = F.floor((F.unix_micros("next_ts") - F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000)
    return made.select("tick", "kind", "place", "amount_paise", wait.alias("wait_seconds"))


QUERIES = {f.__name__: f for f in (record_details, ugliest_rows, batch_orders, batch_funnel, shown_times, shown_counts, generated_corpus, made_scores, tick_activity)}

_A, _V = f"WITH a AS ({AUDIT}) ", f"WITH v AS ({VARIANCES}) "
_TOP = "SELECT '{by}' AS ordered_by, {up} AS upwards, row_number() OVER (ORDER BY {key} {way}, batch_id)::INT AS place, batch_id FROM b QUALIFY place <= 10"
_KEYS = {"created": "batch_id", "unexplained": "coalesce(u, 0)", "open": "o", "records": "n"}
_COUNT = "CASE WHEN length(w) <= 3 THEN w ELSE ltrim(reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(\\d\\d)', '\\1,', 'g')), ',') || ',' || right(w, 3) END"
_CHANCE = lambda name, more="": f"(('0x' || left(md5('1/{name}/' || tick{more}), 8))::BIGINT / 4294967296.0::DOUBLE)"
_SHARES = ", ".join(f"({i}, '{k}', {w}::DOUBLE)" for i, (k, w) in enumerate(scenarios.WEIGHTS.items()) if i)

ORACLES = {
    "record_details": f"""SELECT txn_id, source_kind, external_ref, amount_paise, fee_paise, tax_paise, net_paise, txn_date, CAST(txn_date - INTERVAL 1 DAY AS DATE) AS value_date,
  CASE WHEN amount_paise % 3 = 1 THEN 'by ' || counterparty ELSE '' END AS description, counterparty, CASE WHEN amount_paise % 5 > 0 THEN '{{"currency":"INR","settlement_id":"' || coalesce(settlement_id, 'none') || '"}}' END AS raw FROM ({CORPUS})""",
    "ugliest_rows": _BASE.rstrip().rstrip(",") + f""" SELECT txn_id, 10 * (length(x) - length(replace(x, ',', ''))) + length(x) + coalesce(length(description), 0) // 20 AS ugliness
FROM (SELECT s.txn_id, CASE WHEN t.amount_paise >= 0 THEN 'Rs. ' ELSE '' END || shown AS x, CASE WHEN t.amount_paise % 2 = 0 THEN repeat(external_ref, 4) END AS description FROM {_SHOWN} s JOIN t USING (txn_id)) ORDER BY 2 DESC, 1 LIMIT 5""",
    "batch_orders": _V.rstrip() + ", b AS (SELECT batch_id, count(*) AS n, count(*) FILTER (status = 'open') AS o, sum(abs(variance_paise)) FILTER (status = 'open' AND category = 'unexplained') AS u FROM v GROUP BY 1) "
    + " UNION ALL ".join(f"({_TOP.format(by=by, up=up, key=key, way='ASC' if up else 'DESC')})" for by, key in _KEYS.items() for up in (False, True)),
    "batch_funnel": _BASE
    + _WALK.rstrip()
    + f""", g AS (SELECT batch_id, tier, group_id, count(*) AS n, max(amount_paise) - min(amount_paise) AS r FROM (SELECT 1 AS tier, batch_id, group_id, amount_paise FROM one UNION ALL SELECT 2, batch_id, group_id, amount_paise FROM two) GROUP BY ALL),
k AS (SELECT batch_id, count(*) AS n, sum(abs(p)) AS r FROM (SELECT batch_id, r AS p FROM g WHERE r <> 0 UNION ALL SELECT batch_id, amount_paise FROM rest WHERE txn_id NOT IN (SELECT txn_id FROM two)) GROUP BY 1)
SELECT batch_id, 0 AS place, 'Records ingested' AS label, NULL::BIGINT AS groups, count(*) AS records, 'gateway + bank + ledger' AS strategy, 0::BIGINT AS residual_paise FROM t GROUP BY 1
UNION ALL SELECT batch_id, tier, 'Tier ' || tier, count(*), sum(n)::BIGINT, CASE tier WHEN 1 THEN 'exact' ELSE 'reference' END, sum(r)::BIGINT FROM g GROUP BY 1, tier
UNION ALL SELECT batch_id, 99, 'Variance queue', coalesce(k.n, 0), w.n - coalesce(m.n, 0), 'unmatched records + unbalanced groups', coalesce(r, 0)::BIGINT
FROM (SELECT batch_id, count(*) AS n FROM t GROUP BY 1) w LEFT JOIN k USING (batch_id) LEFT JOIN (SELECT batch_id, sum(n)::BIGINT AS n FROM g GROUP BY 1) m USING (batch_id)""",
    "shown_times": _A.rstrip() + f""", x AS (SELECT id, step, abs(s) AS n, s > 0 AS ahead, CASE WHEN id % 7 > 0 THEN (id % 4000) / 4.0::DOUBLE END AS spent FROM (SELECT *, date_diff('second', TIMESTAMP '{NOW}', date_trunc('second', created_at)) AS s FROM a)),
y AS (SELECT *, CASE WHEN n < 45 THEN n || 's' WHEN n < 3600 THEN floor(n / 60 + 0.5)::BIGINT || 'm' WHEN n < 86400 THEN floor(n / 3600 + 0.5)::BIGINT || 'h' ELSE floor(n / 86400 + 0.5)::BIGINT || 'd' END AS body FROM x)
SELECT id, CASE WHEN ahead THEN 'in ' || body ELSE body || ' ago' END AS apart, CASE WHEN spent IS NULL THEN '{D.DASH}' WHEN spent < 60 THEN (floor(spent * 10 + 0.5)::BIGINT // 10) || '.' || (floor(spent * 10 + 0.5)::BIGINT % 10) || 's' ELSE floor(spent / 60)::BIGINT || 'm ' || floor(spent % 60 + 0.5)::BIGINT || 's' END AS spent,
  CASE WHEN length(step) < 6 THEN rpad(step, 6, ' ') ELSE left(step, 8) END AS step FROM y""",
    "shown_counts": _V + f"""SELECT batch_id, CASE WHEN net < 0 THEN '-' ELSE '' END || {_COUNT} AS net, CASE WHEN n % 5 > 0 THEN (o * 200000 + 1024) // 2048 // 1000 || '.' || lpad(((o * 200000 + 1024) // 2048 % 1000)::VARCHAR, 3, '0') || '%' ELSE '{D.DASH}' END AS ratio, CASE WHEN n % 5 > 0 THEN (o * 20000 + 1024) // 2048 // 10000 || '.' || lpad(((o * 20000 + 1024) // 2048 % 10000)::VARCHAR, 4, '0') || '%' ELSE '{D.DASH}' END AS percent
FROM (SELECT *, abs(net)::VARCHAR AS w FROM (SELECT batch_id, count(*) AS n, count(*) FILTER (status = 'open') AS o, sum(variance_paise)::BIGINT AS net FROM v GROUP BY 1))""",
    "tick_activity": f"""WITH k AS (SELECT event_id AS tick FROM events),
u AS (SELECT tick, {_CHANCE("quiet")} < 0.35 AS quiet, 1 + floor({_CHANCE("payments")} * 4)::BIGINT AS n, {_CHANCE("refund")} < 0.2 AS refund, {_CHANCE("partial")} < 0.5 AS part, {_CHANCE("target")} AS target, 1200 + floor({_CHANCE("wait")} * 4201)::BIGINT AS wait FROM k),
p AS (SELECT *, 30000 + 100 * floor({_CHANCE("amount", " || '/' || i")} * 4701)::BIGINT AS paise FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM u WHERE NOT quiet))
SELECT tick, 'quiet' AS kind, 0::INT AS place, NULL::BIGINT AS amount_paise, wait AS wait_seconds FROM u WHERE quiet
UNION ALL SELECT tick, 'payment', i::INT, paise, wait FROM p
UNION ALL SELECT tick, 'refund', i::INT, -CASE WHEN part THEN paise // 3 ELSE paise END, wait FROM p WHERE refund AND i = 1 + floor(target * n)""",
    "generated_corpus": f"""WITH p AS (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY md5('20260826/' || k), k) - 1 AS pos, count(*) OVER (PARTITION BY batch_id) AS n FROM (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m') AS batch_id FROM orders)),
c AS (SELECT batch_id, scenario, size, sum(size) OVER (PARTITION BY batch_id ORDER BY place) - size AS first FROM (SELECT batch_id, place, scenario, floor(n * share + 0.5)::BIGINT AS size FROM (SELECT DISTINCT batch_id, n FROM p), (VALUES {_SHARES}) w(place, scenario, share))),
s AS (SELECT p.batch_id, coalesce(scenario, 'clean_3way') AS scenario, pos - first AS i, size FROM p LEFT JOIN c ON p.batch_id = c.batch_id AND pos >= first AND pos < first + size),
z AS (SELECT g, 5 + g % 8 AS n, sum(5 + g % 8) OVER (ORDER BY g) - (5 + g % 8) AS start FROM range(20000) r(g)),
q AS (SELECT batch_id, count(DISTINCT CASE WHEN size - start < 5 AND g > 0 THEN g - 1 ELSE g END) AS settlements FROM s JOIN z ON scenario = 'many_to_one' AND i >= start AND i < start + n GROUP BY 1),
e AS (SELECT batch_id, scenario, count(*) AS n FROM s GROUP BY 1, 2)
SELECT batch_id, scenario, n AS events, (n * CASE scenario WHEN 'many_to_one' THEN 2 WHEN 'refund_chargeback' THEN 6 WHEN 'missing_one_source' THEN 2 WHEN 'duplicate_one_source' THEN 4 WHEN 'genuine_noise' THEN 1 ELSE 3 END + CASE scenario WHEN 'many_to_one' THEN settlements ELSE 0 END)::BIGINT AS records,
  (CASE scenario WHEN 'many_to_one' THEN settlements WHEN 'genuine_noise' THEN 0 ELSE n END)::BIGINT AS groups FROM e LEFT JOIN q USING (batch_id)""",
}
