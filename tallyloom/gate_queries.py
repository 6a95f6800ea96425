"""Registered queries that count, check and assert: ingest summaries, the residual identity, contexts to be sent, progress of batches; with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .functions import review as R
from .functions import scalars as S
from .operators import classify
from .operators import match as M
from .operators.shared import shared_folder, written
from .oracles import _BASE, _QUEUE, _WALK
from .plans.corpus import CORPUS, match_view, txns
from .plans.ledger import AUDIT, audit
from .queries import QUERIES as RECON
from .sources import ingest
from .sources.files import parsed_rows
from .streaming import progress

FINAL = ["purchase"]


def _statement(spark, d):
    """The bank rows as lines of a statement, of which some are unreadable, by rules on the amount."""
    t = txns(spark, d).where("source_kind = 'bank'")
    money, n = S.rupees(F.col("amount_paise")), F.col("amount_paise")
    debit = F.when((n % 13 == 0) | (n >= 0) & (n % 17 != 0), "").otherwise(money)
    credit = F.when((n % 13 == 0) | (n < 0) & (n % 17 != 0), "").when(n % 19 == 0, "oops").otherwise(money)
    narration = F.when(n % 23 == 0, "BY TRANSFER").otherwise(F.concat(F.lit("NEFT/"), "external_ref"))
    raw = t.select("batch_id", F.lit("bank").alias("source_kind"), F.regexp_extract("txn_id", r"(\d+)", 1).cast("int").alias("line"), F.date_format("txn_date", "dd/MM/yyyy").alias("value_date"), narration.alias("narration"), debit.alias("debit"), credit.alias("credit"))
    return written(parsed_rows(raw, "batch_id", "source_kind"), "statement")


def ingest_summary(spark, d):
    return ingest.by_source(_statement(spark, d), "batch_id")


def first_skips(spark, d):
    return ingest.first_skips(_statement(spark, d), "batch_id").select("batch_id", "line", "reason", "place")


def residual_identity(spark, d):
    """Per batch, over tiers 1 and 2: all rows are open, in a balanced or in an unbalanced group; what is unexplained is checked both ways.

    A group's residual is its spread of amounts. A batch whose sums don't agree fails the query.
    """
    t = written(match_view(txns(spark, d)), "txns")
    one = written(M.exact_members(t), "members")
    both = written(one.unionByName(M.cluster_members(M.unmatched(t, one))), "members")
    groups = both.groupBy("batch_id", "group_id").agg(F.sum("amount_paise").alias("own"), (F.max("amount_paise") - F.min("amount_paise")).alias("residual"))
    level = F.col("residual") == 0
    made = groups.groupBy("batch_id").agg(F.sum(F.when(level, F.col("own")).otherwise(0)).alias("balanced_paise"), F.sum(F.when(level, 0).otherwise(F.col("own"))).alias("unbalanced_paise"), F.sum("residual").alias("residual_paise"))
    rest = M.unmatched(t, both).groupBy("batch_id").agg(F.sum("amount_paise").alias("open_paise"))
    out = t.groupBy("batch_id").agg(F.sum("amount_paise").alias("total_paise")).join(made, "batch_id", "left").join(rest, "batch_id", "left").na.fill(0)
    expected = F.col("total_paise") - F.col("balanced_paise") - (F.col("unbalanced_paise") - F.col("residual_paise"))
    out = out.withColumn("unexplained_paise", F.col("open_paise") + F.col("residual_paise"))
    return out.where(F.assert_true(F.col("unexplained_paise") == expected, F.lit("a batch's sums don't agree")).isNull())


def model_context(spark, d):
    """What a model would be sent of a bank row; the query fails if any of it holds a mark of the answer key."""
    t = txns(spark, d).where("source_kind = 'bank'")
    raw = F.create_map(F.lit("settlement_id"), F.coalesce("settlement_id", F.lit("")), F.lit("category"), F.lit("x"))
    text = F.when(F.col("amount_paise") % 3 == 0, F.concat(F.lit("synthetic:"), "external_ref")).otherwise(F.col("external_ref"))
    sent = t.select("txn_id", "batch_id", "amount_paise", S.redacted_description(text).alias("description"), S.redacted_raw(raw).alias("raw"))
    sent = sent.where(S.no_leak(F.struct(*sent.columns)))
    return sent.select("txn_id", F.to_json(F.struct("batch_id", "amount_paise", "description", "raw")).alias("context"))


def batch_steps(spark, d):
    done = progress.steps_done(audit(spark, d))
    return done.select("batch_id", "step", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("first_at"))


def silent_batches(spark, d):
    quiet = progress.fallen_silent(audit(spark, d), FINAL)
    return quiet.groupBy("batch_id").agg(F.count("*").alias("silences"), F.date_format(F.max("at"), "yyyy-MM-dd HH:mm:ss").alias("last_at"))


def by_rule(texts: list[str]) -> list[str]:
    """A classifier that needs no model: what a queue row's category says of it, as a model's JSON."""
    known = {"duplicate_suspect": ("duplicate_entry", "flag_for_human", 0.9), "missing_counterpart": ("missing_source_record", "request_bank_advice", 0.7), "residual_rounding": ("fx_or_rounding", "write_off", 1.5)}
    out = []
    for text in texts:
        row = json.loads(text)
        category, action, sure = known.get(row["category"], ("unexplained", "flag_for_human", 0.8))
        out.append("```json\n" + json.dumps({"category": category, "suggested_action": action, "confidence": sure, "explanation": f"{row['amount_paise']} paise", "subcategory": row["category"]}) + "\n```")
    return out


def classified_queue(spark, d):
    """The queue asked in chunks of a batch, largest amounts first, with the checked answers."""
    rows = written(RECON["variance_queue"](spark, d), "queue").withColumn("context", F.to_json(F.struct("txn_id", "amount_paise", "category")))
    rows = rows.where(S.no_leak(F.struct("context")))
    found = classify.classified(rows, ["batch_id"], [F.abs("amount_paise").desc(), "txn_id"], "txn_id", "context", by_rule, shared_folder(spark, "answers"))
    return found.select("txn_id", R.answer(F.col("answer")).alias("a")).select("txn_id", "a.*")


QUERIES = {f.__name__: f for f in (ingest_summary, first_skips, residual_identity, model_context, batch_steps, silent_batches, classified_queue)}

_LINES = f"""WITH s AS (SELECT batch_id, regexp_extract(txn_id, '(\\d+)', 1)::INT AS line, amount_paise % 23 = 0 AS no_ref,
  CASE WHEN amount_paise % 13 = 0 OR amount_paise % 17 = 0 THEN 'exactly one of debit and credit' WHEN amount_paise >= 0 AND amount_paise % 19 = 0 THEN 'amount' END AS reason FROM ({CORPUS}) WHERE source_kind = 'bank') """
_A = f"WITH a AS ({AUDIT}) "

ORACLES = {
    "ingest_summary": _LINES + "SELECT batch_id, 'bank' AS source_kind, count(*) FILTER (reason IS NULL) AS parsed, count(*) FILTER (reason IS NOT NULL) AS skipped, count(*) FILTER (reason IS NULL AND no_ref) AS missing_ref FROM s GROUP BY 1",
    "first_skips": _LINES + "SELECT * FROM (SELECT batch_id, line, reason, row_number() OVER (PARTITION BY batch_id ORDER BY line, reason)::INT AS place FROM s WHERE reason IS NOT NULL) WHERE place <= 50",
    "residual_identity": _BASE
    + _WALK.rstrip()
    + """, g AS (SELECT batch_id, group_id, sum(amount_paise)::BIGINT AS own, max(amount_paise) - min(amount_paise) AS residual FROM (SELECT batch_id, group_id, amount_paise FROM one UNION ALL SELECT batch_id, group_id, amount_paise FROM two) GROUP BY ALL),
p AS (SELECT batch_id, coalesce(sum(own) FILTER (residual = 0), 0)::BIGINT AS balanced_paise, coalesce(sum(own) FILTER (residual <> 0), 0)::BIGINT AS unbalanced_paise, sum(residual)::BIGINT AS residual_paise FROM g GROUP BY 1),
o AS (SELECT batch_id, sum(amount_paise)::BIGINT AS open_paise FROM rest WHERE txn_id NOT IN (SELECT txn_id FROM two) GROUP BY 1)
SELECT batch_id, total_paise, coalesce(balanced_paise, 0) AS balanced_paise, coalesce(unbalanced_paise, 0) AS unbalanced_paise, coalesce(residual_paise, 0) AS residual_paise, coalesce(open_paise, 0) AS open_paise,
  coalesce(open_paise, 0) + coalesce(residual_paise, 0) AS unexplained_paise
FROM (SELECT batch_id, sum(amount_paise)::BIGINT AS total_paise FROM t GROUP BY 1) LEFT JOIN p USING (batch_id) LEFT JOIN o USING (batch_id)""",
    "model_context": f"""SELECT txn_id, '{{"batch_id":"' || batch_id || '","amount_paise":' || amount_paise || ',"description":"' || CASE WHEN amount_paise % 3 = 0 THEN '' ELSE external_ref END || '","raw":{{"settlement_id":"' || coalesce(settlement_id, '') || '"}}}}' AS context
FROM ({CORPUS}) WHERE source_kind = 'bank'""",
    "classified_queue": _BASE
    + _QUEUE.rstrip()
    + """ SELECT txn_id, CASE category WHEN 'duplicate_suspect' THEN 'duplicate_entry' WHEN 'missing_counterpart' THEN 'missing_source_record' WHEN 'residual_rounding' THEN 'fx_or_rounding' ELSE 'unexplained' END AS category,
  CASE category WHEN 'missing_counterpart' THEN 'request_bank_advice' WHEN 'residual_rounding' THEN 'write_off' ELSE 'flag_for_human' END AS suggested_action,
  CASE category WHEN 'duplicate_suspect' THEN 0.9 WHEN 'missing_counterpart' THEN 0.7 WHEN 'residual_rounding' THEN 1.0 ELSE 0.49 END::DOUBLE AS confidence, amount_paise || ' paise' AS explanation, category AS subcategory, true AS well_formed FROM queue""",
    "batch_steps": _A + "SELECT batch_id, step, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_at FROM a GROUP BY 1, 2",
    "silent_batches": _A
    + """, e AS (SELECT batch_id, created_at AS seen, max((step = 'purchase')::INT) AS final FROM a GROUP BY 1, 2),
w AS (SELECT batch_id, seen, coalesce(lead(seen) OVER (PARTITION BY batch_id ORDER BY seen), (SELECT max(created_at) FROM a)) AS later, max(final) OVER (PARTITION BY batch_id ORDER BY seen ROWS UNBOUNDED PRECEDING) AS ended FROM e)
SELECT batch_id, count(*) AS silences, strftime(max(seen), '%Y-%m-%d %H:%M:%S') AS last_at FROM w WHERE ended = 0 AND epoch_us(later) - epoch_us(seen) >= 1800000000 GROUP BY 1""",
}
