"""Registered queries on explanations, questions and days: the explainer's report, contexts and answers, the daily summary, stalled batches; with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .functions import review as R
from .operators import explained, questions
from .operators import match as M
from .operators import reports as P
from .operators.shared import shared_folder, written
from .oracles import _BASE, _WALK
from .plans.corpus import MATCH_COLUMNS, guarded, match_view, txns
from .plans.ledger import AUDIT, VARIANCES, audit, variances
from .report_oracles import _POOL, _base, _shown

NOW = "2024-01-20 00:00:00"


def _explained(spark, d):
    """Queue rows with their own record or none, groups of two records, and rows that no model has seen."""
    v = variances(spark, d)
    name, group = F.concat(F.lit("r"), F.col("id").cast("string")), F.concat(F.lit("g"), F.floor(F.col("id") / 2).cast("string"))
    n = F.col("id")
    queue = v.select("batch_id", "id", F.when(n % 3 > 0, name).alias("txn_id"), F.when(n % 2 == 0, group).alias("match_group_id"), "category", "subcategory", "confidence", "explanation", F.when(n % 5 > 0, "{}").alias("model_raw"))
    return written(queue, "queue"), v.select(group.alias("group_id"), name.alias("txn_id")), v.select(name.alias("txn_id"), "description", "raw_category")


def _part(name):
    def query(spark, d):
        return explained.report(*_explained(spark, d))[name]

    return query


def _context(spark, d):
    t = written(match_view(txns(spark, d)), "txns")
    one = written(M.exact_members(t), "members")
    two = written(M.cluster_members(M.unmatched(t, one)), "members")
    both = one.withColumn("tier", F.lit(1)).unionByName(two.withColumn("tier", F.lit(2)))
    groups = both.groupBy("batch_id", "group_id", "tier").agg(F.count("*").alias("members"), (F.max("amount_paise") - F.min("amount_paise")).alias("variance_paise")).withColumn("strategy", F.when(F.col("tier") == 1, "exact").otherwise("reference"))
    matched = both.groupBy("batch_id").agg(F.count("*").alias("matched_txns"))
    rate = F.round(F.col("matched_txns") / F.col("total_txns"), 4)
    none = F.lit(None).cast("double")
    scores = t.where("batch_id not like '%-01'").groupBy("batch_id").agg(F.count("*").alias("total_txns"), F.sum("amount_paise").alias("unexplained_paise")).join(matched, "batch_id", "left")
    scores = scores.withColumns({"match_rate": rate, "precision": F.lit(1.0), "recall": F.lit(0.0), "f1": none, "grounding_pct": F.when(F.col("total_txns") % 2 == 0, F.col("total_txns") % 100)})
    queue = variances(spark, d).where("batch_id not like '%-02'").select("batch_id", "id", "variance_paise", "category", "status", "explanation", F.when(F.col("id") % 2 == 0, "write_off").alias("suggested_action"))
    return questions.context(t.select("batch_id").distinct(), scores, queue, groups)


def question_context(spark, d):
    return _context(spark, d)


def by_reading(texts: list[str]) -> list[str]:
    """A model that needs no model: reads the total out of its prompt; for some totals it makes a figure up."""
    out = []
    for text in texts:
        found = re.search(r"ingested: (\d+)", text)
        total = int(found[1]) if found else 0
        out.append(f"There are {total:,} rows, in 2024." if found else "No score is recorded.")
        if total % 5 == 1:
            out[-1] = "About 987654321 rows."
    return out


def answered_questions(spark, d):
    """How many rows each batch has, asked of its context, and whether the answer quotes the total."""
    contexts = written(_context(spark, d), "contexts")
    found = questions.answered(contexts, F.lit("How many rows are there?"), by_reading, shared_folder(spark, "answers"))
    total = contexts.select("batch_id", F.regexp_extract("context", r"ingested: (\d+)", 1).alias("total"))
    return found.join(total, "batch_id").select("batch_id", "answer", "verified", "attempts", "untraced", R.quoted(F.col("total"), F.col("answer")).alias("quoted"))


def _batches(spark, d):
    status = F.when(F.col("id") % 4 == 0, "complete").when(F.col("id") % 4 == 1, "failed").when(F.col("id") % 4 == 2, "matching")
    return audit(spark, d).where("step = 'signup'").select("id", F.col("created_at").cast("timestamp"), status.alias("status"), F.when(F.col("id") % 4 < 2, F.timestamp_seconds(F.unix_seconds(F.col("created_at").cast("timestamp")) + (F.col("id") % 50) * 3600)).alias("completed_at"))


def day_summary(spark, d):
    a = audit(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp"))
    of = lambda step: a.where(F.col("step") == step)
    scores = of("purchase").select(F.col("created_at").alias("run_at"), F.floor(F.col("id") * 7).alias("unexplained_paise"), F.when(F.col("id") % 3 > 0, F.col("id") % 101).alias("grounding_pct"))
    return P.day_summary(P.activity(_batches(spark, d), of("click"), of("view"), scores))


def stalled_batches(spark, d):
    return P.stalled(_batches(spark, d), F.lit(NOW).cast("timestamp")).select("id", "status")


def shown_figures(spark, d):
    """Ratios with their percent, and money side by side, of every queue row."""
    ratio = F.when(F.col("id") % 9 > 0, F.col("id") % 1001 / 1000)
    return variances(spark, d).select("id", R.ratio_with_percent(ratio).alias("ratio"), R.money(F.col("variance_paise")).alias("money"), R.figure_key(R.money(F.col("variance_paise"))).alias("key"))


def currency_candidates(spark, d):
    """The candidates of open bank rows where rows declare a currency or none; two declared ones must agree."""
    full = txns(spark, d)
    n = F.pmod(F.col("amount_paise"), F.lit(3))
    t = written(guarded(full.select(*MATCH_COLUMNS, F.when(n == 0, "INR").when(n == 1, "USD").alias("currency"))), "txns")
    bank, pool = M.open_settlements(t, written(M.exact_members(t.drop("currency")), "members"))
    return M.rule_candidates(bank, pool).select("bank", "target", "txn_id", "net", "place")


QUERIES = {f"explainer_{n}": _part(n) for n in ("summary", "scenarios", "misses", "quotes")} | {f.__name__: f for f in (question_context, answered_questions, day_summary, stalled_batches, shown_figures, currency_candidates)}


def _money(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || 'Rs ' || {_shown(x)} || ' (' || {x} || ' paise)')"


_READINGS = " OR ".join(f"scenario = '{s}' AND predicted IN ({', '.join(repr(c) for c in cs)})" for s, cs in R.ACCEPTABLE.items())
_QUOTED = "regexp_matches(lower(coalesce(explanation, '') || chr(10) || coalesce(subcategory, '')), '" + "|".join(R.VOCABULARY) + "')"
_E = f"""WITH v AS (SELECT *, CASE WHEN regexp_matches(description, '^synthetic:\\w+$') THEN substr(description, 11) ELSE raw_category END AS label FROM ({VARIANCES})),
q AS (SELECT * FROM v WHERE id % 5 > 0),
l AS (SELECT id, label FROM q WHERE id % 3 > 0 UNION ALL SELECT q.id, o.label FROM q JOIN v o ON q.id // 2 = o.id // 2 WHERE q.id % 2 = 0),
c AS (SELECT id, count(DISTINCT label) AS labels, min(label) AS label FROM l GROUP BY 1),
h AS (SELECT q.batch_id, q.id, q.subcategory, q.confidence, q.explanation, coalesce(q.category, '(none)') AS predicted, coalesce(labels, 0) AS labels, CASE WHEN labels = 1 THEN c.label END AS scenario FROM q LEFT JOIN c USING (id)),
g AS (SELECT *, coalesce({_READINGS}, false) AS fits, trim(coalesce(explanation, '')) <> '' AS told, trim(coalesce(explanation, '')) <> '' AND {_QUOTED} AS quoting FROM h) """

_C = (
    _BASE
    + _WALK.rstrip()
    + f""", both_ AS (SELECT batch_id, group_id, 1 AS tier, 'exact' AS strategy, amount_paise FROM one UNION ALL SELECT batch_id, group_id, 2, 'reference', amount_paise FROM two),
gr AS (SELECT batch_id, tier, strategy, group_id, count(*) AS m, max(amount_paise) - min(amount_paise) AS p FROM both_ GROUP BY ALL),
s AS (SELECT batch_id, total, u, matched, round(matched / total, 4) AS rate FROM (SELECT batch_id, count(*) AS total, sum(amount_paise)::BIGINT AS u FROM t WHERE batch_id NOT LIKE '%-01' GROUP BY 1) LEFT JOIN (SELECT batch_id, count(*) AS matched FROM both_ GROUP BY 1) USING (batch_id)),
v AS (SELECT * FROM ({VARIANCES}) WHERE batch_id NOT LIKE '%-02'),
k AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY abs(p) DESC, category, status) AS spot FROM (SELECT batch_id, coalesce(category, 'uncategorised') AS category, coalesce(status, 'unknown') AS status, count(*) AS n, sum(variance_paise)::BIGINT AS p FROM v GROUP BY ALL)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY abs(variance_paise) DESC, id) AS spot FROM v WHERE status = 'open') WHERE spot <= 5),
b AS (SELECT DISTINCT batch_id FROM t),
lines AS (
  SELECT batch_id, 'RECONCILIATION RUN — batch ' || batch_id AS line, 0 AS sec, 0 AS spot FROM b
  UNION ALL SELECT batch_id, 'RUN SCORE', 1, 0 FROM b
  UNION ALL SELECT batch_id, '  no score recorded for this batch', 1, 1 FROM b WHERE batch_id NOT IN (SELECT batch_id FROM s)
  UNION ALL SELECT batch_id, '  total transactions ingested: ' || total || chr(10) || '  transactions matched into a group: ' || coalesce(matched::VARCHAR, 'not recorded') || chr(10) || '  match rate: ' || coalesce(rate::VARCHAR || ' (' || printf('%.2f', rate * 100) || '%)', 'not recorded') || chr(10)
    || '  precision: 1.0 (100.00%)' || chr(10) || '  recall: 0.0 (0.00%)' || chr(10) || '  f1: not recorded' || chr(10) || '  unexplained value: ' || {_money('u')} || CASE WHEN total % 2 = 0 THEN chr(10) || '  explanation grounding rate: ' || total % 100 || '%' ELSE '' END, 1, 1 FROM s
  UNION ALL SELECT batch_id, 'VARIANCE QUEUE BY CATEGORY (count and summed value)', 2, 0 FROM b
  UNION ALL SELECT batch_id, '  the variance queue is empty for this batch', 2, 1 FROM b WHERE batch_id NOT IN (SELECT batch_id FROM k)
  UNION ALL SELECT batch_id, '  ' || category || ' [' || status || ']: ' || n || ' variances, total ' || {_money('p')}, 2, spot FROM k
  UNION ALL SELECT batch_id, '5 LARGEST OPEN VARIANCES', 3, 0 FROM b
  UNION ALL SELECT batch_id, '  no open variances', 3, 1 FROM b WHERE batch_id NOT IN (SELECT batch_id FROM top)
  UNION ALL SELECT batch_id, '  ' || spot || '. ' || {_money('variance_paise')} || ' — category ' || coalesce(category, 'none') || ', suggested action ' || CASE WHEN id % 2 = 0 THEN 'write_off' ELSE 'none' END || CASE WHEN coalesce(explanation, '') <> '' THEN chr(10) || '     explanation: ' || explanation ELSE '' END, 3, spot FROM top
  UNION ALL SELECT batch_id, 'MATCHING TIER CONTRIBUTION', 4, 0 FROM b
  UNION ALL SELECT batch_id, '  no match groups recorded for this batch', 4, 1 FROM b WHERE batch_id NOT IN (SELECT batch_id FROM gr)
  UNION ALL SELECT batch_id, '  tier ' || tier || ' (' || strategy || '): ' || n || ' groups, ' || m || ' transactions, residual variance ' || {_money('p')}, 4, tier FROM (SELECT batch_id, tier, strategy, count(*) AS n, sum(m)::BIGINT AS m, sum(p)::BIGINT AS p FROM gr GROUP BY ALL)),
ctx AS (SELECT batch_id, string_agg(line, chr(10) ORDER BY sec, spot) AS context FROM lines WHERE batch_id IN (SELECT batch_id FROM b) GROUP BY 1) """
)
_D = f"""WITH a AS ({AUDIT}), b AS (SELECT id, created_at, CASE id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' WHEN 2 THEN 'matching' END AS status, CASE WHEN id % 4 < 2 THEN created_at + (id % 50) * INTERVAL 1 HOUR END AS completed_at FROM a WHERE step = 'signup') """

ORACLES = {
    "explainer_summary": _E
    + """SELECT batch_id, total, coalesce(classified, 0) AS classified, coalesce(graded, 0) AS graded, coalesce(correct, 0) AS correct, coalesce(ambiguous, 0) AS ambiguous, coalesce(unlabelled, 0) AS unlabelled, coalesce(with_text, 0) AS with_text, coalesce(quoting, 0) AS quoting,
  CASE WHEN graded > 0 THEN round(100.0::DOUBLE * correct / graded, 2) END AS accuracy_pct, CASE WHEN with_text > 0 THEN round(100.0::DOUBLE * quoting / with_text, 2) END AS quotation_pct
FROM (SELECT batch_id, count(*) AS total FROM v GROUP BY 1) LEFT JOIN (SELECT batch_id, count(*) AS classified, count(*) FILTER (labels = 1) AS graded, count(*) FILTER (labels = 1 AND fits) AS correct, count(*) FILTER (labels > 1) AS ambiguous, count(*) FILTER (labels = 0) AS unlabelled, count(*) FILTER (told) AS with_text, count(*) FILTER (quoting) AS quoting FROM g GROUP BY 1) USING (batch_id)""",
    "explainer_scenarios": _E + "SELECT batch_id, scenario, predicted, count(*) AS graded, count(*) FILTER (fits) AS correct FROM g WHERE labels = 1 GROUP BY ALL",
    "explainer_misses": _E + "SELECT * FROM (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY id)::INT AS place, id, scenario, predicted, confidence, left(coalesce(explanation, ''), 200) AS explanation FROM g WHERE labels = 1 AND NOT fits) WHERE place <= 25",
    "explainer_quotes": _E + "SELECT * FROM (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY id)::INT AS place, id, subcategory, left(explanation, 200) AS explanation FROM g WHERE quoting) WHERE place <= 5",
    "question_context": _C + "SELECT batch_id, context FROM ctx",
    "answered_questions": _C
    + f"""SELECT batch_id, CASE WHEN total IS NULL THEN 'No score is recorded.' WHEN total % 5 = 1 THEN '{questions.REFUSAL}' ELSE 'There are ' || printf('%,d', total) || ' rows, in 2024.' END AS answer, coalesce(total % 5 <> 1, true) AS verified,
  CASE WHEN total % 5 = 1 THEN 2 ELSE 1 END AS attempts, CASE WHEN total % 5 = 1 THEN '987654321' ELSE '' END AS untraced, coalesce(total % 5 <> 1, false) AS quoted FROM b LEFT JOIN s USING (batch_id)""",
    "day_summary": _D
    + """, e AS (SELECT created_at AS spot, 'created' AS kind, NULL AS u, NULL AS g FROM b UNION ALL SELECT completed_at, 'completed', NULL, NULL FROM b WHERE completed_at IS NOT NULL UNION ALL SELECT created_at, 'failed', NULL, NULL FROM b WHERE status = 'failed'
  UNION ALL SELECT created_at, step, CASE WHEN step = 'purchase' THEN id * 7 END, CASE WHEN step = 'purchase' AND id % 3 > 0 THEN id % 101 END FROM a WHERE step IN ('click', 'view', 'purchase'))
SELECT CAST(spot AS DATE) AS day, count(*) FILTER (kind = 'created') AS batches_created, count(*) FILTER (kind = 'completed') AS batches_completed, count(*) FILTER (kind = 'failed') AS batches_failed, count(*) FILTER (kind = 'view') AS groups_created, count(*) FILTER (kind = 'click') AS variances_opened,
  count(*) FILTER (kind = 'purchase') AS scores_written, coalesce(sum(u), 0)::BIGINT AS unexplained_paise, round(avg(g), 2) AS mean_grounding_pct FROM e GROUP BY 1""",
    "stalled_batches": _D + f"SELECT id, status FROM b WHERE coalesce(status, '') NOT IN ('complete', 'failed') AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at) > 1800000000",
    "currency_candidates": _base(
        """SELECT * FROM (SELECT b.txn_id AS bank, b.amount_paise AS target, p.txn_id, p.net_paise AS net, row_number() OVER (PARTITION BY b.txn_id ORDER BY p.net_paise DESC, p.txn_id) AS place
FROM targets b JOIN pool p ON b.batch_id = p.batch_id AND p.net_paise <= b.amount_paise AND date_diff('day', p.txn_date, b.txn_date) BETWEEN 0 AND 10
  AND (b.amount_paise % 3 = p.amount_paise % 3 OR b.amount_paise % 3 NOT IN (0, 1) OR p.amount_paise % 3 NOT IN (0, 1))) WHERE place <= 60""",
        _POOL,
    ),
    "shown_figures": f"""SELECT id, CASE WHEN id % 9 > 0 THEN (id % 1001 / 1000)::VARCHAR || ' (' || printf('%.2f', id % 1001 / 1000 * 100) || '%)' ELSE 'not recorded' END AS ratio, {_money('variance_paise')} AS money, regexp_replace({_money('variance_paise')}, '[^0-9.-]', '', 'g') AS key FROM ({VARIANCES})""",
}
