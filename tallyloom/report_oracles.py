"""DuckDB SQL for the report queries, written apart from their plans."""

from __future__ import annotations

from .functions.review import ACCEPTABLE, ACTIONS, CATEGORIES, RATES, VOCABULARY
from .oracles import _BASE, _WALK
from .oracles import ORACLES as RECON
from .plans.corpus import CORPUS
from .plans.ledger import AUDIT, VARIANCES
from .queries import AS_OF

_V, _A = f"WITH v AS ({VARIANCES}) ", f"WITH a AS ({AUDIT}) "


def _quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def _base(last: str, *more: str) -> str:
    return _BASE + "".join(m.rstrip().rstrip(",") + ",\n" for m in more) + "done AS (SELECT 1) " + last


def _shown(x: str) -> str:
    """Indian grouping of the absolute value of paise."""
    w = f"(abs({x}) // 100)::VARCHAR"
    return f"(CASE WHEN length({w}) <= 3 THEN {w} ELSE ltrim(reverse(regexp_replace(reverse(left({w}, length({w}) - 3)), '(\\d\\d)', '\\1,', 'g')), ',') || ',' || right({w}, 3) END || '.' || lpad((abs({x}) % 100)::VARCHAR, 2, '0'))"


_URGENCY = "CASE WHEN status = 'open' AND coalesce(category, 'unexplained') = 'unexplained' THEN 0 WHEN status = 'open' THEN 1 ELSE 2 END"
_SCENARIO = "coalesce(CASE WHEN description LIKE 'synthetic:%' THEN substr(description, 11) END, raw_category, 'unlabelled')"
_FITS = ", ".join(f"('{s}', '{c}')" for s, cs in ACCEPTABLE.items() for c in cs)
_CONFUSION = f"c AS (SELECT {_SCENARIO} AS scenario, coalesce(category, 'uncategorised') AS predicted, count(*) AS n FROM v GROUP BY ALL), m AS (SELECT scenario, predicted, n, CASE WHEN (scenario, predicted) IN ({_FITS}) THEN n ELSE 0 END AS fits FROM c) "
_USAGE = f"""u AS (SELECT coalesce(provider, 'unknown') AS provider, action = 'batch_failed' AS bad, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM a WHERE action IN ('batch_explained', 'critic_batch_graded', 'batch_failed')),
s AS (SELECT provider, count(*) FILTER (NOT bad) AS calls, count(*) FILTER (bad) AS failed, coalesce(sum(k) FILTER (NOT bad), 0)::BIGINT AS prompt_tokens, coalesce(sum(k // 2) FILTER (NOT bad), 0)::BIGINT AS completion_tokens FROM u GROUP BY 1),
p AS (SELECT s.*, round(coalesce(prompt_tokens * rp + completion_tokens * rc, 0.0), 8)::DOUBLE AS cost_usd, CASE WHEN rp IS NULL THEN prompt_tokens + completion_tokens ELSE 0 END AS unpriced_tokens FROM s LEFT JOIN (VALUES {", ".join(f"('{n}', {a:.12f}::DOUBLE, {b:.12f}::DOUBLE)" for n, a, b in RATES)}) r(provider, rp, rc) USING (provider)) """
_TEXTS = """j AS (SELECT id, category AS k, CASE id % 6 WHEN 0 THEN 'pay_out' WHEN 1 THEN 'write_off' ELSE 'flag_for_human' END AS act,
  CASE id % 10 WHEN 0 THEN NULL WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 0.75 END AS sure, id % 9 <> 0 AS noted, id % 14 <> 0 AS parsed FROM v) """
_VERDICTS = """w AS (SELECT id, id % 19 <> 0 AND id % 5 > 1 AS grounded, id % 19 <> 0 AND id % 7 <> 0 AS amounts_correct, id % 19 <> 0 AND id % 11 <> 0 AS action_appropriate, id % 19 = 0 OR id % 5 = 1 OR id % 7 = 0 OR id % 11 = 0 AS malformed FROM v),
x AS (SELECT id, grounded, amounts_correct, action_appropriate, grounded AND amounts_correct AND action_appropriate AS passed, malformed FROM w) """
_PARTS = RECON["fee_interpretations"].replace("SELECT g.txn_id AS g", "SELECT g.amount_paise AS gross, g.fee_paise AS gf, g.tax_paise AS gt, o.amount_paise AS oa, greatest(g.txn_date, o.txn_date) AS newest, g.txn_id AS g")
_BREAK = f"(SELECT g, o, label, newest, CASE WHEN label = 'gross' THEN 0 ELSE gf END AS fee_paise, CASE WHEN label IN ('gross', 'gross_minus_fee') THEN 0 ELSE gt END AS tax_paise, gross - oa AS variance_paise FROM ({_PARTS}))"
_BREAK = f"(SELECT *, variance_paise - fee_paise - tax_paise AS residual_paise FROM {_BREAK})"
_GROUPS = f"(SELECT g, o, residual_paise, CASE WHEN abs(residual_paise) < 100 THEN 'residual_rounding' WHEN date_diff('day', newest, DATE '{AS_OF}') <= 5 THEN 'timing' ELSE 'unclassified' END AS category FROM {_BREAK} WHERE variance_paise <> 0)"
_POOL = """ids AS (SELECT b.txn_id AS bank, p.txn_id FROM rest b JOIN t p ON b.source_kind = 'bank' AND p.source_kind = 'gateway' AND b.batch_id = p.batch_id AND b.settlement_id = p.settlement_id),
taken AS (SELECT bank AS txn_id FROM ids UNION SELECT txn_id FROM ids UNION SELECT txn_id FROM one WHERE group_id IN (SELECT group_id FROM one JOIN ids USING (txn_id)) UNION SELECT txn_id FROM one WHERE group_id IN (SELECT group_id FROM one WHERE source_kind = 'bank')),
targets AS (SELECT * FROM rest WHERE source_kind = 'bank' AND txn_id NOT IN (SELECT txn_id FROM taken)),
pool AS (SELECT * FROM t WHERE source_kind = 'gateway' AND fee_paise IS NOT NULL AND txn_id NOT IN (SELECT txn_id FROM taken))
"""
_PAY = "WITH p AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, CASE WHEN o_orderkey % 4 > 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) // 50 END AS fee, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 3 WHEN 0 THEN 'captured' WHEN 1 THEN 'failed' ELSE 'unknown' END AS status FROM orders) "

ORACLES = {
    "variances_by_status": _V + "SELECT coalesce(status, 'unknown') AS status, count(*) AS n, sum(abs(variance_paise))::BIGINT AS abs_paise FROM v GROUP BY 1",
    "category_by_status": _V + "SELECT coalesce(category, 'uncategorised') AS category, coalesce(status, 'unknown') AS status, count(*) AS n, sum(variance_paise)::BIGINT AS net_paise FROM v GROUP BY 1, 2",
    "open_value": _V + "SELECT count(*) AS n, sum(abs(variance_paise))::BIGINT AS abs_paise, sum(variance_paise)::BIGINT AS signed_paise FROM v WHERE status = 'open'",
    "rows_per_batch": _V + "SELECT batch_id, count(*) AS n FROM v GROUP BY 1",
    "queue_page": _V + "SELECT id, batch_id, variance_paise, category, status FROM v WHERE category = 'gateway_fee' ORDER BY abs(variance_paise) DESC, id LIMIT 200",
    "queue_options": _V + "SELECT DISTINCT 'category' AS kind, category AS value FROM v WHERE category IS NOT NULL UNION ALL SELECT DISTINCT 'status', status FROM v WHERE status IS NOT NULL",
    "queue_counts": _V + f"SELECT batch_id, count(*) FILTER (status = 'open') AS open, coalesce(sum(abs(variance_paise)) FILTER (u < 2), 0)::BIGINT AS undecided_paise, max(abs(variance_paise)) FILTER (u < 2) AS largest_paise FROM (SELECT *, {_URGENCY} AS u FROM v) GROUP BY 1",
    "queue_by_urgency": _V + f"SELECT id, ({_URGENCY})::BIGINT AS urgency, coalesce(confidence, -1) AS confidence, variance_paise FROM v ORDER BY 2, 3 DESC, abs(variance_paise) DESC, id LIMIT 100",
    "retry_batches": _V + f"SELECT batch_id, count(*) AS n FROM v WHERE {_URGENCY} = 0 GROUP BY 1 ORDER BY n DESC, batch_id LIMIT 3",
    "explained_with_text": _V + "SELECT id, batch_id FROM v WHERE status = 'explained' AND length(trim(explanation)) > 0",
    "scenario_confusion": _V.rstrip() + ", " + _CONFUSION + "SELECT scenario, predicted, n, fits AS \"right\" FROM m",
    "scenario_accuracy": _V.rstrip() + ", " + _CONFUSION + "SELECT scenario, sum(n)::BIGINT AS n, sum(fits)::BIGINT AS \"right\", round(100.0::DOUBLE * sum(fits) / sum(n), 4) AS accuracy FROM m GROUP BY 1",
    "quotation_rate": _V + f"SELECT count(*) AS graded, count(*) FILTER (q) AS quoted, round(100.0::DOUBLE * count(*) FILTER (q) / count(*), 4) AS quoted_pct FROM (SELECT regexp_matches(lower(explanation || ' ' || subcategory), '{'|'.join(VOCABULARY)}') AS q FROM v WHERE length(trim(explanation)) > 0)",
    "described_categories": _V + "SELECT CASE WHEN description LIKE '%:%' THEN split_part(description, ':', 2) ELSE '?' END AS category, count(*) AS n FROM v GROUP BY 1",
    "usage_cost": _A.rstrip() + ", " + _USAGE + "SELECT provider, calls, failed, prompt_tokens, completion_tokens, cost_usd, unpriced_tokens FROM p",
    "usage_totals": _A.rstrip() + ", " + _USAGE + "SELECT sum(calls)::BIGINT AS calls, sum(failed)::BIGINT AS failed, round(sum(cost_usd), 6) AS cost_usd, sum(unpriced_tokens)::BIGINT AS unpriced_tokens FROM p",
    "batch_spans": _A + "SELECT batch_id, n, seconds, CASE WHEN seconds > 0 THEN round(n / seconds, 4) END AS rows_per_second FROM (SELECT batch_id, count(*) AS n, round((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6, 3)::DOUBLE AS seconds FROM a GROUP BY 1)",
    "audit_page": _A + "SELECT id, batch_id, action, actor FROM a WHERE CAST(created_at AS DATE) = DATE '2024-01-05' AND action = 'batch_explained' ORDER BY created_at, id LIMIT 500",
    "latest_audit": _A + "SELECT id, batch_id, action FROM a ORDER BY created_at DESC, id LIMIT 12",
    "audit_options": _A + "SELECT DISTINCT 'actor' AS kind, actor AS value FROM a UNION ALL SELECT DISTINCT 'step', step FROM a UNION ALL SELECT DISTINCT 'action', action FROM a",
    "audit_counts": _A + "SELECT batch_id, count(*) FILTER (actor = 'human') AS human, count(*) FILTER (action LIKE '%failed%' OR action LIKE '%crashed%') AS failed FROM a GROUP BY 1",
    "labelled_batches": _A + "SELECT 'month ' || batch_id AS label, count(*) AS n FROM a WHERE user_id % 4 = 2 GROUP BY 1",
    "stuck_batches": _A + "SELECT batch_id, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(created_at))) / 6e7, 1)::DOUBLE AS idle_minutes FROM a WHERE (step <> 'purchase' OR user_id % 2 = 0) AND user_id % 7 <> 0 GROUP BY batch_id HAVING count(*) FILTER (step = 'purchase') = 0 AND epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(created_at)) >= 1800000000",
    "batch_list": _A + "SELECT batch_id, count(*) AS n, (SELECT value FROM a s WHERE s.batch_id = a.batch_id AND s.step = 'purchase' ORDER BY created_at DESC, id LIMIT 1) AS score FROM a GROUP BY batch_id ORDER BY max(created_at) DESC, batch_id LIMIT 100",
    "scores_of_labels": _A + "SELECT id, batch_id, value FROM a WHERE step = 'purchase' AND user_id % 4 = 2",
    "acquired_at": _A + "SELECT id FROM a WHERE props ->> '$.k' = '7'",
    "lookup_by_ids": _V + "SELECT id, variance_paise FROM v WHERE id IN (SELECT user_id * 40 FROM events)",
    "variance_details": _V + """SELECT v.id, c_name AS customer, items, upper(left(replace(category, '_', ' '), 1)) || substr(replace(category, '_', ' '), 2) AS category, CASE WHEN description LIKE 'synthetic:%' OR description IS NULL THEN '' ELSE description END AS description
FROM v LEFT JOIN customer ON c_custkey = custkey LEFT JOIN (SELECT l_orderkey, string_agg(CAST(l_linenumber AS INT), ',' ORDER BY l_linenumber) AS items FROM lineitem GROUP BY 1) ON l_orderkey = v.id WHERE status = 'open'""",
    "checked_answers": _V.rstrip() + ", " + _TEXTS + f"""SELECT id, CASE WHEN good THEN k ELSE 'unexplained' END AS category, CASE WHEN good THEN act ELSE 'flag_for_human' END AS suggested_action, (CASE WHEN NOT good THEN 0.0 WHEN k = 'unexplained' THEN least(sure, 0.49) ELSE sure END)::DOUBLE AS confidence,
CASE WHEN parsed AND noted THEN 'the fee' ELSE 'Model response for this variance was missing or did not match the required format.' END AS explanation, CASE WHEN good THEN 's' ELSE 'malformed_model_response' END AS subcategory, good AS well_formed
FROM (SELECT *, coalesce(parsed AND noted AND sure IS NOT NULL AND act IN ({_quoted(ACTIONS)}) AND k IN ({_quoted(CATEGORIES)}), false) AS good FROM j)""",
    "verdicts": _V.rstrip() + ", " + _VERDICTS + "SELECT * FROM x",
    "audit_pass_rate": _V.rstrip() + ", " + _VERDICTS + "SELECT count(*) AS graded, count(*) FILTER (passed) AS passed, round(100.0::DOUBLE * count(*) FILTER (passed) / count(*), 4) AS pass_pct, count(*) FILTER (malformed) AS malformed FROM x",
    "reopened": _V.rstrip() + ", " + _VERDICTS + "SELECT id, 'open' AS status, 'unexplained' AS category, (CASE WHEN confidence IS NULL THEN 0 WHEN confidence < 0.49 THEN confidence ELSE 0.49 END)::DOUBLE AS confidence, explanation FROM v JOIN x USING (id) WHERE status = 'explained' AND NOT passed",
    "amount_check": _base("""SELECT txn_id, n AS cited, CASE WHEN extra THEN '987654321.5' ELSE '' END AS untraced, NOT extra AS all_found FROM (SELECT txn_id, amount_paise % 3 = 0 AS extra, 2 + (tax_paise >= 100)::BIGINT + (amount_paise % 3 = 0)::BIGINT AS n, tax_paise, amount_paise, fee_paise, net_paise FROM t WHERE fee_paise > 0)"""),
    "ungrounded_replies": _V + "SELECT id, concat_ws(' ', CASE WHEN id % 3 <> 1 AND id % 3 + 11 <> abs(variance_paise) / 100.0 THEN (id % 3 + 11)::VARCHAR END, CASE WHEN abs(variance_paise) <> 210100 THEN '2101' END) AS bad FROM v",
    "wrong_pairs": _base("""SELECT a.batch_id || '/' || right(a.external_ref, 2) AS group_id, a.txn_id AS a, b.txn_id AS b, greatest(abs(a.amount_paise), abs(b.amount_paise)) AS worst_paise FROM t a JOIN t b ON a.batch_id = b.batch_id AND right(a.external_ref, 2) = right(b.external_ref, 2) AND a.txn_id < b.txn_id
WHERE a.source_kind = 'bank' AND b.source_kind = 'bank' AND a.external_ref <> '' AND b.external_ref <> '' AND (a.truth_group = b.truth_group) IS NOT TRUE ORDER BY worst_paise DESC, a, b LIMIT 10"""),
    "pair_scores_f1": f"SELECT tp, fp, fn, precision, recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM ({RECON['pair_scores']})",
    "variance_breakdown": f"SELECT g, o, label, fee_paise, tax_paise, residual_paise, variance_paise FROM {_BREAK}",
    "group_variances": f"SELECT * FROM {_GROUPS}",
    "variance_explained": f"SELECT sum(abs(variance_paise))::BIGINT AS total_paise, sum(greatest(abs(variance_paise) - abs(residual_paise), 0))::BIGINT AS explained_paise, round(100.0::DOUBLE * sum(greatest(abs(variance_paise) - abs(residual_paise), 0)) / sum(abs(variance_paise)), 4) AS explained_pct FROM {_BREAK}",
    "full_queue": f"SELECT kind, category, count(*) AS n, sum(p)::BIGINT AS net_paise FROM (SELECT 'row' AS kind, category, amount_paise AS p FROM ({RECON['variance_queue']}) UNION ALL SELECT 'group', category, residual_paise FROM {_GROUPS}) GROUP BY ALL",
    "tier_report": _base(
        """SELECT step, count(*) AS groups, sum(n)::BIGINT AS member_rows, sum(v)::BIGINT AS variance_paise FROM g GROUP BY 1 UNION ALL SELECT '3 total', count(*), sum(n)::BIGINT, sum(v)::BIGINT FROM g
UNION ALL SELECT '4 open', 0, count(*), sum(amount_paise)::BIGINT FROM rest WHERE txn_id NOT IN (SELECT txn_id FROM two)""",
        _WALK,
        "g AS (SELECT '1 exact' AS step, group_id, count(*) AS n, max(amount_paise) - min(amount_paise) AS v FROM one GROUP BY 2 UNION ALL SELECT '2 reference', group_id, count(*), max(amount_paise) - min(amount_paise) FROM two GROUP BY 2)",
    ),
    "largest_group": _base("SELECT group_id, count(*) AS member_count FROM one GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"),
    "settlement_candidates": _base("""SELECT * FROM (SELECT b.txn_id AS bank, b.amount_paise AS target, p.txn_id, p.net_paise AS net, row_number() OVER (PARTITION BY b.txn_id ORDER BY p.net_paise DESC, p.txn_id) AS place
FROM targets b JOIN pool p ON b.batch_id = p.batch_id AND p.net_paise <= b.amount_paise AND date_diff('day', p.txn_date, b.txn_date) BETWEEN 0 AND 10) WHERE place <= 60""", _POOL),
    "settlement_targets": _base("SELECT batch_id, txn_id AS bank, amount_paise AS target, row_number() OVER (PARTITION BY batch_id ORDER BY amount_paise DESC, txn_id) AS place FROM targets", _POOL),
    "refund_claims": _base("""SELECT count(*) AS pairs, count(DISTINCT original) AS originals, sum(days)::BIGINT AS days FROM (SELECT n.txn_id AS refund, p.txn_id AS original, date_diff('day', p.txn_date, n.txn_date) AS days
FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, counterparty, -amount_paise ORDER BY txn_id) AS i FROM t WHERE amount_paise < 0) n JOIN (SELECT *, row_number() OVER (PARTITION BY batch_id, counterparty, amount_paise ORDER BY txn_date DESC, txn_id) AS i FROM t WHERE amount_paise > 0) p
ON n.batch_id = p.batch_id AND n.counterparty = p.counterparty AND n.amount_paise = -p.amount_paise AND n.i = p.i WHERE date_diff('day', p.txn_date, n.txn_date) BETWEEN 0 AND 30)"""),
    "truth_check": f"WITH t AS ({CORPUS}) SELECT count(*) AS n, count(DISTINCT truth_group) AS groups, count(*) FILTER (truth_group IS NULL) AS noise, count(*) FILTER (truth_group IS NULL AND amount_paise < 0) AS refunds_of_noise, count(DISTINCT source_kind) AS kinds FROM t",
    "narrations": f"WITH t AS ({CORPUS}) SELECT txn_id, CASE WHEN length(txn_id) % 4 <> 3 AND NOT regexp_matches(external_ref, '^\\d{{1,2}}$') THEN external_ref END AS found FROM t WHERE source_kind = 'bank'",
    "money_forms": _V + f"""SELECT id, CASE WHEN p < 0 THEN '-' ELSE '' END || CASE WHEN abs(p) >= 1000000000 THEN printf('%d.%02d Cr', abs(p) // 1000000000, abs(p) % 1000000000 // 10000000) WHEN abs(p) >= 10000000 THEN printf('%d.%02d L', abs(p) // 10000000, abs(p) % 10000000 // 100000) ELSE printf('%d.%02d', abs(p) // 100, abs(p) % 100) END AS compact,
CASE WHEN variance_paise < 0 THEN '-' ELSE '' END || 'Rs ' || {_shown("variance_paise")} || ' (' || variance_paise || ' paise)' AS dual, 120 + id % 10 AS odd, id % 1000 * 100 + 50 AS wide, substr(md5(CAST(id AS VARCHAR)), 1, 8) AS short_id FROM (SELECT *, variance_paise * 1000 AS p FROM v)""",
    "drawn_amounts": _V + "SELECT count(*) AS n, min(x)::BIGINT AS least, count(*) FILTER (x > 100000) AS above_1000 FROM (SELECT greatest(100, round(exp(7.0::DOUBLE + 0.9::DOUBLE * (list_sum(list_transform(range(12), lambda i: ('0x' || substr(md5(CAST(id AS VARCHAR) || '/' || (i // 4)), (1 + 8 * (i % 4))::INT, 8))::BIGINT / 4294967296.0::DOUBLE)) - 6)) * 100)) AS x FROM v)",
    "sampled_rows": _V + "SELECT id FROM v ORDER BY md5('7/' || id), id LIMIT 30",
    "fixed_chunks": _V + "SELECT batch_id, id, (row_number() OVER (PARTITION BY batch_id ORDER BY id) - 1) // 5 AS chunk FROM v WHERE status = 'open'",
    "context_lines": _V + "SELECT batch_id, id FROM (SELECT *, sum(length(concat_ws(' ', category, status, variance_paise::VARCHAR)) + 1) OVER (PARTITION BY batch_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS chars FROM v) WHERE chars <= 801",
    "timestamps_read": _A + "SELECT id, CASE WHEN id % 5 > 0 THEN strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS at, CASE WHEN id % 5 > 0 THEN CAST(created_at AS DATE) END AS day FROM a",
    "payment_records": _PAY + "SELECT 'pay_' || k AS external_ref, 'gateway' AS source_kind, amount AS amount_paise, fee AS fee_paise, fee * 18 // 118 AS tax_paise, amount - fee AS net_paise, CASE WHEN k % 5 > 1 THEN 'a@b.example' ELSE '+91' || k END AS counterparty, day AS txn_date FROM p",
    "settlement_records": _PAY + "SELECT 'setl_' || k AS external_ref, 'gateway' AS source_kind, amount AS amount_paise, fee AS fee_paise, fee * 18 // 118 AS tax_paise, amount AS net_paise, NULL::VARCHAR AS counterparty, day AS txn_date, day AS value_date FROM p WHERE fee IS NOT NULL",
    "payment_statuses": _PAY + "SELECT status, count(*) AS n FROM p GROUP BY 1",
    "range_ingest": _PAY + "SELECT status, count(*) AS fetched, count(*) FILTER (amount % 2 = 1) AS added FROM p WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY 1",
}
