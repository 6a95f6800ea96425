"""DuckDB SQL for the reconciliation queries, written apart from their plans."""

from __future__ import annotations

from .functions.scalars import PREFIXES
from .plans.corpus import CORPUS
from .queries import AS_OF

_FULL = f"coalesce(nullif(ltrim(regexp_replace(regexp_replace(upper(external_ref), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '^(?:{'|'.join(PREFIXES)})+(.)', '\\1'), '0'), ''), regexp_replace(regexp_replace(upper(external_ref), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '^(?:{'|'.join(PREFIXES)})+(.)', '\\1'))"

_BASE = f"""WITH RECURSIVE t AS MATERIALIZED ({CORPUS}),
buckets AS (SELECT batch_id, external_ref, amount_paise, txn_date, min(txn_id) AS first FROM t WHERE external_ref <> '' GROUP BY ALL HAVING count(DISTINCT source_kind) >= 2),
one AS MATERIALIZED (SELECT t.*, 't1:' || first AS group_id FROM t JOIN buckets b ON t.batch_id = b.batch_id AND t.external_ref = b.external_ref AND t.amount_paise = b.amount_paise AND t.txn_date IS NOT DISTINCT FROM b.txn_date),
rest AS MATERIALIZED (SELECT * FROM t WHERE txn_id NOT IN (SELECT txn_id FROM one)),
refs AS MATERIALIZED (SELECT *, {_FULL} AS f FROM rest),
pairs AS MATERIALIZED (SELECT a.txn_id AS a, b.txn_id AS b FROM refs a JOIN refs b ON a.batch_id = b.batch_id AND right(a.f, 3) = right(b.f, 3) AND a.source_kind <> b.source_kind AND a.txn_id < b.txn_id
  WHERE abs(a.amount_paise - b.amount_paise) <= 1 AND abs(date_diff('day', a.txn_date, b.txn_date)) <= 3
    AND (a.f = b.f OR right(a.f, 8) = right(b.f, 8) OR (least(length(a.f), length(b.f)) BETWEEN 3 AND 4 AND (ends_with(a.f, b.f) OR ends_with(b.f, a.f))))),
"""

_WALK = """sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
walk(node, root) AS (SELECT a, a FROM sym UNION SELECT sym.b, root FROM walk JOIN sym ON sym.a = node),
two AS (SELECT rest.*, 't2:' || r AS group_id FROM (SELECT node, min(root) AS r FROM walk GROUP BY node) JOIN rest ON txn_id = node)
"""

_QUEUE = f"""keys AS (SELECT DISTINCT batch_id, source_kind, unnest([f, right(f, 8)]) AS key FROM (SELECT *, {_FULL} AS f FROM t) WHERE f <> ''),
alone AS (SELECT batch_id, key, count(DISTINCT source_kind) AS kinds FROM keys GROUP BY ALL),
seen AS (SELECT txn_id, max(kinds) AS kinds FROM (SELECT txn_id, batch_id, unnest([f, right(f, 8)]) AS key FROM refs) JOIN alone USING (batch_id, key) GROUP BY txn_id),
twins AS (SELECT batch_id, source_kind, external_ref, amount_paise, count(*) AS twins FROM t GROUP BY ALL),
queue AS (SELECT r.txn_id, r.batch_id, r.amount_paise,
  CASE WHEN twins > 1 THEN 'duplicate_suspect' WHEN coalesce(kinds, 1) <= 1 THEN 'missing_counterpart' WHEN abs(r.amount_paise) < 100 THEN 'residual_rounding'
       WHEN date_diff('day', r.txn_date, DATE '{AS_OF}') <= 5 THEN 'timing' ELSE 'unclassified' END AS category
  FROM rest r LEFT JOIN twins USING (batch_id, source_kind, external_ref, amount_paise) LEFT JOIN seen ON seen.txn_id = r.txn_id)
"""

_DIFFERS = lambda x: f"(count(DISTINCT {x}) + (count(*) > count({x}))::INT > 1)::INT"
_NORMAL = f"CASE WHEN external_ref <> '' THEN {_FULL} END"
_GROUP = f"""SELECT group_id, count(*) AS member_count, count(DISTINCT source_kind) AS n_sources, max(amount_paise) - min(amount_paise) AS variance_paise,
  (95 - 5 * ({_DIFFERS(_NORMAL)} + {_DIFFERS("amount_paise")} + {_DIFFERS("txn_date")}))::BIGINT AS confidence_pct FROM """

_SHOWN = "(SELECT txn_id, amount_paise, fee_paise, CASE WHEN length(w) <= 3 THEN w ELSE ltrim(reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(\\d\\d)', '\\1,', 'g')), ',') || ',' || right(w, 3) END || '.' || lpad((abs(amount_paise) % 100)::VARCHAR, 2, '0') AS shown FROM (SELECT *, (abs(amount_paise) // 100)::VARCHAR AS w FROM t))"


def _with(last: str, *more: str) -> str:
    return _BASE + "".join(m.rstrip().rstrip(",") + ",\n" for m in more) + "done AS (SELECT 1) " + last


ORACLES = {
    "normalize_refs": _with(f"SELECT txn_id, f AS ref_full, right(f, 8) AS ref_last8 FROM (SELECT txn_id, {_FULL} AS f FROM t)"),
    "t1_exact_groups": _with(_GROUP + "one GROUP BY group_id"),
    "t1_roles": _with("SELECT group_id, txn_id, CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY CASE source_kind WHEN 'gateway' THEN 0 WHEN 'bank' THEN 1 ELSE 2 END, txn_id) = 1 THEN 'primary' ELSE 'counterpart' END AS role FROM one"),
    "t2_candidate_pairs": _with("SELECT a, b FROM pairs"),
    "t2_clusters": _with(_GROUP + "two GROUP BY group_id", _WALK),
    "fee_interpretations": _with("""SELECT g.txn_id AS g, o.txn_id AS o, o.source_kind, g.amount_paise - o.amount_paise AS deducted,
  CASE WHEN o.amount_paise = g.amount_paise THEN 'gross' WHEN o.amount_paise = g.amount_paise - g.fee_paise THEN 'gross_minus_fee' WHEN o.amount_paise = g.amount_paise - g.fee_paise - g.tax_paise THEN 'gross_minus_fee_minus_tax' ELSE 'gross_minus_fee_plus_tax' END AS label
FROM (SELECT *, """ + _FULL + """ AS f FROM t WHERE source_kind = 'gateway' AND fee_paise IS NOT NULL) g JOIN (SELECT * FROM refs WHERE source_kind <> 'gateway') o ON g.batch_id = o.batch_id
WHERE (o.amount_paise IN (g.amount_paise, g.amount_paise - g.fee_paise) OR abs(o.amount_paise - (g.amount_paise - g.fee_paise - g.tax_paise)) <= 2)
  AND (abs(date_diff('day', g.txn_date, o.txn_date)) <= 3 OR g.f = o.f OR right(g.f, 8) = right(o.f, 8))"""),
    "refund_pairs_asof": _with("""SELECT refund, original, days FROM (SELECT n.txn_id AS refund, p.txn_id AS original, date_diff('day', p.txn_date, n.txn_date) AS days, row_number() OVER (PARTITION BY n.txn_id ORDER BY p.txn_date DESC, p.txn_id) AS rn
FROM t n JOIN t p ON n.source_kind = p.source_kind AND n.counterparty = p.counterparty AND n.amount_paise = -p.amount_paise WHERE n.amount_paise < 0 AND date_diff('day', p.txn_date, n.txn_date) BETWEEN 0 AND 30) WHERE rn = 1"""),
    "settlement_by_id": _with("""SELECT *, bank_paise - net_paise AS residual_paise FROM (SELECT batch_id, settlement_id, sum(amount_paise) FILTER (source_kind = 'bank')::BIGINT AS bank_paise, sum(net_paise) FILTER (source_kind = 'gateway')::BIGINT AS net_paise, count(*) FILTER (source_kind = 'gateway') AS payments
FROM t WHERE settlement_id IS NOT NULL GROUP BY ALL) WHERE bank_paise IS NOT NULL AND payments > 0"""),
    "unmatched_anti": _with("SELECT txn_id, source_kind, amount_paise FROM rest"),
    "duplicate_suspects": _with("SELECT txn_id, twins FROM (SELECT txn_id, count(*) OVER (PARTITION BY batch_id, source_kind, external_ref, amount_paise) AS twins FROM t WHERE external_ref <> '') WHERE twins > 1"),
    "variance_queue": _with("SELECT * FROM queue", _QUEUE),
    "variances_by_category": _with("SELECT category, count(*) AS n, sum(amount_paise)::BIGINT AS net_paise, sum(abs(amount_paise))::BIGINT AS abs_paise FROM queue GROUP BY category", _QUEUE),
    "open_top5": _with("SELECT * FROM queue ORDER BY abs(amount_paise) DESC, txn_id LIMIT 5", _QUEUE),
    "pair_scores": _with("""SELECT tp, made - tp AS fp, wanted - tp AS fn, round(tp / made, 6) AS precision, round(tp / wanted, 6) AS recall FROM
(SELECT sum(n * (n - 1) // 2)::BIGINT AS made FROM (SELECT count(*) AS n FROM one GROUP BY group_id)),
(SELECT sum(n * (n - 1) // 2)::BIGINT AS tp FROM (SELECT count(*) AS n FROM one WHERE truth_group IS NOT NULL GROUP BY group_id, truth_group)),
(SELECT sum(n * (n - 1) // 2)::BIGINT AS wanted FROM (SELECT count(*) AS n FROM t WHERE truth_group IS NOT NULL GROUP BY truth_group))"""),
    "tier_funnel": _with("SELECT 1 AS tier, count(DISTINCT group_id) AS groups, count(*) AS member_rows FROM one UNION ALL SELECT 2, count(DISTINCT group_id), count(*) FROM two HAVING count(*) > 0", _WALK),
    "recon_identity": _with("""SELECT matched, matched_rows, open, open_rows, total, total_rows, matched + open = total AND matched_rows + open_rows = total_rows AS balanced FROM
(SELECT sum(amount_paise)::BIGINT AS matched, count(*) AS matched_rows FROM one), (SELECT sum(amount_paise)::BIGINT AS open, count(*) AS open_rows FROM rest), (SELECT sum(amount_paise)::BIGINT AS total, count(*) AS total_rows FROM t)"""),
    "rows_by_source": _with("SELECT batch_id, source_kind, count(*) AS n, sum(amount_paise)::BIGINT AS net_paise FROM t GROUP BY ALL"),
    "running_balance": _with("SELECT txn_id, (10000000 + sum(amount_paise) OVER (PARTITION BY batch_id ORDER BY txn_date, external_ref, txn_id ROWS UNBOUNDED PRECEDING))::BIGINT AS balance_paise FROM t WHERE source_kind = 'bank'"),
    "latest_per_counterparty": _with("SELECT counterparty, txn_id, amount_paise FROM (SELECT *, row_number() OVER (PARTITION BY counterparty ORDER BY txn_date DESC, txn_id) AS rn FROM t) WHERE rn = 1"),
    "ingest_idempotent": f"""WITH t AS MATERIALIZED ({CORPUS}), held AS (SELECT DISTINCT batch_id, source_kind, external_ref FROM t WHERE right(txn_id, 1) IN ('0', '1', '2', '3', '4'))
SELECT txn_id FROM t ANTI JOIN held ON t.batch_id = held.batch_id AND t.source_kind = held.source_kind AND t.external_ref IS NOT DISTINCT FROM held.external_ref""",
    "parse_money": _with(f"SELECT txn_id, 'Rs. ' || shown || CASE WHEN amount_paise < 0 THEN ' DR' ELSE ' CR' END AS shown, amount_paise AS paise FROM {_SHOWN}"),
    "extract_reference": _with("SELECT txn_id, external_ref AS found FROM t WHERE length(external_ref) > 2"),
    "figure_trace": _with(f"SELECT txn_id, replace(shown, ',', '') || coalesce(' ' || fee_paise::VARCHAR, '') AS numbers, CASE WHEN fee_paise IS NULL OR fee_paise::VARCHAR = replace(shown, ',', '') THEN 0 ELSE 1 END::BIGINT AS untraced FROM {_SHOWN}"),
    "daily_rollup": "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS paise FROM events GROUP BY 1",
    "idle_detection": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)
SELECT user_id, sum(fresh)::BIGINT AS sessions, count(*) AS events, floor((epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 60000000)::BIGINT AS idle_minutes, floor((epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 60000000) > 30 AS idle FROM g GROUP BY user_id""",
    "usage_by_provider": "SELECT event_type, count(*) AS calls, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS tokens, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY 1",
    "category_confusion": _with("SELECT CASE WHEN truth_group IS NULL THEN 'noise' ELSE 'linked' END AS scenario, category, count(*) AS n FROM queue JOIN t USING (txn_id) GROUP BY ALL", _QUEUE),
}

ORACLES |= {
    "refund_group_merge": _with(
        """SELECT group_id, count(*) AS member_count, sum(amount_paise)::BIGINT AS net_paise FROM (SELECT coalesce(target, one.group_id) AS group_id, amount_paise FROM one LEFT JOIN moves ON moves.source = one.group_id) GROUP BY 1 HAVING min(amount_paise) < 0 AND max(amount_paise) > 0""",
        f"""heads AS (SELECT *, {_FULL} AS f FROM (SELECT *, min(amount_paise) OVER g AS least, max(amount_paise) OVER g AS most, row_number() OVER (PARTITION BY group_id ORDER BY CASE source_kind WHEN 'gateway' THEN 0 WHEN 'bank' THEN 1 ELSE 2 END, txn_id) AS rn FROM one WINDOW g AS (PARTITION BY group_id)) WHERE rn = 1),
moves AS (SELECT r.group_id AS source, min(o.group_id) AS target FROM heads r JOIN heads o ON r.batch_id = o.batch_id AND r.most < 0 AND o.least > 0 AND length(o.f) >= 3 AND contains(r.f, o.f) AND -r.amount_paise <= o.amount_paise AND coalesce(date_diff('day', o.txn_date, r.txn_date) BETWEEN 0 AND 30, true) GROUP BY 1 HAVING count(*) = 1)""",
    ),
    "settlement_absorption": _with(
        """SELECT 't4:' || bank AS group_id, count(*) AS member_count, count(DISTINCT absorbed) AS absorbed_groups, (sum(amount_paise) FILTER (source_kind = 'bank') - sum(net_paise) FILTER (source_kind = 'gateway'))::BIGINT AS residual_paise
FROM (SELECT bank, txn_id, absorbed FROM claimed UNION ALL SELECT DISTINCT bank, bank, NULL FROM claimed) JOIN t USING (txn_id) GROUP BY bank""",
        """picked AS (SELECT b.txn_id AS bank, p.txn_id, one.group_id AS absorbed FROM rest b JOIN t p ON b.source_kind = 'bank' AND p.source_kind = 'gateway' AND b.batch_id = p.batch_id AND b.settlement_id = p.settlement_id LEFT JOIN one ON one.txn_id = p.txn_id),
claimed AS (SELECT txn_id, min(bank) AS bank, min(absorbed) AS absorbed FROM (SELECT * FROM picked UNION ALL SELECT bank, one.txn_id, group_id FROM picked JOIN one ON group_id = absorbed) GROUP BY txn_id)""",
    ),
    "score_by_tier": _with(
        """SELECT tier, count(DISTINCT group_id) AS groups, sum(n)::BIGINT AS member_rows, sum(n * (n - 1) // 2)::BIGINT AS pairs, sum(tp)::BIGINT AS tp, (sum(n * (n - 1) // 2) - sum(tp))::BIGINT AS fp
FROM (SELECT tier, group_id, sum(m)::BIGINT AS n, sum(CASE WHEN truth_group IS NULL THEN 0 ELSE m * (m - 1) // 2 END)::BIGINT AS tp FROM (SELECT tier, group_id, truth_group, count(*) AS m FROM (SELECT 1 AS tier, group_id, truth_group FROM one UNION ALL SELECT 2, group_id, truth_group FROM two) GROUP BY ALL) GROUP BY tier, group_id) GROUP BY tier""",
        _WALK,
    ),
    "source_histogram": _with(f"SELECT n_sources, count(*) AS groups FROM ({_GROUP} one GROUP BY group_id) GROUP BY 1"),
    "confidence_histogram": _with(f"SELECT confidence_pct, count(*) AS groups FROM ({_GROUP} two GROUP BY group_id) GROUP BY 1", _WALK),
    "open_by_batch": _with("SELECT batch_id, count(*) AS n, sum(abs(amount_paise))::BIGINT AS abs_paise FROM queue GROUP BY 1", _QUEUE),
    "most_open_batches": _with("SELECT batch_id, count(*) AS n, sum(abs(amount_paise))::BIGINT AS abs_paise FROM queue GROUP BY 1 ORDER BY n DESC, batch_id LIMIT 3", _QUEUE),
    "review_chunks": _with(
        "SELECT batch_id, txn_id, (CASE WHEN i < n - last THEN i // 10 ELSE (n - 1) // 10 END)::BIGINT AS chunk FROM (SELECT *, CASE WHEN n > 10 THEN greatest((n - 1) % 10 + 1, 5) ELSE n END AS last FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY abs(amount_paise) DESC, txn_id) - 1 AS i, count(*) OVER (PARTITION BY batch_id) AS n FROM queue))",
        _QUEUE,
    ),
    "redaction": _with("SELECT txn_id, source_kind = 'bank' AS leaked, CASE source_kind WHEN 'bank' THEN '' ELSE external_ref END AS description, 'settlement_id' AS raw_keys, false AS leaks, 'was  ' || CASE source_kind WHEN 'bank' THEN regexp_replace('synthetic:' || external_ref, 'synthetic:\\w*', '', 'i') ELSE external_ref END AS claim FROM t"),
}
ORACLES["interpretation_counts"] = f"SELECT label, count(*) AS n FROM ({ORACLES['fee_interpretations']}) GROUP BY 1"
