"""Derived tables for the reports: a review queue, an audit log and batch scores, without randomness.

Each text is read by Spark and by DuckDB alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import over_tables

#: Queue rows with category, status, confidence, a scenario label and the text of an explanation.
VARIANCES = """
SELECT o_orderkey AS id, substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) AS batch_id, CAST(o_custkey AS BIGINT) AS custkey,
  CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS variance_paise,
  CASE o_orderkey % 7 WHEN 0 THEN 'gateway_fee' WHEN 1 THEN 'timing_difference' WHEN 2 THEN 'unexplained' WHEN 3 THEN 'duplicate_entry' WHEN 4 THEN 'missing_source_record' WHEN 5 THEN 'refund_offset' END AS category,
  CASE o_orderkey % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'explained' WHEN 2 THEN 'open' WHEN 3 THEN 'accepted' END AS status,
  CASE WHEN o_orderkey % 11 < 10 THEN CAST(o_orderkey % 11 AS DOUBLE) / 10 END AS confidence,
  CASE WHEN o_orderkey % 4 = 0 THEN 'paid by card' WHEN o_orderkey % 4 = 1 THEN NULL ELSE concat('synthetic:', CASE o_orderkey % 9 WHEN 0 THEN 'fee_tax_split' WHEN 1 THEN 'value_date_drift' WHEN 2 THEN 'many_to_one' WHEN 3 THEN 'refund_chargeback' WHEN 4 THEN 'missing_one_source' WHEN 5 THEN 'duplicate_one_source' WHEN 6 THEN 'ref_format_drift' WHEN 7 THEN 'genuine_noise' ELSE 'clean_3way' END) END AS description,
  CASE WHEN o_orderkey % 8 = 1 THEN 'genuine_noise' END AS raw_category,
  CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 13 = 1 THEN NULL WHEN o_orderkey % 13 = 2 THEN 'A Clean_3Way row' ELSE 'the fee was deducted' END AS explanation,
  CASE WHEN o_orderkey % 17 = 0 THEN 'GENUINE_NOISE' ELSE 'fee' END AS subcategory
FROM orders
"""

#: The audit log: who did what to which batch, when, with the tokens of model calls in props.
AUDIT = """
SELECT event_id AS id, concat('b', CAST(user_id AS STRING)) AS batch_id, user_id, ts AS created_at, event_type AS step,
  CASE event_type WHEN 'purchase' THEN 'batch_explained' WHEN 'click' THEN 'critic_batch_graded' WHEN 'error' THEN 'batch_failed' WHEN 'signup' THEN 'run_crashed' ELSE 'viewed' END AS action,
  CASE WHEN event_id % 6 = 0 THEN 'human' ELSE 'matcher' END AS actor,
  CASE user_id % 5 WHEN 0 THEN 'nvidia' WHEN 1 THEN 'byteplus' WHEN 2 THEN 'openrouter' WHEN 3 THEN 'local' END AS provider, value, props
FROM events
"""


def _view(spark: SparkSession, sf_dir: str, table: str, text: str) -> DataFrame:
    return over_tables(spark, sf_dir, text, table)


def variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "orders", VARIANCES)


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log. A call's prompt tokens are k of its props, its completion tokens half of them."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return _view(spark, sf_dir, "events", AUDIT).withColumns({"prompt_tokens": k, "completion_tokens": F.floor(k / 2)})
