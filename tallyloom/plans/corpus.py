"""The records of three sources, derived from the order tables without randomness.

The text is read by Spark and by DuckDB alike, so that both work on one relation. Scenario by
order key modulo 20: 0-5 three equal legs, 6-8 fee and tax, 9-10 late bank date, 11-12 changed
reference, 13-14 many payments and one credit (13 with a settlement id), 15 refund, 16 a leg
missing, 17 a leg twice, 18-19 one leg that matches nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CORPUS = """
WITH o AS (
  SELECT o_orderkey AS k, o_orderkey % 20 AS s, upper(substr(md5(CAST(o_orderkey AS STRING)), 1, 6)) AS token,
         CAST(round(o_totalprice * 100) AS BIGINT) AS gross, CAST(o_orderdate AS DATE) AS d,
         CAST(floor(o_orderkey / 20) AS BIGINT) % 3 AS leg, concat('c', CAST(o_custkey AS STRING)) AS who FROM orders),
f AS (SELECT *, CASE WHEN s BETWEEN 6 AND 8 THEN CAST(floor((gross * 2 + 50) / 100) AS BIGINT) END AS fee FROM o),
e AS (SELECT *, CAST(floor((fee * 18 + 50) / 100) AS BIGINT) AS tax FROM f),
items AS (
  SELECT k, s, token, d, who, CAST(round(l_extendedprice) AS BIGINT) AS paid,
         row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS rn
  FROM e JOIN lineitem ON l_orderkey = k WHERE s IN (13, 14)),
kinds AS (SELECT 'gateway' AS source_kind, 0 AS place UNION ALL SELECT 'bank', 1 UNION ALL SELECT 'ledger', 2),
copies AS (SELECT 0 AS copy UNION ALL SELECT 1),
legs AS (
  SELECT concat(source_kind, '_', CAST(k AS STRING), CASE WHEN copy = 1 THEN 'b' ELSE '' END) AS txn_id, d AS day, source_kind,
         CASE WHEN s NOT IN (11, 12) THEN token WHEN place = 0 THEN concat('pay_', token) WHEN place = 1 THEN concat('PAY', token) ELSE substr(token, 4, 3) END AS external_ref,
         CASE WHEN place = 1 AND s BETWEEN 6 AND 8 THEN gross - fee - tax ELSE gross END AS amount_paise,
         CASE WHEN place = 0 THEN fee END AS fee_paise, CASE WHEN place = 0 THEN tax END AS tax_paise,
         CASE WHEN place = 0 THEN gross - fee - tax END AS net_paise,
         CASE WHEN place = 1 AND s IN (9, 10) THEN CAST(k % 3 + 1 AS INT) ELSE 0 END AS later, who AS counterparty,
         CAST(NULL AS STRING) AS settlement_id, CASE WHEN s < 18 THEN concat('tg_', CAST(k AS STRING)) END AS truth_group
  FROM e CROSS JOIN kinds CROSS JOIN copies
  WHERE (copy = 0 OR (s = 17 AND leg = place)) AND (s <= 12 OR s IN (15, 17) OR (s = 16 AND leg <> place) OR (s = 18 AND place = 0) OR (s = 19 AND place = 1))
  UNION ALL
  SELECT concat('refund_', source_kind, '_', CAST(k AS STRING)), d, source_kind, concat('rfnd_', token),
         -CASE WHEN k % 40 = 15 THEN gross ELSE CAST(floor(gross / 2) AS BIGINT) END, NULL, NULL, NULL, 5, who, NULL, concat('tg_', CAST(k AS STRING))
  FROM e CROSS JOIN kinds WHERE s = 15
  UNION ALL
  SELECT concat('item_', source_kind, '_', CAST(k AS STRING), '_', CAST(rn AS STRING)), d, source_kind, concat(token, 'N', CAST(rn AS STRING)), paid,
         CASE WHEN place = 0 THEN 0 END, CASE WHEN place = 0 THEN 0 END, CASE WHEN place = 0 THEN paid END, -CAST(rn % 3 AS INT), who,
         CASE WHEN s = 13 AND place = 0 THEN concat('setl_', CAST(k AS STRING)) END, concat('tg_', CAST(k AS STRING))
  FROM items CROSS JOIN kinds WHERE place <> 1
  UNION ALL
  SELECT concat('credit_', CAST(k AS STRING)), max(d), 'bank', concat('STL', max(token)), CAST(sum(paid) AS BIGINT), NULL, NULL, NULL, 1, max(who),
         CASE WHEN max(s) = 13 THEN concat('setl_', CAST(k AS STRING)) END, concat('tg_', CAST(k AS STRING))
  FROM items GROUP BY k)
SELECT txn_id, substr(CAST(day AS STRING), 1, 7) AS batch_id, source_kind, external_ref, amount_paise, fee_paise, tax_paise, net_paise,
       CAST(day + later * INTERVAL '1' DAY AS DATE) AS txn_date, counterparty, settlement_id, truth_group
FROM legs
"""


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_tables(spark, sf_dir, CORPUS, "orders", "lineitem")


def over_tables(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """The query text over the given tables, which are views of names of their own: the caller's views stay."""
    for name in tables:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"tallyloom_{name}")
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 tallyloom_{name}", text)
    return spark.sql(text)


#: Columns that matchers may see; the answer key is not among them.
MATCH_COLUMNS = ["txn_id", "batch_id", "source_kind", "external_ref", "amount_paise", "fee_paise", "tax_paise", "net_paise", "txn_date", "counterparty", "settlement_id"]
FORBIDDEN = {"truth_group", "is_noise"}


def match_view(df: DataFrame) -> DataFrame:
    return guarded(df.select(*MATCH_COLUMNS))


def guarded(df: DataFrame) -> DataFrame:
    """Fails if a matcher would see the answer key."""
    if seen := FORBIDDEN & set(df.columns):
        raise ValueError(f"answer key columns in a matcher: {sorted(seen)}")
    return df
