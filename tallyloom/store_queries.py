"""Registered queries over tables kept by batch: changes of single batches and the grounding audit; with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .functions import review as R
from .functions import scalars as S
from .operators import grounding
from .operators.shared import shared_folder
from .operators.store import BatchTable
from .plans.corpus import CORPUS, match_view, txns
from .plans.ledger import VARIANCES, variances
from .report_oracles import _shown
from .sources import files, workbook


def _table(rows, key):
    spark = rows.sparkSession
    table = BatchTable(spark, shared_folder(spark, "table"), rows.schema, key)
    table.replace(rows)
    return table


def batch_rewrite(spark, d):
    """The queue after some batches' rows are updated, deleted and added, one batch is replaced and one removed, all of it twice.

    An added row has its own key, which tells id 0 from its negative.
    """
    queue = variances(spark, d).select("batch_id", "id", "variance_paise", "status", F.col("id").cast("string").alias("key"))
    table = _table(queue, "key")
    year = queue.where("batch_id like '1995-%'")
    for _ in range(2):
        added = year.where("id % 11 = 0").withColumns({"id": -F.col("id"), "key": F.concat(F.lit("added "), "key")})
        put = year.where("id % 3 = 0").withColumn("status", F.lit("explained")).unionByName(added)
        table.change(put, year.where("id % 3 <> 0 and id % 7 = 0"))
        table.replace(queue.where("batch_id = '1996-02' and id % 2 = 0"))
        table.remove(queue.where("batch_id = '1996-03'"))
        table.change(drop=queue.where("batch_id = '1996-04'"))
    return table.rows().drop("key")


def _explained(spark, d):
    """Explained fee rows: a figure of nowhere in some texts, damaged labels in others."""
    t = match_view(txns(spark, d)).where("fee_paise > 0")
    n = F.col("amount_paise")
    text = F.concat(F.when(n % 4 == 0, "synthetic:fee ").otherwise(""), F.lit("fee "), S.rupees(F.col("fee_paise")), F.when(n % 3 == 0, " or 987654321.5").otherwise(""))
    status = F.when(n % 10 == 0, "open").otherwise("explained")
    rows = t.select("batch_id", F.col("txn_id").alias("id"), status.alias("status"), F.when(n % 2 == 0, "gateway_fee").otherwise("gst_on_fee").alias("category"), F.lit("fee").alias("subcategory"), F.lit("book_to_fee_account").alias("suggested_action"), ((n % 10).cast("double") / 10).alias("confidence"), text.alias("explanation"), F.lit(None).cast("map<string,string>").alias("model_raw"))
    record = F.struct("amount_paise", "fee_paise", "tax_paise", "net_paise", "external_ref")
    amounts = R.amount_universe(F.array("amount_paise", "fee_paise", "tax_paise", "net_paise"), F.array(F.lit(None).cast("long")))
    return rows, t.select("batch_id", F.col("txn_id").alias("id"), record.alias("record"), amounts.alias("universe"))


def by_amount(texts: list[str]) -> list[str]:
    """A critic that needs no model: a verdict by the record's amount, for some no verdict at all."""
    out = []
    for text in texts:
        n = json.loads(text)["record"]["amount_paise"]
        out.append("no verdict" if n % 11 == 0 else json.dumps({"grounded": n % 5 != 1, "amounts_correct": True, "action_appropriate": n % 7 != 2}))
    return out


def grounding_audit(spark, d):
    rows, cases = _explained(spark, d)
    return grounding.audit(_table(rows, "id"), cases, by_amount, shared_folder(spark, "verdicts"))


def grounding_resets(spark, d):
    """The stored rows after the audit."""
    rows, cases = _explained(spark, d)
    table = _table(rows, "id")
    grounding.audit(table, cases, by_amount, shared_folder(spark, "verdicts"))
    return table.rows().select("batch_id", "id", "status", "category", "subcategory", "confidence", "explanation", F.get_json_object(F.col("model_raw")["grounding_audit"], "$.rejected_category").alias("rejected"))


def exported_statement(spark, d):
    """Bank rows with a reference of six or more letters and digits, written as a statement and read back."""
    t = match_view(txns(spark, d)).where("source_kind = 'bank' and external_ref rlike '^[0-9A-F]*[A-F][0-9A-F]*$' and external_ref rlike '[0-9]' and length(external_ref) >= 6")
    path = shared_folder(spark, "statement")
    files.write_bank_csv(t, path)
    return files.read_bank_csv(spark, path).select("external_ref", "amount_paise", "txn_date", "reason")


def exported_books(spark, d):
    """Ledger rows as a workbook per batch and read back: sheet and line of each."""
    path = shared_folder(spark, "books")
    workbook.write_ledger_books(spark, match_view(txns(spark, d)).where("source_kind = 'ledger'"), path)
    return files.read_ledger_xlsx(spark, path)


QUERIES = {f.__name__: f for f in (batch_rewrite, grounding_audit, grounding_resets, exported_statement, exported_books)}

_Q = f"WITH v AS (SELECT batch_id, id, variance_paise, status FROM ({VARIANCES})) "
_AUDIT = f"""WITH t AS (SELECT *, amount_paise AS n FROM ({CORPUS}) WHERE fee_paise > 0),
s AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY md5('20260823/' || txn_id), txn_id) AS place FROM t WHERE n % 10 <> 0),
g AS (SELECT *, n % 11 <> 0 AND n % 5 <> 1 AND n % 7 <> 2 AS passed, n % 11 = 0 AS malformed, n % 3 = 0 AS odd FROM s WHERE place <= 30) """

ORACLES = {
    "exported_statement": f"SELECT external_ref, amount_paise, txn_date, NULL::VARCHAR AS reason FROM ({CORPUS}) WHERE source_kind = 'bank' AND regexp_full_match(external_ref, '[0-9A-F]*[A-F][0-9A-F]*') AND regexp_matches(external_ref, '[0-9]') AND length(external_ref) >= 6",
    "exported_books": f"""SELECT CASE WHEN i <= n // 2 THEN 0 ELSE 1 END AS sheet, CAST(4 + CASE WHEN i <= n // 2 THEN i ELSE i - n // 2 END AS INT) AS line, amount_paise, txn_date, external_ref, NULL::VARCHAR AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY txn_date, external_ref, txn_id) AS i, count(*) OVER (PARTITION BY batch_id) AS n FROM ({CORPUS}) WHERE source_kind = 'ledger')""",
    "batch_rewrite": _Q
    + """SELECT batch_id, id, variance_paise, CASE WHEN batch_id LIKE '1995-%' AND id % 3 = 0 THEN 'explained' ELSE status END AS status FROM v
WHERE NOT (batch_id LIKE '1995-%' AND id % 3 <> 0 AND id % 7 = 0) AND NOT (batch_id = '1996-02' AND id % 2 <> 0) AND batch_id NOT IN ('1996-03', '1996-04')
UNION ALL SELECT batch_id, -id, variance_paise, status FROM v WHERE batch_id LIKE '1995-%' AND id % 11 = 0""",
    "grounding_audit": _AUDIT
    + """SELECT batch_id, count(*) AS graded, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(100.0::DOUBLE * count(*) FILTER (passed) / count(*), 2) AS grounding_pct, count(*) FILTER (malformed) AS malformed,
  count(*) AS citing, count(*) FILTER (NOT odd) AS traced, count(*) FILTER (passed AND odd) AS disagreements, CAST(ceil(count(*) / 5) AS BIGINT) AS calls FROM g GROUP BY 1""",
    "grounding_resets": _AUDIT
    + f"""SELECT t.batch_id, t.txn_id AS id, CASE WHEN g.txn_id IS NOT NULL THEN 'open' WHEN t.n % 10 = 0 THEN 'open' ELSE 'explained' END AS status,
  CASE WHEN g.txn_id IS NOT NULL THEN 'unexplained' WHEN t.n % 2 = 0 THEN 'gateway_fee' ELSE 'gst_on_fee' END AS category, CASE WHEN g.txn_id IS NOT NULL THEN 'failed_grounding_audit' ELSE 'fee' END AS subcategory,
  CASE WHEN g.txn_id IS NOT NULL THEN least(CAST(t.n % 10 AS DOUBLE) / 10, 0.49::DOUBLE) ELSE CAST(t.n % 10 AS DOUBLE) / 10 END AS confidence,
  CASE WHEN t.n % 4 = 0 THEN 'synthetic:fee ' ELSE '' END || 'fee ' || {_shown('t.fee_paise')} || CASE WHEN t.n % 3 = 0 THEN ' or 987654321.5' ELSE '' END AS explanation,
  CASE WHEN g.txn_id IS NOT NULL THEN CASE WHEN t.n % 2 = 0 THEN 'gateway_fee' ELSE 'gst_on_fee' END END AS rejected
FROM t LEFT JOIN (SELECT * FROM g WHERE NOT passed) g ON g.txn_id = t.txn_id AND g.batch_id = t.batch_id""",
}
