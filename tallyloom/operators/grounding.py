"""The grounding audit as one run: a seeded sample, a critic's verdicts, figures traced, failures opened again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import review as R
from ..functions import scalars as S
from . import classify
from .shared import written
from .store import BatchTable

#: Rows sampled of a batch, rows per call, the seed of the draw, the mark of a failed row.
SAMPLE, CALL, SEED, FAILED = 30, 5, 20260823, "failed_grounding_audit"


def drawn(rows: DataFrame, n: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """n explained rows with a text of each batch, in the order of a digest of seed and id; all if there are fewer."""
    pool = rows.where("status = 'explained' and trim(coalesce(explanation, '')) <> ''")
    place = F.row_number().over(W.partitionBy("batch_id").orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("id").cast("string"))), "id"))
    return pool.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def case_text() -> F.Column:
    """What the critic reads of a row: id, the record and the claim, without marks of the answer key."""
    claim = F.struct("category", "subcategory", "suggested_action", S.scrubbed_claim(F.col("explanation")).alias("explanation"))
    return F.to_json(F.struct(F.col("id").cast("string").alias("variance_id"), "record", claim.alias("claim")))


def graded(rows: DataFrame, critic: Callable[[list[str]], list[str]], folder: str, n: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """A verdict for each sampled row.

    rows: batch_id, id, status, category, subcategory, suggested_action, confidence, explanation, record (a
    struct without the answer key), universe (amounts that may be cited). critic: texts to JSON verdicts.
    A row whose call failed, or whose verdict is no verdict, has not passed.
    """
    cases = drawn(rows, n, seed).withColumn("case", case_text())
    cases = written(cases.where(F.assert_true(~F.col("case").rlike("synthetic:|truth_group"), F.lit("a case holds a mark of the answer key")).isNull()), "cases")
    said = classify.classified(cases, ["batch_id"], ["id"], "id", "case", critic, folder, most=CALL, least=1)
    said = said.select(F.col("id").alias("said_id"), "chunk_key", "answer", "error")
    found = cases.join(said, cases.id.cast("string") == said.said_id, "left").withColumns({"v": R.verdict(F.col("answer")), "cited": R.cited(F.col("explanation"), F.col("universe"))})
    found = found.withColumn("untraced", R.untraced(F.col("cited"), F.col("universe")))
    cites, bad = F.size("cited") > 0, F.size("untraced") > 0
    return found.select("batch_id", "id", "category", "subcategory", "confidence", "explanation", "chunk_key", "error", "v.*", F.array_join("untraced", " ").alias("untraced"), cites.alias("cites"), (cites & ~bad).alias("traced"), (F.col("v.passed") & cites & bad).alias("disagrees"))


def summary(grades: DataFrame) -> DataFrame:
    """Per batch: graded, passed, failed, percent passed, malformed verdicts, rows that cite and whose figures are all found, passes with a figure of nowhere, calls."""
    passed = F.count_if("passed")
    calls = F.count_distinct(F.when(F.col("error").isNull(), F.col("chunk_key")))
    return grades.groupBy("batch_id").agg(F.count("*").alias("graded"), passed.alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.round(100.0 * passed / F.count("*"), 2).alias("grounding_pct"), F.count_if("malformed").alias("malformed"), F.count_if("cites").alias("citing"), F.count_if("traced").alias("traced"), F.count_if("disagrees").alias("disagreements"), calls.alias("calls"))


def reset(rows: DataFrame, grades: DataFrame) -> DataFrame:
    """The rows that failed, open and unexplained again; the text stays, and model_raw (a map of texts, or null) keeps why."""
    why = grades.where("not passed").select(F.col("batch_id").alias("__batch_id"), F.col("id").alias("__id"), F.to_json(F.struct("grounded", "amounts_correct", "action_appropriate", "untraced", F.col("category").alias("rejected_category"), F.col("subcategory").alias("rejected_subcategory"))).alias("__why"))
    failed = rows.join(why, rows.batch_id.eqNullSafe(why["__batch_id"]) & (rows.id == why["__id"]))
    raw = F.map_filter(F.coalesce("model_raw", F.create_map().cast("map<string,string>")), lambda k, _: k != "grounding_audit")
    sure = F.when(F.col("confidence").isNull(), 0.0).otherwise(F.least("confidence", F.lit(R.CEILING)))
    changed = {"status": F.lit("open"), "category": F.lit("unexplained"), "subcategory": F.lit(FAILED), "confidence": sure, "model_raw": F.map_concat(raw, F.create_map(F.lit("grounding_audit"), F.col("__why")))}
    return failed.withColumns(changed).select(*rows.columns)


def audit(table: BatchTable, cases: DataFrame, critic: Callable[[list[str]], list[str]], folder: str, n: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """One run over a stored queue: grades it, opens what failed in the table and returns summary(). cases: batch_id, id, record, universe."""
    held = table.rows()
    what = cases.select(F.col("batch_id").alias("__batch_id"), F.col("id").alias("__id"), "record", "universe")
    rows = held.join(what, held.batch_id.eqNullSafe(what["__batch_id"]) & (held.id == what["__id"])).drop("__batch_id", "__id")
    grades = written(graded(rows, critic, folder, n, seed), "grades")
    counts = written(summary(grades), "summary")
    table.change(reset(held, grades))
    return counts
