"""How well the explainer read its rows: labels of all records of a row, what fits them, and the first misses and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import review as R
from .shared import written

#: Misses and quotes that a report shows, and characters of a text in it.
MISSES, QUOTES, CHARS = 25, 5, 200


def graded(queue: DataFrame, members: DataFrame, records: DataFrame, acceptable: dict[str, list[str]] = R.ACCEPTABLE) -> DataFrame:
    """The rows that the explainer wrote (model_raw is not null, be it empty), with scenario and outcome.

    queue: batch_id, id, txn_id, match_group_id, category, subcategory, confidence, explanation, model_raw.
    members: group_id, txn_id. records: txn_id, description, raw_category. A row's labels are those
    of its record and of its group's members: none is unlabelled, several are ambiguous, and one is right or wrong.
    """
    rows = queue.where("model_raw is not null")
    of_group = rows.where("match_group_id is not null").select("id", F.col("match_group_id").alias("group_id")).join(members, "group_id").select("id", "txn_id")
    links = rows.where("txn_id is not null").select("id", "txn_id").unionByName(of_group)
    named = records.select("txn_id", R.scenario(F.col("description"), F.col("raw_category")).alias("label")).where("label is not null")
    labels = links.join(named, "txn_id").groupBy("id").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    predicted = F.coalesce(F.nullif("category", F.lit("")), F.lit("(none)"))
    fits = F.lit(False)
    for name, good in acceptable.items():
        fits = fits | ((F.col("least") == name) & predicted.isin(good))
    outcome = F.when(F.col("least").isNull(), "unlabelled").when(F.col("least") != F.col("most"), "ambiguous").when(fits, "right").otherwise("wrong")
    out = rows.join(labels, "id", "left").withColumns({"predicted": predicted, "outcome": outcome})
    return out.withColumn("scenario", F.when(F.col("outcome").isin("right", "wrong"), F.col("least"))).drop("least", "most")


def _told():
    return F.trim(F.coalesce("explanation", F.lit(""))) != ""


def _quotes():
    return _told() & R.quotes_label(F.col("explanation"), F.col("subcategory"))


def _share(part, whole):
    return F.round(F.try_divide(100.0 * part, whole), 2)


def summary(queue: DataFrame, grades: DataFrame) -> DataFrame:
    """Per batch of the queue: rows, those the explainer wrote, graded, right, the share, ambiguous, unlabelled, texts and how many quote a label."""
    is_ = lambda *o: F.count_if(F.col("outcome").isin(*o))
    counts = grades.groupBy("batch_id").agg(F.count("*").alias("classified"), is_("right", "wrong").alias("graded"), is_("right").alias("correct"), is_("ambiguous").alias("ambiguous"), is_("unlabelled").alias("unlabelled"), F.count_if(_told()).alias("with_text"), F.count_if(_quotes()).alias("quoting"))
    out = queue.groupBy("batch_id").agg(F.count("*").alias("total")).join(counts, "batch_id", "left").na.fill(0)
    return out.withColumns({"accuracy_pct": _share(F.col("correct"), F.col("graded")), "quotation_pct": _share(F.col("quoting"), F.col("with_text"))})


def per_scenario(grades: DataFrame) -> DataFrame:
    """Per batch, scenario and predicted category: graded rows and right ones."""
    return grades.where("scenario is not null").groupBy("batch_id", "scenario", "predicted").agg(F.count("*").alias("graded"), F.count_if(F.col("outcome") == "right").alias("correct"))


def _first(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy("batch_id").orderBy("id"))).where(F.col("place") <= n)


def misses(grades: DataFrame, n: int = MISSES) -> DataFrame:
    """The first n wrong rows of each batch, by id."""
    return _first(grades.where("outcome = 'wrong'"), n).select("batch_id", "place", "id", "scenario", "predicted", "confidence", F.left(F.coalesce("explanation", F.lit("")), F.lit(CHARS)).alias("explanation"))


def quotes(grades: DataFrame, n: int = QUOTES) -> DataFrame:
    """The first n rows of each batch whose texts quote a label, by id."""
    return _first(grades.where(_quotes()), n).select("batch_id", "place", "id", "subcategory", F.left("explanation", F.lit(CHARS)).alias("explanation"))


def report(queue: DataFrame, members: DataFrame, records: DataFrame) -> dict[str, DataFrame]:
    """All of the above over one table of grades."""
    grades = written(graded(queue, members, records), "grades")
    return {"summary": summary(queue, grades), "scenarios": per_scenario(grades), "misses": misses(grades), "quotes": quotes(grades)}
