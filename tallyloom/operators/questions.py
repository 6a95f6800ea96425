"""Questions about a batch: a context of figures, an answer asked twice at most, and a refusal where figures can't be traced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import review as R
from . import classify
from .shared import written

#: Open rows shown, characters of a context, and what is said where it ends early or no answer holds.
TOP_OPEN, BUDGET = 5, 8000
CUT = "  [context truncated to fit the token budget]"
REFUSAL = "The system could not produce a verified answer to that question. A draft answer was generated but it cited figures that could not be traced back to the reconciliation data for this batch, so it was withheld rather than shown."


def _lines(df: DataFrame, section: int, order, *texts) -> DataFrame:
    """batch_id, section, place, line: the texts of each row in turn, null texts left out."""
    lines = df.select("batch_id", order.alias("at"), F.posexplode(F.filter(F.array(*texts), lambda x: x.isNotNull())).alias("i", "line"))
    return lines.select("batch_id", F.struct(F.lit(section).alias("section"), F.col("at").cast("long").alias("at"), "i").alias("place"), "line")


def _headed(batches: DataFrame, rows: DataFrame, section: int, head: str, none: str) -> DataFrame:
    """A heading for every batch, and a line for those without rows."""
    empty = batches.join(rows.select("batch_id").distinct(), "batch_id", "left_anti")
    return _lines(batches, section, F.lit(0), F.lit(head)).unionByName(_lines(empty, section, F.lit(1), F.lit("  " + none)))


def _put(text: str, *columns) -> F.Column:
    """text with each {} replaced by a column."""
    parts = text.split("{}")
    return F.concat(F.lit(parts[0]), *(x for c, p in zip(columns, parts[1:]) for x in (c.cast("string"), F.lit(p))))


def context(batches: DataFrame, scores: DataFrame, queue: DataFrame, groups: DataFrame, budget: int = BUDGET) -> DataFrame:
    """batch_id, context: the score, the queue by category, the largest open rows and the tiers, most asked for first.

    batches: batch_id, without nulls. scores: batch_id, total_txns, matched_txns, match_rate, precision, recall,
    f1, unexplained_paise, grounding_pct; one row a batch, null where not recorded. queue: batch_id, id, variance_paise, category,
    status, suggested_action, explanation. groups: batch_id, group_id, tier, strategy, members, variance_paise.
    Of a context longer than the budget whole lines are left out from its end, and a last line says so.
    """
    c = F.col
    rate = lambda name: R.ratio_with_percent(c(name))
    told = [_put("  total transactions ingested: {}", F.coalesce(c("total_txns").cast("string"), F.lit("not recorded"))), _put("  transactions matched into a group: {}", F.coalesce(c("matched_txns").cast("string"), F.lit("not recorded")))]
    told += [_put(f"  {n.replace('_', ' ')}: {{}}", rate(n)) for n in ("match_rate", "precision", "recall", "f1")]
    told += [_put("  unexplained value: {}", R.money(c("unexplained_paise"))), _put("  explanation grounding rate: {}%", c("grounding_pct"))]
    score = _headed(batches, scores, 1, "RUN SCORE", "no score recorded for this batch").unionByName(_lines(scores, 1, F.lit(1), *told))

    by = W.partitionBy("batch_id")
    sums = queue.groupBy("batch_id", F.coalesce("category", F.lit("uncategorised")).alias("category"), F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"), F.sum(F.coalesce("variance_paise", F.lit(0))).alias("p"))
    sums = sums.withColumn("at", F.row_number().over(by.orderBy(F.abs("p").desc(), "category", "status")))
    kinds = _headed(batches, sums, 2, "VARIANCE QUEUE BY CATEGORY (count and summed value)", "the variance queue is empty for this batch")
    kinds = kinds.unionByName(_lines(sums, 2, c("at"), _put("  {} [{}]: {} variances, total {}", c("category"), c("status"), c("n"), R.money(c("p")))))

    size = F.abs(F.coalesce("variance_paise", F.lit(0)))
    top = queue.where("status = 'open'").withColumn("at", F.row_number().over(by.orderBy(size.desc(), "id"))).where(c("at") <= TOP_OPEN)
    text = F.when(F.trim(F.coalesce("explanation", F.lit(""))) != "", F.concat(F.lit("     explanation: "), "explanation"))
    shown = _put("  {}. {} — category {}, suggested action {}", c("at"), R.money(F.coalesce("variance_paise", F.lit(0))), F.coalesce("category", F.lit("none")), F.coalesce("suggested_action", F.lit("none")))
    large = _headed(batches, top, 3, f"{TOP_OPEN} LARGEST OPEN VARIANCES", "no open variances").unionByName(_lines(top, 3, c("at"), shown, text))

    tiers = groups.groupBy("batch_id", "tier", F.coalesce("strategy", F.lit("?")).alias("strategy")).agg(F.count("*").alias("n"), F.sum("members").alias("m"), F.sum(F.coalesce("variance_paise", F.lit(0))).alias("p"))
    tiers = tiers.withColumn("at", F.row_number().over(by.orderBy(F.asc_nulls_last("tier"), "strategy")))
    last = _headed(batches, tiers, 4, "MATCHING TIER CONTRIBUTION", "no match groups recorded for this batch")
    last = last.unionByName(_lines(tiers, 4, c("at"), _put("  tier {} ({}): {} groups, {} transactions, residual variance {}", F.coalesce(c("tier").cast("string"), F.lit("?")), c("strategy"), c("n"), c("m"), R.money(c("p")))))

    title = _lines(batches, 0, F.lit(0), _put("RECONCILIATION RUN — batch {}", c("batch_id")))
    every = title.unionByName(score).unionByName(kinds).unionByName(large).unionByName(last)
    chars = F.sum(F.length("line") + 1).over(by.orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    kept = every.withColumn("fits", chars - 1 <= budget)
    kept = kept.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.when(c("fits"), F.struct("place", "line")))).alias("l"), F.bool_and("fits").alias("whole"))
    return kept.select("batch_id", F.concat(F.array_join(c("l.line"), "\n"), F.when(c("whole"), "").otherwise("\n" + CUT)).alias("context"))


def answered(contexts: DataFrame, question: F.Column, model: Callable[[list[str]], list[str]], folder: str, attempts: int = 2) -> DataFrame:
    """batch_id, question, answer, verified, attempts, untraced: an answer all of whose figures are in the context, else the refusal.

    contexts: batch_id, context. A batch whose call failed, or whose answer names a figure of nowhere, is asked
    again, up to `attempts` times; only those rows are. untraced: such figures of its last answer.
    """
    rows = written(contexts.select("batch_id", "context", question.alias("question")), "questions")
    open_, out = rows, None
    for n in range(1, attempts + 1):
        prompt = F.concat(F.lit("FIGURES FROM THIS RECONCILIATION RUN:\n\n"), "context", F.lit("\n\nQUESTION: "), F.coalesce("question", F.lit("")))
        asks = open_.select(F.col("batch_id").alias("chunk_key"), F.array("batch_id").alias("ids"), F.array(prompt).alias("texts"))
        said = classify.asked(asks, model, f"{folder}/{n}").select(F.col("chunk_key").alias("batch_id"), F.trim(F.col("answers")[0]).alias("said"))
        tried = open_.join(said, "batch_id").withColumn("bad", R.ungrounded(F.col("said"), F.col("context")))
        good = F.col("said").isNotNull() & (F.size("bad") == 0)
        tried = written(tried.withColumns({"good": F.coalesce(good, F.lit(False)), "bad": F.coalesce(F.array_join("bad", " "), F.lit(""))}), "tried")
        done = tried if n == attempts else tried.where("good")
        done = done.select("batch_id", "question", F.when(F.col("good"), F.col("said")).otherwise(REFUSAL).alias("answer"), F.col("good").alias("verified"), F.lit(n).alias("attempts"), F.col("bad").alias("untraced"))
        out = done if out is None else out.unionByName(done)
        open_ = tried.where("not good").select(*rows.columns)
    return out
