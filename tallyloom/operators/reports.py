"""Reports over groups, the queue and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import review as R
from .tiers import running


def usage(audit: DataFrame, rates: list[tuple[str, float, float]] = R.RATES) -> DataFrame:
    """Per provider: served and failed calls, tokens, cost, and tokens of providers without a rate.

    A served call is one completion; failed ones have neither tokens nor provider and count apart.
    audit: action, provider, prompt_tokens, completion_tokens; null tokens are 0.
    """
    spark = audit.sparkSession
    tokens = lambda c: F.when(served, F.coalesce(c, F.lit(0))).otherwise(0)
    served = F.col("action").isin("batch_explained", "critic_batch_graded")
    failed = F.col("action").isin("batch_failed", "critic_batch_failed")
    rows = audit.where(served | failed).select(F.coalesce("provider", F.lit("unknown")).alias("provider"), served.alias("served"), tokens("prompt_tokens").alias("prompt"), tokens("completion_tokens").alias("completion"))
    sums = rows.groupBy("provider").agg(F.count_if("served").alias("calls"), F.count_if(~F.col("served")).alias("failed"), F.sum("prompt").alias("prompt_tokens"), F.sum("completion").alias("completion_tokens"))
    priced = sums.join(F.broadcast(spark.createDataFrame(rates, "provider string, p double, c double")), "provider", "left")
    cost = F.round(F.coalesce(F.col("prompt_tokens") * F.col("p") + F.col("completion_tokens") * F.col("c"), F.lit(0.0)), 8)
    return priced.select("provider", "calls", "failed", "prompt_tokens", "completion_tokens", cost.alias("cost_usd"), F.when(F.col("p").isNull(), F.col("prompt_tokens") + F.col("completion_tokens")).otherwise(0).alias("unpriced_tokens"))


def spans(audit: DataFrame) -> DataFrame:
    """Per batch: rows, seconds between first and last (0 with fewer than two), and rows a second (null at 0)."""
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    out = audit.groupBy("batch_id").agg(F.count("created_at").alias("n"), F.round((F.max(at) - F.min(at)) / 1e6, 3).alias("seconds"))
    seconds = F.when(F.col("n") < 2, 0.0).otherwise(F.col("seconds"))
    return out.select("batch_id", "n", seconds.alias("seconds"), F.round(F.try_divide("n", F.nullif(seconds, F.lit(0.0))), 4).alias("rows_per_second"))


def pairs_in_groups(members: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, inside groups, and whether they belong together. Grows with the square of a group's size."""
    own = members.select("group_id", "txn_id", "amount_paise").join(truth, "txn_id")
    a, b = (own.select("group_id", *(F.col(c).alias(f"{p}_{c}") for c in ("txn_id", "amount_paise", "truth_group"))) for p in "ab")
    pairs = a.join(b, "group_id").where("a_txn_id < b_txn_id")
    worst = F.greatest(F.abs("a_amount_paise"), F.abs("b_amount_paise"))
    return pairs.select("group_id", F.col("a_txn_id").alias("a"), F.col("b_txn_id").alias("b"), worst.alias("worst_paise"), F.coalesce(F.col("a_truth_group") == F.col("b_truth_group"), F.lit(False)).alias("right"))


def f1(tp, fp, fn):
    """Precision, recall and their harmonic mean, each 0 where it has no denominator, rounded to 6."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1")]


def explained_share(rows: DataFrame) -> DataFrame:
    """Share (percent, 4 decimals) of the absolute variance that fee and tax account for. rows: variance_paise, residual_paise."""
    total, rest = F.abs("variance_paise"), F.abs(F.coalesce("residual_paise", "variance_paise"))
    sums = rows.agg(F.coalesce(F.sum(total), F.lit(0)).alias("total_paise"), F.coalesce(F.sum(F.greatest(total - rest, F.lit(0))), F.lit(0)).alias("explained_paise"))
    return sums.withColumn("explained_pct", F.round(F.coalesce(F.try_divide(100.0 * F.col("explained_paise"), F.col("total_paise")), F.lit(0.0)), 4))


def group_category(residual, newest, as_of: str):
    """Category of a group's variance: rounding below one rupee, timing if its newest member is at most 5 days old."""
    recent = F.datediff(F.lit(as_of).cast("date"), newest) <= 5
    return F.when(F.abs(residual) < 100, "residual_rounding").when(recent, "timing").otherwise("unclassified")


def confusion(rows: DataFrame, acceptable: dict[str, list[str]] = R.ACCEPTABLE) -> DataFrame:
    """Per scenario and predicted category: rows, and how many of them are an acceptable reading."""
    pairs = [(s, c) for s, cs in acceptable.items() for c in cs]
    table = rows.sparkSession.createDataFrame(pairs, "scenario string, predicted string").withColumn("fits", F.lit(1))
    labelled = rows.select(F.coalesce(R.scenario(F.col("description"), F.col("raw_category")), F.lit("unlabelled")).alias("scenario"), F.coalesce("category", F.lit("uncategorised")).alias("predicted"))
    counts = labelled.groupBy("scenario", "predicted").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(table), ["scenario", "predicted"], "left").select("scenario", "predicted", "n", F.when(F.col("fits") == 1, F.col("n")).otherwise(0).alias("right"))


def page(rows: DataFrame, order: list, limit: int, **wanted) -> DataFrame:
    """Rows that have the wanted values (None: any), in order, at most limit."""
    for column, value in wanted.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.orderBy(*order).limit(limit)


def options(rows: DataFrame, *columns: str) -> DataFrame:
    """The distinct values of some columns (kind, value), over all rows whatever the page's filters."""
    parts = [F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in columns]
    return rows.select(F.explode(F.array(*parts)).alias("o")).select("o.*").where("value is not null").distinct()


def latest(rows: DataFrame, key: str, order: list) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def stuck(audit: DataFrame, locked: DataFrame, final: list[str], now, minutes: int = 30) -> DataFrame:
    """Batches without a final step whose last activity is `minutes` old and that nobody holds. locked: batch_id."""
    at = F.col("created_at").cast("timestamp")
    last = audit.groupBy("batch_id").agg(F.max(at).alias("last"), F.max(F.col("step").isin(final).cast("int")).alias("over"))
    idle = (F.unix_micros(now) - F.unix_micros("last")) / 60_000_000
    return last.where(F.col("over") == 0).where(idle >= minutes).join(locked, "batch_id", "left_anti").select("batch_id", F.round(idle, 1).alias("idle_minutes"))


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a digest of seed and key: the same draw each time, all rows if there are fewer."""
    return rows.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def trimmed(rows: DataFrame, key: str, order: list, text: str, most: int) -> DataFrame:
    """Whole lines of a context, from its start, as long as they and their line ends fit into `most` characters."""
    kept = running(rows, [key], order, {"chars": F.length(text) + 1})
    return kept.where(F.col("chars") <= most + 1).drop("chars_all")


def activity(batches: DataFrame, variances: DataFrame, groups: DataFrame, scores: DataFrame) -> DataFrame:
    """One row (at, kind, unexplained_paise, grounding_pct) for everything that the daily summary counts.

    batches: created_at, completed_at, status; variances and groups: created_at; scores: run_at, unexplained_paise, grounding_pct.
    """
    none = [F.lit(None).cast("long").alias("unexplained_paise"), F.lit(None).cast("double").alias("grounding_pct")]
    of = lambda df, at, kind: df.select(F.col(at).alias("at"), F.lit(kind).alias("kind"), *none)
    out = scores.select(F.col("run_at").alias("at"), F.lit("score").alias("kind"), F.col("unexplained_paise").cast("long").alias("unexplained_paise"), F.col("grounding_pct").cast("double").alias("grounding_pct"))
    for df, at, kind in ((batches, "created_at", "created"), (batches.where("completed_at is not null"), "completed_at", "completed"), (batches.where("status = 'failed'"), "created_at", "failed"), (variances, "created_at", "variance"), (groups, "created_at", "group")):
        out = out.unionByName(of(df, at, kind))
    return out


def day_summary(rows: DataFrame) -> DataFrame:
    """Per UTC day, from activity(), as a table or as a stream with a watermark on `at`: the six counts, unexplained money and the mean of the recorded grounding rates."""
    kinds = {"created": "batches_created", "completed": "batches_completed", "failed": "batches_failed", "group": "groups_created", "variance": "variances_opened", "score": "scores_written"}
    counts = [F.count_if(F.col("kind") == k).alias(n) for k, n in kinds.items()]
    days = rows.groupBy(F.window("at", "1 day").alias("w")).agg(*counts, F.coalesce(F.sum("unexplained_paise"), F.lit(0)).alias("unexplained_paise"), F.round(F.avg("grounding_pct"), 2).alias("mean_grounding_pct"))
    return days.select(F.col("w.start").cast("date").alias("day"), *kinds.values(), "unexplained_paise", "mean_grounding_pct")


def stalled(batches: DataFrame, now, minutes: int = 30, final=("complete", "failed")) -> DataFrame:
    """Batches in no final state (null is none) that were created more than `minutes` ago, whatever happened to them since."""
    age = F.unix_micros(now) - F.unix_micros(F.col("created_at").cast("timestamp"))
    return batches.where(~F.coalesce(F.col("status"), F.lit("")).isin(*final) & (age > minutes * 60_000_000))
