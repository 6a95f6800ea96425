"""The registered reconciliation queries: each maps (spark, sf_dir) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import match as M
from .operators import tiers as T
from .operators.shared import written
from .plans.corpus import match_view, txns
from .sources.files import new_rows
from .streaming import live

AS_OF = "2001-08-05"


def _t(spark, d) -> DataFrame:
    return match_view(txns(spark, d))


def _exact(spark, d) -> DataFrame:
    return M.exact_members(written(_t(spark, d), "txns"))


def _open(spark, d) -> DataFrame:
    t = written(_t(spark, d), "txns")
    return M.unmatched(t, M.exact_members(t))


def _queue(spark, d) -> DataFrame:
    t = written(_t(spark, d), "txns")
    return M.variance_queue(t, M.unmatched(t, M.exact_members(t)), AS_OF)


def normalize_refs(spark, d):
    full = S.full_ref(F.col("external_ref"))
    return _t(spark, d).select("txn_id", full.alias("ref_full"), S.last8(full).alias("ref_last8"))


def t1_exact_groups(spark, d):
    return M.groups_of(_exact(spark, d))


def t1_roles(spark, d):
    return M.with_roles(_exact(spark, d)).select("group_id", "txn_id", "role")


def t2_candidate_pairs(spark, d):
    rest = _open(spark, d)
    return M.candidate_pairs(rest, rest)


def t2_clusters(spark, d):
    return M.groups_of(M.cluster_members(_open(spark, d)))


def t2_attach(spark, d):
    t = written(_t(spark, d), "txns")
    members = written(M.exact_members(t), "members")
    return M.attached(M.unmatched(t, members), members)


def fee_interpretations(spark, d):
    t = written(_t(spark, d), "txns")
    return M.fee_pairs(t, M.unmatched(t, M.exact_members(t)))


def refund_pairs_asof(spark, d):
    return M.refund_pairs(_t(spark, d))


def settlement_by_id(spark, d):
    return M.settlements_by_id(_t(spark, d))


def subset_sum_settlement(spark, d):
    t = written(_t(spark, d), "txns")
    return M.settled_once(t, T.earlier_members(t))


def unmatched_anti(spark, d):
    return _open(spark, d).select("txn_id", "source_kind", "amount_paise")


def duplicate_suspects(spark, d):
    t = _t(spark, d).where("external_ref <> ''")
    w = W.partitionBy("batch_id", "source_kind", "external_ref", "amount_paise")
    return t.withColumn("twins", F.count("*").over(w)).where("twins > 1").select("txn_id", "twins")


def variance_queue(spark, d):
    return _queue(spark, d)


def variances_by_category(spark, d):
    return _queue(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.sum("amount_paise").alias("net_paise"), F.sum(F.abs("amount_paise")).alias("abs_paise"))


def open_top5(spark, d):
    return _queue(spark, d).orderBy(F.abs("amount_paise").desc(), "txn_id").limit(5)


def pair_scores(spark, d):
    full = written(txns(spark, d), "txns")
    return M.pair_scores(M.exact_members(match_view(full)), full.select("txn_id", "truth_group")).select("tp", "fp", "fn", "precision", "recall")


def tier_funnel(spark, d):
    t = written(_t(spark, d), "txns")
    one = written(M.exact_members(t), "members")
    two = M.cluster_members(M.unmatched(t, one))
    rows = one.withColumn("tier", F.lit(1)).unionByName(two.withColumn("tier", F.lit(2)))
    return rows.groupBy("tier").agg(F.count_distinct("group_id").alias("groups"), F.count("*").alias("member_rows"))


def recon_identity(spark, d):
    t = written(_t(spark, d), "txns")
    members = written(M.exact_members(t), "members")
    one = members.agg(F.sum("amount_paise").alias("matched"), F.count("*").alias("matched_rows"))
    rest = M.unmatched(t, members).agg(F.sum("amount_paise").alias("open"), F.count("*").alias("open_rows"))
    whole = t.agg(F.sum("amount_paise").alias("total"), F.count("*").alias("total_rows"))
    return one.crossJoin(rest).crossJoin(whole).withColumn("balanced", (F.col("matched") + F.col("open") == F.col("total")) & (F.col("matched_rows") + F.col("open_rows") == F.col("total_rows")))


def rows_by_source(spark, d):
    return _t(spark, d).groupBy("batch_id", "source_kind").agg(F.count("*").alias("n"), F.sum("amount_paise").alias("net_paise"))


def running_balance(spark, d):
    """The balance after each bank row: what the days before brought, and a running sum inside the day, so no batch is one task."""
    rows = written(_t(spark, d).where("source_kind = 'bank'").select("batch_id", "txn_date", "external_ref", "txn_id", "amount_paise"), "bank")
    days = rows.groupBy("batch_id", "txn_date").agg(F.sum("amount_paise").alias("day_paise"))
    past = F.sum("day_paise").over(W.partitionBy("batch_id").orderBy("txn_date").rowsBetween(W.unboundedPreceding, -1))
    start = days.select("batch_id", F.col("txn_date").alias("day"), (F.lit(10_000_000) + F.coalesce(past, F.lit(0))).alias("start"))
    dealt = rows.join(start, (rows.batch_id == start.batch_id) & rows.txn_date.eqNullSafe(start.day)).drop(start.batch_id)
    w = W.partitionBy("batch_id", "txn_date").orderBy("external_ref", "txn_id").rowsBetween(W.unboundedPreceding, 0)
    return dealt.select("txn_id", (F.col("start") + F.sum("amount_paise").over(w)).alias("balance_paise"))


def latest_per_counterparty(spark, d):
    w = W.partitionBy("counterparty").orderBy(F.col("txn_date").desc(), "txn_id")
    return _t(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("counterparty", "txn_id", "amount_paise")


def ingest_idempotent(spark, d):
    t = _t(spark, d)
    stored = t.where("substr(txn_id, -1) in ('0', '1', '2', '3', '4')").select("batch_id", "source_kind", "external_ref")
    return new_rows(t, stored).select("txn_id")


def parse_money(spark, d):
    t = _t(spark, d)
    text = F.concat(F.lit("Rs. "), S.rupees(F.col("amount_paise")), F.when(F.col("amount_paise") < 0, " DR").otherwise(" CR"))
    return t.select("txn_id", text.alias("shown"), S.paise_of(text).alias("paise"))


def extract_reference(spark, d):
    narration = F.concat(F.lit("NEFT/"), "external_ref", F.lit("-12 by TRANSFER"))
    return _t(spark, d).where("length(external_ref) > 2").select("txn_id", S.extracted_ref(narration).alias("found"))


def figure_trace(spark, d):
    t = _t(spark, d)
    text = F.concat(F.lit("paid "), S.rupees(F.col("amount_paise")), F.lit(" on 2024-01-02 with fee "), F.coalesce(F.col("fee_paise").cast("string"), F.lit("none")), F.lit(" id x9"))
    found = S.numbers_in(text)
    known = F.array(F.regexp_replace(S.rupees(F.col("amount_paise")), ",", ""))
    return t.select("txn_id", F.array_join(found, " ").alias("numbers"), F.size(F.array_except(found, known)).cast("long").alias("untraced"))


def daily_rollup(spark, d):
    return live.daily(spark.read.parquet(f"{d}/events.parquet"))


def idle_detection(spark, d):
    return live.idle(spark.read.parquet(f"{d}/events.parquet"))


def usage_by_provider(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    tokens = F.get_json_object("props", "$.k").try_cast("long")
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.max(tokens).alias("most"))


def category_confusion(spark, d):
    full = txns(spark, d).withColumn("scenario", F.when(F.col("truth_group").isNull(), "noise").otherwise("linked"))
    return _queue(spark, d).join(full.select("txn_id", "scenario"), "txn_id").groupBy("scenario", "category").agg(F.count("*").alias("n"))


def refund_group_merge(spark, d):
    members = written(T.with_refunds(written(_exact(spark, d), "members")), "merged")
    mixed = (F.min("amount_paise") < 0) & (F.max("amount_paise") > 0)
    return members.groupBy("group_id").agg(F.count("*").alias("member_count"), F.sum("amount_paise").alias("net_paise"), mixed.alias("merged")).where("merged").drop("merged")


def settlement_absorption(spark, d):
    t = written(_t(spark, d), "txns")
    found = written(T.settlement_members(t, written(M.exact_members(t), "members")), "settled")
    net = F.sum(F.when(F.col("source_kind") == "gateway", F.col("net_paise")))
    bank = F.sum(F.when(F.col("source_kind") == "bank", F.col("amount_paise")))
    return found.join(t, "txn_id").groupBy("group_id").agg(F.count("*").alias("member_count"), F.count_distinct("absorbed").alias("absorbed_groups"), (bank - net).alias("residual_paise"))


def score_by_tier(spark, d):
    full = written(txns(spark, d), "txns")
    t = match_view(full)
    one = written(M.exact_members(t), "members")
    rows = one.withColumn("tier", F.lit(1)).unionByName(M.cluster_members(M.unmatched(t, one)).withColumn("tier", F.lit(2)))
    return T.scores_by_tier(rows, full.select("txn_id", "truth_group"))


def fee_groups(spark, d):
    return T.fee_groups(written(_open(spark, d), "open"))


def fee_attach(spark, d):
    t = written(_t(spark, d), "txns")
    members = written(M.exact_members(t), "members")
    return T.fee_attached(M.unmatched(t, members), members)


def source_histogram(spark, d):
    return t1_exact_groups(spark, d).groupBy("n_sources").agg(F.count("*").alias("groups"))


def confidence_histogram(spark, d):
    return t2_clusters(spark, d).groupBy("confidence_pct").agg(F.count("*").alias("groups"))


def interpretation_counts(spark, d):
    return fee_interpretations(spark, d).groupBy("label").agg(F.count("*").alias("n"))


def open_by_batch(spark, d):
    return _queue(spark, d).groupBy("batch_id").agg(F.count("*").alias("n"), F.sum(F.abs("amount_paise")).alias("abs_paise"))


def most_open_batches(spark, d):
    return open_by_batch(spark, d).orderBy(F.desc("n"), "batch_id").limit(3)


def review_chunks(spark, d):
    return T.chunked(_queue(spark, d), ["batch_id"], [F.abs("amount_paise").desc(), "txn_id"]).select("batch_id", "txn_id", "chunk")


def redaction(spark, d):
    t = _t(spark, d)
    raw = F.create_map(F.lit("settlement_id"), F.coalesce("settlement_id", F.lit("")), F.lit("category"), F.col("source_kind"))
    text = F.when(F.col("source_kind") == "bank", F.concat(F.lit("synthetic:"), "external_ref")).otherwise(F.col("external_ref"))
    before = t.select("txn_id", text.alias("description"), raw.alias("raw"))
    after = before.select("txn_id", S.leaks(F.struct("description", "raw")).alias("leaked"), S.redacted_description(F.col("description")).alias("description"), S.redacted_raw(F.col("raw")).alias("raw"), S.scrubbed_claim(F.concat(F.lit("was SYNTHETIC:x1 "), "description")).alias("claim"))
    return after.select("txn_id", "leaked", "description", F.array_join(F.map_keys("raw"), ",").alias("raw_keys"), S.leaks(F.struct("description", "raw")).alias("leaks"), "claim")


QUERIES = {f.__name__: f for f in (normalize_refs, t1_exact_groups, t1_roles, t2_candidate_pairs, t2_clusters, t2_attach, fee_interpretations, refund_pairs_asof, settlement_by_id, subset_sum_settlement, unmatched_anti, duplicate_suspects, variance_queue, variances_by_category, open_top5, pair_scores, tier_funnel, recon_identity, rows_by_source, running_balance, latest_per_counterparty, ingest_idempotent, parse_money, extract_reference, figure_trace, daily_rollup, idle_detection, usage_by_provider, category_confusion, refund_group_merge, settlement_absorption, score_by_tier, fee_groups, fee_attach, source_histogram, confidence_histogram, interpretation_counts, open_by_batch, most_open_batches, review_chunks, redaction)}
