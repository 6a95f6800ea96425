"""Records of three sources made from a table of events by nine scenarios in given shares, with the answer key.

Every choice is a hash of the seed and the event (or group), so the same events give the same
records wherever the tasks run. Scenarios are dealt in exact numbers per batch: each but the
first gets its share of the batch's events, rounded half up, and the first gets the rest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import written
from ..operators.tiers import running

#: The scenarios' shares.
WEIGHTS = {
    "clean_3way": 0.263,
    "fee_tax_split": 0.13,
    "value_date_drift": 0.065,
    "ref_format_drift": 0.075,
    "many_to_one": 0.075,
    "refund_chargeback": 0.027,
    "missing_one_source": 0.027,
    "duplicate_one_source": 0.018,
    "genuine_noise": 0.32,
}
SOURCES = ("gateway", "bank", "ledger")


@dataclass(frozen=True)
class Mix:
    """How records are made. Amounts in paise; a settlement's payments are captured within window_days before its anchor."""

    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    seed: int = 20260826
    least_amount: int = 100
    most_amount: int = 5_000_000
    log_median: float = math.log(5000)
    log_spread: float = 1.2
    spread_days: int = 45
    least_payments: int = 5
    most_payments: int = 12
    explicit_share: float = 0.7
    window_days: int = 2

    def __post_init__(self):
        if set(self.weights) != set(WEIGHTS) or min(self.weights.values()) < 0 or abs(sum(self.weights.values()) - 1) >= 1e-9:
            raise ValueError(f"shares of {', '.join(WEIGHTS)} must be given, not negative and add up to 1: {self.weights}")
        if not 1 <= self.least_payments <= self.most_payments:
            raise ValueError("a settlement has at least one payment, and at most no fewer")

    @classmethod
    def of(cls, options: dict[str, str]) -> Mix:
        """From texts, as a configuration gives them: the fields' names, and weight.<scenario>. Unknown names are an error."""
        own = {f.name: type(getattr(cls(), f.name)) for f in fields(cls) if f.name != "weights"}
        weights = {k.removeprefix("weight."): float(v) for k, v in options.items() if k.startswith("weight.")}
        rest = {k: v for k, v in options.items() if not k.startswith("weight.")}
        if unknown := {*rest} - {*own} | {*weights} - {*WEIGHTS}:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return replace(cls(weights=WEIGHTS | weights), **{k: own[k](v) for k, v in rest.items()})


def uniform(mix: Mix, name: str, *keys: Column) -> Column:
    """A number from 0 to below 1 that a hash of seed, name and keys gives."""
    text = F.md5(F.concat_ws("/", F.lit(str(mix.seed)), F.lit(name), *(k.cast("string") for k in keys)))
    return F.conv(F.left(text, F.lit(8)), 16, 10).cast("double") / 4294967296.0


def below(mix: Mix, n: int, name: str, *keys: Column) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(uniform(mix, name, *keys) * n).cast("int")


def clipped_lognormal(mix: Mix, *keys: Column) -> Column:
    """A whole amount between the bounds; before it is clipped, its logarithm is normally distributed."""
    u, v = 1 - uniform(mix, "size", *keys), uniform(mix, "angle", *keys)
    drawn = F.exp(F.lit(mix.log_median) + mix.log_spread * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v))
    return F.round(F.least(F.greatest(drawn, F.lit(mix.least_amount)), F.lit(mix.most_amount))).cast("long")


def _group(mix: Mix, at: Column):
    """Number and start of the settlement that has the payment of place `at`: sizes go up from the least to the most, over and over."""
    sizes = list(range(mix.least_payments, mix.most_payments + 1))
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    turn, inside = F.floor(at / ends[-1]), at % ends[-1]
    number, start = sum(((inside >= e).cast("long") for e in ends), F.lit(0)), F.lit(0)
    for e in ends:
        start = F.when(inside >= e, F.lit(e)).otherwise(start)
    return turn * len(sizes) + number, turn * ends[-1] + start


def dealt(events: DataFrame, mix: Mix) -> DataFrame:
    """events (event_id, batch_id, first_day) with scenario, and for payments of settlements their group's number in the batch."""
    key = F.md5(F.concat_ws("/", F.lit(str(mix.seed)), F.col("event_id").cast("string")))
    rows = running(events.withColumn("__key", key), ["batch_id"], ["__key", "event_id"], {"__at": F.lit(1)})
    at, whole = F.col("__at") - 1, F.col("__at_all")
    start, first, scenario, inside, sizes = F.lit(0).cast("long"), None, None, None, {}
    for name in list(WEIGHTS)[1:]:
        sizes[name] = F.floor(whole * mix.weights[name] + 0.5).cast("long")
        end = start + sizes[name]
        here = at < end
        scenario = F.when(here, name) if scenario is None else scenario.when(here, name)
        inside = F.when(here, at - start) if inside is None else inside.when(here, at - start)
        start = end
    rows = rows.withColumns({"scenario": scenario.otherwise(next(iter(WEIGHTS))), "__in": inside.otherwise(at - start), "__many": sizes["many_to_one"]})
    number = _group(mix, F.col("__in"))[0]
    last, begun = _group(mix, F.col("__many") - 1)
    short = (F.col("__many") - begun < mix.least_payments) & (last > 0) & (number == last)
    group = F.when(F.col("scenario") == "many_to_one", number - short.cast("long"))
    return rows.select("event_id", "batch_id", "first_day", "scenario", group.alias("settlement"))


def _leg(source: str, ref: Column, amount: Column, day: Column, copy: str = "", fee=None, tax=None, value_day=None) -> Column:
    null = F.lit(None).cast("long")
    net = null if fee is None else amount - fee - tax
    return F.struct(F.lit(copy).alias("copy"), F.lit(source).alias("source_kind"), ref.alias("external_ref"), amount.cast("long").alias("amount_paise"), (null if fee is None else fee).alias("fee_paise"), (null if tax is None else tax).alias("tax_paise"), net.alias("net_paise"), day.alias("txn_date"), (day if value_day is None else value_day).alias("value_date"))


def generated(events: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Records (txn_id, batch_id, the fields of a leg, settlement_id, scenario, truth_group, is_noise) of events (event_id, batch_id, first_day)."""
    i, day0 = F.col("event_id"), F.col("first_day")
    rows = written(dealt(events, mix), "events")
    owned = lambda name, n: below(mix, n, name, F.col("batch_id"), F.col("settlement"))
    rows = rows.withColumns({
        "gross": clipped_lognormal(mix, i),
        "token": F.left(F.md5(F.concat_ws("/", F.lit(str(mix.seed)), F.lit("token"), i.cast("string"))), F.lit(14)),
        "day": F.date_add(day0, below(mix, mix.spread_days, "day", i)),
        "anchor": F.date_add(day0, owned("anchor", mix.spread_days - 1)),
    }).withColumn("fee", F.floor((F.col("gross") * 2 + 50) / 100).cast("long")).withColumn("tax", F.floor((F.col("fee") * 18 + 50) / 100).cast("long"))
    gross, fee, tax, token, day = (F.col(c) for c in ("gross", "fee", "tax", "token", "day"))
    three = [_leg(s, token, gross, day) for s in SOURCES]
    drift = F.date_add(day, 1 + below(mix, 3, "drift", i))
    short = F.left(token, F.lit(5))
    part = F.when(uniform(mix, "full", i) < 0.5, gross).otherwise(F.round(gross * (0.2 + 0.6 * uniform(mix, "part", i))).cast("long"))
    back, one = F.date_add(day, 1 + below(mix, 10, "back", i)), below(mix, 3, "one", i)
    paid = F.date_sub(F.col("anchor"), below(mix, mix.window_days + 1, "paid", i))
    legs = {
        "clean_3way": F.array(*three),
        "fee_tax_split": F.array(_leg("gateway", token, gross, day, fee=fee, tax=tax), _leg("bank", token, gross - fee - tax, day), three[2]),
        "value_date_drift": F.array(three[0], three[2], _leg("bank", token, gross, drift, value_day=day)),
        "ref_format_drift": F.array(_leg("gateway", F.concat(F.lit("pay_"), short), gross, day), _leg("bank", F.concat(F.lit("PAY"), F.upper(short)), gross, day), _leg("ledger", F.right(short, F.lit(3)), gross, day)),
        "many_to_one": F.array(_leg("gateway", F.concat(F.lit("pay_"), token), gross, paid, fee=fee, tax=tax), _leg("ledger", F.concat(F.lit("led_"), token), gross, paid)),
        "refund_chargeback": F.array(*three, *(_leg(s, F.concat(F.lit("rfnd_"), token), -part, back, "r") for s in SOURCES)),
        "missing_one_source": F.filter(F.array(*three), lambda x: x.source_kind != F.element_at(F.array(*map(F.lit, SOURCES)), one + 1)),
        "duplicate_one_source": F.array(*three, *(F.when(one == n, _leg(s, token, gross, day, "b")) for n, s in enumerate(SOURCES))),
        "genuine_noise": F.filter(F.array(*three), lambda x: x.source_kind == F.element_at(F.array(*map(F.lit, SOURCES)), one + 1)),
    }
    made = None
    for name, own in legs.items():
        made = F.when(F.col("scenario") == name, own) if made is None else made.when(F.col("scenario") == name, own)
    explicit = (F.col("scenario") == "many_to_one") & (uniform(mix, "explicit", F.col("batch_id"), F.col("settlement")) < mix.explicit_share)
    name = F.concat_ws("_", F.lit("setl"), "batch_id", F.col("settlement").cast("string"))
    truth = F.when(F.col("scenario") == "many_to_one", F.concat(F.lit("tg_"), name)).when(F.col("scenario") != "genuine_noise", F.concat(F.lit("tg_"), i.cast("string")))
    out = rows.select("batch_id", "event_id", "settlement", "scenario", F.when(explicit, name).alias("settlement_id"), truth.alias("truth_group"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("leg"))
    out = written(out.select("*", "leg.*").drop("leg"), "legs")
    single = out.withColumn("txn_id", F.concat("source_kind", F.lit("_"), F.col("event_id").cast("string"), "copy"))
    pay = out.where("scenario = 'many_to_one' and source_kind = 'gateway'").groupBy("batch_id", "settlement", "scenario", "settlement_id", "truth_group")
    credit = pay.agg(F.sum("net_paise").alias("amount_paise"), F.date_add(F.max("txn_date"), 1).alias("txn_date"))
    # a credit is named by its settlement; only the explicit ones say so on the payments too
    credit = credit.select("*", F.concat(F.lit("credit_"), name).alias("txn_id"), F.lit("bank").alias("source_kind"), F.coalesce("settlement_id", F.concat(F.lit("stl_"), F.left(F.md5(name), F.lit(14)))).alias("external_ref"), F.col("txn_date").alias("value_date"))
    both = single.unionByName(credit, allowMissingColumns=True)
    return both.select("txn_id", "batch_id", "source_kind", "external_ref", "amount_paise", "fee_paise", "tax_paise", "net_paise", "txn_date", "value_date", "settlement_id", "scenario", "truth_group", (F.col("scenario") == "genuine_noise").alias("is_noise"))


def verified(rows: DataFrame, events: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per batch and scenario the records and truth groups of generated rows.

    The query fails if a record that isn't noise has no truth group, noise has one, or a scenario's
    groups are not as many as its events (or settlements) make.
    """
    given = dealt(events, mix).groupBy("batch_id", "scenario").agg(F.count("*").alias("events"), F.count_distinct("settlement").alias("settlements"))
    made = rows.groupBy("batch_id", "scenario").agg(F.count("*").alias("records"), F.count_distinct("truth_group").alias("groups"), F.count_if(F.col("is_noise") != F.col("truth_group").isNull()).alias("wrong"))
    expected = F.when(F.col("scenario") == "many_to_one", F.col("settlements")).when(F.col("scenario") == "genuine_noise", 0).otherwise(F.col("events"))
    both = given.join(made, ["batch_id", "scenario"], "full")
    sound = F.coalesce((F.col("wrong") == 0) & (F.col("groups") == expected), F.lit(False))
    return both.where(F.assert_true(sound, F.lit("generated records don't agree with their answer key")).isNull()).select("batch_id", "scenario", "events", "records", "groups")
