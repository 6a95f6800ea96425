"""Small merchant activity made from a table or stream of ticks, so that a stream of payments has something to find.

Each choice is a hash of the seed and the tick, so a replayed micro-batch makes the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pace:
    """Minutes to the next tick (a floor and what is added), chances, payments of a tick and their amounts in paise."""

    floor_minutes: int = 20
    more_minutes: int = 70
    quiet: float = 0.35
    least_payments: int = 1
    most_payments: int = 4
    least_amount: int = 30_000
    most_amount: int = 500_000
    refund: float = 0.2
    seed: int = 1


def activity(ticks: DataFrame, pace: Pace = Pace()) -> DataFrame:
    """Rows of each tick (tick, ts): kind (quiet, payment, refund), place, amount_paise, next_ts.

    A quiet tick has one row without an amount. Any other has its payments, in whole rupees, and,
    by chance, a refund of one of them (place is the payment's), in full or of a third. ticks may be a stream.
    """

    def chance(name: str, *keys: Column) -> Column:
        text = F.md5(F.concat_ws("/", F.lit(str(pace.seed)), F.lit(name), F.col("tick").cast("string"), *(k.cast("string") for k in keys)))
        return F.conv(F.left(text, F.lit(8)), 16, 10).cast("double") / 4294967296.0

    def amount(place: Column) -> Column:
        steps = (pace.most_amount - pace.least_amount) // 100 + 1
        return (pace.least_amount + 100 * F.floor(chance("amount", place) * steps)).cast("long")

    row = lambda kind, place, paise: F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("place"), paise.cast("long").alias("amount_paise"))
    n = pace.least_payments + F.floor(chance("payments") * (pace.most_payments - pace.least_payments + 1))
    made = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: row("payment", i, amount(i)))
    target = 1 + F.floor(chance("target") * n)
    back = F.when(chance("partial") < 0.5, F.floor(amount(target) / 3)).otherwise(amount(target))
    busy = F.when(chance("refund") < pace.refund, F.concat(made, F.array(row("refund", target, -back)))).otherwise(made)
    rows = F.when(chance("quiet") < pace.quiet, F.array(row("quiet", F.lit(0), F.lit(None)))).otherwise(busy)
    wait = pace.floor_minutes * 60 + F.floor(chance("wait") * (pace.more_minutes * 60 + 1))
    later = F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) + wait * 1_000_000).cast("long"))
    return ticks.select("tick", "ts", later.alias("next_ts"), F.explode(rows).alias("row")).select("tick", "ts", "next_ts", "row.*")
