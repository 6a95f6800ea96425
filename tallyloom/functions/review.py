"""Columns of the review side: labels, model answers, verdicts, figures and display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S

#: Scenario names that a text must not quote, and the categories that read a scenario rightly.
VOCABULARY = ["synthetic", "genuine_noise", "fee_tax_split", "value_date_drift", "ref_format_drift", "refund_chargeback", "missing_one_source", "duplicate_one_source", "clean_3way"]
ACCEPTABLE = {
    "fee_tax_split": ["gateway_fee", "gst_on_fee"],
    "value_date_drift": ["timing_difference"],
    "many_to_one": ["partial_settlement", "timing_difference"],
    "refund_chargeback": ["refund_offset", "chargeback"],
    "missing_one_source": ["missing_source_record"],
    "duplicate_one_source": ["duplicate_entry"],
    "ref_format_drift": ["missing_source_record", "unexplained"],
    "genuine_noise": ["missing_source_record", "unexplained"],
    "clean_3way": ["unexplained", "missing_source_record"],
}
#: What a model may answer, and the most confidence of an unexplained row.
CATEGORIES = ["gateway_fee", "gst_on_fee", "refund_offset", "chargeback", "timing_difference", "duplicate_entry", "missing_source_record", "fx_or_rounding", "partial_settlement", "unexplained"]
ACTIONS = ["auto_accept", "book_to_fee_account", "await_next_settlement", "request_bank_advice", "flag_for_human", "write_off"]
CEILING = 0.49
#: US dollars per token by provider (prompt, completion).
RATES = [("nvidia", 0.00000008, 0.0000002), ("byteplus", 0.000000065, 0.00000018), ("openrouter", 0.0, 0.0)]


def scenario(description: Column, raw_category: Column) -> Column:
    """The label of a description of the form synthetic:label, else the raw category; null if there is neither."""
    own = F.regexp_extract(F.coalesce(description, F.lit("")), r"^synthetic:(\w*)$", 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(raw_category, F.lit("")))


def category_of(description: Column) -> Column:
    """What follows the first colon, else a question mark."""
    return F.when(description.contains(":"), F.regexp_extract(description, r"^[^:]*:(.*)$", 1)).otherwise("?")


def quotes_label(*texts: Column) -> Column:
    """Whether one of the texts names a scenario, in whatever case."""
    found = [F.coalesce(t, F.lit("")).rlike("(?i)" + "|".join(VOCABULARY)) for t in texts]
    return F.greatest(*found) if len(found) > 1 else found[0]


def unfenced(text: Column) -> Column:
    """A model's text without code fences at its ends."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*|\s*```$", ""))


def answer(text: Column) -> Column:
    """A model's JSON answer as (category, suggested_action, confidence, explanation, subcategory, well_formed).

    A field that is missing, of a wrong type or not in its list makes the row unexplained, with
    confidence 0 and a flag for a human. Confidence is clamped to 0..1, and to CEILING if unexplained.
    """
    json = F.try_parse_json(unfenced(text))
    string = lambda k: F.when(F.schema_of_variant(F.try_variant_get(json, f"$.{k}", "variant")) == "STRING", F.try_variant_get(json, f"$.{k}", "string"))
    number = F.when(F.schema_of_variant(F.try_variant_get(json, "$.confidence", "variant")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(json, "$.confidence", "double"))
    category, action, note, kind = string("category"), string("suggested_action"), F.trim(string("explanation")), string("subcategory")
    good = category.isin(CATEGORIES) & action.isin(ACTIONS) & number.isNotNull() & (note != "") & kind.isNotNull()
    good = F.coalesce(good, F.lit(False))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))
    sure = F.when(category == "unexplained", F.least(clamped, F.lit(CEILING))).otherwise(clamped)
    missing = F.lit("Model response for this variance was missing or did not match the required format.")
    return F.struct(
        F.when(good, category).otherwise("unexplained").alias("category"),
        F.when(good, action).otherwise("flag_for_human").alias("suggested_action"),
        F.when(good, sure).otherwise(0.0).alias("confidence"),
        F.coalesce(F.nullif(note, F.lit("")), missing).alias("explanation"),
        F.when(good, kind).otherwise("malformed_model_response").alias("subcategory"),
        good.alias("well_formed"),
    )


def verdict(text: Column) -> Column:
    """A critic's JSON as (grounded, amounts_correct, action_appropriate, passed, malformed): only a JSON true counts."""
    json = F.try_parse_json(unfenced(text))
    names = ["grounded", "amounts_correct", "action_appropriate"]
    kinds = [F.coalesce(F.schema_of_variant(F.try_variant_get(json, f"$.{n}", "variant")), F.lit("VOID")) for n in names]
    flags = [F.when(k == "BOOLEAN", F.coalesce(F.try_variant_get(json, f"$.{n}", "boolean"), F.lit(False))).otherwise(False) for n, k in zip(names, kinds)]
    malformed = ~((kinds[0] == "BOOLEAN") & (kinds[1] == "BOOLEAN") & (kinds[2] == "BOOLEAN"))
    return F.struct(*(f.alias(n) for f, n in zip(flags, names)), (flags[0] & flags[1] & flags[2]).alias("passed"), malformed.alias("malformed"))


def figures(text: Column) -> Column:
    """Number tokens of a text as written; dates are left out."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\d{4}-\d{2}-\d{2}|\d{2}[/-]\d{2}[/-]\d{2,4}", " ")
    return F.regexp_extract_all(bare, F.lit(r"(?<![0-9A-Za-z])\d[\d,]*(?:\.\d+)?(?![0-9A-Za-z])"), F.lit(0))


def figure_value(token: Column) -> Column:
    return F.regexp_replace(token, ",", "").try_cast("decimal(30,6)")


def bare_year(token: Column) -> Column:
    return token.rlike(r"^(19\d\d|20\d\d|2100)$")


def pairwise(amounts: Column) -> Column:
    """All sums and absolute differences of two amounts of an array, each with itself too."""
    return F.array_distinct(F.flatten(F.transform(amounts, lambda a: F.flatten(F.transform(amounts, lambda b: F.array(a + b, F.abs(a - b)))))))


def amount_universe(amounts: Column, totals: Column) -> Column:
    """What an explanation may cite, as paise and as rupees: amounts of the records, their sums and differences, and totals."""
    own = F.filter(amounts, lambda x: x.isNotNull())
    whole = F.array_distinct(F.concat(own, pairwise(own), F.filter(totals, lambda x: x.isNotNull())))
    signed = F.array_distinct(F.concat(whole, F.transform(whole, F.abs)))
    paise = F.transform(signed, lambda x: x.cast("decimal(30,6)"))
    return F.array_distinct(F.concat(paise, F.transform(signed, lambda x: (x.cast("decimal(24,2)") / 100).cast("decimal(30,6)"))))


def cited(text: Column, universe: Column) -> Column:
    """Figures of a text that look like money: with a comma or point, or 100 and more; bare years only if they are amounts."""
    money = lambda t: t.contains(",") | t.contains(".") | (figure_value(t) >= 100)
    return F.filter(figures(text), lambda t: money(t) & ~(bare_year(t) & ~F.array_contains(universe, figure_value(t))))


def untraced(tokens: Column, universe: Column) -> Column:
    return F.filter(tokens, lambda t: ~F.array_contains(universe, figure_value(t)))


def ungrounded(reply: Column, context: Column) -> Column:
    """Figures of a reply (bare years aside) that the context doesn't have by value."""
    known = F.transform(figures(context), figure_value)
    return F.filter(figures(reply), lambda t: ~bare_year(t) & ~F.array_contains(known, figure_value(t)))


def compact_rupees(paise: Column) -> Column:
    """Crores from 1e7 and lakhs from 1e5 rupees, with two decimals; below, the rupees with two decimals."""
    size = F.abs(paise)
    scaled = lambda unit, name: F.concat(F.format_string("%d.%02d", F.floor(size / unit), F.floor(size % unit / (unit // 100))), F.lit(name))
    text = F.when(size >= 10**9, scaled(10**9, " Cr")).when(size >= 10**7, scaled(10**7, " L")).otherwise(scaled(100, ""))
    return F.concat(F.when(paise < 0, "-").otherwise(""), text)


def humanised(name: Column) -> Column:
    """Underscores to spaces, with a capital first letter."""
    spaced = F.regexp_replace(name, "_", " ")
    return F.concat(F.upper(F.left(spaced, F.lit(1))), F.substring(spaced, 2, 1 << 20))


def breakdown(gross: Column, fee: Column, tax: Column, amount: Column, label: Column) -> Column:
    """Fee and tax of the deduction that the label names, and what they leave: fee + tax + residual is the variance."""
    zero = F.lit(0).cast("long")
    fees = F.when(label == "gross", zero).otherwise(F.coalesce(fee, zero))
    taxes = F.when(label.isin("gross", "gross_minus_fee"), zero).otherwise(F.coalesce(tax, zero))
    return F.struct(fees.alias("fee_paise"), taxes.alias("tax_paise"), (gross - amount - fees - taxes).alias("residual_paise"), (gross - amount).alias("variance_paise"))


def money(paise: Column) -> Column:
    """Rupees and paise side by side, with the sign in front; null stays null."""
    return F.concat(F.when(paise < 0, "-").otherwise(""), F.lit("Rs "), S.rupees(paise), F.lit(" ("), paise.cast("string"), F.lit(" paise)"))


def ratio_with_percent(value: Column) -> Column:
    """0.9748 as 0.9748 (97.48%); null is not recorded."""
    plain = F.regexp_replace(F.regexp_replace(value.cast("decimal(20,10)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.coalesce(F.concat(plain, F.lit(" ("), F.format_string("%.2f", value.cast("double") * 100), F.lit("%)")), F.lit("not recorded"))


def figure_key(text: Column) -> Column:
    """Digits, sign and point alone."""
    return F.regexp_replace(text, r"[^0-9.-]", "")


def quoted(fact: Column, answer: Column) -> Column:
    """Whether an answer quotes a fact's figure, however both are written."""
    return F.coalesce((F.length(figure_key(fact)) > 0) & figure_key(answer).contains(figure_key(fact)), F.lit(False))
