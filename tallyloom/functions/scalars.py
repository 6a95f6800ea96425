"""Scalar functions of the reconciliation engine as column expressions (amounts are integer paise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes that may be stacked before a reference, and words of a bank narration that never are one.
PREFIXES = ["PAYMENT", "NEFT", "IMPS", "TXN", "REF", "PAY", "LED", "VCH", "JV"]
STOPWORDS = ["NEFT", "IMPS", "UPI", "RTGS", "TRF", "FROM", "TO", "BY", "TRANSFER", "RAZORPAY", "RZPY", "MPS", "SOFTWARE", "PVT", "LTD", "PRIVATE", "LIMITED", "SETTLEMENT", "PAYMENT", "COLLECTION", "REF", "REFNO", "DT", "DATE", "CR", "DR", "TXN", "NA"]


def full_ref(ref: Column) -> Column:
    """Upper case, letters and digits only, stacked prefixes and leading zeros off, but never to nothing."""
    kept = F.regexp_replace(F.upper(ref), r"[^\p{L}\p{N}]", "")
    bare = F.regexp_replace(kept, f"^(?:{'|'.join(PREFIXES)})+(?=.)", "")
    return F.regexp_replace(bare, "^0+(?=[^0])", "")


def last8(full: Column) -> Column:
    return F.right(full, F.lit(8))


def refs_link(a: Column, b: Column) -> Column:
    """Equal, equal in the last 8, or the shorter (3 or 4 characters) ends the longer."""
    small = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    large = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a == b) | (last8(a) == last8(b)) | (F.length(small).between(3, 4) & large.endswith(small))


#: Zeros of the decimal digits of scripts that a statement may hold; nine more digits follow each.
_ZEROS = "\u0660\u06f0\u0966\u09e6\u0a66\u0ae6\u0b66\u0be6\u0c66\u0ce6\u0d66\uff10"


def latin_digits(text: Column) -> Column:
    """Decimal digits of other scripts as 0 to 9."""
    return F.translate(text, "".join(chr(ord(z) + i) for z in _ZEROS for i in range(10)), "0123456789" * len(_ZEROS))


def paise_of(text: Column) -> Column:
    """Paise of a rupee text; null if it can't be read. Brackets, a leading minus or a final DR make it negative.

    Digits of any script count; all that follows the first point is the fraction, cut to two digits.
    """
    bare = F.trim(F.regexp_replace(F.trim(latin_digits(text)), r"(?i)₹|\bRs\.?|\bINR\b", ""))
    bracket = bare.rlike(r"^\(.*\)$")
    inner = F.when(bracket, F.regexp_replace(bare, r"^\(|\)$", "")).otherwise(bare)
    debit = inner.rlike(r"(?i)\bDR\s*$")
    digits = F.regexp_replace(F.regexp_replace(inner, r"(?i)\b(CR|DR)\s*$", ""), r"[^0-9.\-]", "")
    negative = bracket | debit | digits.startswith("-")
    parts = F.split(F.regexp_replace(digits, "-", ""), r"\.")
    cents = F.rpad(F.left(F.array_join(F.slice(parts, 2, 1 << 20), ""), F.lit(2)), 2, "0")
    whole = F.when(parts[0] == "", "0").otherwise(parts[0])
    value = whole.try_cast("bigint") * 100 + cents.try_cast("bigint")
    return F.when(F.regexp_replace(digits, r"[^0-9]", "") == "", None).when(negative, -value).otherwise(value)


def rupees(paise: Column) -> Column:
    """Indian grouping without sign: 123456789 becomes 12,34,567.89."""
    size = F.abs(paise)
    whole = F.floor(size / 100).cast("string")
    head = F.regexp_replace(F.left(whole, F.length(whole) - 3), r"(\d)(?=(\d\d)+$)", "$1,")
    grouped = F.when(F.length(whole) <= 3, whole).otherwise(F.concat(head, F.lit(","), F.right(whole, F.lit(3))))
    return F.concat(grouped, F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def parsed_date(text: Column) -> Column:
    """dd/mm/yyyy, dd-mm-yyyy, ISO, or two-digit years (69 and more are 19xx); null if none fits."""
    t = F.trim(text)
    short = F.regexp_extract(t, r"^\d{1,2}[/-]\d{1,2}[/-](\d{2})$", 1)
    century = F.when(short.try_cast("int") >= 69, "19").otherwise("20")
    whole = F.when(short != "", F.concat(F.left(t, F.length(t) - 2), century, short)).otherwise(t)
    slashes = F.regexp_replace(whole, r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$1/$2/$3")
    return F.coalesce(F.try_to_date(slashes, "d/M/yyyy"), F.try_to_date(whole, "yyyy-MM-dd"))


def extracted_ref(narration: Column) -> Column:
    """The longest token that is no stopword and not one or two digits; the first of equals; null if none."""
    words = F.split(narration, r"[\s/\-*|:;,#()\[\]]+")
    stop = F.array(*map(F.lit, STOPWORDS))
    good = F.filter(words, lambda w: (w != "") & ~F.array_contains(stop, F.upper(w)) & ~w.rlike(r"^\d{1,2}$"))
    ranked = F.transform(good, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w")))
    return F.array_min(ranked)["w"]


def numbers_in(text: Column) -> Column:
    """Number tokens of a text (not parts of words), commas removed, dates left out."""
    bare = F.regexp_replace(text, r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}", " ")
    found = F.regexp_extract_all(bare, F.lit(r"(?<![0-9A-Za-z])\d[\d,]*(?:\.\d+)?(?![0-9A-Za-z])"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, ",", ""))


def interpretations(amount: Column, gross: Column, fee: Column, tax: Column) -> Column:
    """The tightest form of a gateway amount that explains amount: whole, less the fee, less fee and tax (all exact), or the latter within 2 paise.

    Forms that need a fee or tax which is null are left out.
    """
    form = lambda label, value, tolerance, i: F.when(F.abs(amount - value) <= tolerance, F.struct(F.abs(amount - value).alias("off"), F.lit(i).alias("i"), F.lit(label).alias("label")))
    both = gross - fee - tax
    forms = F.array(form("gross", gross, 0, 0), form("gross_minus_fee", gross - fee, 0, 1), form("gross_minus_fee_minus_tax", both, 0, 2), form("gross_minus_fee_plus_tax", both, 2, 3))
    return F.array_min(F.filter(forms, lambda x: x.isNotNull()))["label"]


#: Keys of a record's raw fields and marks of a text that give the answer key away.
LEAK_KEYS = ["synthetic", "category", "truth_group"]
LEAK_MARKS = ["synthetic:", "truth_group"]


def redacted_description(text: Column) -> Column:
    """Empty where the text names the scenario; null is empty."""
    return F.when(F.coalesce(text, F.lit("")).startswith("synthetic:"), "").otherwise(F.coalesce(text, F.lit("")))


def redacted_raw(raw: Column) -> Column:
    """A map without the keys of the answer key; null stays null."""
    return F.map_filter(raw, lambda k, _: ~k.isin(LEAK_KEYS))


def leaks(record: Column) -> Column:
    """Whether a record, as it would be sent, holds a mark of the answer key anywhere."""
    text = F.to_json(record)
    return text.contains(LEAK_MARKS[0]) | text.contains(LEAK_MARKS[1])


def no_leak(record: Column) -> Column:
    """True; a record that holds a mark of the answer key fails the query that evaluates this."""
    return F.assert_true(~leaks(record), F.lit("a record to be sent holds a mark of the answer key")).isNull()


def scrubbed_claim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)synthetic:\w*", "")
