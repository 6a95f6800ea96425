"""Bank CSV and ledger XLSX sources and sinks. Bad rows are kept apart with line number and reason."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.tiers import running
from . import split_csv

#: Rows of a workbook that a task holds at a time.
CHUNK = 10_000
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def parsed_rows(raw: DataFrame, *keep: str) -> DataFrame:
    """line, value_date, narration, debit, credit (texts) to amounts, dates and references, with a reason for bad rows; keep: other columns."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    debit, credit = S.paise_of(F.col("debit")), S.paise_of(F.col("credit"))
    amount = F.when(blank(F.col("debit")), credit).otherwise(-debit)
    day = S.parsed_date(F.col("value_date"))
    reason = F.when(blank(F.col("debit")) == blank(F.col("credit")), "exactly one of debit and credit").when(amount.isNull(), "amount").when(day.isNull() & ~blank(F.col("value_date")), "date")
    return raw.select(*keep, "line", amount.alias("amount_paise"), day.alias("txn_date"), S.extracted_ref(F.coalesce("narration", F.lit(""))).alias("external_ref"), reason.alias("reason"))


def read_bank_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of bank CSV files, many tasks per file; line numbers count within a file, and quoted fields may hold line ends."""
    return parsed_rows(split_csv.read(spark, path, ["value_date", "narration", "debit", "credit"]))


#: What banks write around a reference, and the balance before the first row.
NARRATIONS = ["NEFT/RAZORPAY/{ref}/SETTLEMENT", "IMPS/{ref}/RZPY/CR", "UPI/{ref}/PAYMENT/REF", "NEFT-RAZORPAY-{ref}-SETTLEMENT", "TRF FROM RAZORPAY REF {ref} DT {dd}/{mm}", "  MPS/{ref}/RAZORPAY SOFTWARE PVT LTD  ", "RTGS/{ref}/RAZORPAY/COLLECTION", "BY TRANSFER-NEFT*{ref}*RAZORPAY SOFTWARE"]
OPENING_PAISE = 500_000_000


def narration(key: Column, ref: Column, day: Column) -> Column:
    """One of NARRATIONS, by a digest of key, around ref; rows without a day name today's."""
    text = F.element_at(F.array(*map(F.lit, NARRATIONS)), (F.pmod(F.xxhash64(key), F.lit(len(NARRATIONS))) + 1).cast("int"))
    when = F.coalesce(day, F.current_date())
    for mark, value in (("{dd}", F.date_format(when, "dd")), ("{mm}", F.date_format(when, "MM")), ("{ref}", F.coalesce(ref, F.lit("")))):
        text = F.replace(text, F.lit(mark), value)
    return text


def write_bank_csv(t: DataFrame, path: str, opening: int = OPENING_PAISE) -> None:
    """Bank rows as CSV by batch and day, with narrations, Indian grouping and a running balance per batch."""
    rows = t.select("batch_id", "txn_date", "external_ref", "txn_id", "amount_paise")
    order = ["txn_date", "external_ref", "txn_id"]
    out = running(rows, ["batch_id"], order, {"balance": F.col("amount_paise")}).sort("batch_id", *order)
    money = lambda c: F.when(c, S.rupees(F.col("amount_paise"))).otherwise("")
    told = narration(F.col("txn_id"), F.col("external_ref"), F.col("txn_date"))
    columns = [F.date_format("txn_date", "dd/MM/yyyy").alias("value_date"), told.alias("narration"), money(F.col("amount_paise") < 0).alias("debit"), money(F.col("amount_paise") >= 0).alias("credit"), S.rupees(F.lit(opening) + F.col("balance")).alias("balance")]
    out.select(*columns).write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path, header=True)


def _elements(stream, tag: str):
    """The elements of a tag in turn, read from an XML stream; what was given out is not kept."""
    above = []
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            above.append(element)
            continue
        above.pop()
        if element.tag == tag:
            yield element
            if above:
                above[-1].clear()


def sheet_rows(data: bytes):
    """Yields (sheet number, line, cell texts) of a workbook; blank cells that the file leaves out are empty texts. Sheets are streamed, a row at a time."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as stream:
                shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in _elements(stream, f"{_NS}si")]
        sheets = [n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)]
        for number, name in enumerate(sorted(sheets, key=lambda n: (int(re.sub(r"\D", "", n.rsplit("/", 1)[1]) or 0), n))):
            line = 0
            with book.open(name) as stream:
                for row in _elements(stream, f"{_NS}row"):
                    line, cells = int(row.get("r") or line + 1), []
                    for c in row.iter(f"{_NS}c"):
                        place = column_of(c.get("r")) if c.get("r") else len(cells)
                        value = "".join(t.text or "" for t in c.iter() if t.tag in (f"{_NS}v", f"{_NS}t"))
                        cells += [""] * (place - len(cells))
                        cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                    yield number, line, cells


def column_of(reference: str) -> int:
    """Place of a cell reference: A1 is 0, AA7 is 26."""
    at = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        at = 26 * at + ord(letter) - 64
    return at - 1


def read_ledger_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all sheets of ledger workbooks. The header is the first of 15 rows with three of its four names."""
    wanted = ["date", "voucher no", "particulars", "amount"]
    names = ["sheet", "line", "day", "voucher", "particulars", "amount"]

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                header, out = {}, []
                for sheet, line, cells in sheet_rows(data):
                    low = [c.strip().lower() for c in cells]
                    if sheet not in header:
                        if line <= 15 and len(set(wanted) & set(low)) >= 3:
                            header[sheet] = [low.index(w) if w in low else None for w in wanted]
                    elif any(low):
                        out.append((sheet, line, *(cells[i] if i is not None and i < len(cells) else "" for i in header[sheet])))
                        if len(out) >= CHUNK:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                yield pd.DataFrame(out, columns=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    raw = files.mapInPandas(parse, "sheet int, line int, day string, voucher string, particulars string, amount string")
    amount, day = S.paise_of(F.col("amount")), S.parsed_date(F.col("day"))
    reason = F.when(amount.isNull(), "amount").when(day.isNull() & (F.trim("day") != ""), "date")
    return raw.select("sheet", "line", amount.alias("amount_paise"), day.alias("txn_date"), F.col("voucher").alias("external_ref"), reason.alias("reason"))


def ledger_workbook(rows: list[tuple[str, str, str, str]]) -> bytes:
    """A workbook of one sheet of text cells: three title rows, the header and the rows (a bounded report)."""
    lines = [["Ledger"], ["Generated"], [""], ["Date", "Voucher No", "Particulars", "Amount"], *rows]
    cell = lambda x: f'<c t="inlineStr"><is><t>{escape(x)}</t></is></c>'
    body = "".join(f'<row r="{i}">{"".join(map(cell, r))}</row>' for i, r in enumerate(lines, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_NS[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def new_rows(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """Fetched rows whose source and reference the batch doesn't hold yet; null references are equal."""
    held = stored.select("batch_id", "source_kind", "external_ref").distinct()
    on = (fetched.batch_id == held.batch_id) & (fetched.source_kind == held.source_kind) & fetched.external_ref.eqNullSafe(held.external_ref)
    return fetched.join(held, on, "left_anti")
