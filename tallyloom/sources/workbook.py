"""Workbooks as a sink: a file per book, streamed row by row in the tasks and put in place when all are written."""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import scalars as S
from ..operators.tiers import running

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Rows that a sheet can hold below its title block (the file format's limit less four).
SHEET_ROWS = 1_048_572
#: Titles of the sheets, and the rows above the header.
TITLES = ["Q1 Ledger", "Q2 Ledger"]
ABOVE = [["ACME COMMERCE PRIVATE LIMITED"], ["General Ledger Export — {title}"], ["Generated by FinBooks v4.2", "", "Page 1 of 1"]]
HEADER = ["Date", "Voucher No", "Particulars", "Amount"]


@dataclass
class Written(WriterCommitMessage):
    books: list  # (name, temporary file)


class Book:
    """One workbook, written to a stream; sheets come in order and hold text cells."""

    def __init__(self, sink):
        self.zip, self.sheet, self.titles = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED), None, []

    def start(self, title: str) -> None:
        self._end()
        self.titles.append(title)
        self.sheet, self.at = self.zip.open(f"xl/worksheets/sheet{len(self.titles)}.xml", "w", force_zip64=True), 0
        self.sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())

    def row(self, cells) -> None:
        self.at += 1
        clean = (re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", c or "") for c in cells)
        body = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in clean)
        self.sheet.write(f'<row r="{self.at}">{body}</row>'.encode())

    def _end(self) -> None:
        if self.sheet:
            self.sheet.write(b"</sheetData></worksheet>")
            self.sheet.close()

    def close(self) -> None:
        self._end()
        n = range(1, len(self.titles) + 1)
        part = lambda name, xml: self.zip.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{xml}')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        part("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in n) + "</Types>")
        part("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        part("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name={quoteattr(t)} sheetId="{i}" r:id="rId{i}"/>' for i, t in zip(n, self.titles)) + "</sheets></workbook>")
        part("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        self.zip.close()


class WorkbookWriter(DataSourceWriter):
    """Rows (book, sheet, cells), of which a task has a book's all, in order.

    A task writes its books under names of its own. When all tasks are done they are renamed, and only
    then; tasks that ran twice leave nothing behind, and a job that fails leaves the folder as it was.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.titles, self.above, self.header = (json.loads(options[k]) for k in ("titles", "above", "header"))
        self.temporary = f".writing-{uuid.uuid4().hex}"

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:/") else f"file://{self.path}")

    def write(self, rows):
        system, base = self._files()
        folder = f"{base}/{self.temporary}"
        system.create_dir(folder, recursive=True)
        done, name, book, out = [], None, None, None
        for row in rows:
            if book is None or row["book"] != name:
                self._finish(book, out)
                name = row["book"]
                done.append((name, f"{folder}/{uuid.uuid4().hex}"))
                out = system.open_output_stream(done[-1][1])
                book = Book(out)
            self._sheets(book, row["sheet"] + 1)
            book.row(row["cells"])
        self._finish(book, out)
        return Written(done)

    def _sheets(self, book, n: int) -> None:
        """Starts the sheets up to the n-th, also those without rows."""
        while len(book.titles) < n:
            at = len(book.titles)
            title = self.titles[at] if at < len(self.titles) else f"Sheet {at + 1}"
            book.start(title)
            for above in self.above:
                book.row([a.replace("{title}", title) for a in above])
            book.row(self.header)

    def _finish(self, book, out) -> None:
        if book:
            self._sheets(book, len(self.titles))
            book.close()
            out.close()

    def commit(self, messages):
        system, base = self._files()
        system.create_dir(base, recursive=True)
        made = [b for m in messages if m for b in m.books]
        if len({n for n, _ in made}) < len(made):
            raise ValueError("rows of one book came from several tasks")
        for name, temporary in made:
            system.move(temporary, f"{base}/{name}")
        if self.overwrite:
            from pyarrow import fs

            kept = {n for n, _ in made}
            for f in system.get_file_info(fs.FileSelector(base)):
                if f.base_name.endswith(".xlsx") and f.base_name not in kept:
                    system.delete_file(f.path)
        self._clear(system, base)

    def abort(self, messages):
        self._clear(*self._files())

    def _clear(self, system, base):
        from pyarrow import fs

        if system.get_file_info(f"{base}/{self.temporary}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/{self.temporary}")


class Workbooks(DataSource):
    """df.write.format("workbooks"); options path, titles, above and header (JSON lists). Append replaces books of the same name, overwrite removes others too."""

    @classmethod
    def name(cls):
        return "workbooks"

    def schema(self):
        return "book string, sheet int, cells array<string>"

    def writer(self, schema, overwrite):
        return WorkbookWriter(self.options, overwrite)


def ledger_books(t: DataFrame, most: int = SHEET_ROWS) -> DataFrame:
    """book, sheet, place, cells of records (batch_id, txn_id, txn_date, external_ref, amount_paise).

    A batch is a book of two sheets cut at the midpoint, in the order of date, reference and id; one that two
    sheets of `most` rows can't hold is several books of nearly equal size. Amounts are texts with DR or CR.
    """
    rows = t.select("batch_id", "txn_date", "external_ref", "txn_id", "amount_paise")
    dealt = running(rows, ["batch_id"], ["txn_date", "external_ref", "txn_id"], {"i": F.lit(1)})
    i, n = F.col("i") - 1, F.col("i_all")
    per = F.ceil(n / F.ceil(n / (2 * most)))
    dealt = dealt.withColumns({"part": F.floor(i / per), "at": i % per}).withColumn("own", F.least(per, n - F.col("part") * per))
    below = F.col("at") >= F.floor(F.col("own") / 2)
    ref = F.coalesce("external_ref", F.lit(""))
    day = F.coalesce(F.date_format("txn_date", "dd-MM-yyyy"), F.lit(""))
    cells = F.array(day, ref, F.concat(F.lit("Ledger entry "), ref), F.concat(S.rupees(F.col("amount_paise")), F.when(F.col("amount_paise") < 0, " DR").otherwise(" CR")))
    name = F.coalesce(F.concat(F.lit("ledger-"), F.url_encode("batch_id")), F.lit("ledger"))
    book = F.concat(name, F.when(F.col("part") > 0, F.concat(F.lit("."), (F.col("part") + 1).cast("string"))).otherwise(""), F.lit(".xlsx"))
    return dealt.select(book.alias("book"), below.cast("int").alias("sheet"), F.col("at").alias("place"), cells.alias("cells"))


def write_ledger_books(spark: SparkSession, t: DataFrame, path: str, mode: str = "overwrite", most: int = SHEET_ROWS) -> None:
    """Workbooks of all batches below path, each by one task that holds a row at a time."""
    spark.dataSource.register(Workbooks)
    rows = ledger_books(t, most).repartition("book").sortWithinPartitions("book", "sheet", "place").select("book", "sheet", "cells")
    rows.write.format("workbooks").options(titles=json.dumps(TITLES), above=json.dumps(ABOVE), header=json.dumps(HEADER)).mode(mode).save(path)
