"""Licence scan by canonical digests of entire texts.

A text is normalised (case, copyright lines, punctuation, equivalent spellings, white space)
and its SHA-256 is hash-joined to the digests of known licences. The units are the whole text
of a document and each of its lines. Entire licence texts (ISC, MIT, and the files of
license_texts) are also found however they are wrapped, alone or inside a longer document: there
the words one after the other are compared, without copyright lines and list numbers. Null text is empty and matches nothing. Rows with the
same doc_id count as one document, whose matches each of them gets. The table of known digests has one row per known text.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'

#: Licence id and text. Statements that stand on a line, and short licences whole.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS + " AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + ", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]

#: Spellings that licence matching takes for one word, the second stands for both.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"),
    ("modelling", "modeling"), ("noncommercial", "non commercial"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("percent", "per cent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]

#: Rewriting steps in order: pattern and replacement, on lower-case text. Only letters and digits count, of any script.
STEPS = [
    (r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*", r" "),
    (r"[^\p{L}\p{N}]+", r" "),
    (r"\blicence", r"license"),
    (r"\b(sub)?licens(ed|e|ing)\b", r"license"),
    (r"\breleased\b", r"license"),
    (r"\bv(ersion)? ?([0-9])", r"\2"),
]


def normalised(text) -> F.Column:
    out = F.lower(text)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    return spelled(F.trim(out))


def spelled(text) -> F.Column:
    """Words of a normalised text in the spelling that stands for all."""
    table = F.create_map(*(F.lit(x) for pair in SPELLINGS for x in pair))
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


#: The same for entire texts, where a line may begin with the word copyright inside a sentence.
ENTIRE_STEPS = [
    (r"(^|\n)[^a-z0-9\n]*(copyright[ \t]+(\(c\)|©|[0-9<\[{])|\(c\)[ \t]|©)[^\n]*", r" "),
    (r"\ball rights reserved\b", r" "),
    (r"(^|\n)[ \t]*(\(?[0-9a-z]{1,2}[.)]|[*•–-])[ \t]+", r" "),
    *STEPS[1:],
]
#: A word that every entire text has, and the words of its beginning.
SIGN, BEGINNING = "warrant", 8


def entire(text) -> F.Column:
    out = F.lower(text)
    for pattern, to in ENTIRE_STEPS:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    return spelled(F.trim(out))


def entire_texts() -> list[tuple[str, str, list[str]]]:
    """Licence id, its text, and the texts that stand for it alone: with a title, or with what follows its terms."""
    folder = resources.files(__package__) / "license_texts"
    texts = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}
    three = texts["BSD-3-Clause"]
    texts["BSD-2-Clause"] = three[: three.index("3. Neither")] + three[three.index("THIS SOFTWARE") :]
    texts |= {k: t for k, t in KNOWN if len(t) > 300}
    titles = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License"]}
    titles |= {f"BSD-{n}-Clause": [f"BSD {n}-Clause License", f"The {n}-Clause BSD License"] for n in (2, 3)}
    rows = []
    for k, t in texts.items():
        end = t.find("END OF TERMS AND CONDITIONS")
        terms = t if end < 0 else t[:end]
        closed = [] if end < 0 else [terms + "END OF TERMS AND CONDITIONS"]
        rows.append((k, terms, [t, terms, *closed, *(f"{title}\n\n{t}" for title in titles.get(k, []))]))
    return rows


def catalogue(spark) -> tuple[list[tuple[str, int]], DataFrame]:
    """Of the entire texts: (beginning, length) of each, and the table digest, license, whole.

    Normalised, with a space at both ends. A beginning is the first BEGINNING words, where a text is
    looked for inside a longer one. The table has one row per text and per form that stands alone.
    """
    rows = spark.createDataFrame(entire_texts(), "license string, t string, alone array<string>")
    padded = lambda t: F.concat(F.lit(" "), entire(t), F.lit(" "))
    inside = rows.select("license", F.lit(False).alias("whole"), padded(F.col("t")).alias("t"))
    alone = rows.select("license", F.lit(True).alias("whole"), F.explode(F.transform("alone", padded)).alias("t"))
    texts = inside.unionByName(alone).select("license", "whole", F.sha2("t", 256).alias("digest"), F.length("t").alias("n"), F.substring_index("t", " ", BEGINNING + 1).alias("begins"))
    found = texts.collect()  # the catalogue is a fixed list
    table = spark.createDataFrame([(r.digest, r.license, r.whole) for r in found], "digest string, license string, whole boolean")
    return sorted({(r.begins + " ", r.n) for r in found if not r.whole}), table.distinct()


def places(text, begins: str) -> F.Column:
    """Where a beginning stands in a text, counted from 1."""
    pieces = F.split(text, begins)
    step = lambda at, piece: F.concat(at, F.array(F.element_at(at, -1) + F.length(piece) + len(begins)))
    ends = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.array(F.lit(1)), step)
    return F.transform(F.slice(ends, 2, F.size(pieces) - 1), lambda at: at - len(begins))


def entire_matches(docs: DataFrame) -> DataFrame:
    """doc_id, whole, license: entire texts that documents are (whole) or hold.

    Digests are looked up of each whole document and, wherever a known text's beginning stands in
    it, of as many characters as that text has.
    """
    begins, table = catalogue(docs.sparkSession)
    own = F.explode(F.array(F.concat(F.lit(" "), entire(F.col("text")), F.lit(" ")))).alias("own")  # worked out once per row
    rows = docs.where(F.lower("text").contains(SIGN)).select("doc_id", own)
    cut = lambda n: lambda at: F.substr(F.col("own"), at, F.lit(n))
    cuts = [F.transform(places(F.col("own"), b), cut(n)) for b, n in begins]
    tagged = F.transform(F.concat(F.array("own"), *cuts), lambda x, i: F.struct((i == 0).alias("whole"), x.alias("unit")))
    units = rows.select("doc_id", F.explode(F.array_distinct(tagged)).alias("u"))
    found = units.select("doc_id", "u.whole", F.sha2("u.unit", 256).alias("digest")).join(F.broadcast(table), ["digest", "whole"])
    return found.groupBy("doc_id", "license").agg(F.max("whole").alias("whole")).select("doc_id", "whole", "license")


#: Known texts have the word license or permission once normalised, and STEPS make license of these only.
SIGNS = ("licen", "released", "permission")


def may_match(text) -> F.Column:
    """Whether a text has a sign; without one its digest can't be a known one."""
    low = F.lower(text)
    return low.contains(SIGNS[0]) | low.contains(SIGNS[1]) | low.contains(SIGNS[2])


def known(spark) -> DataFrame:
    """license, digest: one row for each digest (its least licence id)."""
    rows = spark.createDataFrame(KNOWN, "license string, t string")
    return rows.groupBy(F.sha2(normalised(F.col("t")), 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, whole_license (of the entire text), licenses (of lines, and of entire texts inside a longer one; sorted, comma-separated), license_lines."""
    least = min(len(t) for _, t in KNOWN) // 2
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: (F.length(x) >= least) & may_match(x))
    unit = lambda whole: lambda x: F.struct(F.lit(whole).alias("whole"), x.alias("unit"))
    units = docs.where(may_match(text)).select("doc_id", F.explode(F.concat(F.array(unit(True)(text)), F.transform(lines, unit(False)))).alias("u"))
    digests = units.select("doc_id", "u.whole", F.sha2(normalised(F.col("u.unit")), 256).alias("digest"))
    matches = digests.join(F.broadcast(known(docs.sparkSession)), "digest").select("doc_id", "whole", "license", (~F.col("whole")).alias("line"))
    found = matches.unionByName(entire_matches(docs).withColumn("line", F.lit(False))).groupBy("doc_id").agg(
        F.max(F.when(F.col("whole"), F.col("license"))).alias("whole_license"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("licenses"),
        F.count_if("line").alias("license_lines"),
    )
    rows = docs.select("doc_id").join(found, "doc_id", "left")
    return rows.select("doc_id", "whole_license", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("license_lines", F.lit(0)).cast("long").alias("license_lines"))


def op3_licenses(spark, sf_dir):
    return scan(common.table(spark, sf_dir, "documents"))


def _sql_normalised(x: str) -> str:
    out = f"lower({x})"
    for pattern, to in STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    table = ", ".join(f"'{a}': '{b}'" for a, b in SPELLINGS)
    return f"array_to_string([coalesce((MAP {{{table}}})[w], w) for w in string_split(trim({out}), ' ')], ' ')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = f"""
WITH known AS (SELECT sha256({_sql_normalised("t")}) AS digest, min(license) AS license
               FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in KNOWN)}) AS v(license, t) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
found AS (SELECT doc_id, license FROM lines JOIN known ON digest = sha256({_sql_normalised("line")})),
of_lines AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) AS n FROM found GROUP BY doc_id)
SELECT d.doc_id, k.license AS whole_license, coalesce(licenses, '') AS licenses, coalesce(n, 0) AS license_lines
FROM documents d LEFT JOIN known k ON digest = sha256({_sql_normalised("coalesce(text, '')")}) LEFT JOIN of_lines o ON o.doc_id = d.doc_id
"""
