"""Many small blocks against one plain reader."""

import csv
import io
import random

import pytest

from tallyloom.sources import split_csv

NAMES = ["narration", "debit", "absent"]


def whole(text):
    reader = csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""))
    header, out = [h.strip().lower() for h in next(reader, [])], []
    for row in reader:
        if any(x.strip() for x in row):
            fields = dict(zip(header, row))
            out.append((reader.line_num, *(fields.get(n) for n in NAMES)))
    return out


def file_of(seed, end):
    rng = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["Debit", " Narration ", "x"])
    for i in range(300):
        long = "\n".join(rng.choice(["", 'say ""', "a,b", "é" * 40]) for _ in range(rng.choice([1, 1, 1, 2, 5, 60])))
        writer.writerow(rng.choice([[i, long, "z"], [i, f'q"{i}"', ""], [], ["", "", ""], [i]]))
    return "﻿" * (seed % 2) + out.getvalue()


@pytest.mark.parametrize("end,size", [("\n", "300"), ("\r\n", "1000"), ("\n", "1000000")])
def test_blocks_against_a_plain_reader(spark, tmp_path, end, size):
    texts = {f"f{i}.csv": file_of(i, end) for i in range(3)} | {"empty.csv": "", "head.csv": "narration,debit\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = split_csv.read(spark, str(tmp_path), NAMES).collect()
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    own = lambda name: sorted(((r.line, r.narration, r.debit, r.absent) for r in got if r.file.endswith(name)), key=str)
    for name, text in texts.items():
        assert own(name) == sorted(whole(text), key=str), name
    assert size != "300" or tasks > 50
