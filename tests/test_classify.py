import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import classify
from tallyloom.operators.shared import shared_folder


def asker(log):
    def ask(texts):
        with open(log, "a") as f:
            f.write(json.dumps(texts) + "\n")
        if any(t == "bad" for t in texts):
            raise ValueError("no answer")
        return [t.upper() for t in texts[:9]]

    return ask


def test_each_chunk_is_asked_once(spark, tmp_path):
    """A second run asks only the chunk that failed; short answers leave rows null; tails are balanced."""
    rows = [(f"r{i:03d}", "b" if i < 43 else "c", "bad" if i == 60 else f"t{i}") for i in range(63)] + [("x", None, None)]
    df, folder = spark.createDataFrame(rows, "id string, batch string, text string"), shared_folder(spark, "answers")
    run = lambda: sorted(map(tuple, classify.classified(df, ["batch"], [F.col("id")], "id", "text", asker(tmp_path / "log"), folder).collect()))
    got = run()
    first = (tmp_path / "log").read_text().splitlines()
    assert run() == got and len(got) == 64
    again = (tmp_path / "log").read_text().splitlines()[len(first) :]
    assert len(again) == 1 and "bad" in again[0] and len(first) == len(set(first)) == 8
    answers = {i: (a, e) for i, _, a, e in got}
    assert answers["x"] == ("", None) and answers["r060"] == (None, "ValueError: no answer") and answers["r000"] == ("T0", None) and answers["r009"] == (None, None)
    assert sorted(len(json.loads(t)) for t in first) == [1, 5, 8, 10, 10, 10, 10, 10]
    assert classify.classified(df.where("false"), ["batch"], [F.col("id")], "id", "text", asker(tmp_path / "log"), folder).count() == 0


def test_kept_answers_are_by_text(tmp_path):
    kept = classify.Answers(f"file://{tmp_path}")
    assert kept.get("ab12") is None
    kept.put("ab12", ["x", None])
    assert kept.get("ab12") == ["x", None]
    with pytest.raises(json.JSONDecodeError):
        (tmp_path / "cd").mkdir()
        (tmp_path / "cd" / "cd34.json").write_text("{")
        kept.get("cd34")
