"""A classifier asked chunk by chunk, whose answers are kept by what it was asked.

The classifier is the caller's: a function from a list of texts to a list of as many answers. It runs
in the tasks, on chunks of bounded size. A chunk's answers are written under the digest of its texts
before the task goes on, so a task that runs again, or another run over the same rows, reads them and asks
nothing; a chunk whose call fails keeps no answers and gives its rows null and the error.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiers import chunked

ANSWERED = "chunk_key string, digest string, ids array<string>, answers array<string>, error string"


class Answers:
    """Answers on the shared folder, a file per chunk."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.system, self.base = fs.FileSystem.from_uri(uri)

    def _path(self, digest: str) -> str:
        return f"{self.base}/{digest[:2]}/{digest}.json"

    def get(self, digest: str) -> list | None:
        try:
            with self.system.open_input_stream(self._path(digest)) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def put(self, digest: str, answers: list) -> None:
        path = self._path(digest)
        self.system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        temporary = f"{path}.{uuid.uuid4().hex}"
        with self.system.open_output_stream(temporary) as f:
            f.write(json.dumps(answers).encode())
        self.system.move(temporary, path)


def asked(chunks: DataFrame, classifier: Callable[[list[str]], list[str]], folder: str) -> DataFrame:
    """ANSWERED for each row of chunks (chunk_key, ids, texts)."""

    def ask(batches):
        import pandas as pd

        kept = Answers(folder)
        for pdf in batches:
            out = []
            for key, ids, texts in zip(pdf["chunk_key"], pdf["ids"], pdf["texts"]):
                texts = list(texts)
                digest, error = hashlib.sha256(json.dumps(texts).encode()).hexdigest(), None
                answers = kept.get(digest)
                if answers is None:
                    try:
                        answers = list(classifier(texts))[: len(texts)]
                        answers += [None] * (len(texts) - len(answers))
                        kept.put(digest, answers)
                    except Exception as failed:  # the caller's code: any failure is the chunk's result
                        answers, error = [None] * len(texts), f"{type(failed).__name__}: {failed}"
                out.append((key, digest, list(ids), answers, error))
            yield pd.DataFrame(out, columns=["chunk_key", "digest", "ids", "answers", "error"])

    return chunks.select("chunk_key", "ids", "texts").mapInPandas(ask, ANSWERED)


def classified(rows: DataFrame, keys: list[str], order: list, key: str, text: str, classifier: Callable[[list[str]], list[str]], folder: str, most: int = 10, least: int = 5) -> DataFrame:
    """key, chunk_key, answer, error of every row; rows of a chunk are asked together, by key; order deals them into chunks."""
    dealt = chunked(rows, keys, order, most, least)
    name = F.to_json(F.struct(*keys, "chunk")).alias("chunk_key")
    sorted_rows = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    chunks = dealt.groupBy(name).agg(sorted_rows.alias("rows")).select("chunk_key", F.col("rows.id").alias("ids"), F.col("rows.t").alias("texts"))
    found = asked(chunks, classifier, folder)
    return found.select("chunk_key", "error", F.explode(F.arrays_zip("ids", "answers")).alias("r")).select(F.col("r.ids").alias(key), "chunk_key", F.col("r.answers").alias("answer"), "error")
