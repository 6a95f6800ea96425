"""A corpus pipeline: toxicity, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes each stage's rows in the shared folder and reads them again.

Null texts are empty. Rows go by doc_id and text, so two texts of one doc_id fare apart, and of
repeated rows one stays. Rows without doc_id go if a copy has one; otherwise one of each text stays.
Other columns, whatever their names, are handed through up to the last stage. Empty tables give no
rows; without labels nothing counts as toxic.
"""

from __future__ import annotations

from tallyloom.llm import common, exact_dedup, near_dedup, packing, tokens, toxicity


def drop_toxic(spark, docs, sf_dir):
    return toxicity.survivors(docs, common.table(spark, sf_dir, "labels"))


def drop_copies(spark, docs, sf_dir):
    return exact_dedup.survivors(docs)


def drop_near_copies(spark, docs, sf_dir):
    return near_dedup.survivors(docs)


def pack(spark, docs, sf_dir):
    return packing.pack_documents(docs, tokens.vocabulary_path(), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack)]

#: The classifier and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
