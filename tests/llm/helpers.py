"""Small tables that every operator must handle, and reference token ids."""

from functools import cache

from tokenizers import Tokenizer

from tallyloom.llm import tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t, None if i % 3 else "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in ("kept", "component_id", "score", "start", "fp", "word", "bucket")})
    return df


ODD = ["", None, " \n\t ", "a", "Same text here.", "Same  text\nhere.", "same text here.", "<|endoftext|> x", "it's é́ ŒUVRE…, 12.5!!", "word " * 30000, "Same text here."]


@cache
def tokenizer():
    return Tokenizer.from_file(tokens.vocabulary_path())


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids
