"""A corpus from raw documents to packed training sequences: each stage is written and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.llm import common, jaccard, languages, packing, substrings


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no letters, or characters that no learned language puts together.

    A null or empty text has no letters and goes. Long texts are judged whole, repeated rows alike. Null languages teach
    nothing; an empty table stays empty, and one without any language rejects all. Other columns are kept as they are.
    """
    return languages.keep_identified(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, 5-word shingles alike at 0.75 or more over any number of steps, the smallest id stays.

    Null and empty texts, and those without words, link with nothing and stay. Of rows with one id and text one stays. Long
    texts are compared whole; an empty table stays empty. Other columns, whatever their names, are kept as they are.
    """
    return jaccard.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur more than once go; n_chars follows the text that is left.

    All of a passage's places lose it, those in one text too. A document that loses all of its words goes; one that loses
    nothing, a null, empty or wordless text too, stays as it is. Texts are read whole whatever their length, repeated rows
    are passages of each other; an empty table stays empty. Other columns, whatever their names, are kept as they are.
    """
    return substrings.with_rest_as_text(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row for each piece of a document.

    A null or empty text is its end token alone. Longer ones are cut; repeated rows are documents of their own. Of an empty
    table there are no pieces. The columns are those of pieces, so names of documents can't clash with them.
    """
    return packing.with_digest(packing.pack_documents(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", jaccard_join),
    ("substring dedup", substring_dedup),
    ("packing", packing_stage),
]

#: SQL has no language models and no tokenizer; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; the tables between stages are in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = common.staged(stage(spark, docs, sf_dir), f"stage{n}")
    return docs
