"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads
what it wrote.  All but the last return the columns of ``documents``, and keep further
columns of any name.  Null, empty and letterless texts go in the first stage.  Repeated
rows are copies of each other: their lines stay in the first row only, so the others go
in the second stage.  Nulls in other columns stay as they are; a null id sorts last where
the first of several documents stays.  Empty tables pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaweave.llm import jaccard, langid, linededup, packing, pii
from chromaweave.llm.store import materialise, small_batches, unused

#: Calibrated probability below which a document's language counts as unknown.
LEAST_SCORE = 0.5


def with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``documents`` with the length of the text as it is now."""
    return docs.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels know; null, letterless and undecided texts go."""
    small_batches(spark)
    model = langid.fit(docs)
    label, score = unused("_lang", docs.columns), unused("_score", docs.columns)
    found = langid.predict(docs, model, label=label, score=score)
    return found.where((F.col(label) != langid.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which only blanks are left go."""
    small_batches(spark)
    found = linededup.dedup_lines(docs)
    return with_text(found, docs.columns).where(~F.coalesce(F.col("text").rlike(r"^\s*$"), F.lit(False)))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    small_batches(spark)
    return jaccard.keep_one(docs)


def protect_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data generalised and disclosing terms removed."""
    small_batches(spark)
    return with_text(pii.protect(docs, spans=unused("_spans", docs.columns), sanitised="text"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences of at most 2048."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("PII", protect_pii),
    ("packing", pack),
]

#: SQL cannot express the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i}")
    return docs
