"""A training corpus from raw documents: rules, near duplicates, benchmark leaks, source mixing, token files.

Each stage is a function (spark, docs, folder) -> DataFrame; its result is written and read again as the next one's docs.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnscope.llm import decontamination, jaccard, mixing, quality_rules, token_files
from columnscope.llm.queries import MIX_EPOCHS, MIX_LEVELS, MIX_SEED, MIX_WEIGHTS, with_domain
from columnscope.llm.storage import shared_folder

# Stages decide by similarity, subsequences and a tokenizer, for which SQL has no words.
ORACLE_SQL = None

# The mixture has as many tokens as the documents that reach it.
MIX_BUDGET = 1.0
TOKENIZER = "byte_bpe_50k.json"


def rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the base and all rules."""
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document of smallest id of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard.one_of_each(docs, width=5, threshold=Fraction(4, 5))


def decontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.clean_rows(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents by target weights: one row for each epoch that uses a document; the last of a leaf is cut to its share."""
    # a document travels as one struct, so that no column of its own clashes with the mixture's
    names = [F.col(f"`{c}`") for c in docs.columns]
    counted = with_domain(docs.select("doc_id", "lang", "source", F.struct(*names).alias("row"))).withColumn("n_tokens", mixing.n_words(F.col("row.text")))
    chosen = mixing.mix(counted, MIX_LEVELS, "n_tokens", MIX_BUDGET, MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    cut = F.col("taken") < F.col("n_tokens")
    text = F.when(cut, mixing.cut_to(F.col("row.text"), F.col("taken"))).otherwise(F.col("row.text"))
    replaced = {"text": text}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.when(cut, F.length(text).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    return chosen.select(*[replaced.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token files of the mixture, read back: where each document's ids are and their checksum."""
    out = f"{shared_folder(spark)}/tokens-{uuid.uuid4()}"
    return token_files.document_facts(token_files.write_tokens(docs, out, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality rules", rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed), ("token ids", tokens),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of ``folder``; between stages the rows are written to the shared folder."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{number}")
            docs = spark.read.parquet(f"{base}/{number}")
    return docs
