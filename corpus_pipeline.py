"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. The first four return the columns of ``docs``, whatever they are called and
whichever more there are; the last returns the packed pieces of every document left.

Defined cases, at every stage: an empty table gives an empty one; a null text is
judged, compared and packed as an empty one, and stays null until the last stage;
a null identifier takes part; rows that repeat are judged alike, and each is kept
or goes on its own, but for the near copies, of which one row is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loreweave.llm import packing, pii, quality, simhash, toxicity
from loreweave.llm.common import staged


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, learned from ``labels``, scores below one half; without labels none goes."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer holds to be good; if it sees one side only, the votes decide."""
    return quality.good_only(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the smallest identifier's, or where none has one, any."""
    return simhash.one_of_each(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, private data replaced by surrogates; ``n_chars`` follows where it was the text's length."""
    return pii.with_surrogates(docs, pii.key_of(spark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 1024 tokens; a null text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("toxicity", remove_toxic),
    ("quality classifier", remove_low_quality),
    ("simhash near-dedup", remove_near_copies),
    ("pii surrogates", replace_private),
    ("best-fit packing", pack_sequences),
]

#: The stages hold learned models and tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
