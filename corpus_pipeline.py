"""From raw documents to packed training sequences.

Each stage is a function (spark, documents, folder of the tables) -> DataFrame. All but the
last return rows with the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from presslens.llm import exact_dedup, minhash, mixing, packing, toxicity
from presslens.llm.common import find_package, stored
from presslens.session import prepare_session

#: Documents that score as high as this go.
TOXIC = 0.3


def _ready(spark: SparkSession) -> SparkSession:
    find_package(spark)
    # whole texts go to Python workers in small batches: both sides hold a batch, next to what stages before left in memory
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return prepare_session(spark)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = _ready(spark).read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.drop_toxic(docs, labels, TOXIC)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return minhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document appears as often as the mix takes it."""
    _ready(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("toxicity", without_toxic), ("exact_dedup", without_copies), ("minhash_near_dedup", without_near_copies),
          ("mixing", mixed), ("packing", packed)]

#: Hashed signatures, a fitted classifier and a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
