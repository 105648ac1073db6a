"""A corpus from raw documents to token ids, in five stages over the operators of pixelweave.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it keeps is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm import bpe, copies, mixing, quality, toxicity
from pixelweave.llm.common import shared_folder, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.5 or more stay.

    Null and empty texts score as texts without words, very long ones whole; repeated rows stay or go together; no rows give none. Without labels of both
    kinds all stay. Columns of other names stay as they are.
    """
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.7 stay.

    Null and empty texts score as the labelled ones without words do, very long ones whole; repeated rows stay or go together; no rows give none. Without labels
    all stay. Columns of other names stay as they are.
    """
    return toxicity.kept(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies (five words, similarity 0.8), the document with the smallest id stays.

    Null and empty texts are copies of each other; of repeated rows one stays; rows with a null id stay, as nothing tells them apart; very long texts are
    compared whole; no rows give none. Columns of other names stay as they are.
    """
    return copies.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, three times at most.

    Null and empty texts have a size of 0 and are taken as others of their source are; a null source is a source, the last; repeated rows are documents of their own;
    very long texts are counted whole; no rows give none. Columns of other names stay as they are.
    """
    return mixing.resampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of what they decode to, and the ids themselves.

    A null or empty text has no ids; very long ones are encoded whole; repeated rows give repeated results; no rows give none; other columns are dropped.
    """
    return bpe.encoded(docs, decoded=False)


STAGES = [
    ("quality", quality_filter),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("mixing", source_mix),
    ("tokens", tokens),
]
#: The classifiers' scores, samples and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are kept in the shared folder and read again."""
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{place}/{i}-{name}")
        docs = spark.read.parquet(f"{place}/{i}-{name}")
    return docs
