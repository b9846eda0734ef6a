"""The corpus pipeline: reject toxic documents, keep one of near copies, drop test leaks, redact, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared folder and read again as the next stage's docs. All but the last return the columns of
documents. Texts count whole, however long; an empty table gives an empty result; further columns may have any name.

A stage leaves the session with Arrow batches of BATCH bytes, as its result is planned after it returns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontamination, neardup, packing, pii, toxicity
from tidelog.llm.common import table
from tidelog.session import checkpoint_folder


#: Bytes of texts that go to Python at a time (more, where one text is longer). Executors and their workers hold several copies.
BATCH = "2m"


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """stage, with Arrow batches of BATCH."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the toxicity model rejects. It is fitted on the labelled rows among docs.

    Null, empty and blank texts have no features and stay, as do all where no toxic and clean rows are labelled.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


@in_small_batches
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs of which near copies (five-word shingles, similarity 0.8) are gone but for the least id's.

    Null ids come last. Documents without words are no copies; of rows that repeat an id and a text one stays.
    """
    return neardup.without_copies(docs, neardup.Params(shingle=5))


@in_small_batches
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that cover a benchmark item. Null and empty texts cover none and stay; repeated rows go or stay together."""
    return decontamination.without_matches(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


@in_small_batches
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data in text replaced by the names of its kinds. Null texts stay null, and no row goes."""
    return pii.redact(docs)


@in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs in sequences of at most 1024 tokens. A null or empty text is a piece of its end alone; repeated rows are packed each."""
    return packing.pack(docs, forget=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", keep_one_of_near_copies),
    ("decontamination", drop_leaks),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Tiling, tokenizers and the learned grades have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes when the next one's is written; the last one stays."""
    shared, docs, before = checkpoint_folder(spark), table(spark, sf_dir, "documents"), None
    for n, (_, stage) in enumerate(STAGES):
        path = f"{shared}/corpus-{uuid.uuid4().hex}-{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            folder = spark._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        before = path
    return docs
