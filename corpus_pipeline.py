"""A training corpus from raw documents: quality, exact copies, near copies, mixing, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's input. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import exact, mixing, quality, setsketch, spm
from gaugeworks.llm.common import documents, table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the quality ranker rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts the row with the largest doc_id stays."""
    return exact.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document stays of each group linked by 0.8 of their five-word shingles."""
    return setsketch.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents are repeated (never left out) so that language totals move to tempered shares."""
    return mixing.mixed_docs(docs, least=1.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: ids of every text, checked by decoding them."""
    return spm.encode(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_copies),
    ("minhash near-dedup", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("sentencepiece encoding and decoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# A trained ranker, sketches and a tokenizer have no SQL form; tests/llm compares run() with a plain version.
ORACLE_SQL = None
