"""From documents to token ids: quality filter, near-duplicates, repeated passages, source mix, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. run() writes what a stage
returns as Parquet in the folder that the cluster shares and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, common, mixing, quality, simhash, suffix

#: A document goes if the classifier finds it likelier bad than good.
LEAST_QUALITY = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from all labels of the folder.

    Null and empty texts are scored like any other; null ids have no label but are scored; repeated rows are scored each;
    without usable labels every score is 0.5, so nothing goes. Columns of any name stay as they are."""
    common.bounded_batches(spark)
    model, score = quality.train(docs, common.read(spark, sf_dir, "labels")), common.unused("quality_score", docs.columns)
    return quality.score(docs, model, score).where(F.col(score) >= LEAST_QUALITY).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (links: exact Jaccard similarity of five-word shingles, 0.8 or more): that of the
    smallest doc_id.

    Null texts and texts without words are one group, texts with fewer than five words are one shingle; rows without an
    id stay; rows that repeat id and text are one document and stay as often as they stand; columns of any name stay."""
    common.bounded_batches(spark)
    return simhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that 100-byte strings starting earlier cover go; documents of which nothing is left go too.

    Null and empty texts stay (as empty texts); null ids come last in the order; rows that repeat id and text are one
    document; n_chars follows the text, columns of any other name stay as they are."""
    common.bounded_batches(spark)
    return suffix.deduplicated_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the shares 1, 2, 3, repeating; a document taken twice stands twice.

    A null source is one of its own, last in order; null and empty texts have no words and are in no run; rows without
    an id and repeated rows are documents of their own; n_chars follows the text, columns of any other name stay."""
    common.bounded_batches(spark)
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the bytes that they decode to.

    Null and empty texts give 0 tokens; null ids and repeated rows stay; other columns are left out. Every stage gives
    no rows for an empty table."""
    common.bounded_batches(spark)
    return bpe.digest(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: The trained classifier and the seeded choice of blocks have no SQL form; tests/llm compares every stage with a plain
#: version of it on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage returned is deleted once the next one has been written. The table that the last
    stage reads stays, since its rows are read when the result is."""
    docs, before = common.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            out = common.cut(out)
            if before is not None:
                common.drop_cut(before)
            before = out
        docs = out
    return docs
