"""A training corpus from documents: quality, near duplicates, repeated passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. A stage works on all rows that its predecessor kept, and what it decides takes effect.

What a stage writes on its way to the result, in spark.checkpoint.dir, is deleted when a later stage is called in the same thread with
docs that don't read it: so a result must be written before the next stage is called with other docs than that result.

All stages take nulls in any column, empty and very long texts (whole), repeated rows and empty tables, and drop columns that
documents doesn't have, whatever they are named. What becomes of such rows is said at each stage.
"""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm import bpe, jaccard, mixing, quality, suffixes
from vexel.llm.common import release, remembered, sweep, sweep_unread, written, written_since
from vexel.plans.workers import on_workers

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Tables that the stages before wrote, a list for each thread.
_LEFT = threading.local()


def stage(fn):
    """A stage that begins with deleting what earlier ones wrote and its docs don't read."""

    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)  # their shuffles too
        _LEFT.tables = sweep_unread(spark, getattr(_LEFT, "tables", []), docs)
        before = remembered()
        out = fn(spark, docs, sf_dir)
        _LEFT.tables += written_since(before)
        return out

    return run


def with_text(docs: DataFrame, text) -> DataFrame:
    """The columns of documents, with another text and its length."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that fail the base rules or their script's bands, fitted on labelled rows, go. Null and empty texts
    fail; repeated rows share one verdict; null ids, languages and sources have no influence."""
    on_workers(spark)
    return quality.fitted(spark, docs.select(*COLUMNS), sf_dir).where("kept").select(*COLUMNS)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each component one row stays, that with the smallest id; of rows that share it, or all have none, the
    first one as they were packed. So of repeated rows one stays. Rows without words are in no component and stay."""
    on_workers(spark)
    return jaccard.near_duplicates(docs.select(*COLUMNS)).where("representative").select(*COLUMNS)


@stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: bytes of passages that an earlier document has go; a character goes if one of its bytes does. Documents
    of which no word is left, null and empty ones among them, go. A null id is later than all others; rows that share an
    id take nothing from each other."""
    on_workers(spark)
    found = suffixes.remove_earlier(docs.select(*COLUMNS), as_text=True)
    left = with_text(found, F.col("kept"))
    return left.where(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) > 0)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: every copy that the mixture takes is a row, in the order of its training position. A null source is a source;
    repeated rows are taken each by itself; a document without words is taken as often as its whole source is."""
    # written between the join and the sort, so that the texts are in one shuffle at a time; what led there goes
    before = remembered()
    mixed = written(mixing.mix(docs.select(*COLUMNS)), "mixed")
    sweep(spark, before, keep=1)
    return mixing.positions(mixed).select(*COLUMNS)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the ids of every text, with the digests by which they can be held against another encoder's. A null text is
    an empty one, without ids."""
    import public_tokenizers

    on_workers(spark)
    encoded = bpe.encode_texts(docs.select(*COLUMNS), bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return bpe.digests(encoded, "doc_id", "lang", "source", "ids")


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: The near-duplicate, suffix and encoding stages are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again, and goes, with the tables that it
    made on the way, when its successor's result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = remembered()
    for name, of in STAGES[:-1]:
        docs = written(of(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
