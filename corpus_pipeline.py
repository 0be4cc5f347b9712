"""A training corpus from documents: five stages, each reading what the one before it wrote.

Classify quality, drop near duplicates, drop contaminated documents, mix sources to target weights, shard.

Odd rows: a null or empty text is graded by its statistics' bins alone, has no near duplicate and no contamination
and takes part in mixing and sharding like others. A row with a null doc_id is judged by its own text in every
stage, links with nothing and is one key of sharding. Rows that repeat a doc_id share a fate in deduplication: with
the doc_id least in its group all stay. Ties go to the least doc_id. Columns of documents pass through, whatever
their names (but ``shard`` and ``slot`` are replaced); an empty table gives an empty one.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helioflux.llm import decontaminate, mixing, near_dedup, quality, sharding
from helioflux.llm.queries import TARGETS
from helioflux.llm.store import discard, quoted, spill, table

SHARDS = 8


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal quality model accepts."""
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each near-duplicate group."""
    gone = near_dedup.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination."""
    return decontaminate.removed(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at rates of at most 1: clean ones whole, others cut to their share beside them.

    A domain of which too little is left, such as junk after stage "quality", falls short of its weight.
    """
    return mixing.drawn(docs, table(spark, sf_dir, "labels"), TARGETS, scarce="short")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard and slot."""
    return sharding.placed(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", classify),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: The stages train and iterate, which SQL can't express; tests hold them against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; rows in and out of the stages before it are logged, the last one keeps all."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.count()
    for name, stage in STAGES[:-1]:
        kept = spill(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs, before = kept, rows
        rows = docs.count()
        logging.getLogger(__name__).info("%s: %d rows in, %d out", name, before, rows)
    return STAGES[-1][1](spark, docs, sf_dir)
