"""Weighted rendezvous hashing of stable keys over shards; DataFrame functions only.

Each (key, shard) pair draws a uniform u from a hash, and the key goes to the shard with the largest
``ln(u) / weight``. The draw of a pair depends on nothing else, so a shard added at the end takes keys only into
itself, and each shard gets a share of keys in proportion to its weight.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import quoted, spill

#: Rows of one shard that are numbered together
GROUP_ROWS = 20000


def _uniform(key: Column, tail: str) -> Column:
    """A uniform in (0, 1) from the first 52 bits of a digest."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{tail}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard (int from 0) of a key, given the shards' weights; ties, never seen, would go to the last."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    draws = [F.struct((F.ln(_uniform(key, str(s))) / w).alias("draw"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.array_max(F.array(*draws))["shard"]


def numbered(df: DataFrame, group: str, order: list[str], spread: Column, rows: int, name: str) -> DataFrame:
    """Gapless numbers from 0 within each value of ``group``, without bringing a group together.

    Rows of a group fall into buckets by ``spread`` (an int >= 0); a bucket's numbers start at the count of the
    buckets before it, which comes from one aggregation.
    """
    buckets = max(1, -(-rows // GROUP_ROWS))
    df = df.withColumn("_bucket", (spread % F.lit(buckets)).cast("int"))
    counts = df.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(group, "_bucket").orderBy(*order)
    placed = df.withColumn("_own", F.row_number().over(own) - 1)
    return placed.join(F.broadcast(counts) if buckets <= 10000 else counts, [group, "_bucket"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_bucket", "_before", "_own")


def _spread() -> Column:
    """A draw by key, text and, where rows have one, their own number ``_at``."""
    return F.pmod(F.xxhash64("_key", "text_crc32", "_at"), F.lit(1 << 31))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, 0 for null, plus 1) and text_crc32 (0 for null)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))


def assign(rows: DataFrame, weights: list[float], next_weight: float | None = None) -> DataFrame:
    """rows (doc_id, text_crc32 and any others) with law, shard, slot and grown_shard added.

    grown_shard: the shard once one more of weight next_weight (the last weight if None) is added. Rows with an
    equal doc_id share a shard; a null doc_id is a key of its own. Within a shard, slots run from 0 without a
    gap; equal rows get theirs in any order. An empty table gives an empty result. Columns named law, shard,
    slot or grown_shard are replaced.
    """
    rows = rows.drop("law", "shard", "slot", "grown_shard")
    rows = rows if "_at" in rows.columns else rows.withColumn("_at", F.lit(0))
    grown = [*weights, weights[-1] if next_weight is None else next_weight]
    out = rows.withColumn("_key", _key("doc_id"))
    out = out.withColumns({"law": F.lit("key"), "shard": shard_of(F.col("_key"), weights), "grown_shard": shard_of(F.col("_key"), grown)})
    n = rows.count()
    return numbered(out, "shard", ["doc_id", "text_crc32"], _spread(), n, "slot").drop("_key", "_at").withColumn("slot", F.col("slot").cast("long"))


def sharded(docs: DataFrame, shards: int = 8, weights: list[float] | None = None) -> DataFrame:
    """All documents: doc_id, size, text_crc32, law, shard, slot, grown_shard; rows as in ``assign``.

    The measures are written once; a row's place in their files tells equal rows apart, so any number of them
    spreads over the buckets.
    """
    held = spill(measured(docs), "measured")
    rows = held.select("doc_id", "size", "text_crc32", F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("_at"))
    return assign(rows, weights or [1.0] * shards).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _in_files(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """columns of docs with ``_at``, a number of each row by its place in files; docs that don't come from files are written first."""
    at = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("_at")
    try:
        return docs.select(*columns, at)
    except AnalysisException:  # no files behind these rows, or a column of that name
        return spill(docs.select(*columns), "rows").select("*", at)


def placed(docs: DataFrame, shards: int = 8, weights: list[float] | None = None) -> DataFrame:
    """docs with all their columns, whatever their names, and shard and slot; existing columns of those two names are replaced.

    Rows as in ``assign``; a row's place in its files tells equal rows apart, so any number of them spreads over the
    buckets. Rows that don't come straight from files are written once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    columns = [F.struct(*[quoted(c) for c in kept]).alias("_row"), F.col("doc_id"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32")]
    out = assign(_in_files(docs, columns), weights or [1.0] * shards)
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], "shard", "slot")
