"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= g) = sigmoid(threshold_g - w . x): one weight vector over hashed text features is shared by all
grades, and thresholds are kept in order by fitting their positive gaps. The expected grade and the tail
probability P(grade >= least) select documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashed import Adam, Sample, dot, extract, restrict, sigmoid, telling
from .textblocks import blocks

BITS = 18
#: Bound of labelled rows that the model is fitted on, the first by a hash of doc_id
TRAIN_ROWS = 12000


def grade_of_labels() -> Column:
    """0: poor; 1: good but toxic; 2: good. Null where the labels don't tell."""
    return F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1.. of each document."""
        return 1 - sigmoid(self.thresholds[None, :] - dot(numbers, at, self.weights)[:, None])


def fit(sample: Sample, grade: np.ndarray, grades: int, bits: int = BITS, steps: int = 150, rate: float = 0.05, l2: float = 1e-5) -> Model:
    """Maximum likelihood with an L2 penalty. Without rows: weights 0 and even grades."""
    counts = np.bincount(grade, minlength=grades).astype(float) + 1
    below = np.cumsum(counts)[:-1] / counts.sum()
    first = np.log(below / (1 - below))
    x = np.zeros((1 << bits) + grades - 1)
    x[1 << bits] = first[0]
    x[(1 << bits) + 1 :] = np.log(np.maximum(np.diff(first), 1e-3))
    if len(grade):
        keep = np.zeros(1 << bits, dtype=bool)
        for g in range(1, grades):
            keep |= telling(sample, (grade >= g).astype(float), bits)
        sample = restrict(sample, keep)
        adam, n = Adam(len(x), rate), len(grade)
        for _ in range(steps):
            cut = x[1 << bits] + np.concatenate([[0], np.cumsum(np.exp(x[(1 << bits) + 1 :]))])
            eta = dot(sample.numbers, sample.at, x[: 1 << bits])
            low = np.where(grade > 0, sigmoid(cut[np.maximum(grade - 1, 0)] - eta), 0.0)
            high = np.where(grade < grades - 1, sigmoid(cut[np.minimum(grade, grades - 2)] - eta), 1.0)
            p = np.maximum(high - low, 1e-12)
            d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
            by_cut = np.bincount(np.minimum(grade, grades - 2), weights=-d_high * (grade < grades - 1), minlength=grades - 1)
            by_cut += np.bincount(np.maximum(grade - 1, 0), weights=d_low * (grade > 0), minlength=grades - 1)
            gaps = np.exp(x[(1 << bits) + 1 :])
            tail = np.cumsum(by_cut[::-1])[::-1]
            adam.step(x, np.concatenate([sample.gradient((d_high - d_low) / n, bits) + l2 * x[: 1 << bits], tail[:1] / n, tail[1:] * gaps / n]))
    cut = x[1 << bits] + np.concatenate([[0], np.cumsum(np.exp(x[(1 << bits) + 1 :]))])
    return Model(x[: 1 << bits].astype(np.float32), cut)


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                numbers, at = extract(block, bits)
                packed = [numbers[at[d] : at[d + 1]].astype(np.int32).tobytes() for d in range(block.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.array(packed, pa.binary())], ["target", "features"])

    return run


def gathered(docs: DataFrame, labels: DataFrame, target: Column, rows: int, bits: int) -> tuple[Sample, np.ndarray]:
    """Features and targets (long) of at most ``rows`` labelled documents, the first by a hash of doc_id.

    Of differing texts under one doc_id the least counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), target.cast("long").alias("target")).where("doc_id is not null and target is not null").groupBy("doc_id").agg(F.max("target").alias("target"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    chosen = chosen.groupBy("doc_id").agg(F.first("target").alias("target"), F.min("text").alias("text"))
    got = chosen.select("target", "text").mapInArrow(_features(bits), "target long, features binary").collect()
    return Sample.of([np.frombuffer(r["features"], np.int32) for r in got]), np.array([r["target"] for r in got], dtype=np.int64)


def _scorer(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bits = held.value
        for batch in batches:
            parts = []
            for block in blocks(batch.column(batch.schema.get_field_index("text"))):
                parts.append(model.tails(*extract(block, bits)))
            tails = np.concatenate(parts) if parts else np.zeros((0, len(model.thresholds)))
            arrays = [*batch.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, 0])]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "expected_grade", "p_good"])

    return run


def graded(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, bits: int = BITS, carry: list[str] | None = None) -> DataFrame:
    """expected_grade (0 to 2), p_good = P(grade >= 1) beside the columns ``carry`` (default: doc_id) of every row.

    Labels are joined on doc_id; null labels are skipped, of repeated ones the best grade counts. Without labels
    every text gets the prior. Null and empty texts are scored by their bins alone.
    """
    model = fit(*gathered(docs, labels, grade_of_labels(), rows, bits), 3, bits)
    held = docs.sparkSession.sparkContext.broadcast((model, bits))
    names = carry or ["doc_id"]
    source = docs.select(*names, *(["text"] if "text" not in names else []))
    source = source.withColumn("text", F.col("text").cast("string"))
    schema = source.drop("expected_grade", "p_good").schema.add("expected_grade", "double").add("p_good", "double")
    out = source.drop("expected_grade", "p_good").mapInArrow(_scorer(held), schema)
    return out if "text" in names else out.drop("text")


def classified(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_good, kept (p_good >= least) of every row."""
    return graded(docs, labels).select("doc_id", "expected_grade", "p_good", (F.col("p_good") >= least).alias("kept"))


def selected(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs' rows with p_good >= least; columns as in docs."""
    clash = [c for c in ("expected_grade", "p_good") if c in docs.columns]
    safe = docs.withColumnsRenamed({c: f"_{c}" for c in clash})
    out = graded(safe, labels, carry=safe.columns).where(F.col("p_good") >= least).select(*safe.columns)
    return out.withColumnsRenamed({f"_{c}": c for c in clash})
