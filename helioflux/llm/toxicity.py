"""Toxicity by weak supervision.

1. Voters look at a text and vote or stay silent: single words of a fixed lexicon, features mined from labelled
   rows, and patterns over the text's statistics.
2. A generative label model takes the vote table of the whole corpus. Given the class, votes follow a tree: each
   voter but the first has one parent, and its chance of voting depends on the class and the parent's vote (Chow and
   Liu, 1968; Friedman et al., 1997). So a voter's accuracy and its strongest correlation are both estimated, and
   voters that repeat each other count once. Tables are fitted by expectation maximisation over all rows, in which
   labelled rows, whose class is known, count as observed; each round draws the tree anew from the expected pair
   counts. A row's posterior comes from its votes alone.
3. A linear classifier over hashed text features learns the posterior labels of a bounded sample of rows, and
   scores every text. Its inputs come from the text alone; no row's own label is its target.

Labels are used only from rows whose crc32(doc_id as text) mod 3 is not 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashed import Sample, dot, extract, logistic, restrict, sigmoid, telling
from .quality import gathered
from .store import discard, spill
from .textblocks import Block, blocks, span_hashes

BITS = 18
#: Insults, each a voter
LEXICON = (
    "idiot", "moron", "stupid", "dumb", "fool", "loser", "clown", "scum", "trash", "garbage", "pathetic", "worthless",
    "disgusting", "ugly", "filthy", "vermin", "pig", "coward", "liar", "jerk", "bastard", "freak", "imbecile", "retard",
)
MINED = 32
VOTERS = len(LEXICON) + MINED + 4
#: Bounds of labelled rows for mining and first rates, and of rows for the classifier, the first by hash each
TRAIN_ROWS = 12000
SAMPLE_ROWS = 12000
#: Rows' weight in the label model for each that carries a label, and rows added to smooth a table's entry
KNOWN, SMOOTH = 20.0, 2.0


def remainder() -> Column:
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 3


def lexicon_features(bits: int = BITS) -> np.ndarray:
    """The hashed features of the lexicon's words."""
    data = np.frombuffer("".join(LEXICON).encode(), np.uint8)
    end = np.cumsum([len(w) for w in LEXICON])
    return (span_hashes(data, np.concatenate([[0], end[:-1]]), end, fold=True) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Voters:
    """Hashed features that vote when present; four patterns count how many do, and how dense they are."""

    features: np.ndarray
    bits: int = BITS

    def votes(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bit masks of votes of each document."""
        n = len(at) - 1
        place = np.full(1 << self.bits, -1, dtype=np.int64)
        place[self.features[::-1]] = np.arange(len(self.features))[::-1]
        on = place[numbers]
        hit = on >= 0
        doc = np.repeat(np.arange(n), np.diff(at))[hit]
        matrix = np.zeros((n, len(self.features)), dtype=bool)
        matrix[doc, on[hit]] = True
        words, mined = matrix[:, : len(LEXICON)].sum(axis=1), matrix[:, len(LEXICON) :].sum(axis=1)
        size = np.maximum(np.diff(at), 1)
        patterns = np.stack([words >= 2, mined >= 2, (words + mined) >= 4, (words + mined) / size >= 0.05], axis=1)
        matrix = np.concatenate([matrix, patterns], axis=1)
        return (matrix.astype(np.int64) << np.arange(matrix.shape[1], dtype=np.int64)).sum(axis=1)


def _spread(votes: np.ndarray, n: int) -> np.ndarray:
    return ((votes[:, None] >> np.arange(n, dtype=np.int64)) & 1).astype(np.float64)


@dataclass
class LabelModel:
    """log_table[y, i, u, v]: log chance that voter i's vote is v where its parent's is u, given class y."""

    log_prior: np.ndarray
    parent: np.ndarray
    log_table: np.ndarray

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Of toxic."""
        v = _spread(votes, len(self.parent)).astype(np.int64)
        above = np.where(self.parent < 0, 0, v[:, np.maximum(self.parent, 0)])
        told = self.log_table[1] - self.log_table[0]
        return self.log_prior[1] - self.log_prior[0] + told[np.arange(len(self.parent))[None, :], above, v].sum(axis=1)


def tree_model(total: np.ndarray) -> LabelModel:
    """The likeliest tree and tables from expected counts: total[y, 0, 0] rows, [y, 0, i] votes, [y, i, j] votes of both."""
    n = total.shape[1] - 1
    rows = total[:, 0, 0][:, None, None]
    on = total[:, 1:, 1:]
    one = total[:, 0, 1:]
    # counts[y, i, j, u, v]: rows where voter i's vote is u and voter j's is v
    counts = np.stack([np.stack([rows - one[:, :, None] - one[:, None, :] + on, one[:, None, :] - on], axis=-1), np.stack([one[:, :, None] - on, on], axis=-1)], axis=-2)
    counts = np.maximum(counts, 0.0)
    # Conditional mutual information of each two voters given the class.
    some = counts + 1e-9
    joint = some / some.sum(axis=(3, 4), keepdims=True)
    apart = joint.sum(axis=4, keepdims=True) * joint.sum(axis=3, keepdims=True)
    share = total[:, 0, 0] / max(total[:, 0, 0].sum(), 1e-9)
    shared = (share[:, None, None] * (joint * np.log(joint / apart)).sum(axis=(3, 4))).sum(axis=0)
    parent = np.full(n, -1)
    if n:
        inside = np.zeros(n, dtype=bool)
        inside[0] = True
        near, gain = np.zeros(n, dtype=np.int64), shared[0].copy()
        for _ in range(n - 1):
            i = int(np.argmax(np.where(inside, -np.inf, gain)))
            parent[i], inside[i] = near[i], True
            closer = shared[i] > gain
            near[closer], gain[closer] = i, shared[i][closer]
    # Tables, smoothed towards the voter's own rate, and that towards a rate of both classes.
    both = (one.sum(axis=0) + 0.01) / (total[:, 0, 0].sum() + 1.0)
    rate = (one + SMOOTH * both) / (total[:, 0, 0][:, None] + SMOOTH)
    table = np.empty((2, n, 2, 2))
    for i in range(n):
        for y in (0, 1):
            plain = np.array([1 - rate[y, i], rate[y, i]])
            pair = counts[y, parent[i], i] if parent[i] >= 0 else np.stack([np.array([rows[y, 0, 0] - one[y, i], one[y, i]])] * 2)
            table[y, i] = (pair + SMOOTH * plain) / (pair.sum(axis=1, keepdims=True) + SMOOTH)
    prior = (total[:, 0, 0] + 1.0) / (total[:, 0, 0].sum() + 2.0)
    return LabelModel(np.log(prior), parent, np.log(table))


def counted(votes: np.ndarray, toxic: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Expected counts for tree_model of vote patterns with chances of toxic, each standing for so many rows."""
    v = np.concatenate([np.ones((len(votes), 1)), _spread(votes, n)], axis=1)
    return np.stack([(v * (rows * (1 - toxic))[:, None]).T @ v, (v * (rows * toxic)[:, None]).T @ v])


def taught(n: int) -> np.ndarray:
    """Counts that stand in where no label is known: a word of the lexicon is rare, and ten times as rare in other texts."""
    out = np.zeros((2, n + 1, n + 1))
    for y, (rows, rate) in enumerate(((900.0, 0.005), (100.0, 0.05))):
        p = np.concatenate([[1.0], np.full(n, rate)])
        out[y] = rows * np.outer(p, p)
        np.fill_diagonal(out[y], rows * p)
    return out


def _sums(held, n: int):
    """Partial sums of counted() over vote patterns (votes, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LabelModel = held.value
        total = np.zeros((2, n + 1, n + 1))
        for batch in batches:
            votes = batch.column(0).to_numpy(zero_copy_only=False)
            total += counted(votes, sigmoid(model.log_odds(votes)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64), n)
        cell = np.flatnonzero(total.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.reshape(-1)[cell])], ["cell", "part"])

    return run


def _packing(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                numbers, at = extract(block, bits)
                packed = [numbers[at[d] : at[d + 1]].astype(np.int32).tobytes() for d in range(block.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.array(packed, pa.binary())], ["votes", "features"])

    return run


def _voting(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters: Voters = held.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                numbers, at = extract(block, voters.bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.array(voters.votes(numbers, at)), pa.array(np.diff(at))], ["draw", "votes", "n_features"])

    return run


def _score_text(block: Block, weights: np.ndarray, intercept: float, bits: int) -> np.ndarray:
    return sigmoid(dot(*extract(block, bits), weights) + intercept)


def _scoring(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept, bits = held.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                score = _score_text(block, weights, intercept, bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), batch.column(2).slice(block.first, block.n), pa.array(score), pa.array((score >= 0.7).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


@dataclass
class Trained:
    weights: np.ndarray
    intercept: float
    labels: LabelModel
    voters: Voters


def mine(sample: Sample, toxic: np.ndarray, lexicon: np.ndarray, bits: int, most: int = MINED) -> np.ndarray:
    """Features of mostly toxic rows that tell, one after another; a row's weight halves with each feature that it has.

    So rare vocabularies, such as another language's, get voters too.
    """
    if not len(toxic) or not 0 < toxic.sum() < len(toxic):
        return np.zeros(0, dtype=np.int64)
    sizes = np.diff(sample.at)
    n = np.maximum(np.bincount(sample.numbers, minlength=1 << bits), 1)
    hit = np.bincount(sample.numbers, weights=np.repeat(toxic, sizes), minlength=1 << bits)
    fit = telling(sample, toxic.astype(float), bits) & (hit >= 0.5 * n)
    fit[lexicon] = False
    row = np.repeat(np.arange(len(toxic)), sizes)
    weight, out = toxic.astype(float), []
    for _ in range(most):
        open_ = np.bincount(sample.numbers, weights=weight[row], minlength=1 << bits)
        gain = np.where(fit, open_ * hit / n, 0)
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            break
        out.append(best)
        fit[best] = False
        weight[row[sample.numbers == best]] *= 0.5
    return np.array(out, dtype=np.int64)


def label_model(patterns: DataFrame, fixed: np.ndarray, n_voters: int, rounds: int) -> LabelModel:
    """Fitted over all rows' vote patterns (votes, rows); ``fixed``: counts of rows whose class is known."""
    spark = patterns.sparkSession
    model = tree_model(fixed)
    for _ in range(rounds):
        cells = patterns.mapInArrow(_sums(spark.sparkContext.broadcast(model), n_voters), "cell long, part double").groupBy("cell").agg(F.sum("part").alias("part")).collect()
        total = np.zeros(2 * (n_voters + 1) ** 2)
        for r in cells:
            total[r["cell"]] = r["part"]
        model = tree_model(fixed + total.reshape(2, n_voters + 1, n_voters + 1))
    return model


def trained(docs: DataFrame, labels: DataFrame, rounds: int = 5, bits: int = BITS, sample_rows: int = SAMPLE_ROWS) -> Trained:
    spark = docs.sparkSession
    held_back = remainder() == 1
    known = labels.where(~held_back & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    sample, toxic = gathered(docs, known, F.col("toxic"), TRAIN_ROWS, bits)
    lexicon = lexicon_features(bits)
    mined = mine(sample, toxic, lexicon, bits)
    voters = Voters(np.concatenate([lexicon, mined]), bits)
    n_voters = len(voters.features) + 4
    fixed = KNOWN * counted(voters.votes(sample.numbers, sample.at), toxic.astype(float), np.ones(len(toxic)), n_voters) if len(toxic) else taught(n_voters)
    del sample

    rows = docs.select(F.xxhash64(F.lit(11), F.col("doc_id").cast("string"), F.crc32(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"))).alias("draw"), F.col("text").cast("string").alias("text"))
    table = spill(rows.mapInArrow(_voting(spark.sparkContext.broadcast(voters)), "draw long, votes long, n_features long"), "votes")
    patterns = spill(table.groupBy("votes").agg(F.count(F.lit(1)).alias("rows")), "patterns")
    model = label_model(patterns, fixed, n_voters, rounds)

    # The classifier's rows: half of them rows on which some voter spoke, the first by hash of each kind.
    lots = [table.where(spoke).select("draw", "votes").orderBy("draw", "votes").limit(sample_rows // 2) for spoke in ("votes <> 0", "votes = 0")]
    drawn = spill(lots[0].unionByName(lots[1]).groupBy("draw").agg(F.first("votes").alias("votes")), "drawn")
    chosen = rows.join(F.broadcast(drawn), "draw").dropDuplicates(["draw"]).select("votes", "text")
    got = chosen.mapInArrow(_packing(bits), "votes long, features binary").collect()
    discard(table)
    discard(patterns)
    discard(drawn)
    if not got:
        return Trained(np.zeros(1 << bits, np.float32), -3.0, model, voters)
    soft = sigmoid(model.log_odds(np.array([r["votes"] for r in got], dtype=np.int64)))
    texts = Sample.of([np.frombuffer(r["features"], np.int32) for r in got])
    del got
    texts = restrict(texts, telling(texts, soft, bits))
    weights, intercept = logistic(texts, soft, np.ones(len(soft)), bits, l2=3e-5, steps=150, rate=0.1)
    return Trained(weights.astype(np.float32), intercept, model, voters)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.7).

    Null and empty texts are scored by their statistics' bins, below a half unless such texts were toxic. Labels
    other than 0 and 1 are skipped; of repeated labels 1 counts. Without labels the fixed lexicon alone teaches.
    A null doc_id is an empty text for the remainder. Repeated rows each get theirs; an empty table gives an
    empty result; columns other than doc_id and text are ignored.
    """
    model = trained(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept, BITS))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (remainder() == 1).alias("held_out")).mapInArrow(_scoring(held), "doc_id long, held_out boolean, score double, predicted int")
