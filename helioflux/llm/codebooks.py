"""Vector code compression: product codebooks by Lloyd's rounds with Yinyang bounds (Ding et al., 2015), in integers.

Vectors become integers and are cut into equal parts; each part position has a codebook. Entries of a codebook are
clustered into groups once. A vector's part carries its code and, for each group, a lower bound of its distance to
the group's entries other than its own; when entries move, a bound falls by the farthest move in its group. Only
groups whose bound is not above the distance to the own entry are scanned. Bounds are rounded down to whole numbers
of two bytes, which only makes more groups be scanned; distances that decide are sums of integers, so ties are
exact and go to the lower index.

A round is one map over the vectors, which writes codes and bounds, and one aggregation of sums by part and entry.
The driver holds codebooks only: parts x entries x width of a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Scratch, discard, spill
from .vectors import finite, matrix, packed, raw, usual_width

SCALE = 1024
#: Integers beyond this have squared distances that a long might not hold
LARGEST = 1 << 28
#: Below this a product of integers and its sums are exact in doubles
EXACT = 1 << 22
#: Entries of a codebook to a group, as the method's authors advise
GROUP = 10
_TOP = np.iinfo(np.uint16).max
#: Labels whose sums go along as a broadcast
BROADCAST_LABELS = 100_000


def grouped(entries: np.ndarray, rounds: int = 5) -> np.ndarray:
    """A group number for each entry: a few Lloyd rounds from evenly spaced entries."""
    n = len(entries)
    t = max(1, n // GROUP)
    points = entries.astype(np.float64)
    centres = points[np.arange(t) * n // t]
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1)[None, :] - 2 * points @ centres.T, axis=1)
        for g in range(t):
            if (near == g).any():
                centres[g] = points[near == g].mean(0)
    return np.unique(near, return_inverse=True)[1]


@dataclass
class Codebook:
    """Entries of one part position, their groups, and how far each group's entries went in the last update."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    @staticmethod
    def first(entries: np.ndarray) -> Codebook:
        group = grouped(entries)
        return Codebook(entries, group, np.zeros(int(group.max()) + 1))

    def moved(self, sums: dict[int, tuple[int, list[int]]]) -> Codebook:
        """Entries replaced by the floor of their parts' mean; unused ones stay."""
        now = self.entries.copy()
        for k, (count, total) in sums.items():
            now[k] = [x // count for x in total]
        far = np.sqrt(((now - self.entries).astype(np.float64) ** 2).sum(1))
        drift = np.zeros(len(self.drift))
        np.maximum.at(drift, self.group, far)
        return Codebook(now, self.group, drift)


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, exact."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if points.shape[1] * largest * largest < EXACT * EXACT:
        x, y = points.astype(np.float64), entries.astype(np.float64)
        return ((x**2).sum(1)[:, None] - 2 * (x @ y.T) + (y**2).sum(1)[None, :]).astype(np.int64)
    return np.stack([((points - y) ** 2).sum(1) for y in entries], axis=1)


def assigned(points: np.ndarray, code: np.ndarray, bound: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of ``points``, squared distances, new bounds, and how many distances were computed.

    ``code`` and ``bound`` are of the last round; bounds of 0 know nothing.
    """
    n, groups = len(points), len(book.drift)
    code = code.astype(np.int64)
    own = ((points - book.entries[code]) ** 2).sum(1)
    # A drift rounded up and a bound rounded down: both err towards scanning.
    low = np.maximum(bound.astype(np.int64) - np.ceil(book.drift * (1 + 1e-12)).astype(np.int64), 0)
    best, square = code.copy(), own.copy()
    done = n
    for g in range(groups):
        rows = np.flatnonzero(low[:, g] ** 2 <= square)
        if not len(rows):
            continue
        members = np.flatnonzero(book.group == g)
        found = _squares(points[rows], book.entries[members])
        done += found.size
        first = found.argmin(1)
        at = np.arange(len(rows))
        least, entry = found[at, first], members[first]
        second = found.copy()
        second[at, first] = np.iinfo(np.int64).max
        second = second.min(1)
        before, before_square = best[rows], square[rows]
        better = (least < before_square) | ((least == before_square) & (entry < before))
        best[rows], square[rows] = np.where(better, entry, before), np.where(better, least, before_square)
        # What the group has beside the entry chosen so far; an entry given up here counts in its own group again.
        low[rows, g] = np.minimum(np.floor(np.sqrt(np.where(better | (entry == before), second, least).astype(np.float64))), _TOP)
        lost = np.flatnonzero(better & (book.group[before] != g))
        fall = np.floor(np.sqrt(before_square[lost].astype(np.float64))).astype(np.int64)
        low[rows[lost], book.group[before[lost]]] = np.minimum(low[rows[lost], book.group[before[lost]]], fall)
    return best, square, np.clip(low, 0, _TOP).astype(np.uint16), done


def _state(books: list[Codebook]) -> list[slice]:
    """Where each part's bounds are in a row's bounds."""
    ends = np.cumsum([0, *(len(b.drift) for b in books)])
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _round(width: int, held, last: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: list[Codebook] = held.value
        at, step = _state(books), width // len(books)
        for batch in batches:
            points = raw(batch.column("ints"), width, np.int32).astype(np.int64)
            code = raw(batch.column("code"), len(books), np.uint8)
            bound = raw(batch.column("bound"), at[-1].stop, np.uint16)
            out = [assigned(points[:, p * step : (p + 1) * step], code[:, p], bound[:, at[p]], book) for p, book in enumerate(books)]
            codes = packed(np.stack([x[0] for x in out], axis=1).astype(np.uint8))
            if last:
                error = pa.array(np.sum([x[1] for x in out], axis=0), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, error], ["vec_id", "label", "code", "error"])
            else:
                bounds = packed(np.concatenate([x[2] for x in out], axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("ints"), codes, bounds], ["vec_id", "label", "ints", "code", "bound"])

    return run


def _summed(width: int, parts: int, entries: int) -> Callable:
    """Counts and sums by part and entry of a task's rows."""
    step = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, step), np.int64)
        for batch in batches:
            points = raw(batch.column("ints"), width, np.int32).astype(np.int64).reshape(-1, step)
            key = (raw(batch.column("code"), parts, np.uint8).astype(np.int64) + np.arange(parts) * entries).reshape(-1)
            counts += np.bincount(key, minlength=len(counts))
            # Exact: a batch's sums stay far below 2**53.
            totals += np.stack([np.bincount(key, points[:, i], len(counts)) for i in range(step)], axis=1).astype(np.int64)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64()), pa.array(totals[used].tolist(), pa.list_(pa.int64()))], ["key", "n", "total"])

    return run


def _sums(state: DataFrame, width: int, parts: int, entries: int) -> list[dict[int, tuple[int, list[int]]]]:
    part = state.select("ints", "code").mapInArrow(_summed(width, parts, entries), "key long, n long, total array<long>")
    wide = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(width // parts)]
    out: list[dict[int, tuple[int, list[int]]]] = [{} for _ in range(parts)]
    for row in part.groupBy("key").agg(F.sum("n").alias("n"), *wide).collect():  # at most parts x entries rows
        out[row["key"] // entries][row["key"] % entries] = row["n"], [int(row[f"t{i}"]) for i in range(width // parts)]
    return out


@dataclass
class Compressed:
    """codes: vec_id, label, code (a byte for each part), error; books: the entries of each part position."""

    codes: DataFrame
    books: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def compressed(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scratch: Scratch | None = None) -> Compressed:
    """Product codes of embeddings (vec_id, embedding, label), trained on all of them.

    A component x is floor(1024 * x). Codebooks start as the parts of the vectors with the least vec_ids, then each
    round assigns every part and replaces entries by the componentwise floor of the mean; parts are assigned once
    more at the end. Fewer vectors than entries give as many entries. ``entries`` is at most 256.

    Vectors that are null or hold a null or non-finite component are dropped, and so are those of another length
    than the most frequent one that ``parts`` divides, and those with an integer of 2**28 or more, whose squared
    distances a long might not hold. Repeated rows each count and get a code. A null vec_id comes after all others
    in the order of the first entries; of equal ids the lesser vector comes first. An empty table gives an empty
    result and no entries. Other columns are ignored. ``scratch`` takes the tables that the result reads.
    """
    spark, scratch = embeddings.sparkSession, Scratch() if scratch is None else scratch
    rows = embeddings.select("vec_id", "label", F.col("embedding").alias("v")).where(finite("v"))
    width = usual_width(rows, "v", parts)
    ints = F.transform("v", lambda x: F.floor(x.cast("double") * float(SCALE)))
    fits = F.forall("v", lambda x: F.abs(F.floor(x.cast("double") * float(SCALE)).cast("double")) < float(LARGEST))
    rows = rows.where((F.size("v") == width) & fits).select("vec_id", "label", ints.cast("array<int>").alias("v"))
    none = spark.createDataFrame([], T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]))
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect() if width else []
    if not start:
        return Compressed(none, [])
    step, first = width // parts, np.array([r["v"] for r in start], dtype=np.int64)
    books = [Codebook.first(first[:, p * step : (p + 1) * step]) for p in range(parts)]
    groups = _state(books)[-1].stop

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed(matrix(batch.column("v"), width, np.int32)), packed(np.zeros((n, parts), np.uint8)), packed(np.zeros((n, groups), np.uint16))], ["vec_id", "label", "ints", "code", "bound"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label")]
    carried = ", ".join([*kinds, "ints binary", "code binary", "bound binary"])
    state = rows.mapInArrow(opened, carried)
    for _ in range(rounds):
        now = spill(state.mapInArrow(_round(width, spark.sparkContext.broadcast(books), False), carried), "codes")
        books = [book.moved(sums) for book, sums in zip(books, _sums(now, width, parts, len(first)), strict=True)]
        discard(state)
        state = now
    codes = state.mapInArrow(_round(width, spark.sparkContext.broadcast(books), True), ", ".join([*kinds, "code binary", "error long"]))
    out = scratch.spill(codes, "codes")
    discard(state)
    return Compressed(out, [b.entries for b in books])


def with_label_error(codes: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """codes with label_error, the error summed over equal labels, nulls together."""
    scratch = Scratch() if scratch is None else scratch
    sums = scratch.spill(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "labels")
    # Beyond a size that is safe to send along, both sides are dealt by label and Spark splits the skewed ones.
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def coded(embeddings: DataFrame, parts: int = 4) -> DataFrame:
    """vec_id, code (hex), error, label_error, codebooks_sha256 of ``compressed``."""
    out = compressed(embeddings, parts)
    return with_label_error(out.codes).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(out.digest()).alias("codebooks_sha256"))
