"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

With one more component, sqrt(M^2 - |x|^2) for the greatest norm M, the largest inner product is the least distance,
so the tree is a plain k-means tree. It is fitted on a bounded sample; every row is put into a leaf. A query pops the
nearest node from a priority queue, opens it if it has children and visits it if it is a leaf. How many leaves a query
visits is calibrated: some queries are answered by brute force over all rows, and visits are widened until the leaves
visited hold the wanted share of their true neighbours.

Leaves next to each other in the tree are put into bins of about ``bin_rows`` rows; the rows of a larger leaf are
dealt over several bins. A query goes once to each bin that holds a leaf of it, and brings its best from there. Equal
vectors of a bin are scored once; of their ids only the least can be among a query's nearest, so the rest aren't
compared.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Scratch
from .vectors import finite, matrix, packed, usual_width

#: Rows on which the tree is fitted, expected number; queries that calibrate visits; children of a node
SAMPLE, CALIBRATION, BRANCH = 20_000, 256, 16
#: Rows wanted in a leaf; most leaves of a tree (its centroids are broadcast)
LEAF_ROWS, MOST_LEAVES = 64, 4096
BIN_ROWS, QUERY_ROWS = 2048, 16_384
#: Queries to a task that walks the tree
TOGETHER = 500
RECALL = 0.94
#: Seed of the k-means starts
SEED = 7


@dataclass
class Tree:
    """Nodes in depth-first order: centroid and, in ``child``, the nodes below; a leaf has none and a number."""

    centroid: np.ndarray
    child: list[np.ndarray]
    leaf: np.ndarray
    greatest: float

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def _lifted(self, points: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.greatest**2 - (points**2).sum(1), 0))
        return np.concatenate([points, more[:, None]], axis=1)

    @staticmethod
    def fit(points: np.ndarray, greatest: float, leaves: int) -> Tree:
        """k-means of k-means: a node of more than its share of points gets BRANCH children at most."""
        tree, rng = Tree(np.zeros((0, 0)), [], np.zeros(0, int), greatest), np.random.default_rng(SEED)
        lifted, share = tree._lifted(points), max(1.0, len(points) / max(1, leaves))
        centroid, leaf = [], []

        def grow(rows: np.ndarray) -> int:
            at = len(centroid)
            own = lifted[rows]
            centroid.append(own.mean(0) if len(rows) else np.zeros(lifted.shape[1]))
            tree.child.append(np.zeros(0, int))
            leaf.append(-1)
            k = min(BRANCH, round(len(rows) / share))
            near = _kmeans(own, k, rng) if k > 1 else np.zeros(len(rows), int)
            parts = [rows[near == g] for g in np.unique(near)]
            if len(parts) < 2:
                leaf[at] = max(leaf, default=-1) + 1
                return at
            tree.child[at] = np.array([grow(part) for part in parts])
            return at

        grow(np.arange(len(points)))
        tree.centroid, tree.leaf = np.array(centroid), np.array(leaf)
        return tree

    def put(self, points: np.ndarray) -> np.ndarray:
        """Each point's leaf: from the root to the nearest child, down to a leaf."""
        points, node = self._lifted(points), np.zeros(len(points), int)
        while True:
            inner = np.flatnonzero(self.leaf[node] < 0)
            if not len(inner):
                return self.leaf[node]
            for at in np.unique(node[inner]):
                rows = inner[node[inner] == at]
                below = self.child[at]
                node[rows] = below[_near(points[rows], self.centroid[below])]

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        query, queue = np.append(query, 0.0), [(0.0, 0)]
        while queue:
            _, at = heapq.heappop(queue)
            if self.leaf[at] >= 0:
                yield int(self.leaf[at])
                continue
            below = self.child[at]
            for item in zip(((self.centroid[below] - query) ** 2).sum(1).tolist(), below.tolist(), strict=True):
                heapq.heappush(queue, item)


def _near(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * points @ centres.T, axis=1)


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = _near(points, centres)
        for g in range(k):
            if (near == g).any():
                centres[g] = points[near == g].mean(0)
    return _near(points, centres)


def _scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in order of components, so equal vectors score the same anywhere."""
    return np.cumsum(queries * points, axis=1)[:, -1]


@dataclass
class _Distinct:
    """Distinct vectors of some rows, and the least ids of each."""

    points: np.ndarray
    ids: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, points: np.ndarray, most: int) -> _Distinct:
        whole = np.ascontiguousarray(points + 0.0)  # -0.0 reads as 0.0
        keys = whole.view(np.dtype((np.void, whole.dtype.itemsize * whole.shape[1]))).reshape(-1)
        _, at, same = np.unique(keys, return_index=True, return_inverse=True)
        order = np.lexsort((ids, same))
        ids, same = ids[order], same[order]
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != ids[:-1]) | (same[1:] != same[:-1])
        ids, same = ids[keep], same[keep]
        start = np.searchsorted(same, np.arange(len(at)))
        size = np.minimum(np.diff(np.append(start, len(same))), most)
        return _Distinct(whole[at], ids, start, size)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among their query's k best, by query, score and id; an id counts once, with its best score."""
    order = np.lexsort((ids, -score, query))
    q, x = query[order], ids[order]
    pair = np.lexsort((np.arange(len(q)), x, q))
    again = np.zeros(len(q), bool)
    again[pair[1:]] = (q[pair[1:]] == q[pair[:-1]]) & (x[pair[1:]] == x[pair[:-1]])
    order, q = order[~again], q[~again]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return order[place < k]


def _found(queries: np.ndarray, asked: np.ndarray, own: np.ndarray, rows: _Distinct, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k nearest to each of ``queries``, numbered as in ``asked``; its own id is left out.

    ``bound``: scores below which a query needs none.
    """
    none = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    if not len(queries) or not len(rows.points):
        return none
    rough = queries @ rows.points.T
    least = np.full(len(queries), -np.inf) if bound is None else bound.copy()
    if rough.shape[1] > k + 1:
        least = np.maximum(least, np.partition(rough, -(k + 1), axis=1)[:, -(k + 1)])
    # Rough sums may differ from those in order by their rounding.
    at, point = np.nonzero(rough >= (least - 1e-9 * (1 + np.abs(rough).max(1)))[:, None])
    score = _scores(queries[at], rows.points[point])
    if bound is not None:
        at, point, score = (x[score >= bound[at]] for x in (at, point, score))
    size = rows.count[point]
    pair = np.repeat(np.arange(len(at)), size)
    ids = rows.ids[np.repeat(rows.first[point] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    other = ids != own[at[pair]]
    pair, ids = pair[other], ids[other]
    return asked[at[pair]], ids, score[pair]


_NEAR = "query_id long, vec_id long, score double"
_FIELDS = ["query_id", "vec_id", "score"]


def _table(query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], _FIELDS)


def _brute(width: int, held, k: int) -> Callable:
    """The k nearest of a task's rows to each broadcast query, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = held.value
        best = tuple(np.zeros(0, kind) for kind in (int, int, float))
        for batch in batches:
            rows = _Distinct.of(batch.column("vec_id").to_numpy(), matrix(batch.column("v"), width), k + 1)
            found = _found(queries, ids, ids, rows, k)
            best = tuple(np.concatenate(x) for x in zip(best, found, strict=True))
            keep = _best(*best, k)
            best = tuple(x[keep] for x in best)
        yield from _table(*best).to_batches()

    return run


def nearest_of(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query's finds, an id once, ties to the smaller id."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: DataFrame, width: int, queries: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """Exact ``nearest_of`` for a bounded set of queries (ids, vectors) against all rows (vec_id, v)."""
    held = rows.sparkSession.sparkContext.broadcast(queries)
    return nearest_of(rows.mapInArrow(_brute(width, held, k), _NEAR), k)


def _valid(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & finite("v")).where(F.exists("v", lambda x: x != 0)).select("vec_id", F.col("v").cast("array<double>").alias("v"))


def _drawn(rows: DataFrame, wanted: int, n: int, seed: int) -> DataFrame:
    """About ``wanted`` of n rows, by a hash of the id; all if there are no more."""
    return rows if n <= wanted else rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 40)) < F.lit(int(wanted / n * (1 << 40))))


def _arrays(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a bounded table, on the driver."""
    got = rows.select("vec_id", "v").orderBy("vec_id", "v").toArrow()
    return got["vec_id"].to_numpy(), matrix(got["v"], width)


def _placed(width: int, held) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = held.value.put(matrix(batch.column("v"), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], [*batch.schema.names, "leaf"])

    return run


def bins(sizes: np.ndarray, bin_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First bin of each leaf, and over how many bins its rows are dealt; neighbouring small leaves share one."""
    first, parts, now, held = np.zeros(len(sizes), int), np.ones(len(sizes), int), 0, 0
    for leaf, rows in enumerate(sizes.tolist()):
        if held and held + rows > bin_rows:
            now, held = now + 1, 0
        first[leaf] = now
        held += rows
        if rows > bin_rows:
            parts[leaf] = -(-rows // bin_rows)
            now, held = now + int(parts[leaf]), 0
    return first, parts


def _needed(width: int, held) -> Callable:
    """For each true neighbour of a query, how many leaves are visited until its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = held.value
        for batch in batches:
            points = matrix(batch.column("v"), width)
            out = []
            for point, leaves in zip(points, batch.column("leaves").to_pylist(), strict=True):
                open_, place = set(leaves), {}
                for i, leaf in enumerate(tree.visits(point), 1):
                    if leaf in open_:
                        place[leaf] = i
                        open_.discard(leaf)
                        if not open_:
                            break
                out += [place[x] for x in leaves]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], ["visits"])

    return run


ASKED = "bin long, query_id long, v binary, leaves array<int>, near boolean"


def _asked(width: int, held, visits: int, least: int) -> Callable:
    """A row for each query and bin with leaves that the query visits; visits go on until these hold ``least`` rows.

    near: the bin of the first leaf, whose rows tell what a farther one must beat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, first, parts, sizes = held.value
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                points = matrix(part.column("v"), width)
                query, bin_, leaves, near = [], [], [], []
                for i, point in enumerate(points):
                    own: dict[int, list[int]] = {}
                    rows = 0
                    for visit, leaf in enumerate(tree.visits(point)):
                        if visit >= visits and rows >= least:
                            break
                        rows += int(sizes[leaf])
                        for x in range(parts[leaf]):
                            own.setdefault(int(first[leaf]) + x, []).append(leaf)
                    query += [i] * len(own)
                    bin_ += own.keys()
                    leaves += own.values()
                    near += [x == 0 for x in range(len(own))]
                at = np.array(query, int)
                yield pa.RecordBatch.from_arrays([pa.array(bin_, pa.int64()), part.column("vec_id").take(pa.array(at)), packed(points[at]), pa.array(leaves, pa.list_(pa.int32())), pa.array(near, pa.bool_())], ["bin", "query_id", "v", "leaves", "near"])

    return run


def _searched(width: int, k: int, most: int = 512) -> Callable:
    """One bin's rows and the queries that visit it, ``most`` queries at a time."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        points = np.frombuffer(b"".join(left["v"].to_pylist()), np.float64).reshape(-1, width)
        ids, leaf = left["vec_id"].to_numpy(), left["leaf"].to_numpy()
        by = np.argsort(leaf, kind="stable")
        edges = np.flatnonzero(np.diff(leaf[by], prepend=-1))
        held = {int(leaf[rows[0]]): _Distinct.of(ids[rows], points[rows], k + 1) for rows in np.split(by, edges[1:])}
        out = []
        for start in range(0, right.num_rows, most):
            part = right.slice(start, most)
            queries = np.frombuffer(b"".join(part["v"].to_pylist()), np.float64).reshape(-1, width)
            own, bound = part["query_id"].to_numpy(), part["bound"].to_numpy()
            asked: dict[int, list[int]] = {}
            for i, leaves in enumerate(part["leaves"].to_pylist()):
                for x in leaves:
                    asked.setdefault(x, []).append(i)
            best = tuple(np.zeros(0, kind) for kind in (int, int, float))
            found = []
            for x, rows in held.items():
                if at := asked.get(x):
                    at = np.array(at)
                    found.append(_found(queries[at], own[at], own[at], rows, k, bound[at]))
                    if sum(len(f[0]) for f in found) > 200_000:
                        best = _merged([best, *found], k)
                        found = []
            out.append(_merged([best, *found], k))
        return _table(*(np.concatenate(x) for x in zip(*out, strict=True)))

    return run


def _merged(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    whole = tuple(np.concatenate(x) for x in zip(*found, strict=True))
    keep = _best(*whole, k)
    return tuple(x[keep] for x in whole)


@dataclass
class Index:
    """All rows in leaves of a tree (vec_id, v, leaf); sizes: rows of each leaf."""

    rows: DataFrame
    tree: Tree | None
    width: int
    sizes: np.ndarray

    @staticmethod
    def build(embeddings: DataFrame, scratch: Scratch, leaf_rows: int = LEAF_ROWS) -> Index:
        spark = embeddings.sparkSession
        rows = _valid(embeddings)
        width = usual_width(rows, "v")
        rows = rows.where(F.size("v") == width)
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("greatest")).first()
        if not seen["n"]:
            return Index(rows.withColumn("leaf", F.lit(0)), None, width, np.zeros(1, int))
        sample = _arrays(_drawn(rows, SAMPLE, seen["n"], 1), width)[1]
        leaves = int(min(MOST_LEAVES, max(1, seen["n"] // leaf_rows), max(1, len(sample) // 4)))
        tree = Tree.fit(sample if len(sample) else np.zeros((1, width)), seen["greatest"], leaves)
        placed = scratch.spill(rows.mapInArrow(_placed(width, spark.sparkContext.broadcast(tree)), "vec_id long, v array<double>, leaf int"), "leaves")
        sizes = np.zeros(tree.leaves, int)
        for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # at most MOST_LEAVES rows
            sizes[r["leaf"]] = r["n"]
        return Index(placed, tree, width, sizes)

    def calibrated(self, queries: DataFrame, k: int, recall: float) -> int:
        """Visits at which the leaves visited hold ``recall`` of the true neighbours of CALIBRATION queries.

        Visits double until that is reached, then the least such number between the last two is taken.
        """
        spark = self.rows.sparkSession
        some = _drawn(queries, CALIBRATION, queries.count(), 2)
        held = _arrays(some, self.width)
        if not len(held[0]):
            return self.tree.leaves
        true = brute_force(self.rows.select("vec_id", "v"), self.width, held, k)
        # At most CALIBRATION x k pairs and as many rows: both are sent along.
        leaf = self.rows.select("vec_id", "leaf").join(F.broadcast(true.select("query_id", "vec_id")), "vec_id")
        leaf = leaf.groupBy("query_id").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
        asked = some.join(leaf, some["vec_id"] == leaf["query_id"]).select("v", "leaves")
        need = np.array(asked.mapInArrow(_needed(self.width, spark.sparkContext.broadcast(self.tree)), "visits int").toArrow()["visits"])
        if not len(need):
            return 1
        wide = 1
        while (need <= wide).mean() < recall:
            wide *= 2
        return next(v for v in range(wide // 2 + 1, wide + 1) if (need <= v).mean() >= recall)

    def search(self, queries: DataFrame, k: int, visits: int, scratch: Scratch, bin_rows: int = BIN_ROWS) -> DataFrame:
        """query_id, rank, vec_id, score of queries (vec_id, v) over ``visits`` leaves each, more where they hold too few rows.

        A query meets its nearest bin first; the k-th score found there goes along to the other bins, which bring only
        what reaches it.
        """
        spark = self.rows.sparkSession
        first, parts = bins(self.sizes, bin_rows)
        spread = F.pmod(F.xxhash64("vec_id"), F.element_at(F.lit(parts.tolist()), F.col("leaf") + 1))
        dealt = self.rows.select((F.element_at(F.lit(first.tolist()), F.col("leaf") + 1) + spread).cast("long").alias("bin"), "vec_id", "leaf", "v")
        dealt = dealt.mapInArrow(_packed(self.width), "bin long, vec_id long, leaf int, v binary")
        held = spark.sparkContext.broadcast((self.tree, first, parts, self.sizes))
        asked = scratch.spill(queries.select("vec_id", "v").mapInArrow(_asked(self.width, held, visits, k + 1), ASKED), "asked")
        near = scratch.spill(self._met(dealt, asked.where("near").withColumn("bound", F.lit(float("-inf"))), k), "near")
        kth = nearest_of(near, k).where(F.col("rank") == k).select(F.col("query_id").alias("_query"), F.col("score").alias("bound"))
        other = asked.where("not near").join(kth, F.col("query_id") == F.col("_query"), "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        return nearest_of(near.unionByName(self._met(dealt, other, k)), k)

    def _met(self, dealt: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """Finds of queries in their bins. A group is a bin's rows, at most about bin_rows, with at most about QUERY_ROWS of its queries."""
        asked = asked.select("bin", "query_id", "v", "leaves", "bound")
        chunks = asked.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("chunks"))
        dealt = dealt.join(chunks, "bin").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        asked = asked.join(chunks.select("bin", F.col("chunks").alias("over")), "bin")
        asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("over")).cast("int"))
        return dealt.groupBy("bin", "chunk").cogroup(asked.groupBy("bin", "chunk")).applyInArrow(_searched(self.width, k), _NEAR)


def _packed(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed(matrix(batch.column("v"), width))], batch.schema.names)

    return run


def is_query(every: int) -> Column:
    return F.col("vec_id") % every == 0


def neighbours(embeddings: DataFrame, k: int = 20, every: int = 20, recall: float = RECALL, leaf_rows: int = LEAF_ROWS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest inner product found for each query.

    Queries are the rows whose vec_id ``every`` divides; candidates are all rows with another vec_id than the
    query's. score is the inner product of the original vectors in doubles, summed in order; ties go to the smaller
    vec_id. Visits go on until their leaves hold k + 1 rows, so a table of fewer candidates gives them all.

    Rows with a null vec_id take no part, nor do vectors that are null, empty, zero, hold a null or non-finite
    component or have another length than the most frequent one. Rows that repeat a vec_id are one candidate, with
    the best score of its vectors, and one query, with the least vector. An empty table gives an empty result. Other
    columns are ignored.
    """
    scratch = Scratch()
    index = Index.build(embeddings, scratch, leaf_rows)
    if index.tree is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = index.rows.where(is_query(every)).groupBy("vec_id").agg(F.min("v").alias("v"))
    # A walk through the tree takes milliseconds: few queries to a task.
    queries = scratch.spill(asked.repartition(-(-int(index.sizes.sum()) // (every * TOGETHER)), "vec_id"), "queries")
    return index.search(queries, k, index.calibrated(queries, k, recall), scratch, bin_rows)
