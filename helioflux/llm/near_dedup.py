"""MinHash near-dedup with SuperMinHash signatures, banding, exact verification and union-find grouping.

1. One pass over whole texts gives each document its shingle-set size, a 128-bit digest of the set and band
   keys of its SuperMinHash signature. Equal digests are exact classes: they link without comparison, and one
   member of each goes on.
2. A band key that several documents share is a bucket. Each bucket's pivot is the member that shares most
   buckets; members are compared with it alone, which is linear in the bucket.
3. Verified links give components. Where a bucket still spans components, the members outside its largest
   component are compared with one member of it, drawn by hash for each bucket and round: a member shares many
   buckets with a large group, so it meets as many of its members. This too is linear in the bucket.
4. Members of buckets that span components even then are held against a reference set of the bucket's largest
   component. With D(x) the symmetric difference of x and the reference, x and y differ in |D(x)| + |D(y)| -
   2 |D(x) & D(y)| shingles exactly, so similarity t asks for a least overlap of the differences. Where none is
   asked, both members link with the member of the group that has the least |D| for its size, and only that link
   is checked. Elsewhere a prefix filter (Chaudhuri et al., 2006) over the differences, rarest elements first,
   finds every pair with the overlap. What thousands of members share is in no difference and makes no pair. An
   element of few differences makes pairs of rows. One of many names pairs of blocks of members; a task counts
   the overlaps between two blocks exactly and gives out one link of each two components. No link between
   bucket members is lost, though that last comparison still grows with the square of a group's open members.
5. A link counts only when the whole shingle sets, rebuilt from the texts, pass the threshold in integers.

All pairs of a bucket are never emitted. With 32 bands of 4 rows a pair of similarity 0.8 misses all bands with
probability 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import superminhash
from .components import components
from .store import Scratch, spill
from .textblocks import SPACED, blocks, mix, shingle_sets

SLOTS, ROWS = 128, 4
#: Members, in expectation, that vote on a group's reference set; links don't depend on it
DRAWN = 31
#: Elements of at most so many differences make pairs of rows; blocks of so many members, in expectation, are compared for the rest
RARE, BLOCK = 16, 128
_SIGNED = "n_shingles long, set_hi long, set_lo long, bands array<long>"


def _signer(k: int, slots: int, rows: int, with_text: bool = False):
    salts = mix(np.arange(1, slots // rows + 1, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                values, at = shingle_sets(block, SPACED, k)
                sizes = np.diff(at)
                keys = superminhash.signatures(values, at, slots).reshape(block.n, slots // rows, rows)
                band = np.broadcast_to(salts, keys.shape[:2]).copy()
                for r in range(rows):
                    band = mix(band ^ keys[:, :, r])
                band = band[sizes > 0].reshape(-1).view(np.int64)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
                other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values))])
                ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(sizes > 0, slots // rows, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(band), mask=pa.array(sizes == 0))
                digest = [mix(x[at[1:]] - x[at[:-1]]).view(np.int64) for x in (total, other)]
                last = (batch.column(1).slice(block.first, block.n), "text") if with_text else (lists, "bands")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.array(sizes), pa.array(digest[0]), pa.array(digest[1]), last[0]], ["doc_id", "n_shingles", "set_hi", "set_lo", last[1]])

    return sign


def sign(docs: DataFrame, k: int = 4, slots: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_hi, set_lo, bands) of documents (doc_id long, text); bands is null for an empty set."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_signer(k, slots, rows), f"doc_id long, {_SIGNED}")


def _verifier(k: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, np.ndarray] | None = None
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            left, right = batch.column(2), batch.column(3)
            inter, union = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for block in blocks(right):
                values, at = shingle_sets(block, SPACED, k)
                for d in range(block.n):
                    i = block.first + d
                    if held is None or held[0] != ids[i]:
                        held = (ids[i], shingle_sets(next(blocks(left.slice(i, 1))), SPACED, k)[0])
                    mine, theirs = held[1], values[at[d] : at[d + 1]]
                    if len(mine) < len(theirs):
                        mine, theirs = theirs, mine
                    if len(theirs):
                        where = np.searchsorted(mine, theirs)
                        where[where == len(mine)] = 0
                        inter[i] = np.count_nonzero(mine[where] == theirs)
                    union[i] = len(mine) + len(theirs) - inter[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inter), pa.array(union)], ["a", "b", "n_both", "n_any"])

    return verify


def verified(pairs: DataFrame, docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets have 100 * intersection >= percent * union, with n_both and n_any.

    docs holds each doc_id once.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = pairs.select("a", "b").join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_verifier(k), "a long, b long, n_both long, n_any long").where(f"n_both > 0 and 100 * n_both >= {percent} * n_any")


def _open(members: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (key, id, n) of buckets that span components, with component and the bucket's largest, main."""
    label = components(links, scratch=scratch)
    labelled = members.select("key", "id", "n").join(label.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = scratch.spill(labelled, "labelled")
    parts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    main = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", (-F.col("component")).alias("minus"))).alias("top"))
    return scratch.spill(labelled.join(main.where("parts > 1").select("key", (-F.col("top.minus")).alias("main")), "key"), "open")


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                values, at = shingle_sets(block, SPACED, k)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), lists], ["id", "shingles"])

    return run


#: Rows of a group that share a salt: a group's rows meet what is known of the group in so many at a time
SALT_ROWS, SALTS = 1000, 32


def _salted(held: DataFrame) -> DataFrame:
    """held (main, id, ..) with salts, the number of a group's salts, and each row's own; only large groups have several."""
    counted = held.groupBy("main").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > SALT_ROWS)
    spread = counted.select("main", F.ceil(F.col("c") / SALT_ROWS).cast("int").alias("salts"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    met = held.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(spread, ["main", "_s"], "left").drop("_s")
    met = met.withColumn("salts", F.coalesce("salts", F.lit(1)))
    return met.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.col("salts")).cast("int"))


def _dealt(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """rows (main, salt, ..) with their group's columns; groups (main, salts, ..) has one row a group."""
    return rows.join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"), ["main", "salt"], how)


def _references(held: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(main, salts, ref): shingles of most of some DRAWN members of each main component.

    Any reference gives the same links; one near the members gives short differences.
    """
    inside = held.where("component = main").select("main", "salts", "salt", "id")
    counted = inside.groupBy("main").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first"), F.first("salts").alias("salts"))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) * F.col("c") < DRAWN * (1 << 30)
    drawn = scratch.spill(_dealt(inside.drop("salts"), counted).where(draw | (F.col("id") == F.col("first"))).select("main", "id"), "drawn")
    total = drawn.groupBy("main").agg(F.count(F.lit(1)).alias("total"))
    # Each draw carries its group's total, so shingles needn't meet it by group.
    some = scratch.spill(drawn.join(total, "main"), "drawn")
    uses = some.join(sets, "id").select("main", "total", F.explode("shingles").alias("shingle")).groupBy("main", "total", "shingle").agg(F.count(F.lit(1)).alias("uses"))
    refs = uses.where("2 * uses > total").groupBy("main").agg(F.collect_list("shingle").alias("ref"))
    return refs.join(counted.select("main", "salts"), "main")


def _comparer(percent: int, columns: int = 4096):
    def members(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        held = column[i].values
        delta = held.field("delta")
        ids, parts, w = (held.field(f).to_numpy(zero_copy_only=False) for f in ("id", "component", "w"))
        return ids, parts, w, delta.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ids)), pc.list_value_length(delta).to_numpy(zero_copy_only=False))

    def overlaps(mine: np.ndarray, of: np.ndarray, theirs: np.ndarray, their_of: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """Sizes of intersections of every set here with every set there, some columns of elements at a time."""
        out = np.zeros(shape, np.float32)
        both = np.intersect1d(mine, theirs)
        for k in range(0, len(both), columns):
            some = both[k : k + columns]
            sides = []
            for values, rows, n in ((mine, of, shape[0]), (theirs, their_of, shape[1])):
                at = np.minimum(np.searchsorted(some, values), len(some) - 1)
                here = some[at] == values
                side = np.zeros((n, len(some)), np.float32)
                side[rows[here], at[here]] = 1
                sides.append(side)
            out += sides[0] @ sides[1].T
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, parts, w, values, of = members(batch.column(0), i)
                their_ids, their_parts, their_w, their_values, their_of = members(batch.column(1), i)
                n_both = overlaps(values, of, their_values, their_of, (len(ids), len(their_ids))).astype(np.int64)
                near = (2 * (100 + percent) * n_both >= w[:, None] + their_w[None, :]) & (parts[:, None] != their_parts[None, :])
                x, y = np.nonzero(near)
                # One link is enough between two components.
                _, first = np.unique(np.stack([parts[x], their_parts[y]]), axis=1, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[x[first]]), pa.array(their_ids[y[first]])], ["a", "b"])

    return compare


def _differing(open_: DataFrame, text: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of open members of different components that their differences from a reference can't rule out."""
    ids = open_.select(F.col("id").alias("doc_id")).distinct()
    sets = scratch.spill(text.join(ids, "doc_id").select("doc_id", "text").mapInArrow(_sets(k), "id long, shingles array<long>"), "sets")
    held = scratch.spill(_salted(open_.select("main", "id", "component").distinct()), "held")
    ref = F.coalesce("ref", F.array().cast("array<long>"))
    delta = F.concat(F.array_except("shingles", ref), F.array_except(ref, F.col("shingles")))
    near = _dealt(held.join(sets, "id"), _references(held, sets, scratch), "left").select("main", "salts", "salt", "id", "component", F.size("shingles").cast("long").alias("n"), delta.alias("delta"))
    near = near.withColumn("d", F.size("delta").cast("long")).withColumn("w", (100 + percent) * F.col("d") - (100 - percent) * F.col("n"))
    near = scratch.spill(near, "differences")

    least = near.groupBy("main").agg(F.min(F.struct("w", "id", "component")).alias("least"), F.first("salts").alias("salts"))
    near = _dealt(near, least.select("main", "salts", F.col("least.w").alias("w0"), F.col("least.id").alias("o"), F.col("least.component").alias("co")))
    stars = near.where("w + w0 <= 0 and component <> co").select(F.col("id").alias("a"), F.col("o").alias("b"))

    share = F.greatest(F.ceil((F.col("w") + F.col("w0")) / (2 * (100 + percent))), F.lit(1))
    rows = near.select("main", "salts", "salt", "id", "component", "n", "d", (F.col("d") - share + 1).alias("length"), F.explode("delta").alias("element"))
    uses = rows.groupBy("main", "element").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")
    # Elements of one difference alone take the first places of a prefix and join with nothing.
    of = Window.partitionBy("main", "id")
    common = rows.join(uses, ["main", "element"]).withColumn("place", F.row_number().over(of.orderBy("uses", "element")) + F.col("d") - F.count(F.lit(1)).over(of))
    heads = scratch.spill(common.where("place <= length").select("main", "salts", "salt", "element", "uses", "id", "component", "n"), "heads")

    # A rare element makes fewer than RARE pairs a member.
    rare = heads.where(F.col("uses") <= RARE)
    x, y = (rare.select("main", "element", F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("component").alias(f"c{s}")) for s in ("a", "b"))
    pairs = x.join(y, ["main", "element"]).where("ca <> cb and a < b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    # A frequent one names pairs of blocks, which are compared inside a task.
    sizes = near.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"), F.first("salts").alias("salts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")
    named = _dealt(heads.where(F.col("uses") > RARE).drop("salts"), sizes).select("main", "element", part).distinct()
    met = named.join(named.withColumnRenamed("part", "other"), ["main", "element"]).where("part <= other").select("main", "part", "other").distinct()
    packed = _dealt(near.drop("salts"), sizes).groupBy("main", part).agg(F.collect_list(F.struct("id", "component", "w", "delta")).alias("held"))
    packed = scratch.spill(packed, "blocks")
    both = met.join(packed, ["main", "part"]).join(packed.select("main", F.col("part").alias("other"), F.col("held").alias("held_too")), ["main", "other"])
    linked = both.select("held", "held_too").mapInArrow(_comparer(percent), "a long, b long")
    return stars.unionByName(pairs.select("a", "b")).unionByName(linked).distinct()


#: Rows that share a doc_id but not their set get nodes of their own from here on
_TWINS = 1 << 62


def _noded(rows: DataFrame, twins: DataFrame) -> DataFrame:
    """rows (doc_id, set_hi, set_lo, ..) with id: doc_id, or a node of its own for each set where a doc_id has several."""
    own = F.lit(_TWINS) + F.pmod(F.xxhash64("doc_id", "set_hi", "set_lo"), F.lit(_TWINS))
    return rows.join(twins.withColumn("_twin", F.lit(True)), "doc_id", "left").withColumn("id", F.when(F.col("_twin"), own).otherwise(F.col("doc_id"))).drop("_twin")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, slots: int = SLOTS, rows: int = ROWS, rounds: int = 1) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least doc_id reachable over links), kept.

    docs has doc_id (below 2**62) and text; other columns are ignored. Null and empty texts, and texts without a
    word, have no shingles and link with nothing. Rows with a null doc_id link with nothing: component_id is null
    and they are kept. Rows that share a doc_id belong together, and every one of their texts links. An empty
    table gives an empty result.
    """
    scratch = Scratch()
    signed = spill(sign(docs, k, slots, rows), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    spots = full.groupBy("doc_id").agg(F.min(F.struct("set_hi", "set_lo")).alias("x"), F.max(F.struct("set_hi", "set_lo")).alias("y"))
    twins = scratch.spill(spots.where("x <> y").select("doc_id"), "twins")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with_twins = not twins.isEmpty()
    full = _noded(full, twins) if with_twins else full.withColumn("id", F.col("doc_id"))
    classes = full.groupBy("set_hi", "set_lo", "n_shingles").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a <> last")
    exact = full.select("set_hi", "set_lo", "n_shingles", F.col("id").alias("b")).join(classes, ["set_hi", "set_lo", "n_shingles"]).where("a <> b").select("a", "b").distinct()
    exact = scratch.spill(exact, "exact")
    firsts = full.join(exact.select(F.col("b").alias("id")), "id", "left_anti")
    keyed = firsts.select(F.explode("bands").alias("key"), "id", F.col("n_shingles").alias("n")).distinct() if with_twins else firsts.select(F.explode("bands").alias("key"), "id", F.col("n_shingles").alias("n"))
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = scratch.spill(keyed.join(crowded, "key"), "members")

    # Pivots: in each bucket the member that meets most others, the least id among equals.
    met = members.groupBy("id").agg(F.sum(F.col("size") - 1).alias("met"))
    ranked = members.select("key", "id").join(met, "id")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("a"))
    stars = members.select("key", F.col("id").alias("b"), "n").join(pivots, "key").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    if with_twins:
        of_twins = text.join(twins, "doc_id").mapInArrow(_signer(k, slots, rows, True), "doc_id long, n_shingles long, set_hi long, set_lo long, text string")
        text = text.join(twins, "doc_id", "left_anti").unionByName(_noded(of_twins, twins).select(F.col("id").alias("doc_id"), "text"))
    text = scratch.spill(text.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.first("text").alias("text")), "texts")
    links = scratch.spill(verified(stars, text, k, percent).select("a", "b"), "links")

    # What the stars left apart meets members of the main component, drawn anew for each bucket and round.
    open_ = _open(members, links, scratch)
    for turn in range(rounds):
        draw = F.max(F.struct(F.xxhash64("key", "id", F.lit(turn)).alias("draw"), "id"))
        main = open_.where("component = main").groupBy("key").agg(draw.alias("top")).select("key", F.col("top.id").alias("a"))
        met = open_.where("component <> main").select("key", F.col("id").alias("b")).join(main, "key").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
        links = scratch.spill(links.unionByName(verified(met, text, k, percent).select("a", "b")), "links")
        open_ = _open(open_.select("key", "id", "n"), links, scratch)

    near = _differing(open_, text, k, percent, scratch)
    more = verified(scratch.spill(near, "near"), text, k, percent).select("a", "b")
    edges = links.unionByName(exact).unionByName(more)
    if with_twins:
        edges = edges.unionByName(full.where("id <> doc_id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    label = components(edges)
    scratch.clear()

    out = signed.select("doc_id", "n_shingles").join(label.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
