"""Benchmark decontamination by suffix arrays over the training text.

A shard is a block of whole documents. Its words become an integer sequence with a separator between
documents, and a word-level suffix array of that sequence is built by prefix doubling, which sorts only
suffixes that are still tied (Larsson and Sadakane, 2007). The suffixes of the benchmark items that differ in
their first w words are then binary-searched in the array: the range of suffixes that share those words holds all
occurrences of that window. An occurrence counts only when a 64-bit hash of all its words agrees too. Ranges of
different windows of one length don't overlap, so occurrences are at most as many as words, however often a text
repeats itself; they are never paired with the places of their window in the items.

Which items have a window is kept once for all windows of the same items, so a document meets each such set once.
A match at a word goes on for as long as some item does: the occurrence is searched in a suffix array of the items,
between the suffixes of its window, and the longer of the common prefixes with its neighbours there is its length.
Matches that lie inside another one are left out, so they are as many as words at most.

Documents are never shuffled. The test suffixes go along in blocks of ``block_mb`` of item text, at most
``group_mb`` of them in one broadcast: one map over the corpus for the usual benchmark. A larger one is searched
group by group, each pass adding its matches to the documents' rows, so the size of a broadcast doesn't grow.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import spill, whole_row
from .textblocks import ALNUM, PLACES, Block, Words, blocks, mix, powers, sequence_hashes, span_hashes, words

WINDOW = 13
_SHARD_BYTES = 4 << 20
_BREAK = np.uint32(0)


def _symbols(hashes: np.ndarray) -> np.ndarray:
    """Word hashes as 32-bit symbols; 0 is the separator."""
    return np.maximum((hashes >> np.uint64(32)).astype(np.uint32), np.uint32(1))


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols (at least); beyond that ties stay in any order.

    The sequence reads as if followed by separators.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, dtype=np.int64)
    second = np.concatenate([symbols[1:], np.array([_BREAK])]).astype(np.uint64)
    key = (symbols.astype(np.uint64) << np.uint64(32)) | second
    order = np.argsort(key)
    ordered = key[order]
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    reach = 2
    while reach < depth:
        # Places whose group has several suffixes; groups are contiguous in the order.
        last = np.empty(n, dtype=bool)
        last[-1] = True
        last[:-1] = new[1:]
        tied = np.flatnonzero(~(new & last))
        if not len(tied):
            break
        at = order[tied]
        ahead = at + reach
        beyond = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[at]
        key = (group.astype(np.uint64) << np.uint64(32)) | beyond.astype(np.uint64)
        by = np.argsort(key)
        order[tied] = at[by]
        key = key[by]
        step = np.empty(len(tied), dtype=bool)
        step[0] = True
        np.not_equal(key[1:], key[:-1], out=step[1:])
        new[tied] = step
        rank[order[tied]] = np.maximum.accumulate(np.where(step, tied, 0))
        reach *= 2
    return order


@dataclass
class Tests:
    """A block of items: their words in one row, a query for each different window, and the suffix array of all."""

    items: list[str]
    symbols: np.ndarray
    hashes: np.ndarray
    #: where the item of each word ends
    end: np.ndarray
    order: np.ndarray
    #: of each query: a place, its words, the hash of its window, and the set of items that have it
    start: np.ndarray
    window: np.ndarray
    key: np.ndarray
    owner: np.ndarray
    #: members of each set of items
    owners: list[np.ndarray]
    #: of each query: the range of suffixes that start with its window
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(items: list[str], texts: list[str | None], w: int) -> Tests:
        table = pa.array([t or "" for t in texts], pa.large_string())
        block = next(blocks(table, limit=1 << 62)) if len(texts) else Block(0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64))
        at = words(block, ALNUM)
        hashes = span_hashes(block.data, at.start, at.end, fold=True)
        counts = at.counts
        item = np.repeat(np.arange(len(items)), counts)
        # A separator follows each item, here as in the training text, so a suffix ends with its item.
        symbols, place = _broken(hashes, at)
        end = np.zeros(len(symbols), np.int64)
        end[place] = place + at.doc[1:][item] - np.arange(len(hashes))
        wide = np.zeros(len(symbols), np.uint64)
        wide[place] = hashes
        order = suffix_array(symbols, int(counts.max(initial=0)) + 1)
        key, first = sequence_hashes(hashes, at.doc, w)
        size = np.minimum(w, counts[item[first]])
        _, lead, same = np.unique(np.stack([key, size.astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([same.reshape(-1), item[first]]), axis=1)
        # Sets of items are told apart by the sum of their members' hashes.
        sums = np.zeros(len(lead), np.uint64)
        np.add.at(sums, pairs[0], mix(pairs[1].astype(np.uint64) + np.uint64(1)))
        _, one, owner = np.unique(sums, return_index=True, return_inverse=True)
        bounds = np.searchsorted(pairs[0], np.arange(len(lead) + 1))
        owners = [pairs[1][bounds[k] : bounds[k + 1]] for k in one]
        start = place[first[lead]] if len(lead) else np.zeros(0, np.int64)
        out = Tests(items, symbols, wide, end, order, start, size[lead], key[lead], owner.reshape(-1), owners, np.zeros(0, int), np.zeros(0, int))
        out.low, out.high = _ranges(symbols, order, out)
        return out


def _narrow(symbols: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each range [lo, hi) whose suffixes have symbol ``want`` at ``depth``: two binary searches."""
    n = len(symbols)

    def bound(above: bool) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            at = order[mid] + depth
            here = np.where(at < n, symbols[np.minimum(at, n - 1)], _BREAK)
            right = (here <= want[live]) if above else (here < want[live])
            a[live] = np.where(right, mid + 1, a[live])
            b[live] = np.where(right, b[live], mid)
            live = live[a[live] < b[live]]
        return a

    return bound(False), bound(True)


def _ranges(symbols: np.ndarray, order: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """Of each query, the range of suffixes in ``order`` that start with its window; empty: [0, 0)."""
    live = np.arange(len(tests.start))
    low, high = np.zeros(len(live), dtype=np.int64), np.zeros(len(live), dtype=np.int64)
    lo, hi = low.copy(), np.full(len(live), len(symbols), dtype=np.int64)
    depth = 0
    while len(live):
        a, b = _narrow(symbols, order, lo, hi, depth, tests.symbols[tests.start[live] + depth])
        depth += 1
        here = a < b
        live, lo, hi = live[here], a[here], b[here]
        full = tests.window[live] == depth
        low[live[full]], high[live[full]] = lo[full], hi[full]
        live, lo, hi = live[~full], lo[~full], hi[~full]
    return low, high


def search(symbols: np.ndarray, order: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """Place and query of each occurrence of a query's window."""
    low, high = _ranges(symbols, order, tests)
    size = high - low
    at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return order[at], np.repeat(np.arange(len(size)), size)


class Prefixes:
    """Hashes of all runs of a sequence of word hashes, each from two sums."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.up, self.down = powers(len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], out=self.total[1:])

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.total[start + size] - self.total[start]) * self.down[start]


def _common(a: Prefixes, at: np.ndarray, b: Prefixes, to: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that the run of ``a`` from ``at`` shares with that of ``b`` from ``to``: at least and at most so many."""
    low, high = least.copy(), most.copy()
    while (live := np.flatnonzero(low < high)).size:
        middle = (low[live] + high[live] + 1) >> 1
        same = a.of(at[live], middle) == b.of(to[live], middle)
        low[live] = np.where(same, middle, low[live])
        high[live] = np.where(same, high[live], middle - 1)
    return low


def longest(own: Prefixes, symbols: np.ndarray, place: np.ndarray, end: np.ndarray, query: np.ndarray, tests: Tests, other: Prefixes) -> np.ndarray:
    """Words of the longest match of the text at ``place``, up to ``end``, with any item; it starts with the query's window.

    A binary search among the item suffixes of that window; the neighbours of the place found share the most words.
    """
    first, last = tests.low[query], tests.high[query]
    lo, hi, known = first.copy(), last.copy(), tests.window[query]

    def shared(live: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = tests.order[at]
        return to, _common(own, place[live], other, to, known[live], np.minimum(end[live] - place[live], tests.end[to] - to))

    while (live := np.flatnonzero(lo < hi)).size:
        middle = (lo[live] + hi[live]) >> 1
        to, size = shared(live, middle)
        # Both sequences have a separator after each text, so there is a symbol to compare.
        less = tests.symbols[to + size] < symbols[place[live] + size]
        lo[live] = np.where(less, middle + 1, lo[live])
        hi[live] = np.where(less, hi[live], middle)
    best = known.copy()
    for at in (lo - 1, lo):
        live = np.flatnonzero((at >= first) & (at < last))
        best[live] = np.maximum(best[live], shared(live, at[live])[1])
    return best


def outer(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which spans lie in no other, of several equal ones the first."""
    by = np.lexsort((-size, start))
    end = (start + size)[by]
    before = np.maximum.accumulate(end)
    kept = np.ones(len(by), bool)
    kept[1:] = end[1:] > before[:-1]
    out = np.zeros(len(by), bool)
    out[by[kept]] = True
    return out


def _broken(hashes: np.ndarray, at: Words) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with one separator after each document, and the place of each word."""
    counts = at.counts
    of = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes)) + of
    symbols = np.zeros(len(hashes) + len(counts), dtype=np.uint32)
    symbols[place] = _symbols(hashes)
    return symbols, place


#: Occurrences whose matches are measured together
_TOGETHER = 200_000


def _matches(block: Block, tests: list[Tests], w: int) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Words of each document, its longest matches (start, words), and the items that have windows in it."""
    at = words(block, ALNUM)
    hashes = span_hashes(block.data, at.start, at.end, fold=True)
    symbols, place = _broken(hashes, at)
    order = suffix_array(symbols, w)
    of = np.repeat(np.arange(block.n), at.counts)
    word_at = np.full(len(symbols) + 1, -1, dtype=np.int64)
    word_at[place] = np.arange(len(hashes))
    starts, sizes, items = [np.zeros(0, int)], [np.zeros(0, int)], [set() for _ in range(block.n)]
    own = None
    for part in tests:
        found, query = search(symbols, order, part)
        if not len(found):
            continue
        head, size = word_at[found], part.window[query]
        same = np.zeros(len(head), dtype=bool)
        for length in np.unique(size):
            pick = np.flatnonzero(size == length)
            total = np.zeros(len(pick), np.uint64)
            for j in range(length):
                total += hashes[head[pick] + j] * PLACES[j]
            same[pick] = mix(total) == part.key[query[pick]]
        head, query, found = head[same], query[same], found[same]
        for doc, owner in np.unique(np.stack([of[head], part.owner[query]]), axis=1).T.tolist():
            items[doc].update(part.items[i] for i in part.owners[owner].tolist())
        if own is None:
            wide = np.zeros(len(symbols), np.uint64)
            wide[place] = hashes
            own = Prefixes(wide)
        other, end = Prefixes(part.hashes), found + at.doc[1:][of[head]] - head
        for i in range(0, len(head), _TOGETHER):
            x = slice(i, i + _TOGETHER)
            length = part.window[query[x]].copy()
            # Only a window of w words can go on: an item of fewer is one window.
            more = np.flatnonzero(length == w)
            length[more] = longest(own, symbols, found[x][more], end[x][more], query[x][more], part, other)
            starts.append(head[x])
            sizes.append(length)
    start, size = np.concatenate(starts), np.concatenate(sizes)
    kept = outer(start, size)  # matches of different documents are apart, so none holds another's
    start, size = start[kept], size[kept]
    by = np.argsort(start)
    start, size = start[by], size[by]
    bounds = np.searchsorted(start, at.doc)
    local = start - at.doc[of[start]]
    matches = [list(zip(local[a:b].tolist(), size[a:b].tolist(), strict=True)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return at.counts, matches, items


_MATCHES = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())]))
MATCHES, ITEMS = "array<struct<start long, n_words long>>", "array<string>"
_BUILT: dict[str, list[Tests]] = {}


def _tests(held, name: str, w: int) -> list[Tests]:
    """The queries of a broadcast, made once in a worker process."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = [Tests.of(items, texts, w) for items, texts in held.value]
    return _BUILT[name]


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    """A list column of integer pairs, or of strings."""
    at = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(x) for x in values], out=at[1:])
    flat = [y for x in values for y in x]
    if pa.types.is_string(kind.value_type):
        return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.string()))
    pairs = np.array(flat, np.int64).reshape(-1, 2)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], fields=list(kind.value_type)))


def _finder(held, name: str, w: int):
    """Adds _n_words, _matches and _items to rows; what earlier passes found is kept."""
    made = ("_n_words", "_matches", "_items")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = _tests(held, name, w)
        for batch in batches:
            text, before, known = (batch.column(batch.schema.get_field_index(c)) for c in ("_text", "_matches", "_items"))
            others = [i for i, c in enumerate(batch.schema.names) if c not in made]
            for block in blocks(text, _SHARD_BYTES):
                n_words, matches, items = _matches(block, tests, w)
                for i, (old, names) in enumerate(zip(before.slice(block.first, block.n), known.slice(block.first, block.n), strict=True)):
                    if old.as_py():
                        both = np.array([*((m["start"], m["n_words"]) for m in old.as_py()), *matches[i]], np.int64)
                        matches[i] = sorted(map(tuple, both[outer(both[:, 0], both[:, 1])].tolist()))
                    items[i].update(names.as_py() or ())
                arrays = [pa.array(n_words.astype(np.int64)), _lists(matches, _MATCHES), _lists([sorted(x) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(block.first, block.n) for i in others), *arrays], [*(batch.schema.names[i] for i in others), *made])

    return find


def _covered(matches: Column) -> Column:
    """Words inside any of the matches, which are sorted by start."""

    def add(state: Column, m: Column) -> Column:
        last = m["start"] + m["n_words"]
        more = F.greatest(F.lit(0), last - F.greatest(m["start"], state["end"]))
        return F.struct((state["total"] + more).alias("total"), F.greatest(state["end"], last).alias("end"))

    return F.aggregate(matches, F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end")), add)["total"]


def item_groups(benchmark: DataFrame, block_mb: float = 8, group_mb: float = 64) -> Iterator[list[tuple[list[str], list[str | None]]]]:
    """The benchmark's items in blocks of about ``block_mb`` of text, in groups of about ``group_mb``, one group at a time."""
    group: list[tuple[list[str], list[str | None]]] = []
    held = filled = 0.0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("text")).where("item_id is not null").orderBy("i", "text").toLocalIterator():
        more = len((row["text"] or "").encode())
        if group and held + more > group_mb * 1e6:
            yield group
            group, held, filled = [], 0.0, 0.0
        if not group or filled + more > block_mb * 1e6:
            group.append(([], []))
            filled = 0.0
        group[-1][0].append(row["i"])
        group[-1][1].append(row["text"])
        held, filled = held + more, filled + more
    yield group


def _judged(rows: DataFrame, benchmark: DataFrame, w: int, share: int, group_mb: float) -> DataFrame:
    """rows (row, text) with n_words, matches, n_hit, items and contaminated."""
    spark = rows.sparkSession
    rows = rows.select("row", F.col("text").cast("string").alias("_text"), F.lit(None).cast("long").alias("_n_words"), F.lit(None).cast(MATCHES).alias("_matches"), F.lit(None).cast(ITEMS).alias("_items"))
    for i, group in enumerate(item_groups(benchmark, group_mb=group_mb)):
        if i:
            rows = spill(rows, "matches")
        rows = rows.mapInArrow(_finder(spark.sparkContext.broadcast(group), uuid.uuid4().hex, w), rows.schema)
    out = rows.select("row", F.col("_n_words").alias("n_words"), F.col("_matches").alias("matches"), F.array_sort("_items").alias("items"))
    out = out.withColumn("n_hit", _covered(F.col("matches")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, w: int = WINDOW, share: int = 20, group_mb: float = 64) -> DataFrame:
    """Per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, matches, items.

    A document word is hit inside any occurrence of a window of w consecutive item words (an item of fewer
    words, but not none, is one window); contaminated: n_hit > 0 and share * n_hit >= n_words.
    matches: the longest verbatim matches with items, by first word in the document (from 0) and words; a match holds
    a window, and those inside another match are left out. longest_match: words of the longest, 0 without. items: the
    ids of items with occurring windows, sorted. All are at most as long as the text and the list of items, also
    where document and item repeat one word without end.

    Null and empty texts have no words and are never contaminated. Items without words, with a null text or a
    null item_id match nothing; rows with the same item_id count as one item. Repeated documents each get their
    row, also under a null doc_id. Empty tables are fine. Columns other than doc_id, text and item_id are ignored.
    """
    out = _judged(docs.select(F.col("doc_id").cast("long").alias("row"), "text"), benchmark, w, share, group_mb)
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0).cast("long"))
    digest = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return out.select(F.col("row").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated", longest.alias("longest_match"), "matches", "items")


def removed(docs: DataFrame, benchmark: DataFrame, w: int = WINDOW, share: int = 20, group_mb: float = 64) -> DataFrame:
    """docs' rows that aren't contaminated, with all columns whatever their names; each row is judged by its own text.

    A row with a null doc_id is judged like any other.
    """
    out = _judged(docs.select(whole_row(docs).alias("row"), "text"), benchmark, w, share, group_mb).where("not contaminated")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
