"""Secret scan: fixed patterns, and formats learned by grammar inference.

Three base patterns find credentials in every whole text. Their matches, a bounded sample by hash, are the
labelled credentials: for each kind a prefix tree of the whole strings' characters is built and its statistically
compatible states are merged (ALERGIA; Carrasco and Oncina, 1994), which gives a deterministic probabilistic
automaton. States must agree in their next characters, their ends and the lengths still to come: most states of
random keys have one string, of which next characters alone tell nothing. A character-pair model of ordinary
candidates is the background. Every candidate, a base match or a run of the labelled alphabet outside base matches
and no shorter than the shortest labelled credential, is scored by its log likelihood under each automaton, its
end included, less that under the background, per character; runs above ``least`` become further spans. Most
candidates are ordinary words: they are never written, but found again in a second pass.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, spill
from .textblocks import Block, Words, blocks, runs, span_hashes, starts_of_code_points

#: The base patterns, in the order of kinds
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # a maximal run is found whole, so shorter runs need no match
KINDS = ("assign", "access", "hex")

#: Labelled strings a kind and background strings that the models are fitted on, the first by hash
SAMPLE = 2000
LEAST = 1.0
#: Bounds of training: longer strings are no examples, and a kind's examples have so many characters together
LONGEST, CHARACTERS = 4096, 300_000


def base_spans(data: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the secret itself) in bytes of each base match in one text."""
    out = [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(data)]
    return sorted(out, key=lambda s: (s[0], s[2]))


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_CODE = np.full(256, -1, dtype=np.int64)
_CODE[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(len(_ALPHABET))
SHORTEST = 6
#: Longer candidates are scored one by one
STEPPED = 512


def candidates(block: Block, base: list[list[tuple[int, int, int, int]]]) -> Words:
    """Runs of 6 or more characters of the labelled alphabet in what base matches leave of each text."""
    inside = _CODE[block.data] >= 0
    for d, spans in enumerate(base):
        for a, b, _, _ in spans:
            inside[block.at[d] + a : block.at[d] + b] = False
    found = runs(block, inside)
    long_ = found.end - found.start >= SHORTEST
    start = found.start[long_]
    return Words(start, found.end[long_], np.searchsorted(start, block.at))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[Block, list[bytes], list[list[tuple[int, int, int, int]]]]]:
    """Each block with its texts and their base matches."""
    for block in blocks(batch.column(1)):
        data = [block.data[block.at[d] : block.at[d + 1]].tobytes() for d in range(block.n)]
        yield block, data, [base_spans(x) for x in data]


LEARNT = "kind int, secret string, hash binary"


def _first(sample: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each kind (-1: candidates) the ``sample`` first distinct strings of the partition by hash."""
        kept: dict[int, dict[bytes, int]] = {k: {} for k in range(-1, len(KINDS))}
        edge = dict.fromkeys(kept, (1 << 64) - 1)

        def add(k: int, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
            short = end - start <= LONGEST
            start, end = start[short], end[short]
            hashes = span_hashes(data, start, end, fold=False)
            near = np.flatnonzero(hashes <= np.uint64(edge[k]))
            for i in near.tolist():
                kept[k][data[start[i] : end[i]].tobytes()] = int(hashes[i])
            if len(kept[k]) > 4 * sample:
                shrink(k)

        def shrink(k: int) -> None:
            first = sorted(kept[k].items(), key=lambda x: (x[1], x[0]))[:sample]
            kept[k] = dict(first)
            if len(first) == sample:
                edge[k] = first[-1][1]

        for batch in batches:
            for block, _, base in _texts(batch):
                found = candidates(block, base)
                add(-1, block.data, found.start, found.end)
                for k in range(len(KINDS)):
                    own = [(block.at[d] + s, block.at[d] + b) for d, spans in enumerate(base) for _, b, kind, s in spans if kind == k]
                    if own:
                        spots = np.array(own, dtype=np.int64)
                        add(k, block.data, spots[:, 0], spots[:, 1])
        for k in kept:
            shrink(k)
        rows = [(k, secret.decode("ascii"), h.to_bytes(8, "big")) for k, of in kept.items() for secret, h in sorted(of.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "secret", "hash"])

    return run


@dataclass
class Automaton:
    """A deterministic probabilistic automaton; characters, ends and lengths to come are observed frequencies."""

    moves: list[dict[str, int]] = field(default_factory=list)
    seen: list[dict[str, int]] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    left: list[dict[int, int]] = field(default_factory=list)
    def tables(self, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities (state, character or end) with 0.01 added to each count, and next states.

        The last state is where no example went: all is as likely there, and nothing leaves it.
        """
        n = len(self.moves)
        logs, after = np.zeros((n + 1, alphabet + 1)), np.full((n + 1, alphabet), n, dtype=np.int64)
        counts = np.zeros((n + 1, alphabet + 1))
        for q in range(n):
            for c, k in self.seen[q].items():
                counts[q, _CODE[ord(c)]] = k
            for c, t in self.moves[q].items():
                after[q, _CODE[ord(c)]] = t
            counts[q, alphabet] = self.ends[q]
        counts += 0.01
        logs[:] = np.log(counts / counts.sum(axis=1, keepdims=True))
        return logs, after


def prefix_tree(strings: list[str]) -> Automaton:
    tree = Automaton([{}], [defaultdict(int)], [0], [defaultdict(int)])
    for s in strings:
        state = 0
        tree.left[0][len(s)] += 1
        for i, c in enumerate(s):
            tree.seen[state][c] += 1
            if c not in tree.moves[state]:
                tree.moves[state][c] = len(tree.moves)
                tree.moves.append({})
                tree.seen.append(defaultdict(int))
                tree.ends.append(0)
                tree.left.append(defaultdict(int))
            state = tree.moves[state][c]
            tree.left[state][len(s) - i - 1] += 1
        tree.ends[state] += 1
    return tree


#: A state of so many strings is taken to show all lengths to come
SETTLED = 30


def merged(tree: Automaton, alpha: float = 0.05) -> Automaton:
    """States whose futures agree within Hoeffding bounds are merged, those of most strings first."""
    n = len(tree.moves)
    moves = [dict(m) for m in tree.moves]
    seen = [dict(s) for s in tree.seen]
    left = [dict(x) for x in tree.left]
    ends = list(tree.ends)
    bound = sqrt(0.5 * log(2 / alpha))
    into = list(range(n))

    def at(q: int) -> int:
        while into[q] != q:
            into[q] = into[into[q]]
            q = into[q]
        return q

    def total(q: int) -> int:
        return ends[q] + sum(seen[q].values())

    def compatible(a: int, b: int) -> bool:
        stack, visited = [(a, b)], set()
        while stack:
            p, q = stack.pop()
            p, q = at(p), at(q)
            if p == q or (p, q) in visited:
                continue
            visited.add((p, q))
            np_, nq = total(p), total(q)
            if np_ < nq:
                p, q, np_, nq = q, p, nq, np_
            if np_ >= SETTLED and not left[q].keys() <= left[p].keys():
                return False
            limit = bound * (1 / sqrt(np_) + 1 / sqrt(nq)) if nq else 1.0
            if limit >= 1:  # so few strings differ from nothing, here and further on
                continue
            if abs(ends[p] / np_ - ends[q] / nq) > limit:
                return False
            gap = 0.0
            for x in sorted(left[p].keys() | left[q].keys()):
                gap += left[p].get(x, 0) / np_ - left[q].get(x, 0) / nq
                if abs(gap) > limit:
                    return False
            for c in seen[p].keys() | seen[q].keys():
                if abs(seen[p].get(c, 0) / np_ - seen[q].get(c, 0) / nq) > limit:
                    return False
                if c in moves[p] and c in moves[q]:
                    stack.append((moves[p][c], moves[q][c]))
        return True

    def fold(a: int, b: int) -> None:
        stack = [(a, b)]
        while stack:
            p, q = stack.pop()
            p, q = at(p), at(q)
            if p == q:
                continue
            into[q] = p
            ends[p] += ends[q]
            for mine, theirs in ((seen[p], seen[q]), (left[p], left[q])):
                for c, k in theirs.items():
                    mine[c] = mine.get(c, 0) + k
            for c, t in moves[q].items():
                if c in moves[p]:
                    stack.append((moves[p][c], t))
                else:
                    moves[p][c] = t

    red = [0]
    while True:
        reds = {at(q) for q in red}
        blue = {at(t) for q in reds for t in moves[q].values()} - reds
        if not blue:
            break
        b = max(blue, key=lambda q: (total(q), -q))
        for r in sorted(reds):
            if compatible(r, b):
                fold(r, b)
                break
        else:
            red.append(b)
    names = {q: i for i, q in enumerate(sorted({at(q) for q in red}, key=lambda q: (q != at(0), q)))}
    order = sorted(names, key=names.get)
    return Automaton([{c: names[at(t)] for c, t in moves[q].items() if at(t) in names} for q in order], [dict(seen[q]) for q in order], [ends[q] for q in order], [dict(left[q]) for q in order])


ALPHABET = len(_ALPHABET)


def background(strings: list[str]) -> np.ndarray:
    """Log probabilities (character before or start, character or end) of ordinary candidates, one added to each count."""
    counts = np.ones((ALPHABET + 1, ALPHABET + 1))
    for s in strings:
        codes = _CODE[np.frombuffer(s.encode(), np.uint8)]
        np.add.at(counts, (np.append(ALPHABET, codes), np.append(codes, ALPHABET)), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


@dataclass
class Formats:
    automata: dict[str, Automaton]
    background: np.ndarray

    def __post_init__(self) -> None:
        self.names = sorted(self.automata)
        self.tables = [self.automata[k].tables(ALPHABET) for k in self.names]

    def ratios(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each span the likeliest kind, by its place in ``names``, and its log likelihood ratio a character.

        All spans walk the automata in step, the longest first; a span leaves where it ends.
        """
        best, kind = np.full(len(start), -np.inf), np.zeros(len(start), dtype=np.int64)
        if not self.tables or not len(start):
            return kind, best
        size = end - start
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        plain, before = np.zeros(len(start)), np.full(len(start), ALPHABET)
        totals, states = np.zeros((len(self.tables), len(start))), np.zeros((len(self.tables), len(start)), dtype=np.int64)
        for at in range(int(size[0])):
            n = int(np.searchsorted(-size, -at, side="left"))
            codes = _CODE[data[start[:n] + at]]
            plain[:n] += self.background[before[:n], codes]
            before[:n] = codes
            for i, (logs, after) in enumerate(self.tables):
                totals[i, :n] += logs[states[i, :n], codes]
                states[i, :n] = after[states[i, :n], codes]
        plain += self.background[before, ALPHABET]
        for i, (logs, _) in enumerate(self.tables):
            totals[i] += logs[states[i], ALPHABET]
        ratio = (totals - plain) / size
        kind[order], best[order] = ratio.argmax(axis=0), ratio.max(axis=0)
        return kind, best

    def best(self, text: str) -> tuple[str, float]:
        """The likeliest kind of one string and its log likelihood ratio a character; ("", -inf) without automata."""
        data = np.frombuffer(text.encode(), np.uint8)
        kind, ratio = self.ratios(data, np.zeros(1, np.int64), np.full(1, len(data)))
        return (self.names[kind[0]], float(ratio[0])) if self.tables else ("", float("-inf"))


def fit(labelled: dict[str, list[str]], ordinary: list[str]) -> Formats:
    return Formats({k: merged(prefix_tree(sorted(v))) for k, v in labelled.items() if v}, background(ordinary))


def _digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(_joined(spans).encode()).hexdigest()


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores array<double>, n_learned long"
_ORDER = {k: i for i, k in enumerate((*KINDS, *(f"like_{k}" for k in KINDS)))}


def _scores(formats: Formats, block: Block, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and ratios of spans; equal spans are scored once, and very long ones one at a time."""
    _, one, back = np.unique(span_hashes(block.data, start, end, fold=False), return_index=True, return_inverse=True)
    a, b = start[one], end[one]
    kind, ratio = np.zeros(len(one), dtype=np.int64), np.full(len(one), -np.inf)
    stepped = b - a <= STEPPED
    kind[stepped], ratio[stepped] = formats.ratios(block.data, a[stepped], b[stepped])
    for i in np.flatnonzero(~stepped):
        k, x = formats.ratios(block.data, a[i : i + 1], b[i : i + 1])
        kind[i], ratio[i] = k[0], x[0]
    return kind[back], ratio[back]


def _scanner(held, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats: Formats = held.value
        for batch in batches:
            out = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores", "n_learned")}
            for block, data, base in _texts(batch):
                found: list[list[tuple[int, int, str, float]]] = [[] for _ in range(block.n)]
                own = [(d, a, b, k, s) for d, spans in enumerate(base) for a, b, k, s in spans]
                if own:
                    at = np.array([(block.at[d] + s, block.at[d] + b) for d, _, b, _, s in own], dtype=np.int64)
                    _, ratio = _scores(formats, block, at[:, 0], at[:, 1])
                    for (d, a, b, k, _), x in zip(own, ratio.tolist(), strict=True):
                        found[d].append((a, b, KINDS[k], x))
                if formats.tables:
                    runs_ = candidates(block, base)
                    kind, ratio = _scores(formats, block, runs_.start, runs_.end)
                    of = np.repeat(np.arange(block.n), runs_.counts)
                    for i in np.flatnonzero(ratio >= least).tolist():
                        d = int(of[i])
                        found[d].append((int(runs_.start[i] - block.at[d]), int(runs_.end[i] - block.at[d]), f"like_{formats.names[kind[i]]}", float(ratio[i])))
                for d, spans in enumerate(found):
                    spans.sort(key=lambda s: (s[0], _ORDER[s[2]]))
                    if spans:
                        place = starts_of_code_points(np.frombuffer(data[d], np.uint8))
                        spans = [(int(place[a]), int(place[b]), k, x) for a, b, k, x in spans]
                    plain = [s[:3] for s in spans if s[2] in KINDS]
                    for k in KINDS:
                        out[f"n_{k}"].append(sum(s[2] == k for s in plain))
                    out["base_sha256"].append(_digest(plain))
                    out["spans"].append(_joined([s[:3] for s in spans]))
                    out["scores"].append([s[3] for s in spans])
                    out["n_learned"].append(len(spans) - len(plain))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(out[f"n_{k}"], pa.int64()) for k in KINDS), pa.array(out["base_sha256"], pa.string()), pa.array(out["spans"], pa.string()), pa.array(out["scores"], pa.list_(pa.float64())), pa.array(out["n_learned"], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores", "n_learned"],
            )

    return run


def learned(docs: DataFrame, sample: int = SAMPLE) -> Formats:
    """Automata and background from at most ``sample`` distinct strings a kind, the first by hash.

    Strings of over LONGEST characters are no examples, nor those that CHARACTERS in all leave no room for.
    """
    some = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_first(sample), LEARNT).distinct()
    some = spill(some, "labelled")
    strings: dict[int, list[str]] = {}
    for k in (-1, 0, 1, 2):
        strings[k], room = [], CHARACTERS
        for row in some.where(F.col("kind") == k).orderBy("hash", "secret").limit(sample).collect():
            if len(row["secret"]) <= room:
                strings[k].append(row["secret"])
                room -= len(row["secret"])
    discard(some)
    return fit({KINDS[k]: strings[k] for k in range(len(KINDS))}, strings[-1])


def scanned(docs: DataFrame, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """Per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, scores and n_learned.

    spans lists ``kind:start:end`` in code points, base kinds and learned ones (like_assign, ...), by start; scores
    holds each span's log likelihood ratio a character under its likeliest format (of an assignment: of the
    secret itself). Base spans stay whatever their score.
    Null and empty texts have no spans. Without base matches nothing is learned and nothing added. Repeated rows
    each get theirs; an empty table gives an empty result; only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held = docs.sparkSession.sparkContext.broadcast(learned(docs, sample))
    return rows.mapInArrow(_scanner(held, least), SCANNED)
