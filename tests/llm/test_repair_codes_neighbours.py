"""Operators 11 to 13 against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioflux.llm import codebooks, conversations, neighbours, queries
from helioflux.llm.store import Scratch

SMALL = "/root/testdata/sf0.001"


# Conversations -------------------------------------------------------------------------------------------------


def damage(rows):
    """(conv, turn, role, text) after damage, by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept = out.setdefault(conv, [])
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        kept += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in out.items()}


def cheapest(rows):
    """Least (cost, audit, repaired lines) over all edits with at most two inserts in a row, by exhaustive search over prefixes."""
    best = {("", 0): (0, "", [])}  # key: last initials and inserts in a row
    done = {}

    def settle(layer):
        todo = list(layer)
        while todo:
            key = todo.pop()
            cost, audit, lines = layer[key]
            state, put = key
            if put == 3:
                continue
            for role in ("user", "assistant"):
                if (after := move(state, role[0])) is None:
                    continue
                new = (after, put + 1), (cost + 3, audit + "I", [*lines, f"{role}:"])
                if new[0] not in layer or new[1] < layer[new[0]]:
                    layer[new[0]] = new[1]
                    todo.append(new[0])
        return layer

    def move(state, x):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, x))

    layer, seen = settle(best), set()
    for _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0d]", text)
        twice = (role, text) in seen
        seen.add((role, text))
        cut = not blank and not twice and re.sub(r"[\x20\x09-\x0d]+\Z", "", text)[-1] not in ".!?"
        done, layer = layer, {}
        for (state, _), (cost, audit, lines) in done.items():
            ways = [(state, cost + 4, "D", lines)]
            if not blank and not twice:
                for label, price, said in [("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")]:
                    if (after := move(state, said[:1])) is not None:
                        ways.append((after, cost + price + 3 * cut, label, [*lines, f"{said}:{text}"]))
            for after, price, label, said in ways:
                new = (price, audit + label, said)
                if (after, 0) not in layer or new < layer[after, 0]:
                    layer[after, 0] = new
        layer = settle(layer)
    return min(v for (state, _), v in layer.items() if state in ("", "a"))


def expected(rows):
    out = {}
    for conv, kept in damage(rows).items():
        turns = [t for t, _, _ in kept if t is not None]
        counts, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, set()
        for _, role, text in kept:
            bare = re.sub(r"[\x20\x09-\x0d]+\Z", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost, audit, lines = cheapest(kept)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_repair_equals_brute_force_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, SMALL).collect()}
    assert got == expected(rows)


def test_repair_equals_brute_force_on_odd_conversations(spark):
    draw = random.Random(3)
    texts = ["One.", "Two!", "cut", "", " \t\n", None, "Why? ", "One."]
    rows = [(c if c else None, draw.choice([t, t, None]) if c % 3 == 0 else t, draw.choice(["user", "assistant", "system", "tool", None, ""]) if c % 2 else draw.choice(["user", "assistant"]), draw.choice(texts)) for c in range(120) for t in range(draw.randint(1, 9))]
    # Rows of one turn have no order of their own; those of a null turn are made equal here.
    rows = [(c, t, r, x) if t is not None else (c, t, "user", "same.") for c, t, r, x in rows]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, audit int")
    got = {r[0]: tuple(r)[1:] for r in conversations.audited(conversations.damaged(df)).collect()}
    assert got == expected(rows)
    assert conversations.audited(df.limit(0)).count() == 0


def test_repaired_rows_and_long_conversations(spark):
    """20,000 turns, half of them in the wrong role, come out alternating; the digest is that of the rows."""
    df = spark.range(20000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 4 < 2, "user").otherwise("assistant").alias("role"), F.concat("id", F.lit(".")).alias("text"))
    lines = conversations.repaired(df).orderBy("line").collect()
    assert [r.line for r in lines] == list(range(len(lines))) and [r.role for r in lines[:4]] == ["user", "assistant"] * 2
    assert all(a.role != b.role for a, b in itertools.pairwise(lines))
    row = conversations.audited(df).first()
    assert row.repaired_sha256 == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest()
    assert row.cost == 3 * len(re.findall("[RI]", row.audit)) + 4 * row.audit.count("D")


# Codes ---------------------------------------------------------------------------------------------------------


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label), valid ones."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[int(np.floor(1024 * float(v))) for v in r[1]] for r in rows], dtype=object)
    step = x.shape[1] // parts
    books, code, square = [], [], 0
    for p in range(parts):
        part = x[:, p * step : (p + 1) * step]
        book = part[:entries].copy()
        for r in range(rounds + 1):
            far = ((part[:, None, :] - book[None]) ** 2).sum(2)
            near = np.array([int(min(range(len(book)), key=lambda k: (row[k], k))) for row in far])
            if r < rounds:
                for k in range(len(book)):
                    if (near == k).any():
                        book[k] = [sum(c) // int((near == k).sum()) for c in zip(*part[near == k], strict=True)]
        books.append(book)
        code.append(near)
        square = square + far[np.arange(len(part)), near]
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1)).encode()).hexdigest()
    labels = {}
    for r, e in zip(rows, square, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + int(e)
    return sorted((str(r[0]), "".join(f"{c[i]:02x}" for c in code), int(square[i]), labels[r[2]], digest) for i, r in enumerate(rows))


def test_codes_equal_plain_lloyd_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert sorted((str(r[0]), *r[1:]) for r in queries.op12_vector_codes(spark, SMALL).collect()) == codes_by_hand(rows)


@pytest.mark.parametrize(("n", "scale", "entries"), [(300, 0.004, 16), (200, 0.01, 40), (60, 80000.0, 8), (5, 1.0, 16)])
def test_codes_with_ties_and_large_values(spark, n, scale, entries):
    """Few distinct values tie often; large ones leave the range where products of doubles are exact."""
    draw = np.random.default_rng(n)
    rows = [(int(i), [float(v) for v in draw.integers(-3, 4, 8) * scale], int(i) % 3 if i % 5 else None) for i in range(n)]
    rows += rows[:3] + [(None, rows[0][1], 1)]
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows] + [(900, None, 1, "x"), (901, [1.0] * 7 + [None], 1, "x"), (902, [float("nan")] * 8, 1, "x"), (903, [float("inf")] * 8, 1, "x"), (904, [1.0, 2.0, 3.0, 4.0], 1, "x"), (905, [], 1, "x")], "vec_id long, embedding array<double>, label int, code string")
    out = codebooks.compressed(df, 4, entries)
    got = codebooks.with_label_error(out.codes).withColumn("code", F.lower(F.hex("code"))).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, out.digest()) for r in got) == codes_by_hand(rows, 4, entries)
    assert codebooks.coded(df.limit(0)).count() == 0


def test_bounds_save_distances():
    """After a round without moves hardly any distance is computed, and codes are those of a full search."""
    draw = np.random.default_rng(1)
    entries, points = draw.integers(-500, 500, (256, 16)), draw.integers(-500, 500, (2000, 16))
    book = codebooks.Codebook.first(entries)
    zero = np.zeros((2000, len(book.drift)), np.uint16)
    code, square, bound, full = codebooks.assigned(points, np.zeros(2000, int), zero, book)
    far = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (code == far.argmin(1)).all() and (square == far.min(1)).all()
    again = codebooks.assigned(points, code, bound, book)
    assert (again[0] == code).all() and again[3] < full / 20
    others = far.copy()
    others[np.arange(2000), code] = np.iinfo(np.int64).max
    for g in range(len(book.drift)):
        assert (bound[:, g].astype(np.int64) ** 2 <= others[:, book.group == g].min(1)).all()


# Neighbours ----------------------------------------------------------------------------------------------------


def nearest_by_hand(rows, k=20, every=20):
    best, out = {}, {}
    for i, v in rows:
        best.setdefault(i, []).append(v)
    for i in sorted(best):
        if i % every == 0:
            q = min(best[i])
            found = sorted((-max(float(np.cumsum(np.array(q) * np.array(v))[-1]) for v in vs), j) for j, vs in best.items() if j != i)
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


def recall(got, true):
    return sum(len({j for j, _ in got.get(i, [])} & {j for j, _ in t}) for i, t in true.items()) / max(1, sum(map(len, true.values())))


def collected(df):
    out = {}
    for r in sorted(df.collect()):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_neighbours_recall_on_the_table(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got, true = collected(queries.op13_nearest_neighbours(spark, f"/root/testdata/{sf}")), nearest_by_hand(rows)
    assert set(got) == set(true) and all(len(got[i]) == 20 for i in true)
    assert recall(got, true) >= 0.9
    best = dict(rows)
    for i, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(s == float(np.cumsum(np.array(best[i]) * np.array(best[j]))[-1]) for j, s in found)


def test_neighbours_of_odd_rows_and_many_copies(spark):
    """A third of all rows are one vector; norms differ; ties go to smaller ids; broken rows take no part."""
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(size=6) * draw.uniform(0.1, 5)]) for i in range(2000)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 0.5, 1.0]) for i in range(2000, 3000)]
    odd = [(None, [1.0] * 6), (5000, None), (5020, [0.0] * 6), (5040, [1.0] * 5 + [None]), (5060, [float("nan")] * 6), (5080, [1.0]), (5100, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd + rows[:40]], "vec_id long, embedding array<double>, leaf string")
    got, true = collected(neighbours.neighbours(df, bin_rows=300)), nearest_by_hand(rows)
    assert set(got) == set(true) and recall(got, true) >= 0.9
    same = [i for i in true if i >= 2000]
    copies = [[j for j, s in got[i] if s == 7.25 - 1.0 + 0.0] for i in same]
    assert all(c == sorted(c) for c in copies)
    exact = collected(neighbours.neighbours(df, recall=1.0, bin_rows=300))
    assert recall(exact, true) >= 0.97


def test_neighbours_of_few_rows(spark):
    rows = [(i, [float(i), 1.0]) for i in range(7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert collected(neighbours.neighbours(df)) == nearest_by_hand(rows)
    assert neighbours.neighbours(df.limit(0)).count() == 0 and neighbours.neighbours(df.where("vec_id = 0")).count() == 0


def test_search_of_all_leaves_is_exact_in_split_bins(spark):
    """With all leaves visited, bins that split leaves and chunks of queries lose nothing."""
    draw = np.random.default_rng(8)
    rows = [(i, [float(x) for x in draw.normal(size=8)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scratch = Scratch()
    index = neighbours.Index.build(df, scratch, 200)
    found = index.search(index.rows.where("vec_id % 20 = 0"), 20, index.tree.leaves, scratch, 40)
    assert collected(found) == nearest_by_hand(rows)
    first, parts = neighbours.bins(np.array([10, 20, 100, 5, 5]), 40)
    assert first.tolist() == [0, 0, 1, 4, 4] and parts.tolist() == [1, 1, 3, 1, 1]
