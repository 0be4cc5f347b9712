"""Conversation structure repair by weighted finite-state composition (``wfst``).

A row is read as a symbol: its role's initial and its first fault. Rows come through two sorted passes. The first
carries no text: it counts faults and finds each conversation's cheapest edits, one byte a row and a few small
numbers. The second puts a conversation's edits in front of its rows, sorted alike, and applies them row by row as
they stream by, so a text is held for as long as its batch. Duplicates come from the first turn of each
(conversation, role and text), which is combined before the shuffle. A digest over a conversation needs its rows in
order in one task; that task streams them and holds no text of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wfst import Composition, Edits, Grammar

#: Space and \t..\r
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Costs of edits, and of a truncated row that stays
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: (s?(ua)+)? as states start, after s, after u, after a
GRAMMAR = Grammar(4, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, frozenset({0, 3}))
INITIALS = "sua"
FAULTS = ("", "blank", "duplicate", "truncated")
LEGAL = {"su", "ua", "au"}


def _uses(initial: str, fault: str) -> tuple[tuple[str, int, str | None], ...]:
    delete = ("D", DELETE, None)
    if fault in ("blank", "duplicate"):
        return (delete,)
    more = TRUNCATED if fault == "truncated" else 0
    # Reroling to the role that a row has is never cheaper than keeping it.
    return (("K", more, initial), delete, *(("R", REROLE + more, x) for x in ROLES))


def machine() -> Composition:
    uses = {(x, f): _uses(x, f) for x in (*INITIALS, "") for f in FAULTS}
    return Composition(Edits(uses, tuple(("I", INSERT, x) for x in ROLES)), GRAMMAR)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults put in by crc32 of ``conv_id:turn`` modulo 20.

    0: the row is marked gone, 1: its text is emptied, 2: it loses its sentence ends, 3: it comes twice, 4: its role
    becomes user. Nulls in the checksum's parts, role or text read as one space.
    """
    draw = F.crc32(F.encode(F.concat(_text("conv_id"), F.lit(":"), _text("turn")), "UTF-8")) % 20
    rows = conversations.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), draw.alias("_draw"))
    text = F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_draw") == 4, "user").otherwise(F.col("role")), "gone": F.col("_draw") == 0})
    copies = F.explode(F.when(F.col("_draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.withColumn("_copy", copies).select("conv_id", "turn", "role", "text", "gone")


def _prepared(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with the digest of role and text."""
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), gone.alias("gone"))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumn("digest", F.sha2(F.encode(whole, "UTF-8"), 256))


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Facts:
    """What the first pass knows of the conversation whose rows stream by, in order of turn and digest."""

    def __init__(self, conv) -> None:
        self.conv, self.symbols = conv, bytearray()
        self.counts = dict.fromkeys(FAULTS, 0)
        self.illegal = self.turns = 0
        self.low = self.high = self.seen = None

    def add(self, turn, digest: str, initial: str, blank: bool, truncated: bool, first: bool) -> None:
        fault = "blank" if blank else "duplicate" if not first or digest == self.seen else "truncated" if truncated else ""
        self.counts[fault] += 1
        at = INITIALS.find(initial) if initial else -1
        if self.symbols:
            before = (self.symbols[-1] >> 2) - 1
            self.illegal += before < 0 or at < 0 or INITIALS[before] + INITIALS[at] not in LEGAL
        self.symbols.append((at + 1) << 2 | FAULTS.index(fault))
        self.seen = digest
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn

    def row(self, whole: Composition) -> dict:
        cost, audit = whole.least([SYMBOLS[x] for x in self.symbols])
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv, "gaps": gaps, "blank": self.counts["blank"], "duplicate": self.counts["duplicate"], "truncated": self.counts["truncated"], "illegal": self.illegal, "cost": cost, "audit": audit}


SYMBOLS = {(i + 1) << 2 | k: (INITIALS[i] if i >= 0 else "", f) for i in range(-1, 3) for k, f in enumerate(FAULTS)}


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _counted(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = machine()

        def rows() -> Iterator[dict]:
            now = None
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "digest", "initial", "blank", "truncated", "first", "gone")]
                for conv, turn, digest, initial, blank, truncated, first, gone in zip(*columns, strict=True):
                    if now is None or conv != now.conv:
                        if now is not None:
                            yield now.row(whole)
                        now = _Facts(conv)
                    if not gone:
                        now.add(turn, digest, initial, blank, truncated, first)
            if now is not None:
                yield now.row(whole)

        yield from _batches(rows(), schema)

    return run


def _arrow(df: DataFrame, *columns: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(df.select(*columns).schema))


def _edits(rows: DataFrame) -> DataFrame:
    """Prepared rows' conversations with their counts, cost and edits."""
    bare = F.rtrim("text", F.lit(SPACE))
    kept = rows.where("not gone")
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = kept.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(order).alias("_first"))
    narrow = rows.select("conv_id", "turn", "digest", "gone", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("truncated"))
    told = narrow.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    told = told.select("conv_id", "turn", "digest", "gone", "initial", "blank", "truncated", F.coalesce(F.col("_first.turn").eqNullSafe(F.col("turn")), F.lit(False)).alias("first"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([*_arrow(rows, "conv_id"), *[pa.field(c, pa.string() if c == "audit" else pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")]])
    ordered = told.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest")
    return ordered.mapInArrow(_counted(schema), f"conv_id {kind}, {FACTS}")


def edits(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit.

    rows: conv_id, turn (an integer), role, text and, if there is one, a boolean ``gone``, whose rows count as
    absent; their conversation is listed all the same. Rows are read by turn, nulls first, those of one turn by a
    digest of role and text. gaps: turns missing between the least and the greatest (null turns are no turns). Each
    row counts once: blank, else duplicate (role and text of an earlier row), else truncated. illegal: neighbours
    whose role initials aren't su, ua or au. audit: the cheapest edits that give role initials (s?(ua)+)?, K keep,
    R rerole, D delete, I insert, the least text of equal cost; cost: their cost.

    Null role and text read as one space, so such rows are blank or have no role to keep. A null conv_id is one
    conversation. Without rows: zeros and an empty audit; an empty table gives an empty one. Repeated rows are
    duplicates. Other columns are ignored, whatever their names.
    """
    return _edits(_prepared(rows))


def _streamed(rows: DataFrame) -> DataFrame:
    """Each conversation's facts, then its rows in order."""
    rows = _prepared(rows)
    facts = [x.split()[0] for x in FACTS.split(", ")]
    heads = _edits(rows).select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("digest"), F.lit("").alias("role"), F.lit("").alias("text"), *facts)
    none = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in FACTS.split(", ")]
    body = rows.where("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text", *none)
    return heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "digest")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, str, str, str]]:
    """(facts, "", "", "") of each conversation, followed by (None, edit, role, text) of its repaired rows."""
    audit, at, last = "", 0, ""

    def put(until: int) -> Iterator[tuple[None, str, str, str]]:
        nonlocal at, last
        while at < until and audit[at] == "I":
            at, last = at + 1, "a" if last == "u" else "u"
            yield None, "I", ROLES[last], ""

    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                yield from put(len(audit))
                audit, at, last = row["audit"], 0, ""
                yield row, "", "", ""
                continue
            yield from put(len(audit))
            edit, at = audit[at], at + 1
            if edit != "D":
                # What an edit makes follows from the grammar: after u comes a, after anything else u.
                last = row["role"][:1] if edit == "K" else "a" if last == "u" else "u"
                yield None, edit, row["role"] if edit == "K" else ROLES[last], row["text"]
    yield from put(len(audit))


def repaired(rows: DataFrame) -> DataFrame:
    """Repaired conversations: conv_id, line (from 0), edit (K, R or I), role, text; rows as in ``edits``."""
    table = _streamed(rows)
    kind = table.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([*_arrow(table, "conv_id"), pa.field("line", pa.int64()), *[pa.field(c, pa.string()) for c in ("edit", "role", "text")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[dict]:
            conv, line = None, 0
            for head, edit, role, text in _applied(batches):
                if head is not None:
                    conv, line = head["conv_id"], 0
                    continue
                yield {"conv_id": conv, "line": line, "edit": edit, "role": role, "text": text}
                line += 1

        yield from _batches(lines(), schema, 500)

    return table.mapInArrow(run, f"conv_id {kind}, line long, edit string, role string, text string")


def audited(rows: DataFrame) -> DataFrame:
    """``edits`` with repaired_sha256: of the repaired rows as ``role:text``, joined by newlines."""
    table = _streamed(rows)
    kind = table.schema["conv_id"].dataType.simpleString()
    names = [x.split()[0] for x in FACTS.split(", ")]
    schema = pa.schema([*_arrow(table, "conv_id", *names), pa.field("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def facts() -> Iterator[dict]:
            now, digest, lines = None, None, 0
            for head, _, role, text in _applied(batches):
                if head is not None:
                    if now is not None:
                        yield now | {"repaired_sha256": digest.hexdigest()}
                    now, digest, lines = {c: head[c] for c in ("conv_id", *names)}, hashlib.sha256(), 0
                    continue
                digest.update(("\n" * bool(lines) + f"{role}:{text}").encode())
                lines += 1
            if now is not None:
                yield now | {"repaired_sha256": digest.hexdigest()}

        yield from _batches(facts(), schema)

    return table.mapInArrow(run, f"conv_id {kind}, {FACTS}, repaired_sha256 string")
