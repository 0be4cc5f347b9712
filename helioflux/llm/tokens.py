"""Token counts of sections by offset-mapped attribution.

Each whole document is encoded once by a public byte-level BPE vocabulary. Token byte spans follow from the
vocabulary's token lengths; they are joined with the document's sections, which tile the text, by binary search
on both sorted lists. A token that crosses a section boundary is allocated by an explicit rule:

* ``start``: to the section that holds its first byte;
* ``most``: to the section that holds most of its bytes, the earliest among equals;
* ``split``: to each section it touches, in proportion to bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import blocks, starts_of_code_points

RULES = ("start", "most", "split")
SECTIONS = "doc_id long, section long, start_char long, end_char long, n_tokens double, n_crossing long"

_ENCODERS: dict[str, tuple] = {}


def _encoder(vocabulary: bytes, pattern: str) -> tuple:
    """The encoding and each token's length in bytes, made once in a worker process."""
    import tiktoken

    name = hashlib.sha256(vocabulary + pattern.encode()).hexdigest()
    if name not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _ENCODERS.clear()
        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _ENCODERS[name]


def line_sections(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which sections start, and the text's end: each line with its line feed is a section."""
    ends = np.flatnonzero(data == 10) + 1
    bounds = np.concatenate([[0], ends, [len(data)]])
    return np.unique(bounds)


def attribute(token_ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens allocated to each section and tokens in each that cross its end, from token end offsets."""
    n = len(bounds) - 1
    starts = np.concatenate([[0], token_ends[:-1]]).astype(np.int64)
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, token_ends - 1, side="right") - 1
    crossing = first != last
    counts = np.bincount(first[~crossing], minlength=n).astype(np.float64)
    crossed = np.bincount(first[crossing], minlength=n)
    for i in np.flatnonzero(crossing):
        touched = np.arange(first[i], last[i] + 1)
        part = np.minimum(bounds[touched + 1], token_ends[i]) - np.maximum(bounds[touched], starts[i])
        if rule == "start":
            counts[first[i]] += 1
        elif rule == "most":
            counts[touched[np.argmax(part)]] += 1
        else:
            counts[touched] += part / part.sum()
    return counts, crossed


def _counter(held, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoder(*held.value)
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(1)):
                doc, section, start, end, count, crossed = ([] for _ in range(6))
                for d in range(block.n):
                    data = block.data[block.at[d] : block.at[d + 1]]
                    text = data.tobytes().decode("utf-8", "replace")
                    if "\ufffd" in text:
                        data = np.frombuffer(text.encode(), np.uint8)
                    tokens = np.array(encoding.encode_ordinary(text), dtype=np.int64)
                    bounds = line_sections(data) if len(data) else np.array([0, 0])
                    if len(data):
                        counts, over = attribute(np.cumsum(lengths[tokens]), bounds, rule)
                        chars = starts_of_code_points(data)[bounds]
                    else:
                        counts, over, chars = np.zeros(1), np.zeros(1, np.int64), bounds
                    k = len(counts)
                    doc.append(np.full(k, block.first + d))
                    section.append(np.arange(k))
                    start.append(chars[:-1])
                    end.append(chars[1:])
                    count.append(counts)
                    crossed.append(over)
                join = lambda x: pa.array(np.concatenate(x))
                yield pa.RecordBatch.from_arrays([ids.take(join(doc)), join(section), join(start), join(end), join(count), join(crossed)], ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    return run


def vocabulary_of(path: str | None) -> bytes:
    """The vocabulary file's bytes (under 10 MB, checked); None: the public byte-level vocabulary installed here."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        data = file.read(10_000_001)
    if len(data) > 10_000_000:
        raise ValueError("a vocabulary of over 10 MB isn't broadcast")
    return data


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def section_tokens(docs: DataFrame, rule: str = "start", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per section of every input row: doc_id, section (from 0), its code points [start_char, end_char),
    n_tokens allocated to it and n_crossing, tokens that start in it and end beyond.

    Sections are lines with their line feeds. Over a document, n_tokens sum to its whole encoding's length under
    every rule. A null or empty text has one section without tokens. Bytes that aren't UTF-8 read as U+FFFD, one code
    point, in tokens and offsets alike. Repeated rows each get theirs; only doc_id
    and text are read. An empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    held = docs.sparkSession.sparkContext.broadcast((vocabulary_of(vocabulary), pattern or default_pattern()))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counter(held, rule), SECTIONS)
