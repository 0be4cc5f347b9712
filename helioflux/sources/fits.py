"""Binary tables in FITS files, read by row ranges: a Python data source, ``spark.read.format("fits")``, and its parts.

Headers alone say where a table's rows are, so a file is cut into byte ranges by its length and a task finds its rows
by itself: it seeks from header to header and reads the wanted columns of rows that begin in its range. No task holds
a file, and the driver opens none.

Options: path (a file or a glob that the driver can list and the workers can open; for other paths see
``instruments``), hdu (a name pattern, default any table), columns (comma-separated), split_mb (64). A row has the
file, the table's name, its header as JSON and each wanted column as an array of doubles. A file that can't be parsed
fails the read unless ``mode`` is ``dropmalformed``. With the option ``pushdown`` (and Spark's
``spark.sql.python.filterPushdown.enabled``), equalities on file, hdu and name and bounds on row reach the reader:
other files aren't opened, and other columns' and rows' bytes aren't read.
"""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

BLOCK = 2880
#: Numpy types of TFORM codes
CODES = {"L": "i1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S1"}
#: Bytes of an element of codes that aren't read as numbers
OPAQUE = {"C": 8, "M": 16, "P": 8, "Q": 16}
#: Bytes between two rows' wanted parts from which on they're skipped, and bytes read at once otherwise
GAP, CHUNK = 4096, 8 << 20


def header(file: BinaryIO, at: int) -> tuple[dict, int]:
    """Cards from ``at`` and where the data after them starts."""
    cards: dict = {}
    file.seek(at)
    while True:
        block = file.read(BLOCK)
        if len(block) < BLOCK:
            raise ValueError("the header ends early")
        at += BLOCK
        for i in range(0, BLOCK, 80):
            card = block[i : i + 80].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards, at
            if card[8:10] != "= ":
                continue
            value = card[10:].strip()
            if value.startswith("'"):
                cards[key] = value[1:].split("'")[0].rstrip()
            else:
                text = value.split("/")[0].strip()
                cards[key] = {"T": True, "F": False}.get(text) if text in "TF" and text else float(text) if re.search("[.EeDd]", text) else int(text) if text else None


@dataclass(frozen=True)
class Extent:
    """A binary table in a file: its rows begin at byte ``at`` and are laid out by ``dtype``."""

    name: str
    cards: dict
    at: int
    count: int
    dtype: np.dtype

    @property
    def numbers(self) -> list[str]:
        """Names of columns that hold numbers."""
        return [n for n in self.dtype.names if self.dtype[n].base.kind in "iuf"]

    def begun(self, lo: int, hi: int) -> tuple[int, int]:
        """First row and end of the rows that begin in bytes lo to hi."""
        first, last = (min(max(-((self.at - x) // max(self.dtype.itemsize, 1)), 0), self.count) for x in (lo, hi))
        return first, last


def layout(cards: dict) -> np.dtype:
    fields = []
    for i in range(1, int(cards["TFIELDS"]) + 1):
        count, code = re.match(r"(\d*)([A-Z])", cards[f"TFORM{i}"]).groups()
        n = int(count or 1)
        name = cards.get(f"TTYPE{i}", f"col{i}").upper()
        if code == "A":
            fields.append((name, f"S{n}"))
        elif code in CODES:
            fields.append((name, CODES[code], (n,)) if n != 1 else (name, CODES[code]))
        else:
            fields.append((name, f"V{-(-n // 8) if code == 'X' else n * OPAQUE[code]}"))
    return np.dtype(fields)


def extents(file: BinaryIO) -> list[Extent]:
    """A file's binary tables, from its headers alone; raises if one is damaged or the file ends before a table's rows do."""
    end, at, found = file.seek(0, 2), 0, []
    if end < BLOCK:
        raise ValueError("the file is shorter than one block")
    while at + BLOCK <= end:
        cards, at = header(file, at)
        axes = [int(cards[f"NAXIS{i}"]) for i in range(1, int(cards.get("NAXIS", 0)) + 1)]
        size = abs(int(cards.get("BITPIX", 8))) // 8 * int(np.prod(axes)) if axes else 0
        size = (size + int(cards.get("PCOUNT", 0))) if axes else 0
        if cards.get("XTENSION") == "BINTABLE":
            dtype = layout(cards)
            if dtype.itemsize != axes[0]:
                raise ValueError("the columns don't fill a row")
            if at + axes[0] * axes[1] > end:
                raise ValueError("the file ends before its table does")
            found.append(Extent(str(cards.get("EXTNAME", "")), cards, at, axes[1], dtype))
        at += -(-size // BLOCK) * BLOCK
    return found


@dataclass(frozen=True)
class Part:
    """Rows first to last (exclusive) of a table in an open file."""

    file: BinaryIO
    table: Extent
    first: int
    last: int

    def columns(self, *names: str) -> list[np.ndarray]:
        """Columns as doubles, scaled by their TSCAL and TZERO; NaN and infinities stay.

        Only the bytes from the first wanted column to the end of the last are read of a row, if what lies between
        two rows' parts is worth a seek.
        """
        t = self.table
        places = {n: t.dtype.fields[n] for n in names}
        lo = min(at for _, at, *_ in places.values())
        width = max(at + kind.itemsize for kind, at, *_ in places.values()) - lo
        inner = np.dtype({"names": list(places), "formats": [p[0] for p in places.values()], "offsets": [p[1] - lo for p in places.values()], "itemsize": width})
        raw = self._rows(lo, width)
        out = []
        for n in names:
            i = t.dtype.names.index(n) + 1
            values = np.concatenate([np.frombuffer(r, inner)[n].astype(np.float64) for r in raw]) if raw else np.zeros((0, *t.dtype[n].shape))
            out.append(values * float(t.cards.get(f"TSCAL{i}", 1)) + float(t.cards.get(f"TZERO{i}", 0)))
        return out

    def _rows(self, lo: int, width: int) -> list[bytes]:
        """Bytes lo to lo + width of every row, in pieces of whole rows."""
        size, at = self.table.dtype.itemsize, self.table.at
        if size - width >= GAP:
            return [self._read(at + i * size + lo, width) for i in range(self.first, self.last)]
        step = max(CHUNK // size, 1)
        out = []
        for i in range(self.first, self.last, step):
            n = min(step, self.last - i)
            data = self._read(at + i * size + lo, (n - 1) * size + width).ljust(n * size, b"\0")
            out.append(np.frombuffer(data, np.uint8).reshape(n, size)[:, :width].tobytes())
        return out

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) < n:
            raise ValueError("the file ends before its table does")
        return data


def parts(file: BinaryIO, lo: int = 0, hi: int | None = None) -> list[Part]:
    """Each table's rows that begin in bytes lo to hi of the file; tables without any are there, without rows."""
    found = extents(file)
    return [Part(file, t, *(t.begun(lo, hi) if hi is not None else (0, t.count))) for t in found]


def opened(path: str) -> BinaryIO:
    """A file to seek in, by a local path or a URI that Arrow's file systems know."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if re.match(r"[A-Za-z][\w+.-]*://", path):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        return system.open_input_file(name)
    return open(path, "rb", buffering=0)  # noqa: SIM115 - the caller closes it


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return "file string, hdu string, header string, row bigint, name string, values array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushedReader if str(self.options.get("pushdown", "")).lower() == "true" else FitsReader)(self.options)


class FitsReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        #: What filters leave of file, hdu and name (None: all), and of rows: first and end
        self.only: dict[str, set | None] = {"file": None, "hdu": None, "name": None}
        self.rows: tuple[int, int | None] = (0, None)

    def partitions(self) -> list[InputPartition]:
        size = int(float(self.options.get("split_mb", 64)) * (1 << 20))
        out = []
        for p in sorted(glob.glob(self.options["path"], recursive=True)):
            if self.only["file"] is None or p in self.only["file"]:
                end = max(os.path.getsize(p), 1)
                out += [InputPartition((p, lo, min(lo + size, end))) for lo in range(0, end, size)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        path, lo, hi = partition.value
        with opened(path) as file:
            try:
                found = parts(file, lo, hi)
            except Exception:
                if self.options.get("mode") == "dropmalformed":
                    return
                raise
            wanted = [c.strip().upper() for c in self.options.get("columns", "").split(",") if c.strip()]
            for part in found:
                t = part.table
                first = max(part.first, self.rows[0])
                last = part.last if self.rows[1] is None else min(part.last, self.rows[1])
                if first >= last or not re.search(self.options.get("hdu", ""), t.name) or (self.only["hdu"] is not None and t.name not in self.only["hdu"]):
                    continue
                head = json.dumps(t.cards)
                for name in wanted or t.numbers:
                    if name not in t.dtype.names or (self.only["name"] is not None and name not in self.only["name"]):
                        continue
                    for i, v in enumerate(Part(file, t, first, last).columns(name)[0]):
                        yield path, t.name, head, first + i, name, np.atleast_1d(v).tolist()


class PushedReader(FitsReader):
    """FitsReader that takes filters; those it doesn't know go back to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        column = getattr(f, "attribute", ("",))
        if len(column) == 1 and column[0] in self.only and isinstance(f, EqualTo | In):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            old = self.only[column[0]]
            self.only[column[0]] = values if old is None else old & values
            return True
        if column == ("row",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            lo = {EqualTo: f.value, GreaterThan: f.value + 1, GreaterThanOrEqual: f.value}.get(type(f))
            hi = {EqualTo: f.value + 1, LessThan: f.value, LessThanOrEqual: f.value + 1}.get(type(f))
            first, last = self.rows
            self.rows = (first if lo is None else max(first, lo), last if hi is None else hi if last is None else min(last, hi))
            return True
        return False
