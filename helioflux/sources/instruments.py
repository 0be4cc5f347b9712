"""Typed readers of instrument files: light curves, spectra and band curves as tables.

Files are found by Spark (``binaryFile``), so any path that the cluster can list will do. ``splits`` gives byte ranges
of them, which tasks read by themselves, only the wanted columns of their rows, through local paths or Arrow's file
systems; ``files`` gives whole contents, opened by Spark, one file a task. Readers take either. A file that can't be
parsed is a row of ``errors``, and no rows elsewhere; empty files aren't listed.
"""

from __future__ import annotations

import gzip
import io
import re
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fits import Part, opened, parts

CURVE = "path string, t double, counts double"
SPECTRA = "path string, t double, counts array<double>, channels array<double>, exposure double"
BANDS = "path string, e_lo double, e_hi double, t double, ctr double"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of files below a folder whose names match a glob."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def splits(spark: SparkSession, path: str, pattern: str = "*", split_mb: float = 64, tasks: int | None = None) -> DataFrame:
    """(path, length, lo, hi): byte ranges of files below a folder, dealt over tasks (default the session's shuffle partitions)."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    size, end = int(split_mb * (1 << 20)), F.greatest("length", F.lit(1).cast("long"))
    ranges = listed.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), end - 1, F.lit(size).cast("long")))).withColumn("hi", F.least(F.col("lo") + size, end))
    return ranges.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "lo")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def date_in_name(path: Column) -> Column:
    """The first eight digits of the file's name; null without."""
    found = F.regexp_extract(name_of(path), r"(\d{8})", 1)
    return F.when(found != "", found)


def _clean(x: np.ndarray) -> np.ndarray:
    return np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)


def _first_table(found: list[Part], name: str | None = None) -> Part:
    return next((p for p in found if p.table.name.upper() == name), found[0])


def _named(part: Part, wanted: tuple[str, ...], fallback: int) -> str:
    """The first of the wanted columns that is there, else the one at a place."""
    names = part.table.dtype.names
    return next((n for n in wanted if n in names), names[fallback])


def _curve(found: list[Part]) -> pd.DataFrame:
    p = _first_table(found)
    pair = ("TIME", "COUNTS") if {"TIME", "COUNTS"} <= set(p.table.dtype.names) else (_named(p, (), 0), _named(p, (), -1))
    t, counts = p.columns(*pair) if pair[0] != pair[1] else p.columns(pair[0]) * 2
    return pd.DataFrame({"t": t, "counts": _clean(counts)})


def _channels(p: Part) -> tuple[str, ...]:
    return tuple(n for n in ("CHANNEL",) if n in p.table.numbers)


def _soft(found: list[Part]) -> pd.DataFrame:
    p = _first_table(found, "SPECTRUM")
    t, counts, *channels = p.columns(_named(p, ("TSTART", "TIME"), 0), "COUNTS", *_channels(p))
    return pd.DataFrame({"t": t, "counts": list(_clean(counts)), "channels": list(channels[0]) if channels else None, "exposure": 1.0})


def _hard(found: list[Part]) -> pd.DataFrame:
    p = _first_table(found, "SPECTRUM")
    start = (float(p.table.cards["TSTART"]) - 40587.0) * 86400.0
    also = tuple(n for n in ("EXPOSURE",) if n in p.table.numbers)
    t, counts, *rest = p.columns("TSTART", "COUNTS", *also, *_channels(p))
    exposure = rest.pop(0) if also else np.full(len(t), 20.0)
    return pd.DataFrame({"t": start + t, "counts": list(_clean(counts)), "channels": list(rest[0]) if rest else None, "exposure": np.where(exposure > 0, exposure, 20.0)})


def _bands(found: list[Part]) -> pd.DataFrame:
    out = [pd.DataFrame({"e_lo": [], "e_hi": [], "t": [], "ctr": []})]
    for p in found:
        limits = re.search(r"([\d.]+)KEV_TO_([\d.]+)KEV", p.table.name.upper())
        if limits and {"MJD", "CTR"} <= set(p.table.dtype.names):
            mjd, ctr = p.columns("MJD", "CTR")
            out.append(pd.DataFrame({"e_lo": float(limits[1]), "e_hi": float(limits[2]), "t": (mjd - 40587.0) * 86400.0, "ctr": _clean(ctr)}))
    return pd.concat(out)


def parsed(found: DataFrame, read: Callable[[list[Part]], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of all files with ``error``, null but for the one row of a file that can't be parsed.

    found: (path, content) of ``files`` or (path, lo, hi) of ``splits``. Every range looks at all headers, so a
    damaged file fails in each, and its first range reports it.
    """

    names = [c.split()[0] for c in schema.split(", ")]
    whole = "content" in found.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, *at in frame.itertuples(index=False, name=None):
                try:
                    with io.BytesIO(bytes(at[0])) if whole else opened(path) as file:
                        yield read(parts(file) if whole else parts(file, *at)).assign(path=path, error=None)[[*names, "error"]]
                except Exception as e:  # noqa: BLE001 - reported as a row
                    if whole or at[0] == 0:
                        yield pd.DataFrame([{**dict.fromkeys(names), "path": path, "error": f"{type(e).__name__}: {e}"}])

    return found.select("path", *(["content"] if whole else ["lo", "hi"])).mapInPandas(run, schema + ", error string")


def good(rows: DataFrame) -> DataFrame:
    return rows.where("error is null").drop("error")


def errors(rows: DataFrame) -> DataFrame:
    """(path, error) of files that gave no rows."""
    return rows.where("error is not null").select("path", "error")


def light_curve(found: DataFrame) -> DataFrame:
    """(path, date, t, counts, error) of light-curve files; NaN and infinite counts are 0."""
    return parsed(found, _curve, CURVE).withColumn("date", date_in_name(F.col("path")))


def soft_spectra(found: DataFrame) -> DataFrame:
    """(path, date, detector, t, counts, channels, exposure, error) of the soft instrument's spectra, one a second; channels is the file's own array, null without."""
    return parsed(found, _soft, SPECTRA).withColumns({"date": date_in_name(F.col("path")), "detector": F.lit("soft")})


def hard_spectra(found: DataFrame) -> DataFrame:
    """As soft_spectra for the hard detectors: times are relative to the header's start, an MJD; no exposure means 20 s."""
    detector = F.when(F.lower("path").contains("czt"), "czt").otherwise("cdte")
    return parsed(found, _hard, SPECTRA).withColumns({"date": date_in_path(F.col("path")), "detector": detector})


def hard_bands(found: DataFrame) -> DataFrame:
    """(path, date, e_lo, e_hi, t, ctr, error) of band curves; limits come from the tables' names."""
    return parsed(found, _bands, BANDS).withColumn("date", date_in_path(F.col("path")))


def date_in_path(path: Column) -> Column:
    found = F.regexp_extract(path, r"(20\d{6})", 1)
    return F.when(found != "", found)


def dates_in_paths(paths: DataFrame) -> DataFrame:
    """Distinct dates (yyyymmdd of this century) anywhere in the paths (path)."""
    return paths.select(F.explode(F.regexp_extract_all("path", F.lit(r"(20\d{6})"), F.lit(1))).alias("date")).distinct()


def of_date(paths: DataFrame, date: str, kind: str) -> DataFrame:
    """Paths whose name holds ``kind`` (such as lightcurve_cdte or spectra_czt) and that hold the date anywhere."""
    return paths.where(F.lower(name_of(F.col("path"))).contains(kind) & F.col("path").contains(date))


def picked(paths: DataFrame) -> DataFrame:
    """(date, path, spectrum) of light-curve files (.lc): of each date in a name the SDD2 file, then the least path, and its spectrum.

    The spectrum is the .pi file of the same folder and stem; null without one.
    """
    stem = F.regexp_extract("path", r"(?s)^(.*)\.[^./]*$", 1)
    curves = paths.where(F.col("path").endswith(".lc")).withColumns({"date": date_in_name(F.col("path")), "stem": stem}).where("date is not null")
    best = curves.groupBy("date").agg(F.min_by(F.struct("path", "stem"), F.struct((~F.col("path").contains("SDD2")).alias("other"), "path")).alias("x")).select("date", "x.*")
    spectra = paths.where(F.col("path").endswith(".pi")).select(stem.alias("stem"), F.col("path").alias("spectrum")).dropDuplicates(["stem"])
    return best.join(spectra, "stem", "left").select("date", "path", "spectrum")


def unpacked(archives: DataFrame) -> DataFrame:
    """(archive, member, content, error) of zip files (path, content): members unzipped, .gz ones also gunzipped and renamed.

    One archive is one task; an archive that can't be read is a row with its error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        for member in (m for m in z.namelist() if not m.endswith("/")):
                            data = z.read(member)
                            packed = member.endswith(".gz")
                            yield pd.DataFrame([{"archive": path, "member": member[:-3] if packed else member, "content": gzip.decompress(data) if packed else data, "error": None}])
                except Exception as e:  # noqa: BLE001 - reported as a row
                    yield pd.DataFrame([{"archive": path, "member": None, "content": None, "error": f"{type(e).__name__}: {e}"}])

    return archives.select("path", "content").mapInPandas(run, "archive string, member string, content binary, error string")
