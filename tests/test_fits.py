import gzip
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioflux.sources import fits, instruments


def card(key, value):
    return f"{key:<8}= {value:>20}".ljust(80).encode()


def block(cards):
    data = b"".join(cards) + b"END".ljust(80)
    return data.ljust(-(-len(data) // fits.BLOCK) * fits.BLOCK)


def test_binary_table(spark, tmp_path):
    rows = np.array([(1.5, [1, 2]), (np.nan, [3, 4])], dtype=[("TIME", ">f8"), ("COUNTS", ">i2", (2,))])
    cards = [card("XTENSION", "'BINTABLE'"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 12), card("NAXIS2", 2), card("PCOUNT", 0), card("TFIELDS", 2), card("TTYPE1", "'TIME'"), card("TFORM1", "'1D'"), card("TTYPE2", "'COUNTS'"), card("TFORM2", "'2I'"), card("TZERO2", 10), card("EXTNAME", "'RATE'")]
    data = block([card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0)]) + block(cards) + rows.tobytes().ljust(fits.BLOCK, b"\0")
    (tmp_path / "a.fits").write_bytes(data)
    (tmp_path / "b.fits").write_bytes(b"junk")
    spark.dataSource.register(fits.FitsSource)
    got = spark.read.format("fits").option("path", f"{tmp_path}/*.fits").option("columns", "counts").option("mode", "dropmalformed").load().orderBy("row").collect()
    assert [(r.hdu, r.row, r["values"]) for r in got] == [("RATE", 0, [11.0, 12.0]), ("RATE", 1, [13.0, 14.0])]


def bands_file(folder):
    """A band curve of two samples, one NaN, as the hard instrument's files have it."""
    rows = np.array([(60000.0, 5.0), (60000.5, np.nan)], dtype=[("MJD", ">f8"), ("CTR", ">f8")])
    cards = [card("XTENSION", "'BINTABLE'"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 16), card("NAXIS2", 2), card("PCOUNT", 0), card("TFIELDS", 2), card("TTYPE1", "'MJD'"), card("TFORM1", "'1D'"), card("TTYPE2", "'CTR'"), card("TFORM2", "'1D'"), card("EXTNAME", "'X_20.00KEV_TO_30.00KEV'")]
    data = block([card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0)]) + block(cards) + rows.tobytes().ljust(fits.BLOCK, b"\0")
    (folder / "lightcurve_cdte_20240102.fits").write_bytes(data)
    (folder / "lightcurve_cdte_20240103.fits").write_bytes(b"junk")


def test_band_reader_reports_bad_files(spark, tmp_path):
    bands_file(tmp_path)
    rows = instruments.hard_bands(instruments.files(spark, str(tmp_path), "*.fits"))
    got = [(r.date, r.e_lo, r.e_hi, r.t, r.ctr) for r in instruments.good(rows).orderBy("t").collect()]
    assert got == [("20240102", 20.0, 30.0, 1677283200.0, 5.0), ("20240102", 20.0, 30.0, 1677283200.0 + 43200, 0.0)]
    assert [r.path.rsplit("/", 1)[1] for r in instruments.errors(rows).collect()] == ["lightcurve_cdte_20240103.fits"]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.lc.gz", gzip.compress(b"one"))
        z.writestr("two.pi", b"two")
    (tmp_path / "b.zip").write_bytes(b"junk")
    out = instruments.unpacked(instruments.files(spark, str(tmp_path), "*.zip")).collect()
    assert sorted((r.member, bytes(r.content)) for r in out if r.error is None) == [("two.pi", b"two"), ("x/one.lc", b"one")]
    assert sum(r.error is not None for r in out) == 1


def table(name, columns, cards=()):
    """A binary table of columns (name, code, values)."""
    kinds = {"D": ">f8", "E": ">f4", "J": ">i4", "I": ">i2"}
    dtype = np.dtype([(n, kinds[c], np.shape(v)[1:]) for n, c, v in columns])
    rows = np.zeros(len(columns[0][2]), dtype)
    own = []
    for i, (n, c, v) in enumerate(columns, 1):
        rows[n] = v
        own += [card(f"TTYPE{i}", f"'{n}'"), card(f"TFORM{i}", f"'{int(np.prod(np.shape(v)[1:]))}{c}'")]
    base = [card("XTENSION", "'BINTABLE'"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", dtype.itemsize), card("NAXIS2", len(rows)), card("PCOUNT", 0), card("TFIELDS", len(columns)), card("EXTNAME", f"'{name}'")]
    data = rows.tobytes()
    return block(base + own + [card(k, v) for k, v in cards]) + data.ljust(-(-len(data) // fits.BLOCK) * fits.BLOCK, b"\0")


PRIMARY = block([card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0)])


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, path):
        self.file, self.n = open(path, "rb", buffering=0), 0

    def seek(self, *at):
        return self.file.seek(*at)

    def read(self, n):
        self.n += n
        return self.file.read(n)


def test_one_column_of_one_range_reads_its_bytes(tmp_path):
    n = 20_000
    wide = table("SPECTRUM", [("TSTART", "D", np.arange(n)), ("COUNTS", "J", np.arange(n * 1200).reshape(n, 1200) % 1000), ("EXPOSURE", "D", np.ones(n))])
    narrow = table("RATE", [("TIME", "D", np.arange(n) + 0.5), ("COUNTS", "J", np.arange(n))])
    (tmp_path / "x").write_bytes(PRIMARY + wide + narrow)
    file = Counted(tmp_path / "x")
    spectrum, rate = fits.extents(file)
    headers = file.n
    assert headers <= 4 * fits.BLOCK and spectrum.count == rate.count == n
    # A column of wide rows: its own bytes alone; of narrow ones: the rows from the first to the last.
    got = fits.Part(file, spectrum, 5000, 5100).columns("TSTART")[0]
    assert got.tolist() == list(range(5000, 5100)) and file.n - headers == 800
    file.n = 0
    assert fits.Part(file, rate, 10, 20).columns("COUNTS")[0].tolist() == list(range(10, 20)) and file.n == 9 * 12 + 4
    # Ranges of any size part the rows.
    for size in (1000, 99_991, 1 << 22):
        end = (tmp_path / "x").stat().st_size
        ends = [fits.parts(file, lo, min(lo + size, end)) for lo in (range(0, end, size) if size > 1 << 20 else [*range(0, 50 * size, size)])]
        for a, b in zip(ends, ends[1:], strict=False):
            assert [p.last for p in a] == [p.first for p in b]
        assert [p.first for p in ends[0]] == [0, 0] and (size < 1 << 20 or [p.last for p in ends[-1]] == [n, n])


def test_splits_give_what_whole_files_give(spark, tmp_path):
    n, rng = 3000, np.random.default_rng(5)
    mjd = 60310.0 + np.arange(n) / 86400
    values = rng.poisson(5, n).astype(float)
    values[::7] = np.nan
    (tmp_path / "lightcurve_cdte_20240101.fits").write_bytes(PRIMARY + b"".join(table(f"CDTE_{lo}KEV_TO_{lo + 20}.00KEV", [("MJD", "D", mjd), ("CTR", "E", values + lo)]) for lo in (20, 40)))
    (tmp_path / "lightcurve_cdte_20240102.fits").write_bytes((tmp_path / "lightcurve_cdte_20240101.fits").read_bytes()[:60_000])
    (tmp_path / "spectra czt%20_20240101.pi").write_bytes(PRIMARY + table("SPECTRUM", [("TSTART", "D", np.arange(n) * 20.0), ("CHANNEL", "I", np.tile(np.arange(64), (n, 1))), ("COUNTS", "I", rng.poisson(3, (n, 64))), ("EXPOSURE", "D", np.arange(n) % 3 * 10.0)], [("TSTART", 60310.5)]))
    (tmp_path / "empty_20240103.fits").write_bytes(b"")
    for reader, pattern in ((instruments.hard_bands, "*.fits"), (instruments.hard_spectra, "*.pi"), (instruments.soft_spectra, "*.pi")):
        whole, cut = reader(instruments.files(spark, str(tmp_path), pattern)), reader(instruments.splits(spark, str(tmp_path), pattern, split_mb=0.01))
        key = lambda rows: sorted(map(str, rows.collect()))
        assert key(whole) == key(cut) and instruments.good(cut).count() == (2 * n if pattern == "*.fits" else n)
    # The file that ends early has one error and no rows; Spark lists no empty files.
    bad = instruments.errors(instruments.hard_bands(instruments.splits(spark, str(tmp_path), "*.fits", split_mb=0.01)))
    assert sorted(r.path[-13:-5] for r in bad.collect()) == ["20240102"]
    first = instruments.hard_spectra(instruments.splits(spark, str(tmp_path), "*.pi", split_mb=0.01)).orderBy("t").limit(3).collect()
    assert [(r.t, r.exposure, r.date, r.detector) for r in first] == [((60310.5 - 40587) * 86400 + 20 * i, e, "20240101", "czt") for i, e in enumerate((20.0, 10.0, 20.0))]
    assert first[0].channels == [float(i) for i in range(64)]
    assert {r.channels is None for r in instruments.soft_spectra(instruments.splits(spark, str(tmp_path), "*.pi")).limit(5).collect()} == {False}


def test_split_ranges_reach_many_tasks(spark, tmp_path):
    (tmp_path / "one.lc").write_bytes(PRIMARY + table("RATE", [("TIME", "D", np.arange(40_000)), ("COUNTS", "D", np.arange(40_000) % 9)]))
    rows = instruments.light_curve(instruments.splits(spark, str(tmp_path), "*.lc", split_mb=0.02, tasks=6))
    per = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 40_000 and len(per) >= 4 and max(per) < 20_000


def test_filters_reach_the_reader(spark, tmp_path):
    for d in (1, 2):
        (tmp_path / f"{d}.fits").write_bytes(PRIMARY + table("A", [("X", "D", np.arange(100)), ("Y", "D", np.arange(100) * d)]) + table("B", [("X", "D", np.arange(50))]))
    (tmp_path / "junk.fits").write_bytes(b"junk")
    spark.dataSource.register(fits.FitsSource)
    read = lambda **o: spark.read.format("fits").options(path=f"{tmp_path}/*.fits", split_mb=0.001, **o).load()
    wanted = (F.col("file") == f"{tmp_path}/2.fits") & (F.col("hdu") == "A") & F.col("name").isin("Y", "Z") & (F.col("row") >= 7) & (F.col("row") < 10) & (F.col("header").contains("TFORM"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        # The junk file isn't opened when the file's filter is pushed, and fails the read otherwise.
        assert sorted((r.row, r["values"]) for r in read(pushdown="true").where(wanted).collect()) == [(7, [14.0]), (8, [16.0]), (9, [18.0])]
        with pytest.raises(Exception, match="shorter than one block"):
            read().where(wanted).collect()
        assert read(pushdown="true", mode="dropmalformed").where("row > 97 and row <= 98 and name = 'X'").count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert read(mode="dropmalformed").count() == 500
