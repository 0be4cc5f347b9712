"""Incremental ingest: nothing twice, changed archives again, broken ones in the error table."""

import gzip
import os
import zipfile

from pyspark.sql import functions as F

from helioflux.sources import ingest


def archive(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "."), data)


def held(landing):
    return sorted((r.name, r.member, bytes(r.content)) for r in landing.members().collect())


def test_synced_archives(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(source)
    archive(source / "a.zip", one__txt=b"1", two__fits__gz=gzip.compress(b"22"))
    (source / "bad.zip").write_bytes(b"no archive")
    first = ingest.synced(spark, str(source), target)
    assert held(first) == [("a.zip", "one.txt", b"1"), ("a.zip", "two.fits", b"22")]
    assert [(r.name, r.error.split(":")[0]) for r in first.errors().collect()] == [("bad.zip", "BadZipFile")]
    assert first.ledger().count() == 2
    # Nothing new: nothing is read, no row is added.
    state = sorted(os.listdir(f"{target}/state/offsets"))
    again = ingest.synced(spark, str(source), target)
    assert held(again) == held(first) and again.ledger().count() == 2
    assert sorted(os.listdir(f"{target}/state/offsets")) == state
    # One more, one of another size: the old version's members are gone from view.
    archive(source / "b.zip", three__txt=b"333")
    archive(source / "a.zip", one__txt=b"11111")
    archive(source / "bad.zip", fine__txt=b"ok")
    third = ingest.synced(spark, str(source), target)
    assert held(third) == [("a.zip", "one.txt", b"11111"), ("b.zip", "three.txt", b"333"), ("bad.zip", "fine.txt", b"ok")]
    assert third.errors().isEmpty() and third.ledger().count() == 5
    assert held(ingest.synced(spark, str(source), target)) == held(third) and third.ledger().count() == 5


def test_a_batch_that_failed_is_not_seen_and_lands_once(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(source)
    archive(source / "a.zip", one__txt=b"1")
    landing = ingest.Landing(spark, target)
    rows = spark.read.format("binaryFile").load(str(source))
    # Members are written, then the run dies before its ledger rows.
    own = rows.withColumns({"name": F.lit("a.zip"), "size": F.col("length")})
    part = ingest.unpacked(own).join(own.select(F.col("path").alias("archive"), "name", "size"), "archive").drop("error").withColumn("batch", F.lit("new-0"))
    part.write.partitionBy("batch").parquet(f"{target}/members")
    assert landing.members().isEmpty()
    assert held(ingest.synced(spark, str(source), target)) == [("a.zip", "one.txt", b"1")]
