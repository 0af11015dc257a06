"""The binary alignment format: round trips, ranges against brute force, bytes that are read, failures."""

import os
import random

import pytest
from pyspark.sql import functions as F

from svloom.sources import bam
from svloom.sources.readers import READ_SCHEMA


def _rows(n=3000):
    rng, out = random.Random(3), []
    for k in range(n):
        start = rng.choice([rng.randint(0, 3_000_000), rng.randint(16_000, 17_000)])
        middle = rng.choice([50, 900, 30_000 if k % 50 else 400_000])
        cigar = f"{rng.choice(['', '7H', '9S', '3H5S'])}{rng.randint(20, 80)}M{middle}N{rng.randint(1, 9)}I{rng.randint(1, 90)}D30={rng.randint(1, 5)}X{rng.choice(['', '11S'])}"
        out.append((k, f"read{k}", rng.choice([0, 16, 2048, 4]), rng.choice(["chr1", "chr2"]), start, 0, rng.randint(0, 60), cigar, rng.choice([None, 5]), rng.choice([None, "chr9,5,+,10M,60,1;" * (1 + 4000 * (k % 700 == 0))]), 0, 0, 0, 0))
    return out


def _key(r):
    return r.read_name, r.flag, r.contig, r.ref_start, r.mapq, r.cigar, r.nm, r.sa


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "x.bam")
    contigs = spark.createDataFrame([("chr2", 5_000_000, 0), ("chrEmpty", 10, 1), ("chr1", 5_000_000, 2)], "contig string, length long, ord int")
    bam.write_bam(spark.createDataFrame(_rows(), READ_SCHEMA).repartition(5), contigs, path)
    return path


def test_bam_round_trip(spark, written):
    rows = bam.read_bam(spark, written).orderBy("read_ordinal").collect()
    assert sorted(map(_key, rows), key=str) == sorted(((r[1], r[2], r[3], r[4], r[6], r[7], r[8], r[9]) for r in _rows()), key=str)
    assert [(r.contig == "chr1", r.ref_start) for r in rows] == sorted((r.contig == "chr1", r.ref_start) for r in rows)
    r = next(r for r in rows if r.cigar.startswith("3H5S"))
    lengths = [(int(n), op) for n, op in bam._CIGAR.findall(r.cigar)]
    total = lambda kinds: sum(n for n, op in lengths if op in kinds)
    assert (r.ref_end - r.ref_start, r.query_len, r.q_aln_start, r.q_aln_end, r.read_len) == (total("MDN=X"), total("MIS=X"), 5, 5 + total("MI=X"), total("MISH=X"))
    assert sorted(os.listdir(os.path.dirname(written))) == ["x.bam", "x.bam.bai"]


def test_bam_ranges_equal_brute_force(spark, written):
    rows, rng = _rows(), random.Random(4)
    ranges = [("chr1", 0, 1), ("chr1", 16_383, 16_385), ("chr2", 16_500, 16_501), ("chr2", 2_999_000, 4_000_000), ("chrEmpty", 0, 10), ("none", 0, 5), ("chr1", 9, 9)]
    ranges += [(rng.choice(["chr1", "chr2"]), a := rng.randint(0, 3_200_000), a + rng.choice([1, 500, 70_000, 2_000_000])) for _ in range(8)]
    for contig, start, end in ranges:
        want = sorted(r[1] for r in rows if r[3] == contig and r[4] < end and r[4] + bam.span(r[7]) > start and start < end)
        assert sorted(r.read_name for r in bam.read_bam(spark, written, contig, start, end).collect()) == want, (contig, start, end)
    assert bam.read_bam(spark, written, "chr2").count() == sum(r[3] == "chr2" for r in rows)


def test_bam_ranges_read_a_part_of_the_file(written):
    size = os.path.getsize(written) << 16
    parts = bam.BamReader({"path": written, "contig": "chr1", "start": "2500000", "end": "2500100"}).partitions()
    assert 0 < sum(p.end - p.start for p in parts) < size / 2


def test_bam_parts_of_a_whole_scan(spark, written, monkeypatch):
    monkeypatch.setattr(bam, "PART_BYTES", 30_000)
    parts = bam.BamReader({"path": written}).partitions()
    assert len(parts) > 1 and all(a.end == b.start for a, b in zip(parts, parts[1:]))
    rows = [r for p in parts for batch in bam.BamReader({"path": written}).read(p) for r in batch.to_pylist()]
    assert len(rows) == 3000 and len({r["read_name"] for r in rows}) == 3000


def test_a_failing_bam_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame(_rows(50), READ_SCHEMA).withColumn("mapq", F.when(F.col("read_ordinal") == 40, F.raise_error("lost").cast("int")).otherwise(F.col("mapq")))
    contigs = spark.createDataFrame([("chr1", 9, 0), ("chr2", 9, 1)], "contig string, length long, ord int")
    with pytest.raises(Exception, match="lost"):
        bam.write_bam(rows, contigs, str(tmp_path / "y.bam"))
    assert os.listdir(tmp_path) == []
    (tmp_path / "z.bam").write_bytes(bam.pack_block(b"no"))
    with pytest.raises(Exception, match="no BAM file"):
        bam.read_bam(spark, str(tmp_path / "z.bam")).count()
    bam.write_bam(rows.limit(0), contigs, str(tmp_path / "e.bam"))
    assert bam.read_bam(spark, str(tmp_path / "e.bam")).count() == 0 and bam.read_bam(spark, str(tmp_path / "e.bam"), "chr1", 0, 5).count() == 0
