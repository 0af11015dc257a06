"""What the lists of reads of calls shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from svloom.operators import support as U

READ = "read_name string, read_ordinal long, contig string, ref_start long, ref_end long, flag int, mapq int"
CALL = "call_id string, contig string, svtype string, start long, svlen long, reads array<string>"


@pytest.fixture
def tables(spark):
    rng = random.Random(11)
    reads = [(f"r{k}", k, rng.choice(("c1", "c2")), s := rng.choice((5000, rng.randint(0, 40000))), s + rng.randint(0, 9000), 0, 60) for k in range(600)]
    calls = [(str(k), rng.choice(("c1", "c2")), rng.choice(("INS", "DEL", "BND")), rng.randint(0, 40000), rng.choice((50, 20000)), [f"r{rng.randint(0, 599)}" for _ in range(5)]) for k in range(120)]
    return reads, calls, spark.createDataFrame(reads, READ), spark.createDataFrame(calls, CALL)


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_lists_of_cells_go_on_from_batch_to_batch(spark, monkeypatch, tables, batch):
    reads, calls, r, c = tables
    monkeypatch.setattr(U, "CELL_PIECE", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {}
        for row in U.evidence_reads(c, r, ["call_id"], 20).collect():
            got.setdefault(row.call_id, []).append((row.nth, row.read_ordinal))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for call_id, contig, kind, start, svlen, own in calls:
        end, bias = (start + svlen, 2000) if kind == "DEL" else (start + 1, 1000)
        hits = sorted((x[3], x[1]) for x in reads if x[2] == contig and x[3] < end + bias and x[4] > max(0, start - bias) and x[0] not in own)
        assert sorted(got.get(call_id, [])) == [(n, x[1]) for n, x in enumerate(hits[:20], 1)]


def test_reads_are_dealt_to_pieces_and_not_to_cells(monkeypatch, tables):
    """A read of 9,000 positions touches 46 cells of 200."""
    _, _, r, c = tables
    dealt, bins = [], U.with_bins
    monkeypatch.setattr(U, "with_bins", lambda *args: dealt.append(bins(*args)) or dealt[-1])
    U.evidence_reads(c, r, ["call_id"])
    assert dealt and sum(x.count() for x in dealt) <= 2 * r.count()


def test_arrays_of_near_reads_are_not_shuffled(tables):
    _, _, r, c = tables
    for found in (U.reference_support(c, r, ["call_id"]), U.evidence_reads(c, r, ["call_id"])):
        above, filtered, _ = found._jdf.queryExecution().executedPlan().toString().partition("filter(__list")
        assert filtered and "Exchange" not in above and "Join" not in above


def test_calls_without_reads_have_no_reference_support(spark, tables):
    _, _, r, _ = tables
    c = spark.createDataFrame([("a", None, "INS", 5, 50, ["x"]), ("b", "c9", "DEL", 5, 50, ["x"]), ("c", "c1", "BND", None, 1, None)], CALL)
    assert {x.call_id: x.ref_support for x in U.reference_support(c, r, ["call_id"]).select("call_id", F.col("ref_support")).collect()} == {"a": 0, "b": 0, "c": 0}


def test_lists_of_first_reads_are_about_the_reads(spark, monkeypatch, tables):
    """A read of 9,000 positions touches 10 cells of 1,000, but 3 or 4 of 4,000."""
    reads, _, r, _ = tables
    calls = [(str(k), "c1", "INS", k * 40, 1, []) for k in range(1000)]
    rows, listed = [], U._listed
    monkeypatch.setattr(U, "_listed", lambda *args: rows.append(listed(*args)) or rows[-1])
    found = U.refine_reads(spark.createDataFrame(calls, CALL), r.select("contig", "read_ordinal", "ref_start", "ref_end"), ["call_id"], first=5000)
    assert rows[0].count() <= 3.5 * sum(x[2] == "c1" for x in reads)
    got = {}
    for row in found.collect():
        got.setdefault(row.call_id, []).append((row.nth, row.read_ordinal))
    for call_id, contig, _, start, _, _ in calls:
        hits = sorted((x[3], x[1]) for x in reads if x[2] == contig and x[3] < start + 201 and x[4] > max(0, start - 200))
        assert sorted(got.get(call_id, [])) == [(n, x[1]) for n, x in enumerate(hits, 1)]
