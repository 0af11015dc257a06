"""Committed files, and clusters of dense places."""

import os
import random

import pytest
from pyspark.sql import functions as F

from svloom.operators import clusters as C
from svloom.operators import islands as I
from svloom.operators.components import components
from svloom.operators.cut import cut, drop, exists
from svloom.operators.order_stats import medians
from svloom.sources import array_store, committed, writers

CALL = "contig string, start long, svlen long, svtype string, gt string"
END = "contig string, start long, dir1 string, contig2 string, end long, dir2 string, gt string"


def _call_set(spark):
    rng = random.Random(1)
    rows = [(f"chr{rng.randint(1, 3)}", rng.randint(0, 5000), 60, rng.choice(["DEL", "INS", "DUP", "INV"]), rng.choice(["0/1", "1/1", None])) for _ in range(300)]
    calls = spark.createDataFrame([*rows, ("chr1", -5, 60, "DEL", "0/1"), ("chr1", 5, 60, "XXX", "0/1"), ("chr1", 5, 60, None, "0/1"), ("chr1", None, 60, "INS", "0/1")], CALL)
    ends = spark.createDataFrame([("chr1", 5, "fwd", "chr3", 9, "rev", "0/1"), ("chr2", 7, "rev", "chr1", 70, "rev", None), ("chr2", 7, "rev", None, 70, "rev", None)], END)
    contigs = spark.createDataFrame([("chr3", 5000, 0), ("chr1", 5000, 1), ("chr2", 4000, 2)], "contig string, length long, ord int")
    return rows, calls, ends, contigs


def test_call_files_in_order_with_counts(spark, tmp_path):
    rows, calls, ends, contigs = _call_set(spark)
    counts = writers.write_call_files(calls.repartition(7), ends, contigs, str(tmp_path), "s")
    assert counts == {"written": 304, "unknown_type": 2, "bad_place": 3}
    assert sorted(os.listdir(tmp_path)) == sorted(f"s_{x}.vcf" for x in ("all", "del", "ins", "dup", "inv", "tra"))
    text = {x: (tmp_path / f"s_{x}.vcf").read_text().splitlines() for x in ("all", "del", "ins", "dup", "inv", "tra")}
    head = [x for x in text["all"] if x.startswith("#")]
    assert head[0] == "##fileformat=VCFv4.2" and [x for x in head if x.startswith("##contig")] == [f"##contig=<ID={c},length={n}>" for c, n in (("chr3", 5000), ("chr1", 5000), ("chr2", 4000))]
    assert all(lines[: len(head)] == head for lines in text.values())
    for kind, lines in text.items():
        body = [x.split("\t") for x in lines[len(head) :]]
        assert [(x[0], int(x[1])) for x in body] == sorted(((x[0], int(x[1])) for x in body), key=lambda x: (["chr3", "chr1", "chr2"].index(x[0]), x[1]))
        assert len(body) == (304 if kind == "all" else 4 if kind == "tra" else sum(r[3] == kind.upper() for r in rows))
    assert {x.split("\t")[9] for x in text["tra"][len(head) :]} == {"./."} and "0/1" in {x.split("\t")[9] for x in text["all"] if "BND" in x}
    assert writers.write_vcf_file(calls.limit(0), contigs, str(tmp_path), "none.vcf") == {"written": 0, "unknown_type": 0, "bad_place": 0}
    assert (tmp_path / "none.vcf").read_text().splitlines() == head


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    def broken(parts):
        for part in parts:
            if (part["line"] == "90").any():
                raise RuntimeError("lost")
            yield part

    rows = spark.range(100, numPartitions=4).select(F.lit("f").alias("file"), F.col("id").cast("string").alias("line"))
    with pytest.raises(Exception, match="lost"):
        committed.write_lines(rows.mapInPandas(broken, rows.schema), str(tmp_path))
    assert os.listdir(tmp_path) == []
    committed.write_lines(rows, str(tmp_path))
    assert (tmp_path / "f").read_text().split() == [str(k) for k in range(100)] and os.listdir(tmp_path) == ["f"]
    with pytest.raises(Exception, match="file and line"):
        spark.range(3).write.format("svloom_lines").mode("append").option("path", str(tmp_path)).save()


def test_failed_call_files_leave_a_snapshot(spark, tmp_path, monkeypatch):
    _, calls, ends, contigs = _call_set(spark)
    monkeypatch.setattr(writers, "write_lines", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        writers.write_call_files(calls, ends, contigs, str(tmp_path), "s")
    assert spark.read.parquet(str(tmp_path / "s_debug" / "calls")).count() == calls.count() and not (tmp_path / "s_all.vcf").exists()


def test_cut_tables_go(spark):
    table = cut(spark.range(5))
    assert table.count() == 5 and exists(spark, table._svloom_path)
    drop(table)
    assert not exists(spark, table._svloom_path)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    chain = list(range(100))
    rng.shuffle(chain)
    edges = [("a", x, y) for x, y in zip(chain, chain[1:])] + [("b", 0, k) for k in range(1, 50)] + [("a", 200, 201), ("a", 201, 200), ("a", 7, 7)]
    rows = components(spark.createDataFrame(edges, "k string, u int, v int"), ["k"]).collect()
    assert {(r.k, r.u): r.v for r in rows} == {("a", k): 0 for k in range(1, 100)} | {("b", k): 0 for k in range(1, 50)} | {("a", 201): 200}


def test_a_dense_place_is_one_cluster(spark):
    """300,000 points within 3000 positions, and one point out of reach."""
    spot = spark.range(300_000).select((F.pmod(F.xxhash64("id"), F.lit(3000)) + 5000).alias("start"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2000)) + 50).alias("svlen"))
    sig = spot.unionAll(spark.createDataFrame([(90_000, 60)], spot.schema)).select(F.lit("c").alias("contig"), F.lit("DEL").alias("svtype"), "start", "svlen", F.lit(300.0).alias("eps"))
    assert sorted(r["count"] for r in C.density_clusters(sig).groupBy("cluster").count().collect()) == [1, 300_000]


def test_points_at_the_very_distance(spark):
    """3-4-5 triangles: 30 by 40 apart is within 50, 31 by 40 is not; over cell borders in all directions."""
    rng = random.Random(3)
    for dx, dy, near in ((30, 40, True), (31, 40, False), (40, 30, True), (0, 50, True), (0, 51, False), (50, 0, True), (30, -40, True), (31, -40, False)):
        rows = []
        for k in range(40):
            x, y = rng.randint(0, 10**6), rng.randint(2 * 10**6, 3 * 10**6)
            rows += [(f"c{k}", "DEL", x, y - x), (f"c{k}", "DEL", x + dx, y + dy - x - dx)]
        sig = spark.createDataFrame(rows, "contig string, svtype string, start long, svlen long").withColumn("eps", F.lit(50.0))
        sizes = {r["count"] for r in C.density_clusters(sig).groupBy("contig", "cluster").count().collect()}
        assert sizes == ({2} if near else {1}), (dx, dy)


def test_leaders_of_chains_and_crowds(spark):
    """Read names that rise along the contig, many rows of one cell, and equal rows."""
    rng = random.Random(4)
    rows = [("a", 300 * k, "fwd", "b", 100, "rev", f"r{k:03d}") for k in range(60)] + [("x", rng.randint(0, 900), "fwd", "y", rng.randint(0, 900), "rev", f"q{rng.randint(0, 99)}") for _ in range(3000)] + [("e", 5, "fwd", "f", 5, "rev", "z")] * 4
    df = spark.createDataFrame(rows, "contig string, start long, dir1 string, contig2 string, end long, dir2 string, read_name string")
    leaders, want = {}, {}
    for r in sorted(rows, key=lambda x: (x[6], x[1], x[4])):
        own = leaders.setdefault((r[0], r[3]), [])
        k = next((k for k, (s, e) in enumerate(own) if abs(s - r[1]) <= 1000 and abs(e - r[4]) <= 1000), len(own))
        if k == len(own):
            own.append((r[1], r[4]))
        want.setdefault((r[0], k), []).append(r[6])
    assert sorted(sorted(x.reads) for x in C.leader_clusters(df).collect()) == sorted(sorted(v) for v in want.values())
    assert C.leader_clusters(df.limit(0)).count() == 0


def test_axis_islands_keep_null_keys_and_evaluate_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    rows = [(None, 5), ("a", 1), ("a", 3), ("a", 30), (None, 2_000_000), (None, 6)]
    df = spark.createDataFrame(rows, "k string, start long").mapInPandas(count, "k string, start long")
    out = I.axis_islands(df, ["k"], ["start"], "start", lambda last: F.col("start") - last > 10)
    assert sorted(((r.k or ""), r.start, r.island) for r in out.collect()) == [("", 5, 1), ("", 6, 1), ("", 2_000_000, 2), ("a", 1, 1), ("a", 3, 1), ("a", 30, 2)]
    assert seen.value == len(rows)


def test_medians_equal_sorted_middles(spark):
    rng = random.Random(6)
    rows = [(g, rng.choice([rng.randint(-(10**12), 10**12), rng.randint(0, 50)]), rng.choice([None, 7, rng.randint(0, 9)])) for g in ("a", "b", None, "c") for _ in range({"a": 2000, "b": 501}.get(g, 4))] + [("d", -(2**62), None), ("d", 2**62, None), ("e", 3, None)]
    found = {r.k: (r.x, r.y) for r in medians(spark.createDataFrame(rows, "k string, x long, y long"), ["k"], ["x", "y"]).collect()}

    def middle(values):
        values = sorted(v for v in values if v is not None)
        return (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2 if values else None

    assert found == {k: (middle([x for g, x, _ in rows if g == k]), middle([y for g, _, y in rows if g == k])) for k in {g for g, _, _ in rows}}
    assert medians(spark.createDataFrame([], "k string, x long"), ["k"], ["x"]).count() == 0


def test_array_stores_are_read_by_ranges(spark, tmp_path, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    data, index = rng.random((1000, 8, 3)).astype(np.float16), np.arange(2000, dtype=np.int32).reshape(1000, 2)
    (tmp_path / "deep").mkdir()
    for name, array in (("a", data), ("a_index", index), ("a_label", np.arange(1000) % 2), ("deep/b", data[:5]), ("a_predict", data)):
        np.save(tmp_path / f"{name}.npy", array)
    monkeypatch.setattr(array_store, "PART_BYTES", 48 * 100)
    parts = array_store.ArraysReader(str(tmp_path)).partitions()
    assert [(p.stem, p.lo, p.hi) for p in parts] == [("a", k, k + 100) for k in range(0, 1000, 100)] + [("deep/b", 0, 5)]
    rows = {(r.stem, r.row): r for r in array_store.read_arrays(spark, str(tmp_path)).collect()}
    assert len(rows) == 1005 and all(np.array_equal(np.float16(rows["a", k].features), data[k].ravel()) and rows["a", k]["index"] == index[k].tolist() and rows["a", k].label == k % 2 for k in range(1000))
    assert rows["deep/b", 4].label is None and rows["deep/b", 4]["index"] is None
    np.save(tmp_path / "deep/b_label.npy", np.zeros(3, np.uint8))
    with pytest.raises(Exception, match="differ in rows"):
        array_store.read_arrays(spark, str(tmp_path)).collect()


def test_array_stores_round_trip_and_fail_whole(spark, tmp_path):
    import numpy as np

    rows = spark.range(500).select((F.col("id") % 3).cast("string").alias("stem"), "id", F.array(F.col("id").cast("int")).alias("index"), F.array(F.col("id") / 8, F.lit(1.0)).alias("features"), F.lit(None).cast("int").alias("label"))
    array_store.write_arrays(rows, str(tmp_path), ["id"], "float32")
    assert sorted(os.listdir(tmp_path)) == sorted(f"{k}{x}.npy" for k in range(3) for x in ("", "_index"))
    assert np.array_equal(np.load(tmp_path / "1_index.npy")[:, 0], np.arange(1, 500, 3)) and np.load(tmp_path / "1.npy").dtype == np.float32
    assert array_store.read_arrays(spark, str(tmp_path)).count() == 500
    broken = rows.withColumn("features", F.when(F.col("id") == 499, F.array(F.raise_error("lost").cast("double"))).otherwise(F.col("features")))
    with pytest.raises(Exception, match="lost"):
        array_store.write_arrays(broken, str(tmp_path / "new"), ["id"])
    assert not [x for x in (tmp_path / "new").rglob("*") if x.is_file()] if (tmp_path / "new").exists() else True


def test_short_runs_are_clustered_without_the_grid(spark, monkeypatch):
    """Runs over batches, parts, keys and nulls give the grid's clusters; points that are alone never come to the grid."""
    rng = random.Random(4)
    spots = [rng.randint(-20_000, 60_000) for _ in range(60)]
    rows = [(rng.choice(("c1", "c2", None)), rng.choice(("DEL", "INV")), rng.choice((rng.choice(spots) + rng.randint(0, 400), None) if k % 40 == 0 else (rng.choice(spots) + rng.randint(0, 400),)), rng.choice((50, 90, 400, None) if k % 30 == 0 else (50, 90, 400)), k) for k in range(1500)]
    rows += [("c1", "DEL", 200_000 + 20 * k, 60, 5000 + k) for k in range(90)]
    sig = spark.createDataFrame(rows, "contig string, svtype string, start long, svlen long, ord long").withColumn("eps", F.when(F.col("svtype") == "DEL", 100.0).otherwise(70.0))
    grid, came = C._grid_clusters, []

    def watched(rest, keys):
        came.append(rest.count())
        return grid(rest, keys)

    monkeypatch.setattr(C, "_grid_clusters", watched)
    want = {r.ord: r.cluster for r in grid(sig, ["contig", "svtype", "eps"]).collect()}
    assert len(want) == len(rows)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size, most in ((7, 12), (10_000, 256)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            monkeypatch.setattr(C, "RUN_POINTS", most)
            assert {r.ord: r.cluster for r in C.density_clusters(sig).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert 90 <= came[1] < came[0] < len(rows) + 1
    apart = spark.createDataFrame([("c", "DEL", 500 + 100_000 * k, 60, k) for k in range(50)], sig.drop("eps").schema).withColumn("eps", F.lit(300.0))
    assert C.density_clusters(apart).select("cluster").distinct().count() == 50 and came[2] <= 2
