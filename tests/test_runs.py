"""The two runs from reads to files, feature specifications, loss and fitted scorers."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import functions as F

from svloom.operators.score import bce_loss, best_threshold, fit_linear, linear_scorer, score_windows, threshold_curve
from svloom.plans import runs
from svloom.plans.intervals import labelled_windows
from svloom.sources import config, readers, writers

READ = "read_ordinal long, read_name string, flag int, contig string, ref_start long, ref_end long, mapq int, cigar string, sa string, nm int, query_len int, q_aln_start int, q_aln_end int, read_len int"


def _reads(spark):
    """Twelve reads with a deletion of 60 at 5000 of chr1, six through chr2 without, twelve with a split part on chr2."""
    rows = [(k, f"d{k}", 0, "chr1", 3000, 7060, 60, "2000M60D2000M", None, 60, 4000, 0, 4000, 4000) for k in range(12)]
    rows += [(20 + k, f"n{k}", 16, "chr2", 1000, 9000, 60, "8000M", None, 0, 8000, 0, 8000, 8000) for k in range(6)]
    rows += [(40 + k, f"t{k}", 0, "chr1", 12_000, 14_000, 60, "2000M1000S", "chr2,20001,+,2000S1000M,60,0;", 0, 3000, 0, 2000, 3000) for k in range(12)]
    return spark.createDataFrame(rows, READ)


def test_runs_write_stores_predictions_and_six_files(spark, tmp_path):
    reads = _reads(spark)
    contigs = spark.createDataFrame([("chr1", 40_000, 0), ("chr2", 40_000, 1)], "contig string, length long, ord int")
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    given = config.GenerateConfig(region=20_000, feature_dtype="float16")
    spec = runs.generate(reads, store, given)
    assert spec["feature_dim"] == 20 and readers.store_spec(spark, store) == config.normal_spec(spec)
    n = readers.read_store(spark, store).count()
    runs.generate(reads, store, given)
    assert readers.read_store(spark, store).count() == n > 0
    values = {x for r in readers.read_store(spark, store).limit(3).collect() for x in r.features}
    assert all(float(np.float16(x)) == x for x in values)

    meta = {"threshold": 0.4, "head": "cnn", "feature_config": {"feature_dim": 20, "window_size": 2000}}
    scorer = linear_scorer([0.0] * 40_000, 0.0)
    run = lambda **x: runs.call(reads, contigs, store, str(tmp_path / "probs"), out, "s", scorer, meta, config.CallConfig(**x))
    assert run(predict_only=True) == {} and not (tmp_path / "out").exists()
    probs = readers.read_store(spark, str(tmp_path / "probs"))
    assert probs.count() == n and {r["head"] for r in probs.select("head").distinct().collect()} == {"cnn"}
    counts = run(cluster_only=True)
    lines = [x.split("\t") for x in (tmp_path / "out" / "s_all.vcf").read_text().splitlines() if not x.startswith("#")]
    assert counts["written"] == len(lines) and ["chr1", "5000", "<DEL>"] in [[x[0], x[1], x[4]] for x in lines]
    assert any("SVTYPE=BND" in x[7] for x in lines) and len((tmp_path / "out" / "s_tra.vcf").read_text().splitlines()) > 8
    assert run(cluster_only=True, threshold=0.6)["written"] == 0
    with pytest.raises(ValueError, match="feature_dim"):
        runs.call(reads, contigs, store, str(tmp_path / "p2"), out, "s", scorer, {"feature_config": {"feature_dim": 3}})


def test_specifications_of_stores(spark, tmp_path):
    rows = spark.range(4).select((F.col("id") % 2).alias("region"), F.array(*[F.lit(0.5)] * 6).alias("features"))
    writers.write_store(rows, str(tmp_path / "bare"), ["region"])
    assert readers.store_spec(spark, str(tmp_path / "bare"), 2) == {"feature_version": "inferred_3d", "feature_dim": 3, "window_size": 2, "channel_names": ["feature_0", "feature_1", "feature_2"], "normalization": "unknown"}
    writers.write_store(rows.filter("region = 0"), str(tmp_path / "two"), ["region"], spec={"feature_dim": 3, "window_size": 2})
    writers.write_store(rows.filter("region = 1"), str(tmp_path / "two"), ["region"], spec={"feature_dim": 6, "window_size": 1})
    with pytest.raises(ValueError, match="differ"):
        readers.store_spec(spark, str(tmp_path / "two"))
    assert config.resolve_spec(None, None) == config.feature_spec() and config.inferred_spec(40_000) == config.feature_spec()
    assert config.resolve_spec({"feature_dim": 3, "normalization": "a"}, {"feature_dim": 3, "channel_names": ["x", "y", "z"]})["normalization"] == "a"
    assert json.dumps(config.feature_spec())


def test_halves_are_those_of_numpy(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, 65504.0, 1e6, -1e6, 2.0**-24, 2.0**-25 * 3, 6e-8, 2049.0, 2051.0] + [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 4) for _ in range(500)]
    rows = spark.createDataFrame([(float(np.float32(v)),) for v in values], "x float").select("x", runs.half(F.col("x")).alias("h")).collect()
    assert all(r.h == float(np.clip(np.float16(np.clip(r.x, -65504, 65504)), -65504, 65504)) for r in rows)


def test_loss_of_odd_probabilities(spark):
    rows = spark.createDataFrame([(float("nan"), 1), (float("inf"), 1), (float("-inf"), 0), (0.0, 1), (0.25, 0)], "p double, t int")
    want = [(0.5, 1), (1 - 1e-6, 1), (1e-6, 0), (1e-6, 1), (0.25, 0)]
    loss = [-(t * math.log(p) + (1 - t) * math.log(1 - p)) for p, t in want]
    got = rows.agg(bce_loss(F.col("p"), F.col("t")).alias("a"), bce_loss(F.col("p"), F.col("t"), 2.0).alias("b")).first()
    assert abs(got.a - sum(loss) / 5) < 1e-12 and abs(got.b - sum(x * (2 if t else 1) for x, (_, t) in zip(loss, want)) / 5) < 1e-12


def test_a_fitted_scorer_beats_the_stand_in(spark, sf):
    windows = labelled_windows(spark, sf).cache()
    loss = lambda scorer: score_windows(windows, scorer).agg(bce_loss(F.col("prob"), F.col("label")).alias("x")).first().x
    fitted = linear_scorer(*fit_linear(windows, rounds=12))
    assert loss(fitted) < loss(linear_scorer([0.1, 0.001], -3.0))
    curve = threshold_curve(score_windows(windows, fitted))
    top = curve.orderBy(F.desc("f1"), "nth").first()
    assert best_threshold(curve) == top.threshold and curve.count() == 92 and top.f1 > 0
    assert fit_linear(windows.limit(0)) == ([], 0.0)


def test_scoring_with_resources_of_its_own(spark):
    """The profile reaches the scoring stage: a session without executors of its own refuses it there, and scores without one."""
    df = spark.range(10).select("id", F.array(F.col("id").cast("double")).alias("features"))
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(2)).build
    with pytest.raises(Exception, match="TaskResourceProfile"):
        score_windows(df, linear_scorer([0.1], -1.0), profile=profile).collect()
    assert score_windows(df, linear_scorer([0.1], -1.0)).count() == 10
