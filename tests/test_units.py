"""Edges of the operators on small rows, and brute-force comparisons."""

import gzip
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from svloom.functions import alignment as A
from svloom.functions import genotypes as G
from svloom.functions import variants as V
from svloom.operators import clusters as C
from svloom.operators import cut
from svloom.operators import islands as I
from svloom.operators import pileup as P
from svloom.operators import support as U
from svloom.operators import trio as T
from svloom.operators.ranges import range_count, range_join
from svloom.operators.score import linear_scorer, score_windows
from svloom.plans import calls as calls_plans
from svloom.plans import pipelines
from svloom.sources import config, readers, writers
from svloom.sources.fixtures import projection


def test_cigar_edges(spark):
    rows = [(1, "10S50M45D30M60I20M5H"), (2, "5H7S50M"), (3, "50M"), (4, "50M9S"), (5, "10M20N39D10M40D10M41D5M")]
    df = spark.createDataFrame(rows, "id int, cigar string").select("id", A.cigar_span(F.lit(100), F.col("cigar")).alias("s"), A.indels(A.cigar_ops(F.col("cigar")), F.lit(100)).alias("walk"), A.indels(A.cigar_ops(F.col("cigar")), F.lit(100), True).alias("skip"))
    got = {r.id: r for r in df.collect()}
    assert tuple(got[1].s) == (100, 245, 10, 170)
    assert tuple(got[2].s) == (100, 150, 12, 62)
    assert tuple(got[4].s) == (100, 150, 0, 50)
    assert [tuple(x) for x in got[1].walk] == [("D", 150, 45), ("I", 225, 60)]
    assert [tuple(x) for x in got[5].walk] == [("D", 159, 40), ("D", 209, 41)]
    assert [x.start for x in got[5].skip] == [179, 229]


def test_sa_tag(spark):
    row = spark.createDataFrame([("chr2,100,-,20S60M10D200S,9,3;chr9,5,+,5H300M,61,1;",)], "sa string").select(A.split_alignments(F.col("sa")).alias("s")).first()
    assert [(x.contig, x.pos, x.strand, x.mapq) for x in row.s] == [("chr2", 100, "-", 9), ("chr9", 5, "+", 61)]


def test_range_join_equals_nested_loop(spark):
    rng = random.Random(3)
    left = [(k, f"c{rng.randint(0, 2)}", s := rng.randint(0, 500), s + rng.randint(1, 200)) for k in range(80)]
    right = [(k, f"c{rng.randint(0, 2)}", s := rng.randint(0, 500), s + rng.randint(1, 90)) for k in range(90)]
    l = spark.createDataFrame(left, "a int, contig string, start long, end long")
    r = spark.createDataFrame(right, "b int, contig string, rs long, re long")
    want = {(x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] < y[3] and x[3] > y[2]}
    for width in (7, 64, 1000):
        pairs = [(x.a, x.b) for x in range_join(l, r, ["contig"], ("start", "end"), ("rs", "re"), width).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
    semi = {x.a for x in range_join(l, r, ["contig"], ("start", "end"), ("rs", "re"), 50, "left_semi").collect()}
    anti = {x.a for x in range_join(l, r, ["contig"], ("start", "end"), ("rs", "re"), 50, "left_anti").collect()}
    assert semi == {a for a, _ in want} and anti == {x[0] for x in left} - semi
    counts = {x.a: x.n for x in range_count(l, r, ["contig"], ("start", "end"), ("rs", "re"), 50, ["a"]).collect()}
    assert counts == {x[0]: sum(1 for a, _ in want if a == x[0]) for x in left}


def test_density_clusters_are_components(spark):
    rng = random.Random(5)
    points = [(rng.choice(["c1", "c2"]), "DEL", rng.randint(0, 9000), rng.randint(50, 4000), f"r{k}", "cigar", k) for k in range(150)]
    sig = spark.createDataFrame(points, "contig string, svtype string, start long, svlen long, read_name string, source string, ord long").withColumn("eps", F.lit(300.0))
    rows = C.density_clusters(sig).collect()
    ours = {}
    for r in rows:
        ours.setdefault((r.contig, r.cluster), set()).add(r.ord)
    root = list(range(len(points)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(points):
        for j, y in enumerate(points[:i]):
            if x[0] == y[0] and math.hypot(x[2] - y[2], x[2] + x[3] - y[2] - y[3]) <= 300:
                root[max(top(i), top(j))] = min(top(i), top(j))
    want = {}
    for k in range(len(points)):
        want.setdefault(top(k), set()).add(k)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, want.values()))


def test_leader_clusters_first_fit(spark):
    rng = random.Random(6)
    rows = [("chr1", rng.randint(0, 20000), "fwd", "chr10", rng.randint(0, 4000), "rev", f"r{k:03d}") for k in range(120)]
    df = spark.createDataFrame(rows, "contig string, start long, dir1 string, contig2 string, end long, dir2 string, read_name string")
    leaders, want = [], {}
    for r in sorted(rows, key=lambda x: (x[6], x[1], x[3], x[4])):
        k = next((k for k, (s, e) in enumerate(leaders) if abs(s - r[1]) <= 1000 and abs(e - r[4]) <= 1000), len(leaders))
        if k == len(leaders):
            leaders.append((r[1], r[4]))
        want.setdefault(k, []).append(r[6])
    assert sorted(sorted(x.reads) for x in C.leader_clusters(df).collect()) == sorted(sorted(v) for v in want.values())


def test_summary_keeps_single_short_rows(spark):
    rows = [("c", 1, "DEL", 100, 45, "a", "cigar"), ("c", 2, "DEL", 200, 45, "b", "cigar"), ("c", 2, "DEL", 203, 60, "d", "split"), ("c", 2, "DEL", 208, 63, "e", "split")]
    df = spark.createDataFrame(rows, "contig string, cluster int, svtype string, start long, svlen long, read_name string, source string")
    got = {r.cluster: (r.start, r.svlen, r.support, r.sources) for r in C.summarise(df, ["contig", "cluster", "svtype"]).collect()}
    assert got == {1: (100, 45, 1, ["cigar"]), 2: (206, 62, 2, ["split"])}


def test_bands():
    assert C.parse_bands("1000:220,300:150") == ((300, 150.0), (1000, 220.0))
    for bad in ("", "300", "0:5", "5:-1"):
        with pytest.raises(ValueError):
            C.parse_bands(bad)


@pytest.mark.parametrize("ref,alt,error,loggl,bayes,em", [(0, 0, 0.01, "./.", "0/0", "1/1"), (300, 200, 0.05, "0/1", "0/1", "1/1"), (0, 3, 0.0, "1/1", "1/1", "1/1"), (10, 0, 0.01, "0/0", "0/0", "0/0")])
def test_genotype_edges(spark, ref, alt, error, loggl, bayes, em):
    r, a, e = F.lit(ref), F.lit(alt), F.lit(error)
    row = spark.range(1).select(G.genotype_loggl(r, a, e).alias("l"), G.genotype_bayes(r, a, e).alias("b"), G.genotype_em(r, a, e).alias("m")).first()
    assert row.l == loggl and row.b == bayes
    assert row.m == em or (ref, alt) == (0, 0)


def test_ratio_borders(spark):
    rows = spark.createDataFrame([(8, 2), (2, 8), (0, 0), (5, 5)], "r long, a long").select(G.genotype_ratio(F.col("r"), F.col("a"), 0.8).alias("g")).collect()
    assert [x.g for x in rows] == ["0/0", "1/1" if 0.2 <= 1 - 0.8 else "0/1", "./.", "0/1"]


@pytest.mark.parametrize("coverage,local,error,kind", [(0, 5, 0.0, "INS"), (10, 10, 0.2, "INS"), (20, 20, 0.2, "DEL"), (79, 60, 0.1, "DUP"), (80, 60, 0.1, "DUP")])
def test_min_support(spark, coverage, local, error, kind):
    mu, sigma, rho = G.CURVES[kind]
    noisy, side, limit = G.NOISY_MU[kind]
    if error > 0.1 and (coverage <= limit if side < 0 else coverage >= limit):
        mu = noisy
    want = max(1, round(mu * coverage**sigma * (1 + rho * (math.tanh((local - coverage) / coverage) if coverage else 0))))
    if kind != "INS" and coverage >= 80:
        want = 10
    row = spark.createDataFrame([(kind, coverage, local, error)], "k string, c long, l long, e double").select(G.min_support(F.col("k"), F.col("c"), F.col("l"), F.col("e")).alias("m")).first()
    assert row.m == want


def test_sweep_equals_naive(spark):
    rng = random.Random(9)
    iv = [("c", rng.randint(0, 1), s := rng.randint(0, 60), s + rng.randint(1, 30)) for _ in range(60)]
    df = spark.createDataFrame(iv, "contig string, channel int, start long, end long")
    got = {(r.channel, p): r.cnt for r in P.sweep(df, ["contig", "channel"]).collect() for p in range(r.start, r.end)}
    want = {}
    for _, ch, s, e in iv:
        for p in range(s, e):
            want[ch, p] = want.get((ch, p), 0) + 1
    assert got == want


def test_adjacent_windows_need_equal_ends(spark):
    df = spark.createDataFrame([("c", 0, 2000), ("c", 2000, 4000), ("c", 3000, 5000), ("c", 8000, 9000)], "contig string, start long, end long")
    assert sorted((r.start, r.end) for r in I.merge_adjacent(df, ["contig"], "start", "end").collect()) == [(0, 4000), (3000, 5000), (8000, 9000)]


def test_vcf_round_trip(spark, tmp_path):
    calls = spark.createDataFrame([("chr1", 100, 60, "DEL", "0/1"), ("chr1", -5, 60, "DEL", "0/1"), ("chr2", 7, 80, "INS", None), ("chr2", 9, 80, "XXX", None)], "contig string, start long, svlen long, svtype string, gt string")
    contigs = spark.createDataFrame([("chr1", 5000, 0), ("chr2", 4000, 1)], "contig string, length long, ord int")
    writers.write_vcf(calls, contigs, str(tmp_path / "v"))
    text = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert text[0] == "##fileformat=VCFv4.2" and sum(not x.startswith("#") for x in text) == 2
    back = readers.read_vcf(spark, str(tmp_path / "v"), True).orderBy("chrom").collect()
    assert [(r.chrom, r.pos, r.end, r.svlen, r.svtype, r.gt) for r in back] == [("chr1", 100, 160, 60, "DEL", "0/1"), ("chr2", 7, 7, 80, "INS", "1/1")]
    writers.write_vcf(calls.limit(0), contigs, str(tmp_path / "e"))
    assert all(r.value.startswith("#") for r in spark.read.text(str(tmp_path / "e")).collect())


def test_breakend_lines_read_back(spark):
    df = spark.createDataFrame([(a, b) for a in ("fwd", "rev") for b in ("fwd", "rev")], "a string, b string")
    rows = df.select("a", "b", V.bnd_lines(F.lit("chr1"), F.lit(5), F.col("a"), F.lit("chr10"), F.lit(9), F.col("b"), F.lit(None).cast("string")).alias("l")).collect()
    alts = {(r.a, r.b): [x.split("\t")[4] for x in r.l] for r in rows}
    assert alts["fwd", "fwd"] == ["N[chr10:9[", "]chr1:5]N"] and alts["rev", "rev"] == ["[chr10:9[N", "N]chr1:5]"]
    assert alts["fwd", "rev"] == ["N]chr10:9]", "[chr1:5[N"] and alts["rev", "fwd"] == ["]chr10:9]N", "N[chr1:5["]


def test_bed_reader(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#x\nchr1\t5\t9\nchr1\tbad\t9\n2\t1\t2\textra\n\n")
    assert sorted(map(tuple, readers.read_bed(spark, str(tmp_path / "a.bed")).collect())) == [("1", 5, 9), ("2", 1, 2)]


def test_store_resumes(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = lambda v: spark.createDataFrame([("chr1", 0, v), ("chr2", 0, v)], "contig string, region long, x int")
    writers.write_store(rows(1).filter("contig = 'chr1'"), path, ["contig", "region"])
    writers.write_store(rows(2), path, ["contig", "region"])
    assert sorted((r.contig, r.x) for r in readers.read_store(spark, path).collect()) == [("chr1", 1), ("chr2", 2)]
    assert readers.count_store(spark, path).first().samples == 2


def test_config():
    assert config.parse_contigs("[chr1, chr2]") == ("chr1", "chr2") and config.parse_contigs("") == ()
    assert config.resolve_threshold(None, {"decision_threshold": 0.88}) == 0.88 and config.resolve_threshold(None, {}) == 0.5
    assert config.parse_refine_types(" del,INS,del ") == ("DEL", "INS") and config.infer_channels(40000) == 20
    for bad in (lambda: config.CallConfig(predict_only=True, cluster_only=True), lambda: config.resolve_threshold(2.0, {}), lambda: config.resolve_spec({"feature_dim": 2, "window_size": 1}, {"feature_dim": 2, "window_size": 2}), lambda: config.feature_spec("other"), lambda: config.normal_spec({"feature_dim": 2, "channel_names": ["a"]}), lambda: config.normal_spec({"feature_dim": 2, "feature_version": "v9"}), lambda: config.infer_channels(5)):
        with pytest.raises(ValueError):
            bad()


def test_scorer_batches(spark):
    df = spark.range(150).select("id", F.array(F.col("id").cast("double")).alias("features"))
    rows = score_windows(df, linear_scorer([0.1], -1.0)).collect()
    assert all(abs(r.prob - 1 / (1 + math.exp(1.0 - 0.1 * r.id))) < 1e-12 for r in rows) and len(rows) == 150


def _full_reads(spark, sf):
    reads = projection(spark, sf, "reads").filter("read_ordinal < 400")
    sa = F.when(F.col("read_ordinal") % 3 == 0, F.concat("contig", F.lit(","), F.col("ref_end") + 500, F.lit(",+,700S600M,60,1;")))
    return reads.withColumn("ref_start", F.col("ref_start") % 40000).withColumn("ref_end", F.col("ref_start") + 3000).withColumn("sa", sa).withColumn("read_len", F.col("query_len").cast("int")).withColumn("q_aln_start", F.lit(0)).withColumn("q_aln_end", F.lit(600))


def test_entry_points(spark, sf):
    reads = _full_reads(spark, sf)
    contigs = reads.groupBy("contig").agg(F.lit(100_000).cast("long").alias("length"))
    signals = pipelines.generate_signals(reads, 100_000)
    kinds = {r.channel % 10 for r in signals.select("channel").distinct().collect()}
    assert {0, 1, 3, 7, 8, 9} & kinds and signals.filter("cnt <= 0").isEmpty()
    probs = contigs.select("contig", F.explode(F.sequence(F.lit(0), F.lit(58000), F.lit(2000))).alias("window_start"), F.lit(0.9).alias("prob"))
    calls = pipelines.call_variants(reads, contigs, probs, 0.88)
    rows = calls.collect()
    assert rows and all(r.support >= r.min_support and r.gt in ("0/0", "0/1", "1/1", "./.") for r in rows)
    assert pipelines.call_variants(reads, contigs, probs, 0.95).isEmpty()


def test_signals_and_windows_of_one_read(spark):
    """A forward read of 50M45D30M at 100: depth twice, one deletion, scores over a region of 1000 positions."""
    fields = "read_ordinal long, read_name string, flag int, contig string, ref_start long, ref_end long, mapq int, cigar string, sa string, nm int, query_len int, q_aln_start int, q_aln_end int, read_len int"
    reads = spark.createDataFrame([(1, "r", 0, "chr1", 100, 225, 60, "50M45D30M", None, 45, 80, 0, 80, 80)], fields)
    signals = pipelines.generate_signals(reads, 1000)
    rows = sorted((r.channel, r.start, r.end, r.cnt) for r in signals.collect())
    assert rows == [(10, 150, 195, 1), (19, 100, 150, 1), (19, 195, 225, 1)]

    def score(n, value):
        mean = n / 1000
        return (value - mean) / (math.sqrt(mean - mean * mean) + 1e-10)

    windows = {r.window_start: np.array(r.features).reshape(100, 20) for r in pipelines.dense_windows(signals, 1000, 100).collect()}
    assert sorted(windows) == list(range(0, 1000, 100))
    want = np.zeros((1000, 20))
    want[:, 10], want[150:195, 10], want[:, 19] = score(45, 0), score(45, 1), score(80, 0)
    want[100:150, 19] = want[195:225, 19] = score(80, 1)
    assert np.allclose(np.concatenate([windows[k] for k in sorted(windows)]), want)


def test_breakends_trimming_and_refinement(spark, sf):
    reads = _full_reads(spark, sf)
    other = F.concat(F.lit("chrOther,"), (F.col("ref_end") % 1000 + 500).cast("string"), F.lit(",+,700S600M,60,1;"))
    reads = reads.withColumn("sa", F.when(F.col("read_ordinal") % 3 == 0, other))
    contigs = reads.select("contig").distinct().unionAll(spark.createDataFrame([("chrOther",)], "contig string")).withColumn("length", F.lit(100_000).cast("long"))
    probs = reads.select("contig").distinct().select("contig", F.explode(F.sequence(F.lit(0), F.lit(58000), F.lit(2000))).alias("window_start"), F.lit(0.9).alias("prob"))
    rows = pipelines.call_breakends(reads, contigs, probs, 0.88).collect()
    assert rows and all({r.contig, r.contig2} == {r.contig, "chrOther"} and r.support >= r.min_support and r.support == len(r.reads) and r.gt in ("0/0", "0/1", "1/1", "./.") for r in rows)
    assert pipelines.call_breakends(reads, contigs.filter("contig <> 'chrOther'"), probs, 0.88).isEmpty()
    one = config.CallConfig(contigs=("chr1",), refine=True, refine_types=("DEL", "INS"))
    assert {r.contig for r in pipelines.call_variants(reads, contigs, probs, 0.88, one).collect()} <= {"chr1"}
    rows = spark.createDataFrame([(1, 100 + k, n, f"r{k}") for k, n in enumerate([60, 62, 64, 66, 400, 20])], "cluster int, start long, svlen long, read_name string")
    assert sorted(r.svlen for r in C.trim_members(rows, ["cluster"], ["start"]).collect()) == [60, 62, 64, 66]


def test_islands_over_pieces_of_an_axis(spark):
    rng = random.Random(5)
    rows = [(f"c{rng.randint(0, 2)}", rng.randint(0, 4000), k) for k in range(400)]
    df = spark.createDataFrame(rows, "contig string, start long, k long")
    got = I.axis_islands(df, ["contig"], ["start", "k"], "start", lambda last: F.col("start") - last > 15, "island", 100)
    want = I.gap_sessions(df, ["contig"], "start", 15, ["start", "k"])
    assert {(r.k, r.island) for r in got.collect()} == {(r.k, r.island) for r in want.collect()}


def test_anti_join_keeps_rows_that_repeat(spark):
    left = spark.createDataFrame([("a", 0, 10), ("a", 0, 10), ("a", 50, 60), ("a", 50, 60), (None, 1, 2)], "contig string, start long, end long")
    right = spark.createDataFrame([("a", 5, 7)], "contig string, s long, e long")
    for how, want in (("left_semi", [("a", 0)] * 2), ("left_anti", [("None", 1), ("a", 50), ("a", 50)])):
        assert sorted((str(r.contig), r.start) for r in range_join(left, right, ["contig"], ("start", "end"), ("s", "e"), 4, how).collect()) == want


def test_ranks_along_an_axis(spark):
    rows = [(k, p, t) for k in ("a", "b") for p in (-3, 0, 5, 5, 9, 10, 11, 40) for t in (2, 1)]
    df = spark.createDataFrame(rows, "k string, p long, t long")
    found = I.axis_rank(df, ["k"], ["p", "t"], piece=10).collect()
    for k in ("a", "b"):
        own = sorted((r.nth, r.p, r.t) for r in found if r.k == k)
        assert [n for n, _, _ in own] == list(range(1, 17)) and [(p, t) for _, p, t in own] == sorted((p, t) for x, p, t in rows if x == k)
    assert I.axis_rank(df.limit(0), ["k"], ["p", "t"]).count() == 0


def test_stores_are_found_below_folders(spark, tmp_path):
    for name in ("x/one", "y/z/two", "one_label", "x/one_index", "two_predict"):
        spark.range(1).write.parquet(str(tmp_path / name))
    (tmp_path / "three").mkdir()
    (tmp_path / "three" / "note.txt").write_text("no store")
    assert [r.store for r in readers.find_stores(spark, str(tmp_path)).collect()] == ["one", "two"]
    assert [r.store for r in readers.find_stores(spark, str(tmp_path), ()).collect()] == ["one", "one_index", "one_label", "two", "two_predict"]


def test_shared_folder_is_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        cut.shared_root(type("Session", (), {"sparkContext": Context})())


def test_other_readers_and_sinks(spark, tmp_path):
    (tmp_path / "labels.bed").write_text("#c\nchr1\t5\t9\t9\tDEL\nchr1\t7\tchr2\t70\tTRA\nchr1\tx\t1\t2\tDUP\n")
    assert sorted(map(tuple, readers.read_label_bed(spark, str(tmp_path / "labels.bed")).collect())) == [("chr1", 5, 9, "DEL"), ("chr1", 7, 8, "TRA")]
    line = "chr1\t{p}\t.\tN\t<{t}>\t.\tPASS\tSVTYPE={t};SVLEN=60;END={e};\tGT\t0/1\n"
    for t in ("del", "ins", "dup", "inv", "tra"):
        kind = "BND" if t == "tra" else t.upper()
        with gzip.open(tmp_path / f"s_{t}.vcf.gz", "wt") as f:
            f.write("##x\n" + line.format(p=10, t=kind, e=70))
        (tmp_path / f"s_{t}.vcf").write_text("##x\n" + line.format(p=10, t=kind, e=70))
    assert sorted((r.svtype, r.pos, r.gt) for r in readers.read_sample(spark, str(tmp_path), "s", True).collect()) == [(k, 10, "0/1") for k in ("BND", "DEL", "DUP", "INS", "INV")]
    assert [(r.svtype, r.end) for r in readers.read_vcf(spark, str(tmp_path / "s_del.vcf.gz"), True).collect()] == [("DEL", 70)]
    truth = [tuple(r) for r in readers.read_truth_vcf(spark, str(tmp_path / "s_del.vcf")).collect()]
    assert truth == [("1", 10, 70, "DEL")]
    assert readers.read_weights_meta('{"decision_threshold": 0.88, "ablation": {"eval_head": "cnn"}}') == {"threshold": 0.88, "head": "cnn", "feature_config": {}}
    assert config.resolve_head("auto", {"ablation": {"eval_head": "mamba"}}) == "mamba" and config.resolve_head("cnn", {}) == "cnn"
    assert json.loads(writers.feature_config(2000, ["a", "b"]))["n_channels"] == 2
    summary = spark.createDataFrame([("updated", 3)], "reason string, n long")
    assert writers.write_refine_report(summary, str(tmp_path / "r")) and not writers.write_refine_report(summary.limit(0), str(tmp_path / "none"))
    assert "reason\tn" in [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]


def test_trio_vcf_report_and_snapshot(spark, tmp_path):
    row = "chr1\t{p}\tid{p}\tN\t{a}\t9\tPASS\t{i}\tGT:DR\t{g}:3\n"
    dele = lambda p, n, g: row.format(p=p, a="<DEL>", i=f"SVTYPE=DEL;SVLEN={n};END={p + n}", g=g)
    bnd = lambda p, q, g: row.format(p=p, a=f"N[chr2:{q}[", i="SVTYPE=TRA", g=g)
    ins = lambda p, n, g: row.format(p=p, a="<INS>", i=f"SVTYPE=INS;SVLEN={n}", g=g)
    texts = {
        "child": "##made=1\n##more=2\n#CHROM\tx\n" + dele(5000, 100, "0/1") + bnd(9000, 400, "1|1") + ins(20000, 80, "0/1") + row.format(p=1, a="<X>", i="SVTYPE=CNV", g="0/1"),
        # the first record in the file that matches counts, not the nearest; a length of less than 0.7 does not match
        "father": "##f\n" + dele(5900, 90, "1/1") + dele(5000, 100, "0/1") + bnd(9900, 1300, "0/1") + ins(20500, 50, "1/1"),
        "mother": "##m\n" + bnd(9000, 1500, "0/1") + ins(20900, 60, "./.") + dele(6102, 100, "1/1"),
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.vcf").write_text(text)
    writers.write_trio_vcf(*[str(tmp_path / f"{n}.vcf") for n in ("child", "father", "mother")], str(tmp_path / "trio"), spark, ("F", "M", "C"))
    parts = sorted((tmp_path / "trio").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines[:3] == ["##made=1", "##more=2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tF\tM\tC"]
    assert [x.split("\t")[8:] for x in lines[3:]] == [["GT", "1/1", "./.", "0/1"], ["GT", "0/1", "./.", "1/1"], ["GT", "./.", "1/1", "0/1"]]
    assert lines[3].split("\t")[:8] == dele(5000, 100, "0/1").split("\t")[:8]

    paths = tuple(str(tmp_path / f"{n}.vcf") for n in ("child", "father", "mother"))
    writers.write_trios({"ont": paths, "ccs": (paths[0], paths[2], paths[1])}, str(tmp_path / "set"), spark)
    assert [x.split("\t")[9:] for x in (tmp_path / "set/ont_trio.vcf").read_text().splitlines()[2:]] == [["father", "mother", "child"], ["1/1", "./.", "0/1"], ["0/1", "./.", "1/1"], ["./.", "1/1", "0/1"]]
    manifest = [x.split("\t") for x in (tmp_path / "set/trio_vcf_manifest.tsv").read_text().splitlines()]
    assert manifest[0] == ["platform", "trio_vcf", *T.TYPES] and [(x[0], dict(zip(manifest[0][2:], x[2:]))) for x in manifest[1:]] == [(p, {"DEL": "1", "INS": "1", "DUP": "0", "INV": "0", "BND": "1"}) for p in ("ont", "ccs")]

    child, father, mother = (readers.read_vcf(spark, p, True) for p in paths)
    table = T.discordance(child, father.unionAll(mother))
    assert {r.svtype: (r.total, r.matched, r.rate) for r in table.collect()} == {"DEL": (1, 1, 0.0), "INS": (1, 1, 0.0), "BND": (1, 1, 0.0), "DUP": (0, 0, 0.0), "INV": (0, 0, 0.0), "ALL": (3, 3, 0.0)}
    report = [r.line for r in writers.mdr_report(T.discordance(child, mother)).orderBy("place").collect()]
    assert report[0].split() == ["SV", "TOTAL", "INCONSISTENT", "MDR(%)"] and report[-1] == "Total         3            2     66.67" and len(report) == 7
    assert [r.total for r in T.discordance(child.limit(0), mother).collect()] == [0] * 6

    writers.write_snapshot(str(tmp_path / "snap"), calls=father, contigs=mother.select("chrom"))
    assert spark.read.parquet(str(tmp_path / "snap/calls")).count() == 4 and spark.read.parquet(str(tmp_path / "snap/contigs")).columns == ["chrom"]


def test_length_steps_of_exactly_the_share_do_not_split(spark):
    rows = spark.createDataFrame([("a", x) for x in (27, 90, 153)] + [("b", x) for x in (26, 90, 153)], "k string, svlen long").withColumn("start", F.lit(0))
    got = sorted((r.k, r.svlen, r.part) for r in I.length_subclusters(rows, ["k"], ["start"]).collect())
    assert got == [("a", 27, 1), ("a", 90, 1), ("a", 153, 1), ("b", 26, 1), ("b", 90, 2), ("b", 153, 2)]

def test_first_reads_of_a_call_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(U, "LIST_CELL", 40)
    reads = [(f"r{k % 290}", k, rng.choice(("c1", "c2", None)), s := rng.choice((300, 310, rng.randint(0, 3000))), s + rng.choice((0, 5, rng.randint(1, 400))), 0, rng.choice((10, 60))) for k in range(300)]
    calls = [(str(k), rng.choice(("c1", "c2", "c3", None)), rng.choice(("INS", "DEL", "BND")), rng.randint(0, 3200), rng.choice((1, 40, 3000)), [f"r{rng.randint(0, 299)}" for _ in range(rng.randint(0, 60))]) for k in range(150)]
    r = spark.createDataFrame(reads, "read_name string, read_ordinal long, contig string, ref_start long, ref_end long, flag int, mapq int")
    c = spark.createDataFrame(calls, "call_id string, contig string, svtype string, start long, svlen long, reads array<string>")
    every = {}
    for n, (call_id, contig, kind, start, svlen, own) in enumerate(calls):
        end, bias = (start + 1, 1000) if kind != "DEL" else (start + svlen, 2000)
        hits = sorted((x[3], x[1], x[0]) for x in reads if x[2] == contig and contig and x[6] >= 20 and x[3] < end + bias and x[4] > max(0, start - bias) and x[0] not in own)
        every[call_id] = [x[1] for x in hits]
    for first in (1, 7, 50, None):
        got = {}
        for row in U.evidence_reads(c, r, ["call_id"], first).orderBy("call_id", "nth").collect():
            got.setdefault(row.call_id, []).append(row.read_ordinal)
            assert row.nth == len(got[row.call_id])
        assert got == {k: v[:first] for k, v in every.items() if v}
    at = {x[0]: x for x in calls}
    primary = [x for x in reads if x[2]]
    for row in U.count_support(c, r, ["call_id"]).collect():
        _, contig, kind, start, svlen, _ = at[row.call_id]
        s, e = (start, start + max(svlen, 1)) if kind == "DEL" else (max(0, start - 1000), start + 1000)
        assert row.local == sum(x[2] == contig and x[3] < e and x[4] > s for x in primary)


def test_genotypes_are_computed_once_for_equal_depths(spark):
    rows = spark.createDataFrame([(k, r, a, e) for k, (r, a, e) in enumerate([(3, 2, 0.1), (3, 2, 0.1), (1, 9, 0.0), (None, 2, 0.1), (None, 2, 0.1)])], "id int, ref long, alt long, error double")
    drawn = [r.gt for r in U.genotype_of_depths(rows, lambda r, a, e: F.expr("uuid()")).orderBy("id").collect()]
    assert len(drawn) == 5 and drawn[0] == drawn[1] and drawn[3] == drawn[4] and len(set(drawn)) == 3
    got = U.genotype_of_depths(rows, G.genotype_vote).orderBy("id").collect()
    assert [r.gt for r in got] == [r.gt for r in rows.select("id", G.genotype_vote(F.col("ref"), F.col("alt"), F.col("error")).alias("gt")).orderBy("id").collect()]


def test_events_of_the_first_reads_of_a_call_equal_brute_force(spark, monkeypatch):
    """Calls meet the reads of their cell, in several groups, and at most `first` of them in file order."""
    rng = random.Random(8)
    monkeypatch.setattr(U, "REFINE_CELL", 150)
    monkeypatch.setattr(U, "REFINE_CALLS", 7)
    reads = []
    for k in range(260):
        s = rng.choice((300, rng.randint(0, 2500)))
        e = s + rng.choice((0, 60, rng.randint(1, 700)))
        reads.append((rng.choice(("c1", "c2", None)), rng.choice((f"r{k % 190}", None)), k, s, e, [(rng.choice("DI"), rng.randint(s, e), rng.randint(40, 90)) for _ in range(rng.randint(0, 3))]))
    calls = [(k, rng.choice(("c1", "c2", "c3", None)), rng.choice(("INS", "DEL", "DUP")), rng.choice((rng.randint(0, 2600), None)), rng.choice((0, 50, 400, 2000))) for k in range(120)]
    r = spark.createDataFrame(reads, "contig string, read_name string, read_ordinal long, ref_start long, ref_end long, events array<struct<op:string,start:long,n:long>>")
    c = spark.createDataFrame(calls, "id long, contig string, svtype string, start long, svlen long")
    for first in (1, 9, 5000):
        want = {}
        for k, contig, kind, start, svlen in calls:
            if contig is None or start is None or kind == "DUP":
                continue
            size = max(1, svlen)
            low, high = max(0, start - 100), start + (1 if kind == "INS" else size) + 100
            near = sorted((x for x in reads if x[0] == contig and x[3] < high and x[4] > low), key=lambda x: (x[3], x[2]))[:first]
            fit = []
            for x in near:
                for op, at, n in x[5]:
                    close = abs(at - start) <= 300 or kind == "DEL" and (abs(at + n - start - size) <= 300 or max(0, min(at + n, start + size) - max(at, start)) / max(1, min(n, size)) >= 0.2)
                    if op == kind[0] and close and 0.25 <= n / size <= 4:
                        fit.append((x[1], at, at + (n if kind == "DEL" else 0), n))
            if fit:
                want[k] = (len({x[0] for x in fit} - {None}), *[round(float(np.median([x[i] for x in fit]))) for i in (1, 2, 3)])
        got = {x.id: tuple(x)[1:] for x in U._events_seen(c, r, ["id"], 100, 300, first).collect()}
        assert got == want and want


def test_stores_have_few_files_however_many_regions(spark, tmp_path):
    path, keys = str(tmp_path / "s"), ["contig", "region"]
    rows = spark.range(600).select(F.lit("chr1").alias("contig"), F.floor(F.col("id") / 2).alias("region"), F.col("id").alias("at"), F.lit(1).alias("x"))
    files = lambda: len(list((tmp_path / "s").rglob("*.parquet")))
    got = lambda: {r.x: r["count"] for r in readers.read_store(spark, path).groupBy("x").count().collect()}
    writers.write_store(rows, path, keys)
    assert 0 < files() <= 4 and got() == {1: 600}
    writers.write_store(rows.filter("region < 100").withColumn("x", F.lit(2)), path, keys, overwrite=True)
    assert got() == {1: 400, 2: 200} and readers.count_store(spark, path).first().samples == 600
    # a region that comes back smaller is replaced in whole; one that is there stays
    writers.write_store(rows.filter("at = 0").withColumn("x", F.lit(3)), path, keys, overwrite=True)
    writers.write_store(rows.withColumn("region", F.col("region") + 299).withColumn("x", F.lit(4)), path, keys)
    assert got() == {1: 400, 2: 198, 3: 1, 4: 598}
    writers.write_store(readers.read_store(spark, path).withColumn("x", F.lit(5)), path, keys, overwrite=True)
    assert got() == {5: 1197} and files() <= 4 and readers.read_store(spark, path).columns == rows.columns
    assert {r.store for r in readers.find_stores(spark, str(tmp_path)).collect()} == {f"region={k}" for k in range(599)}


def test_lines_are_not_shuffled_by_contig(spark):
    lines = spark.createDataFrame([("chr1", 5), ("chr9", 6)], "contig string, start long")
    order = spark.createDataFrame([("chr1", 3)], "contig string, ordinal long").distinct()
    placed = writers._ordered(lines, order)
    assert sorted((r.contig, r.ordinal) for r in placed.collect()) == [("chr1", 3), ("chr9", None)]
    assert "BroadcastHashJoin" in (plan := placed._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(contig" not in plan


def test_reads_over_a_call_equal_brute_force_in_any_pieces(spark, monkeypatch):
    rng = random.Random(8)
    reads = [(k, rng.choice(("c1", "c2", None)), s := rng.choice((300, 310, None, rng.randint(0, 3000))), (s or 0) + rng.choice((0, 5, -90, rng.randint(1, 900)))) for k in range(400)]
    calls = [(k, rng.choice(("c1", "c2", "c3", None)), rng.choice(("INS", "DEL", "DUP")), rng.choice((300, rng.randint(0, 3200))), rng.choice((1, 40, 2500, None))) for k in range(120)]
    r = spark.createDataFrame(reads, "read_ordinal long, contig string, ref_start long, ref_end long")
    c = spark.createDataFrame(calls, "id long, contig string, svtype string, start long, svlen long")
    every = {}
    for k, contig, kind, start, svlen in calls:
        end = start + (1 if kind == "INS" else max(1, svlen or 1)) + 200
        hits = sorted((x[2], x[0]) for x in reads if kind != "DUP" and contig and x[1] == contig and x[2] is not None and x[2] < end and x[3] > max(0, start - 200))
        every[k] = [x[1] for x in hits]
    for cell, most in ((1000, 8192), (70, 7)):
        monkeypatch.setattr(U, "PAIR_CELL", cell)
        monkeypatch.setattr(U, "LIST_READS", most)
        for first in (1, 20, 5000):
            found = U.refine_reads(c, r, ["id"], first=first)
            got = {}
            for row in found.orderBy("id", "nth").collect():
                got.setdefault(row.id, []).append(row.read_ordinal)
                assert row.nth == len(got[row.id])
            assert got == {k: v[:first] for k, v in every.items() if v}
            if most > 400:
                # no pair is shuffled: nothing goes by the call
                assert "hashpartitioning(id" not in found._jdf.queryExecution().executedPlan().toString()


def test_all_evidence_equals_brute_force_and_is_not_shuffled(spark, monkeypatch):
    rng = random.Random(9)
    reads = [(f"r{k}", k, "c1", s := rng.randint(0, 30000), s + rng.randint(1, 9000), 0, 60) for k in range(500)]
    calls = [(str(k), "c1", rng.choice(("INS", "DEL")), rng.randint(0, 30000), rng.choice((50, 20000)), [f"r{rng.randint(0, 499)}" for _ in range(9)]) for k in range(90)]
    r = spark.createDataFrame(reads, "read_name string, read_ordinal long, contig string, ref_start long, ref_end long, flag int, mapq int")
    c = spark.createDataFrame(calls, "call_id string, contig string, svtype string, start long, svlen long, reads array<string>")
    reach = {x[0]: (max(0, x[3] - 1000), x[3] + 1001) if x[2] == "INS" else (max(0, x[3] - 2000), x[3] + x[4] + 2000) for x in calls}
    every = {x[0]: [y[0] for y in sorted(reads, key=lambda y: (y[3], y[1])) if y[3] < reach[x[0]][1] and y[4] > reach[x[0]][0] and y[0] not in x[5]] for x in calls}
    for most in (8192, 11):
        monkeypatch.setattr(U, "LIST_READS", most)
        found = U.evidence_reads(c, r, ["call_id"], None)
        got = {}
        for row in found.orderBy("call_id", "nth").collect():
            got.setdefault(row.call_id, []).append(row.read_name)
            assert row.nth == len(got[row.call_id])
        assert got == {k: v for k, v in every.items() if v}
        assert most < 500 or "hashpartitioning(call_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_length_subclusters_make_no_list_of_a_cluster(spark):
    rng = random.Random(6)
    rows = [(rng.choice(("a", "b", "c", None)), rng.choice((50, 90, 153, 400, 401, rng.randint(50, 3000), None)), k) for k in range(300)]
    out = I.length_subclusters(spark.createDataFrame(rows, "k string, svlen long, ord long"), ["k"], ["ord"])
    want = {}
    for key in "abc":
        own = sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        sizes = sorted(x[1] for x in own if x[1] is not None)
        part, last = 0, None
        for _, size, k in own:
            part += last is None or size is None or 10 * (size - last) > 7 * sizes[len(sizes) // 2]
            want[k], last = (key, part), size
    assert {r.ord: (r.k, r.part) for r in out.collect()} == want
    assert "collect_list" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Join" not in plan


def test_spread_range_join_equals_nested_loop_and_is_merged(spark, sf):
    rng = random.Random(18)
    reads = [(k, rng.choice(("c1", "c2", None)), s := rng.choice((300, None, rng.randint(-500, 3000))), (s or 0) + rng.choice((0, 5, -90, rng.randint(1, 900)))) for k in range(300)]
    calls = [(k, rng.choice(("c1", "c2", "c3", None)), s := rng.choice((300, rng.randint(-500, 3200))), s + rng.choice((0, -40, 1, 401, 2500))) for k in range(120)]
    r = spark.createDataFrame([*reads, reads[0]], "read_ordinal long, contig string, rs long, re long")
    c = spark.createDataFrame([*calls, calls[0]], "id long, contig string, start long, end long")
    every = sorted((x[0], y[0]) for x in [*calls, calls[0]] for y in [*reads, reads[0]] if x[1] and x[1] == y[1] and y[2] is not None and x[2] < y[3] and x[3] > y[2])
    for width in (1000, 70):
        found = range_join(c, r, ["contig"], ("start", "end"), ("rs", "re"), width, spread=True)
        assert sorted((x.id, x.read_ordinal) for x in found.collect()) == every
    # pairs are no copies of a broadcast list, and bytes do not decide on the number of tasks
    found = calls_plans.overlap_join_refine(spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "REPARTITION_BY_NUM" in plan
