"""Queries over intervals: scans of label files, range joins, islands, clusters, pileups, jobs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.operators import clusters as C
from svloom.operators import islands as I
from svloom.operators import pileup as P
from svloom.operators.jobs import job_status, pending
from svloom.operators.order_stats import medians
from svloom.operators.ranges import range_join
from svloom.operators.score import bce_loss, linear_scorer, score_windows, threshold_curve
from svloom.plans import pipelines
from svloom.plans.alignments import INDELS_SQL
from svloom.plans.registry import query
from svloom.sources.fixtures import predictions, projection, table, with_ctes

SIG, INTERVALS = with_ctes("sig"), with_ctes("intervals")
ROW = ["start", "svlen", "read_name", "ord"]

# ---------------------------------------------------------------- catalogues and jobs
CONTIGS_SQL = "contigs AS (SELECT contig, CAST(max(ref_end) AS BIGINT) AS length FROM reads GROUP BY 1)"


def contigs_of(reads: DataFrame) -> DataFrame:
    return reads.groupBy("contig").agg(F.max("ref_end").cast("bigint").alias("length"))


@query("scan_contig_catalog", f"{with_ctes('reads')}, {CONTIGS_SQL} SELECT contig, length FROM contigs WHERE contig IN ('chr1', 'chr3')")
def scan_contig_catalog(spark, sf_dir):
    wanted = spark.createDataFrame([("chr1",), ("chr3",), ("chrUnknown",)], "contig string")
    return contigs_of(projection(spark, sf_dir, "reads")).join(wanted, "contig", "left_semi")


_JOBS = "jobs AS (SELECT l_orderkey AS region, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1), regions AS (SELECT o_orderkey AS region, 'chr' || (o_custkey % 5 + 1) AS contig FROM orders)"


def _jobs(spark, sf_dir):
    regions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("region"), F.concat(F.lit("chr"), F.col("o_custkey") % 5 + 1).alias("contig"))
    stores = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").groupBy(F.col("l_orderkey").alias("region")).agg(F.count("*").alias("n"))
    return regions, stores


@query("job_feature_join", f"WITH {_JOBS} SELECT region, contig, n FROM regions JOIN jobs USING (region)")
def job_feature_join(spark, sf_dir):
    regions, stores = _jobs(spark, sf_dir)
    return regions.join(stores, "region")


@query("job_status_split", f"WITH {_JOBS} SELECT region, CASE WHEN n IS NULL THEN 'missing' WHEN n < 3 THEN 'empty' ELSE 'ready' END AS status FROM regions LEFT JOIN jobs USING (region)")
def job_status_split(spark, sf_dir):
    regions, stores = _jobs(spark, sf_dir)
    return job_status(regions, stores.withColumn("n", F.col("n") - F.when(F.col("n") < 3, F.col("n")).otherwise(0)), "region", "n").select("region", "status")


@query("resume_predict", f"WITH {_JOBS} SELECT region, contig FROM regions WHERE region NOT IN (SELECT region FROM jobs)")
def resume_predict(spark, sf_dir):
    return pending(*_jobs(spark, sf_dir), ["region"])


@query("contig_membership_bnd", f"{with_ctes('bnd')} SELECT rec_ordinal, chrom, chr2 FROM bnd WHERE chrom IN ('chr1','chr4') AND chr2 IN ('chr1','chr4')")
def contig_membership_bnd(spark, sf_dir):
    wanted = spark.createDataFrame([("chr1",), ("chr4",)], "c string")
    rows = projection(spark, sf_dir, "bnd").select("rec_ordinal", "chrom", "chr2")
    return rows.join(wanted, F.col("chrom") == F.col("c"), "left_semi").join(wanted, F.col("chr2") == F.col("c"), "left_semi")


# ---------------------------------------------------------------- labels and BED
REGIONS_SQL = "grid AS (SELECT contig, k * {size} AS start, k * {size} + {size} AS \"end\" FROM (SELECT contig, max(\"end\") AS far FROM intervals GROUP BY 1 UNION ALL SELECT 'chrNone', 100000), generate_series(0, far // {size}) u(k))"


def _grid(spark, bed: DataFrame, size: int) -> DataFrame:
    """Regions of one size over all contigs of the intervals, and over one that has none."""
    far = bed.groupBy("contig").agg(F.max("end").alias("far")).unionAll(spark.createDataFrame([("chrNone", 100_000)], "contig string, far long"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("far") / size)))
    return far.select("contig", k.alias("k")).select("contig", (F.col("k") * size).alias("start"), (F.col("k") * size + size).alias("end"))


@query("bed_region_semi", f"{INTERVALS}, {REGIONS_SQL.format(size=20000)} SELECT g.* FROM grid g WHERE g.contig NOT IN (SELECT contig FROM intervals) OR EXISTS (SELECT 1 FROM intervals b WHERE b.contig = g.contig AND b.start < g.\"end\" AND b.\"end\" > g.start AND b.\"end\" > b.start)")
def bed_region_semi(spark, sf_dir):
    every = projection(spark, sf_dir, "intervals")
    bed, grid = every.filter("end > start"), _grid(spark, every, 20000)
    hit = range_join(grid, bed, ["contig"], ("start", "end"), ("start", "end"), 20000, "left_semi")
    return hit.unionAll(grid.join(bed.select("contig").distinct(), "contig", "left_anti"))


@query("bed_window_semi", f"{INTERVALS}, {REGIONS_SQL.format(size=2000)} SELECT g.* FROM grid g WHERE EXISTS (SELECT 1 FROM intervals b WHERE b.contig = g.contig AND b.start < g.\"end\" AND b.\"end\" > g.start AND b.\"end\" > b.start)")
def bed_window_semi(spark, sf_dir):
    every = projection(spark, sf_dir, "intervals")
    return range_join(_grid(spark, every, 2000), every.filter("end > start"), ["contig"], ("start", "end"), ("start", "end"), 2000, "left_semi")


_WINDOWS = "wins AS (SELECT DISTINCT 'chr' || (c_custkey % 4 + 1) AS contig, c_custkey * 2000 AS start FROM customer)"


def _windows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("chr"), F.col("c_custkey") % 4 + 1).alias("contig"), (F.col("c_custkey") * 2000).alias("start")).distinct()


def label_windows(windows: DataFrame, truth: DataFrame, closed: bool, size: int = 2000) -> DataFrame:
    """windows with label 1 where truth overlaps [start, start + size), or with closed touches its ends."""
    grown = windows.withColumn("__s", F.col("start") - (1 if closed else 0)).withColumn("__e", F.col("start") + size + (1 if closed else 0))
    hit = range_join(grown, truth, ["contig"], ("__s", "__e"), ("start", "end"), size, "left_semi").select("contig", "start", F.lit(1).alias("label"))
    return windows.join(hit, ["contig", "start"], "left").select("contig", "start", F.coalesce("label", F.lit(0)).alias("label"))


@query("label_vcf_overlap", f"{INTERVALS}, {_WINDOWS} SELECT contig, start, CAST(EXISTS (SELECT 1 FROM intervals b WHERE b.contig = w.contig AND b.\"end\" > w.start AND b.start < w.start + 2000) AS INT) AS label FROM wins w")
def label_vcf_overlap(spark, sf_dir):
    return label_windows(_windows(spark, sf_dir), projection(spark, sf_dir, "intervals"), closed=False)


@query("label_bed_overlap", f"{INTERVALS}, {_WINDOWS} SELECT contig, start, CAST(EXISTS (SELECT 1 FROM intervals b WHERE b.contig = w.contig AND b.\"end\" >= w.start AND b.start <= w.start + 2000) AS INT) AS label FROM wins w")
def label_bed_overlap(spark, sf_dir):
    return label_windows(_windows(spark, sf_dir), projection(spark, sf_dir, "intervals"), closed=True)


@query("scan_bed", INTERVALS + ", s AS (SELECT replace(contig, 'chr', '') AS chrom, start, row_number() OVER (PARTITION BY contig ORDER BY start) AS nth FROM intervals), e AS (SELECT replace(contig, 'chr', '') AS chrom, \"end\", row_number() OVER (PARTITION BY contig ORDER BY \"end\") AS nth FROM intervals) SELECT chrom, nth, start, \"end\" FROM s JOIN e USING (chrom, nth)")
def scan_bed(spark, sf_dir):
    """Starts and ends of a contig, each sorted for itself, paired by place."""
    rows = projection(spark, sf_dir, "intervals").select(F.regexp_replace("contig", "^chr", "").alias("chrom"), "start", "end")
    starts, ends = (I.axis_rank(rows.select("chrom", c), ["chrom"], [c]) for c in ("start", "end"))
    return starts.join(ends, ["chrom", "nth"])


@query("sort_labels", INTERVALS + " SELECT contig, start, \"end\", CAST(row_number() OVER (PARTITION BY contig ORDER BY start, \"end\") AS INT) AS nth FROM intervals")
def sort_labels(spark, sf_dir):
    ranked = I.axis_rank(projection(spark, sf_dir, "intervals"), ["contig"], ["start", "end"])
    return ranked.select("contig", "start", "end", F.col("nth").cast("int").alias("nth"))


# ---------------------------------------------------------------- predictions
PREDICTIONS = with_ctes("sig") + ", preds AS (SELECT contig, start // 2000 * 2000 AS window_start, (count(*) % 100) / 100.0 AS prob FROM sig GROUP BY ALL)"


@query("threshold_filter", f"{PREDICTIONS} SELECT contig, window_start, prob FROM preds WHERE prob >= 0.03")
def threshold_filter(spark, sf_dir):
    return predictions(spark, sf_dir).filter("prob >= 0.03")


@query("merge_adjacent_windows", f"""{PREDICTIONS}, pos AS (SELECT contig, window_start AS s, window_start + 2000 AS e FROM preds WHERE prob >= 0.03),
  m AS (SELECT *, sum(CASE WHEN lag_e = s THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY s) AS g FROM (SELECT *, lag(e) OVER (PARTITION BY contig ORDER BY s) AS lag_e FROM pos))
  SELECT contig, min(s) AS start, max(e) AS "end", count(*) AS n_windows FROM m GROUP BY contig, g""")
def merge_adjacent_windows(spark, sf_dir):
    rows = predictions(spark, sf_dir).filter("prob >= 0.03").select("contig", F.col("window_start").alias("start"), (F.col("window_start") + 2000).alias("end"))
    return I.merge_adjacent(rows, ["contig"], "start", "end")


@query("prediction_index_zip", f"{PREDICTIONS} SELECT p.contig, p.window_start, p.prob, count(*) AS n FROM preds p JOIN sig s ON s.contig = p.contig AND s.start // 2000 * 2000 = p.window_start GROUP BY ALL")
def prediction_index_zip(spark, sf_dir):
    index = projection(spark, sf_dir, "sig").select("contig", (F.floor(F.col("start") / 2000) * 2000).alias("window_start"))
    return predictions(spark, sf_dir).join(index, ["contig", "window_start"]).groupBy("contig", "window_start", "prob").agg(F.count("*").alias("n"))


@query("predict_windows", f"{SIG} SELECT contig, start // 2000 * 2000 AS window_start, round(1.0 / (1.0 + exp(-(0.1 * count(*) + 0.001 * sum(svlen) - 3.0))), 6) AS prob FROM sig GROUP BY ALL")
def predict_windows(spark, sf_dir):
    grid = projection(spark, sf_dir, "sig").groupBy("contig", (F.floor(F.col("start") / 2000) * 2000).alias("window_start")).agg(F.array(F.count("*").cast("double"), F.sum("svlen").cast("double")).alias("features"))
    scored = score_windows(grid, linear_scorer([0.1, 0.001], -3.0))
    return scored.select("contig", "window_start", F.round("prob", 6).alias("prob"))


#: Windows with two features and a label.
_LABELLED = f"{SIG}, w AS (SELECT contig, start // 2000 * 2000 AS window_start, count(*) AS n, sum(svlen) AS total, CAST(max(CASE WHEN svlen > 1500 THEN 1 ELSE 0 END) AS INT) AS label FROM sig GROUP BY ALL), p AS (SELECT *, 1.0 / (1.0 + exp(-(0.1 * n + 0.001 * total - 3.0))) AS prob FROM w)"


def labelled_windows(spark, sf_dir) -> DataFrame:
    grid = projection(spark, sf_dir, "sig").groupBy("contig", (F.floor(F.col("start") / 2000) * 2000).alias("window_start"))
    return grid.agg(F.array(F.count("*").cast("double"), F.sum("svlen").cast("double")).alias("features"), F.max((F.col("svlen") > 1500).cast("int")).alias("label"))


@query("loss_bce", f"{_LABELLED} SELECT -avg((label * ln(q) + (1 - label) * ln(1 - q)) * CASE label WHEN 1 THEN 3.0 ELSE 1.0 END) AS weighted, -avg(label * ln(q) + (1 - label) * ln(1 - q)) AS loss FROM (SELECT *, least(greatest(prob, 1e-6), 1 - 1e-6) AS q FROM p)")
def loss_bce(spark, sf_dir):
    scored = score_windows(labelled_windows(spark, sf_dir), linear_scorer([0.1, 0.001], -3.0))
    return scored.agg(bce_loss(F.col("prob"), F.col("label"), 3.0).alias("weighted"), bce_loss(F.col("prob"), F.col("label")).alias("loss"))


@query("threshold_sweep", f"""{_LABELLED}, t AS (SELECT k AS nth, 0.05::DOUBLE + 0.01::DOUBLE * k AS threshold FROM generate_series(0, 91) u(k)),
  c AS (SELECT nth, threshold, count(*) FILTER (WHERE prob >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE prob >= threshold AND label = 0) AS fp, count(*) FILTER (WHERE prob < threshold AND label = 1) AS fn FROM t, p GROUP BY ALL)
  SELECT nth, threshold, tp, fp, fn, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM c""")
def threshold_sweep(spark, sf_dir):
    """F1 at 92 thresholds in one pass."""
    return threshold_curve(score_windows(labelled_windows(spark, sf_dir), linear_scorer([0.1, 0.001], -3.0)))


@query("overlap_join_windows_reads", f"""{with_ctes('sig', 'reads')}, preds AS (SELECT contig, start % 2000000 // 2000 * 2000 AS s, count(*) AS n FROM sig GROUP BY ALL), pos AS (SELECT * FROM preds WHERE n >= 20)
  SELECT p.contig, p.s AS start, r.read_ordinal FROM pos p JOIN reads r ON r.contig = p.contig AND r.ref_start < p.s + 2000 AND r.ref_end > p.s WHERE (r.flag & 2308) = 0""")
def overlap_join_windows_reads(spark, sf_dir):
    sig = projection(spark, sf_dir, "sig")
    pos = sig.groupBy("contig", (F.floor(F.col("start") % 2000000 / 2000) * 2000).alias("start")).count().filter("count >= 20").select("contig", "start", (F.col("start") + 2000).alias("end"))
    reads = projection(spark, sf_dir, "reads").filter("(flag & 2308) = 0").select("contig", "read_ordinal", "ref_start", "ref_end")
    return range_join(pos, reads, ["contig"], ("start", "end"), ("ref_start", "ref_end"), 10000).select("contig", "start", "read_ordinal")


# ---------------------------------------------------------------- islands
_EVENTS = with_ctes("sig") + ", ev AS (SELECT DISTINCT read_name, contig, start % 3000 AS start, 30 + svlen % 700 AS size FROM sig WHERE svtype = '{}')"


def _events(spark, sf_dir, svtype: str) -> DataFrame:
    sig = projection(spark, sf_dir, "sig").filter(F.col("svtype") == svtype)
    return sig.select("read_name", "contig", (F.col("start") % 3000).alias("start"), (30 + F.col("svlen") % 700).alias("size")).distinct()


_DELS = """, m AS (SELECT *, sum(CASE WHEN start - lag_end <= 150 THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY start, size ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(start + size) OVER (PARTITION BY {keys} ORDER BY start, size) AS lag_end FROM ev{where})),
  dels AS (SELECT {keys}, min(start) AS start, max(start + size) - min(start) AS size FROM m GROUP BY {keys}, g)"""


@query("merge_cigar_del", _EVENTS.format("DEL") + _DELS.format(keys="read_name, contig", where="") + " SELECT * FROM dels")
def merge_cigar_del(spark, sf_dir):
    return I.merge_cigar_deletions(_events(spark, sf_dir, "DEL"), ["read_name", "contig"])


@query("merge_cigar_ins_gen", _EVENTS.format("INS") + """, m AS (SELECT *, sum(CASE WHEN start - lag_s <= 150 THEN 0 ELSE 1 END) OVER (PARTITION BY read_name, contig ORDER BY start, size ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(start) OVER (PARTITION BY read_name, contig ORDER BY start, size) AS lag_s FROM ev))
  SELECT read_name, contig, min(start) AS start, CAST(sum(size) AS BIGINT) AS size FROM m GROUP BY read_name, contig, g""")
def merge_cigar_ins_gen(spark, sf_dir):
    return I.merge_cigar_insertions(_events(spark, sf_dir, "INS"), ["read_name", "contig"])


_RUN = "CASE WHEN greatest(r.l_size, o.size) < 100 THEN 200 WHEN greatest(r.l_size, o.size) < 500 THEN 400 ELSE 600 END"


_GROWING = f""", o AS (SELECT *, row_number() OVER (PARTITION BY {{keys}} ORDER BY start, size) AS nth FROM ev{{where}}),
  run AS (SELECT {{keys}}, nth, start AS anchor, start AS l_start, size AS l_size, 1 AS g FROM o WHERE nth = 1
  UNION ALL SELECT {{keys}}, nth, CASE WHEN joins THEN anchor ELSE start END, start, CASE WHEN joins THEN l_size + size ELSE size END, CASE WHEN joins THEN g ELSE g + 1 END
    FROM (SELECT {{keys}}, nth, o.start, o.size, r.anchor, r.l_size, r.g, o.start - r.l_start <= {_RUN} AS joins FROM (SELECT {{keys}}, nth + 1 AS nth, anchor, l_start, l_size, g FROM run) r JOIN o USING ({{keys}}, nth))),
  inss AS (SELECT {{keys}}, min(anchor) AS start, max(l_size) AS size FROM run GROUP BY {{keys}}, g)"""


@query("merge_cigar_ins_call", _EVENTS.format("INS").replace("WITH ", "WITH RECURSIVE ") + _GROWING.format(keys="read_name, contig", where="") + " SELECT * FROM inss")
def merge_cigar_ins_call(spark, sf_dir):
    return I.merge_running_insertions(_events(spark, sf_dir, "INS"), ["read_name", "contig"])


_INS_ROWS = with_ctes("sig") + ", rows AS (SELECT DISTINCT read_name, contig, start % 4000 AS start, svlen % 1400 + 40 AS svlen, source, CASE WHEN svlen % 2 = 0 THEN 'A' ELSE 'None' END AS allele, CAST(svlen % 7 AS DOUBLE) AS score FROM sig WHERE svtype = 'INS')"


@query("merge_read_ins", _INS_ROWS + """, l AS (SELECT *, lag(start) OVER w AS p_start, greatest(svlen, lag(svlen) OVER w) AS m, lag(source) OVER w AS p_source FROM rows WINDOW w AS (PARTITION BY read_name, contig ORDER BY start, svlen, source, score)),
  g AS (SELECT *, sum(CASE WHEN start - p_start <= CASE WHEN m < 100 THEN 200 WHEN m < 500 THEN 400 WHEN m < 2000 THEN 800 ELSE 1200 END + CASE WHEN source <> p_source THEN 100 ELSE 0 END THEN 0 ELSE 1 END) OVER (PARTITION BY read_name, contig ORDER BY start, svlen, source, score ROWS UNBOUNDED PRECEDING) AS grp FROM l),
  a AS (SELECT read_name, contig, grp, count(*) AS n, bool_or(svlen >= 1000 AND source = 'split') AS ls, bool_or(svlen >= 1000) AS lg, median(start) FILTER (WHERE svlen >= 1000 AND source = 'split') AS s_ls, median(start) FILTER (WHERE svlen >= 1000) AS s_l, median(start) AS s_a, median(svlen) AS l_a,
    max(svlen) FILTER (WHERE svlen >= 1000 AND source = 'split') AS m_ls, max(svlen) AS m_a, count(DISTINCT source) AS k, min(source) AS src, max(score) AS score, bool_or(allele = 'A') AS seen FROM g GROUP BY ALL)
  SELECT read_name, contig, CAST(round_even(CASE WHEN ls THEN s_ls WHEN lg THEN s_l ELSE s_a END, 0) AS BIGINT) AS start, CASE WHEN ls THEN m_ls WHEN lg THEN m_a ELSE CAST(round_even(l_a, 0) AS BIGINT) END AS svlen,
    CASE WHEN k > 1 AND ls THEN 'split_rescue' WHEN k > 1 THEN 'split+cigar' ELSE src END AS source, CASE WHEN seen THEN 'A' ELSE 'None' END AS allele, score, n FROM a""")
def merge_read_ins(spark, sf_dir):
    sig = projection(spark, sf_dir, "sig").filter("svtype = 'INS'")
    rows = sig.select("read_name", "contig", (F.col("start") % 4000).alias("start"), (F.col("svlen") % 1400 + 40).alias("svlen"), "source", F.when(F.col("svlen") % 2 == 0, "A").otherwise("None").alias("allele"), (F.col("svlen") % 7).cast("double").alias("score")).distinct()
    return I.merge_read_insertions(rows, ["read_name", "contig"], ["start", "svlen", "source", "score"])


_SESSION = """m AS (SELECT *, sum(CASE WHEN start - p <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY start, svlen, read_name, ord ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, lag(start) OVER (PARTITION BY {keys} ORDER BY start, svlen, read_name, ord) AS p FROM {src}))"""


@query("gap_sessions_ins", f"{SIG}, ins AS (SELECT * FROM sig WHERE svtype = 'INS'), {_SESSION.format(gap='(300 / sqrt(2))', keys='contig', src='ins')} SELECT contig, CAST(cluster AS BIGINT) AS cluster, min(start) AS first, max(start) AS last, count(*) AS n FROM m GROUP BY ALL")
def gap_sessions_ins(spark, sf_dir):
    ins = projection(spark, sf_dir, "sig").filter("svtype = 'INS'")
    return C.insertion_clusters(ins, ["contig"], 300, ROW).groupBy("contig", "cluster").agg(F.min("start").alias("first"), F.max("start").alias("last"), F.count("*").alias("n"))


_BANDS = "CASE WHEN svlen <= 300 THEN 220 WHEN svlen <= 1000 THEN 300 WHEN svlen <= 5000 THEN 420 ELSE 600 END"


@query("length_bands", f"{SIG}, ins AS (SELECT *, CAST({_BANDS} AS DOUBLE) AS eps FROM sig WHERE svtype = 'INS'), {_SESSION.format(gap='eps / sqrt(2)', keys='contig, eps', src='ins')} SELECT contig, eps, CAST(cluster AS BIGINT) AS cluster, min(start) AS first, count(*) AS n FROM m GROUP BY ALL")
def length_bands(spark, sf_dir):
    ins = C.with_eps(projection(spark, sf_dir, "sig").filter("svtype = 'INS'"))
    numbered = I.axis_islands(ins, ["contig", "eps"], ROW, "start", lambda last: F.col("start") - last > F.col("eps") / math.sqrt(2), "cluster")
    return numbered.groupBy("contig", "eps", "cluster").agg(F.min("start").alias("first"), F.count("*").alias("n"))


@query("dup_inv_cap", f"{SIG} SELECT svtype, count(*) AS n FROM sig WHERE NOT (svtype IN ('DUP','INV') AND svlen > 1200) GROUP BY 1")
def dup_inv_cap(spark, sf_dir):
    return C.drop_oversized(projection(spark, sf_dir, "sig"), 1200).groupBy("svtype").agg(F.count("*").alias("n"))


@query("long_event_guard", f"{SIG} SELECT svtype, count(*) AS n FROM sig WHERE NOT (svtype IN ('DEL','DUP','INV') AND svlen > 1500) GROUP BY 1")
def long_event_guard(spark, sf_dir):
    return C.drop_oversized(projection(spark, sf_dir, "sig"), 1500, ("DEL", "DUP", "INV")).groupBy("svtype").agg(F.count("*").alias("n"))


_LOCI = f"{SIG}, loci AS (SELECT contig, start // 5000 AS locus, start, svlen * (1 + ord) // 2 AS svlen, read_name, ord FROM sig WHERE svtype <> 'INS')"


@query("length_subcluster", _LOCI + """, med AS (SELECT contig, locus, list_sort(list(svlen))[count(*) // 2 + 1] AS md FROM loci GROUP BY ALL),
  m AS (SELECT contig, locus, svlen, sum(CASE WHEN svlen - p <= 0.7 * md THEN 0 ELSE 1 END) OVER (PARTITION BY contig, locus ORDER BY svlen, start, read_name, ord ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, lag(svlen) OVER (PARTITION BY contig, locus ORDER BY svlen, start, read_name, ord) AS p FROM loci JOIN med USING (contig, locus)))
  SELECT contig, locus, CAST(part AS BIGINT) AS part, count(*) AS n, min(svlen) AS least, max(svlen) AS most FROM m GROUP BY ALL""")
def length_subcluster(spark, sf_dir):
    sig = projection(spark, sf_dir, "sig").filter("svtype <> 'INS'")
    loci = sig.select("contig", F.floor(F.col("start") / 5000).alias("locus"), "start", F.floor(F.col("svlen") * (1 + F.col("ord")) / 2).alias("svlen"), "read_name", "ord")
    parts = I.length_subclusters(loci, ["contig", "locus"], ["start", "read_name", "ord"])
    return parts.groupBy("contig", "locus", "part").agg(F.count("*").alias("n"), F.min("svlen").alias("least"), F.max("svlen").alias("most"))


_STEP = "{{'l': CASE WHEN {hi} THEN acc.l[1:len(acc.l)-1] WHEN {lo} THEN acc.l[2:] ELSE acc.l END}}"


@query("trim_ins_outliers", _LOCI + """, ls AS (SELECT contig, locus, list_sort(list(svlen)) AS l FROM loci GROUP BY ALL),
  t AS (SELECT contig, locus, l, list_reduce(list_prepend(l, [[]::BIGINT[] for i in range(1, len(l) + 1)]), lambda a, x: CASE WHEN len(a) > 2 AND a[len(a)] > 2 * a[len(a) // 2 + 1] AND a[len(a)] - a[len(a) // 2 + 1] > 30 THEN a[1:len(a) - 1] WHEN len(a) > 2 AND a[len(a) // 2 + 1] > 2 * a[1] AND a[len(a) // 2 + 1] - a[1] > 30 THEN a[2:] ELSE a END) AS kept FROM ls)
  SELECT contig, locus, CAST(len(l) AS INT) AS n, CAST(len(kept) AS INT) AS n_kept, kept[1] AS least, kept[len(kept)] AS most FROM t""")
def trim_ins_outliers(spark, sf_dir):
    sig = projection(spark, sf_dir, "sig").filter("svtype <> 'INS'")
    loci = sig.groupBy("contig", F.floor(F.col("start") / 5000).alias("locus")).agg(F.array_sort(F.collect_list(F.floor(F.col("svlen") * (1 + F.col("ord")) / 2))).alias("l"))
    trimmed = loci.withColumn("kept", C.trim_length_outliers(F.col("l")))
    return trimmed.select("contig", "locus", F.size("l").alias("n"), F.size("kept").alias("n_kept"), F.get("kept", 0).alias("least"), F.element_at("kept", -1).alias("most"))


_DBSCAN = f"""WITH RECURSIVE {SIG[len("WITH ") :]}, p AS (SELECT row_number() OVER () AS id, contig, svtype, start, start + svlen AS e, CAST(CASE WHEN svtype = 'DEL' THEN 1000 WHEN svtype = 'DUP' THEN 500 WHEN svlen <= 3000 THEN 280 WHEN svlen <= 10000 THEN 420 ELSE 650 END AS DOUBLE) AS eps FROM sig WHERE svtype <> 'INS' AND NOT (svtype IN ('DUP', 'INV') AND svlen > 2000000)),
  near AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.contig = b.contig AND a.svtype = b.svtype AND a.eps = b.eps AND b.start BETWEEN a.start - a.eps AND a.start + a.eps AND (a.start - b.start) * (a.start - b.start) + (a.e - b.e) * (a.e - b.e) <= a.eps * a.eps),
  reach AS (SELECT id AS a, id AS b FROM p UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b), comp AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY 1)
  SELECT contig, svtype, eps, count(*) AS n, min(start) AS first, max(start) AS last FROM p JOIN comp USING (id) GROUP BY contig, svtype, eps, c"""


@query("dbscan_cluster", _DBSCAN)
def dbscan_cluster(spark, sf_dir):
    sig = C.with_eps(C.drop_oversized(projection(spark, sf_dir, "sig").filter("svtype <> 'INS'")), noisy=True)
    rows = C.density_clusters(sig)
    return rows.groupBy("contig", "svtype", "eps", "cluster").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("start").alias("last")).drop("cluster")


_LEADERS = """WITH RECURSIVE tra AS (SELECT 'chr' || (c_nationkey % 3 + 1) AS contig, c_custkey * 7919 % 60000 AS start, 'chr' || (c_nationkey % 4 + 4) AS contig2, c_custkey * 104729 % 9000 AS e, 'r' || c_custkey AS read_name FROM customer),
  o AS (SELECT *, row_number() OVER (PARTITION BY contig, contig2 ORDER BY read_name, start, e) AS nth FROM tra),
  run AS (SELECT contig, contig2, nth, [{'s': start, 'e': e}] AS leaders, 1 AS k FROM o WHERE nth = 1
  UNION ALL SELECT contig, contig2, nth, CASE WHEN hit = 0 THEN list_append(leaders, {'s': start, 'e': e}) ELSE leaders END, CASE WHEN hit = 0 THEN len(leaders) + 1 ELSE hit END
    FROM (SELECT o.contig, o.contig2, o.nth, o.start, o.e, r.leaders, coalesce(list_position([abs(l.s - o.start) <= 1000 AND abs(l.e - o.e) <= 1000 for l in r.leaders], true), 0) AS hit FROM run r JOIN o ON o.contig = r.contig AND o.contig2 = r.contig2 AND o.nth = r.nth + 1))
  SELECT contig, CAST(ceil(median(start)) AS BIGINT) AS start, 'fwd' AS dir1, contig2, CAST(ceil(median(e)) AS BIGINT) AS "end", 'rev' AS dir2, count(*) AS support, list(read_name ORDER BY read_name) AS reads FROM run JOIN o USING (contig, contig2, nth) GROUP BY contig, contig2, k"""


@query("cluster_tra_leader", _LEADERS)
def cluster_tra_leader(spark, sf_dir):
    return C.leader_clusters(_translocations(spark, sf_dir))


def _translocations(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("chr"), F.col("c_nationkey") % 3 + 1).alias("contig"), (F.col("c_custkey") * 7919 % 60000).alias("start"), F.lit("fwd").alias("dir1"), F.concat(F.lit("chr"), F.col("c_nationkey") % 4 + 4).alias("contig2"), (F.col("c_custkey") * 104729 % 9000).alias("end"), F.lit("rev").alias("dir2"), F.concat(F.lit("r"), "c_custkey").alias("read_name"))


_DENSE = _DBSCAN[: _DBSCAN.index("  SELECT contig, svtype, eps, count(*)")].replace("start, start + svlen AS e,", "start, svlen, read_name, source, ord, start + svlen AS e,").rstrip()
#: Calls of insertions by sessions, of the other intervals by density and length.
SUMMARY_SQL = _DENSE + f""", ins AS (SELECT * FROM sig WHERE svtype = 'INS'), {_SESSION.format(gap='(300 / sqrt(2))', keys='contig', src='ins')},
  q AS (SELECT p.*, c FROM p JOIN comp USING (id)), md AS (SELECT c, list_sort(list(svlen))[count(*) // 2 + 1] AS md FROM q GROUP BY 1),
  parts AS (SELECT *, sum(CASE WHEN svlen - before <= 0.7 * md THEN 0 ELSE 1 END) OVER (PARTITION BY c ORDER BY svlen, start, read_name, ord ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT q.*, md, lag(svlen) OVER (PARTITION BY c ORDER BY svlen, start, read_name, ord) AS before FROM q JOIN md USING (c))),
  members AS (SELECT 'INS' || contig || cluster AS grp, contig, svtype, start, svlen, read_name, source, ord FROM m UNION ALL SELECT c || ':' || part, contig, svtype, start, svlen, read_name, source, ord FROM parts),
  calls AS (SELECT min(concat_ws(':', contig, svtype, start, svlen, read_name, ord)) AS call_id, contig, svtype, CAST(ceil(median(start)) AS BIGINT) AS start, CAST(ceil(median(svlen)) AS BIGINT) AS svlen, count(*) AS support, list(read_name ORDER BY read_name) AS reads, list_sort(list(DISTINCT source)) AS sources
    FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS k FROM members) WHERE k = 1 OR svlen >= 50 GROUP BY grp, contig, svtype)"""
#: Those and the translocations.
ALL_CALLS_SQL = f"{SUMMARY_SQL},{_LEADERS[len('WITH RECURSIVE') :]}".replace("\n  SELECT contig, CAST(ceil(median(start)) AS BIGINT) AS start, 'fwd'", ",\n  bnds AS (SELECT contig, CAST(ceil(median(start)) AS BIGINT) AS start, 'fwd'") + """),
  all_calls AS (SELECT call_id, contig, svtype, start, svlen, support, reads FROM calls UNION ALL SELECT reads[1], contig, 'BND', start, CAST(1 AS BIGINT), support, reads FROM bnds)"""


def interval_calls(spark, sf_dir) -> DataFrame:
    sig = projection(spark, sf_dir, "sig")
    ins = C.summarise(C.insertion_clusters(sig.filter("svtype = 'INS'"), ["contig"], 300, ROW), ["contig", "cluster", "svtype"]).drop("cluster")
    group = ["contig", "svtype", "eps", "cluster"]
    dense = C.density_clusters(C.with_eps(C.drop_oversized(sig.filter("svtype <> 'INS'")), noisy=True))
    parts = I.length_subclusters(dense, group, ["start", "read_name", "ord"])
    return ins.unionByName(C.summarise(parts, [*group, "part"]).drop("eps", "cluster", "part"))


def all_calls(spark, sf_dir) -> DataFrame:
    """Calls of all five types before support: call_id, contig, svtype, start, svlen, support, reads."""
    bnd = C.leader_clusters(_translocations(spark, sf_dir)).select(F.get("reads", 0).alias("call_id"), "contig", F.lit("BND").alias("svtype"), "start", F.lit(1).cast("bigint").alias("svlen"), "support", "reads")
    return interval_calls(spark, sf_dir).select(*bnd.columns).unionByName(bnd)


@query("cluster_summarise", SUMMARY_SQL + " SELECT call_id, contig, svtype, start, svlen, support, reads, sources FROM calls")
def cluster_summarise(spark, sf_dir):
    return interval_calls(spark, sf_dir)


@query("signature_sort_split", f"{SIG} SELECT contig, svtype, start, svlen, read_name, ord, CAST(row_number() OVER (PARTITION BY contig, svtype ORDER BY start, svlen, read_name, ord) AS INT) AS nth FROM sig")
def signature_sort_split(spark, sf_dir):
    ranked = I.axis_rank(projection(spark, sf_dir, "sig"), ["contig", "svtype"], ROW)
    return ranked.select("contig", "svtype", *ROW, F.col("nth").cast("int").alias("nth"))


@query("sort_candidates", f"{SIG} SELECT contig, start, svlen, read_name, ord, row_number() OVER (PARTITION BY contig ORDER BY start, svlen, read_name, ord) AS nth FROM sig")
def sort_candidates(spark, sf_dir):
    return I.axis_rank(projection(spark, sf_dir, "sig"), ["contig"], ROW).select("contig", *ROW, "nth")


@query("union_signatures", f"{SIG} SELECT contig, svtype, count(*) AS n FROM (SELECT contig, svtype FROM sig WHERE source = 'split' UNION ALL SELECT contig, svtype FROM sig WHERE source <> 'split') GROUP BY ALL")
def union_signatures(spark, sf_dir):
    sig = projection(spark, sf_dir, "sig").select("contig", "svtype", "source")
    return sig.filter("source = 'split'").unionByName(sig.filter("source <> 'split'")).groupBy("contig", "svtype").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- pileups
_AXIS = f"{SIG}, iv AS (SELECT contig, CASE svtype WHEN 'DEL' THEN 0 WHEN 'INS' THEN 2 WHEN 'INV' THEN 4 ELSE 5 END AS channel, start % 20000 AS s, least(start % 20000 + svlen % 300 + 1, 20000) AS e FROM sig)"
_NAIVE = "naive AS (SELECT contig, channel, pos, count(*) AS cnt FROM iv, generate_series(s, e - 1) t(pos) GROUP BY ALL)"


def _axis(spark, sf_dir) -> DataFrame:
    sig = projection(spark, sf_dir, "sig")
    s = F.col("start") % 20000
    channel = F.when(F.col("svtype") == "DEL", 0).when(F.col("svtype") == "INS", 2).when(F.col("svtype") == "INV", 4).otherwise(5)
    return sig.select("contig", channel.alias("channel"), s.alias("start"), F.least(s + F.col("svlen") % 300 + 1, F.lit(20000)).alias("end"))


@query("pileup_interval", f"{_AXIS}, {_NAIVE} SELECT contig, channel, pos, cnt FROM naive WHERE channel <> 2")
def pileup_interval(spark, sf_dir):
    runs = P.sweep(_axis(spark, sf_dir).filter("channel <> 2"), ["contig", "channel"])
    return runs.select("contig", "channel", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), "cnt")


@query("pileup_point", f"{_AXIS} SELECT contig, s AS start, s + 1 AS \"end\", count(*) AS cnt FROM iv WHERE channel = 2 GROUP BY ALL")
def pileup_point(spark, sf_dir):
    return P.points(_axis(spark, sf_dir).filter("channel = 2"), ["contig"], "start")


@query("pileup_depth", f"{with_ctes('reads')}, iv AS (SELECT contig, flag = 0 AS forward, ref_start % 5000 AS s, ref_start % 5000 + query_len % 700 + 1 AS e FROM reads WHERE (flag & 3332) = 0) SELECT contig, forward, pos, count(*) AS depth FROM iv, generate_series(s, e - 1) t(pos) GROUP BY ALL")
def pileup_depth(spark, sf_dir):
    reads = projection(spark, sf_dir, "reads").filter("(flag & 3332) = 0")
    iv = reads.select("contig", (F.col("flag") == 0).alias("forward"), (F.col("ref_start") % 5000).alias("start"), (F.col("ref_start") % 5000 + F.col("query_len") % 700 + 1).alias("end"))
    return P.sweep(iv, ["contig", "forward"]).select("contig", "forward", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), F.col("cnt").alias("depth"))


@query("pileup_region_clip", f"{with_ctes('reads')} SELECT read_ordinal, k * 5000 AS region_start, greatest(ref_start, k * 5000) AS start, least(ref_end, k * 5000 + 5000) AS \"end\" FROM reads, generate_series(ref_start // 5000, (ref_end - 1) // 5000) t(k)")
def pileup_region_clip(spark, sf_dir):
    reads = projection(spark, sf_dir, "reads").select("read_ordinal", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"))
    return P.clip_to_region(reads, 5000).select("read_ordinal", "region_start", "start", "end")


@query("signal_matrix_20", f"{_AXIS}, {_NAIVE} SELECT contig, pos, " + ", ".join(f"CAST(coalesce(sum(cnt) FILTER (WHERE channel = {c}), 0) AS BIGINT) AS ch{c}" for c in range(20)) + " FROM naive GROUP BY ALL")
def signal_matrix_20(spark, sf_dir):
    return P.signal_matrix(P.sweep(_axis(spark, sf_dir), ["contig", "channel"]), ["contig"], list(range(P.N_CHANNELS)))


_MOMENTS = "mom AS (SELECT contig, channel, sum(cnt) / 20000.0 AS mean, sqrt(greatest(sum(cnt * cnt) / 20000.0 - (sum(cnt) / 20000.0) * (sum(cnt) / 20000.0), 0)) AS sd FROM naive GROUP BY ALL)"


@query("zscore_region", f"{_AXIS}, {_NAIVE}, {_MOMENTS} SELECT contig, channel, pos, round((cnt - mean) / (sd + 1e-10), 4) + 0.0::DOUBLE AS z, round(-mean / (sd + 1e-10), 4) AS z0 FROM naive JOIN mom USING (contig, channel)")
def zscore_region(spark, sf_dir):
    z = P.zscores(P.sweep(_axis(spark, sf_dir), ["contig", "channel"]), ["contig", "channel"], 20000)
    return z.select("contig", "channel", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), F.round("z", 4).alias("z"), F.round(-F.col("mean") / (F.col("sd") + 1e-10), 4).alias("z0"))


@query("subregion_split", f"{_AXIS}, {_NAIVE}, sub AS (SELECT contig, channel, pos // 4000 * 4000 AS subregion, pos, cnt FROM naive) SELECT contig, channel, subregion, round(sum(cnt) / 4000.0, 6) AS mean, round(sqrt(sum(cnt * cnt) / 4000.0 - (sum(cnt) / 4000.0) * (sum(cnt) / 4000.0)), 6) AS sd FROM sub GROUP BY ALL")
def subregion_split(spark, sf_dir):
    size = P.subregion_size(5500)
    runs = P.window_tiles(P.sweep(_axis(spark, sf_dir), ["contig", "channel"]), size).withColumnRenamed("window_start", "subregion")
    return P.region_moments(runs, ["contig", "channel", "subregion"], size).select("contig", "channel", "subregion", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("window_tiles", f"{_AXIS}, {_NAIVE} SELECT contig, channel, pos // 2000 * 2000 AS window_start, CAST(sum(cnt) AS BIGINT) AS total FROM naive GROUP BY ALL")
def window_tiles(spark, sf_dir):
    tiles = P.window_tiles(P.sweep(_axis(spark, sf_dir), ["contig", "channel"]))
    return tiles.groupBy("contig", "channel", "window_start").agg(F.sum(F.col("cnt") * (F.col("end") - F.col("start"))).alias("total"))


@query("median", f"{SIG} SELECT contig, median(start) AS m_start, median(svlen) AS m_len FROM sig GROUP BY 1")
def median(spark, sf_dir):
    return medians(projection(spark, sf_dir, "sig").select("contig", F.col("start").alias("m_start"), F.col("svlen").alias("m_len")), ["contig"], ["m_start", "m_len"])


_SIGNATURES = INDELS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + _DELS.format(keys="read_ordinal", where=" WHERE op = 'D'") + _GROWING.format(keys="read_ordinal", where=" WHERE op = 'I'")


@query("cigar_signatures", f"{_SIGNATURES} SELECT read_name, contig, f.start, f.size AS svlen, f.svtype FROM (SELECT *, 'DEL' AS svtype FROM dels UNION ALL SELECT *, 'INS' AS svtype FROM inss) f JOIN reads USING (read_ordinal)")
def cigar_signatures(spark, sf_dir):
    """Indels of reads merged within the read, both types, as signatures."""
    return pipelines.cigar_signatures(projection(spark, sf_dir, "reads"), growing=True)
