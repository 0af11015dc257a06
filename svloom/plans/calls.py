"""Queries from clusters to calls: support, genotypes, refinement, VCF rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.functions import genotypes as G
from svloom.functions import variants as V
from svloom.functions.alignment import is_primary
from svloom.operators import support as U
from svloom.operators.cut import cut
from svloom.plans.intervals import ALL_CALLS_SQL, all_calls, contigs_of
from svloom.plans.registry import query
from svloom.sources.fixtures import projection, table, with_ctes

READS = with_ctes("reads")
ID = ["call_id"]


def _calls_sql(reads: str) -> str:
    """Calls of all types on the axis of the reads, a WITH clause of their own."""
    return ALL_CALLS_SQL.replace("WITH RECURSIVE ", f"WITH RECURSIVE {reads[len('WITH ') :]}, ", 1) + ", placed AS (SELECT call_id, contig, svtype, start % 2000000 AS start, svlen, support, reads FROM all_calls)"


CALLS_SQL = _calls_sql(READS)
#: Many more reads at one place of a contig, so that limits on the reads of a call bind.
CROWD = "SELECT read_ordinal + 1000000000 AS read_ordinal, 'c' || read_ordinal AS read_name, 'chr1' AS contig, flag, 1000000 + read_ordinal % 500 AS ref_start, 1006000 + read_ordinal % 500 AS ref_end, query_len, CAST(60 AS INT) AS mapq, cigar, nm FROM cold"
CROWDED = READS.replace("reads AS (", "cold AS (", 1) + f", reads AS (SELECT * FROM cold UNION ALL {CROWD})"
COVERAGE_SQL = "cov AS (SELECT CAST(ceil(sum(query_len) FILTER (WHERE (flag & 2308) = 0) / (SELECT sum(length) FROM (SELECT max(ref_end) AS length FROM reads GROUP BY contig))) AS BIGINT) AS coverage FROM reads)"
LOCAL_SQL = """spans AS (SELECT *, CASE WHEN svtype IN ('INS', 'BND') THEN greatest(0, start - 1000) ELSE start END AS s, CASE WHEN svtype IN ('INS', 'BND') THEN start + 1000 ELSE start + greatest(svlen, 1) END AS f FROM placed),
  over AS (SELECT call_id, count(*) AS n FROM spans c JOIN reads r ON r.contig = c.contig AND r.ref_start < c.f AND r.ref_end > c.s WHERE (r.flag & 2308) = 0 GROUP BY 1), loc AS (SELECT c.*, coalesce(n, 0) AS local FROM placed c LEFT JOIN over USING (call_id))"""


def placed_calls(spark, sf_dir) -> DataFrame:
    """Calls of all types, cut: what follows reads them several times."""
    return cut(all_calls(spark, sf_dir).withColumn("start", F.col("start") % 2000000))


def crowded_reads(spark, sf_dir) -> DataFrame:
    cold = projection(spark, sf_dir, "reads")
    return cold.unionByName(spark.sql(CROWD.replace("FROM cold", "FROM {cold}").replace("'c' || read_ordinal", "concat('c', read_ordinal)"), cold=cold))


def coverage(reads: DataFrame) -> DataFrame:
    """One row: bases of primary reads over the contigs' length, rounded up."""
    bases = reads.filter(is_primary(F.col("flag"), True)).agg(F.sum("query_len").alias("bases"))
    length = contigs_of(reads).agg(F.sum("length").alias("length"))
    return bases.join(length).select(F.coalesce(F.ceil(F.try_divide("bases", "length")), F.lit(0)).cast("bigint").alias("coverage"))


@query("coverage_global", f"{READS}, {COVERAGE_SQL} SELECT coverage FROM cov")
def coverage_global(spark, sf_dir):
    return coverage(projection(spark, sf_dir, "reads"))


@query("coverage_contig", f"{READS} SELECT contig, CAST(ceil(sum(query_len) FILTER (WHERE (flag & 2308) = 0) / max(ref_end)) AS BIGINT) AS coverage FROM reads GROUP BY 1")
def coverage_contig(spark, sf_dir):
    reads = projection(spark, sf_dir, "reads")
    per = reads.groupBy("contig").agg(F.sum(F.when(is_primary(F.col("flag"), True), F.col("query_len"))).alias("bases"), F.max("ref_end").alias("length"))
    return per.select("contig", F.ceil(F.col("bases") / F.col("length")).cast("bigint").alias("coverage"))


@query("overlap_count_support", f"{CALLS_SQL}, {LOCAL_SQL} SELECT call_id, contig, svtype, start, local FROM loc")
def overlap_count_support(spark, sf_dir):
    return U.count_support(placed_calls(spark, sf_dir), projection(spark, sf_dir, "reads"), ID).select("call_id", "contig", "svtype", "start", "local")


# ---------------------------------------------------------------- thresholds over a grid of depths
_GRID = "grid AS (SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS ln, CASE l_linenumber % 5 WHEN 0 THEN 'INS' WHEN 1 THEN 'DEL' WHEN 2 THEN 'INV' WHEN 3 THEN 'DUP' ELSE 'BND' END AS svtype, CAST(l_quantity AS BIGINT) * 2 AS c, l_partkey % 120 AS l, CASE WHEN l_returnflag = 'R' THEN 0.15 ELSE 0.05 END AS error, CASE l_returnflag WHEN 'R' THEN 0.01 WHEN 'A' THEN 0.05 ELSE 0.0 END AS e, CAST(l_suppkey AS BIGINT) AS sk, 50 + l_partkey % 4000 AS svlen FROM lineitem)"


def depth_grid(spark, sf_dir) -> DataFrame:
    sql = _GRID[len("grid AS (") : -1].replace("FROM lineitem", "FROM {t}")
    return spark.sql(sql, t=table(spark, sf_dir, "lineitem")).withColumn("error", F.col("error").cast("double")).withColumn("e", F.col("e").cast("double"))


def _min_support_sql() -> str:
    cases = []
    for kind, (mu, sigma, rho) in G.CURVES.items():
        noisy, side, limit = G.NOISY_MU[kind]
        m = f"CASE WHEN error > 0.1 AND c {'<=' if side < 0 else '>='} {limit} THEN {noisy} ELSE {mu} END"
        value = f"greatest(1, CAST(round_even(CAST(({m}) * pow(c, {sigma}) * (1 + {rho} * CASE WHEN c > 0 THEN tanh((l - c) / c) ELSE 0.0 END) AS DOUBLE), 0) AS BIGINT))"
        cases.append(f"WHEN '{kind}' THEN " + (f"CASE WHEN c >= 80 THEN 10 ELSE {value} END" if kind in ("DEL", "INV", "DUP") else value))
    return f"CAST(CASE svtype {' '.join(cases)} END AS BIGINT)"


@query("min_support", f"WITH {_GRID} SELECT id, ln, sk, svtype, c, l, {_min_support_sql()} AS min_support FROM grid")
def min_support(spark, sf_dir):
    grid = depth_grid(spark, sf_dir)
    return grid.select("id", "ln", "sk", "svtype", "c", "l", G.min_support(F.col("svtype"), F.col("c"), F.col("l"), F.col("error")).alias("min_support"))


_SCALED = "least(greatest(1, CAST(round_even(CAST(l * 0.9 AS DOUBLE), 0) AS BIGINT)), 40)"


@query("adjust_support", f"WITH {_GRID} SELECT id, ln, sk, CAST(greatest(1, CASE svtype WHEN 'INS' THEN greatest({_SCALED} + CASE WHEN svlen <= 300 THEN 2 ELSE 0 END + CASE WHEN svlen >= 2000 THEN -1 ELSE 0 END, 3) WHEN 'INV' THEN greatest({_SCALED} + CASE WHEN svlen <= 3000 THEN 1 ELSE 0 END, 0) ELSE {_SCALED} END) AS BIGINT) AS adjusted FROM grid")
def adjust_support(spark, sf_dir):
    value = G.adjust_support(F.col("svtype"), F.col("svlen"), F.col("l"), 0.9, 40, 0.9, 3, 300, 2, 2000, -1, 0.9, 0, 3000, 1)
    return depth_grid(spark, sf_dir).select("id", "ln", "sk", value.alias("adjusted"))


@query("bnd_ref_bound", f"WITH {_GRID} SELECT id, ln, sk, c, CAST(c * CASE WHEN c <= 2 THEN 20 WHEN c <= 5 THEN 9 WHEN c <= 15 THEN 7 ELSE 5 END AS BIGINT) AS bound FROM grid")
def bnd_ref_bound(spark, sf_dir):
    return depth_grid(spark, sf_dir).select("id", "ln", "sk", "c", G.bnd_ref_bound(F.col("c")).cast("bigint").alias("bound"))


@query("geno_error_rate", f"WITH {_GRID} SELECT id, ln, sk, svtype, CAST(CASE WHEN svtype = 'INS' THEN CASE WHEN c <= 3 THEN 0.01 ELSE 0.05 END WHEN svtype = 'BND' THEN CASE WHEN c <= 2 THEN 0.01 ELSE 0.05 END ELSE CASE WHEN c <= 2 THEN 0.0 WHEN c <= 4 THEN 0.01 ELSE 0.05 END END AS DOUBLE) AS rate FROM grid")
def geno_error_rate(spark, sf_dir):
    return depth_grid(spark, sf_dir).select("id", "ln", "sk", "svtype", G.geno_error_rate(F.col("svtype"), F.col("c")).alias("rate"))


_R, _A = "(c // 2)", "(l % 40)"
_E = "least(greatest(e::DOUBLE, 1e-6), 1.0 - 1e-6)"
_LOGGL = f"""CASE WHEN {_R} + {_A} <= 0 THEN './.' WHEN s0 >= s1 AND s0 >= s2 THEN '0/0' WHEN s1 >= s2 THEN '0/1' ELSE '1/1' END"""
_LOG_SCORES = f"scores AS (SELECT *, ln(1.0::DOUBLE / 3.0) + ({_R} * ln(1.0 - {_E}) + {_A} * ln({_E})) AS s0, ln(1.0::DOUBLE / 3.0) + ({_R} * ln(0.5 * (1.0 - {_E}) + 0.5 * {_E}) + {_A} * ln(0.5 * (1.0 - {_E}) + 0.5 * {_E})) AS s1, ln(1.0::DOUBLE / 3.0) + ({_R} * ln({_E}) + {_A} * ln(1.0 - {_E})) AS s2 FROM grid)"


def _by_depths(spark, sf_dir, method) -> DataFrame:
    """id, ln, sk, gt by a method that is too dear for each row."""
    grid, r, a, e = _depths(spark, sf_dir)
    return U.genotype_of_depths(grid.select("id", "ln", "sk", r.alias("ref"), a.alias("alt"), e.alias("error")), method).select("id", "ln", "sk", "gt")


def _depths(spark, sf_dir):
    return depth_grid(spark, sf_dir), F.floor(F.col("c") / 2), F.col("l") % 40, F.col("e")


@query("genotype_loggl", f"WITH {_GRID}, {_LOG_SCORES} SELECT id, ln, sk, {_LOGGL} AS gt FROM scores")
def genotype_loggl(spark, sf_dir):
    grid, r, a, e = _depths(spark, sf_dir)
    return grid.select("id", "ln", "sk", G.genotype_loggl(r, a, e).alias("gt"))


_LIN = f"lin AS (SELECT *, e::DOUBLE AS x, {_R} AS r, {_A} AS a FROM grid), p AS (SELECT *, pow(1.0 - x, r) * pow(x, a) * (1.0::DOUBLE / 3.0) AS p0, pow(0.7 * (1.0 - x), r) * pow((1.0 - 0.7) * (1.0 - x), a) * (1.0::DOUBLE / 3.0) AS p1, pow(x, r) * pow(1.0 - x, a) * (1.0::DOUBLE / 3.0) AS p2 FROM lin)"
_BAYES = "CASE WHEN p0 / t >= p1 / t AND p0 / t >= p2 / t THEN '0/0' WHEN p1 / t >= p2 / t THEN '0/1' ELSE '1/1' END"


@query("genotype_bayes", f"WITH {_GRID}, {_LIN} SELECT id, ln, sk, {_BAYES} AS gt FROM (SELECT *, greatest(p0 + p1 + p2, 1e-10) AS t FROM p)")
def genotype_bayes(spark, sf_dir):
    grid, r, a, e = _depths(spark, sf_dir)
    return grid.select("id", "ln", "sk", G.genotype_bayes(r, a, e).alias("gt"))


_EM = """em AS (SELECT *, list_reduce(list_prepend({'a': 0.3::DOUBLE, 'b': 0.3::DOUBLE, 'c': 0.3::DOUBLE}, [{'a': l0, 'b': l1, 'c': l2} for i in range(1, 101)]),
  lambda acc, el: {'a': el.a * acc.a / greatest(el.a * acc.a + el.b * acc.b + el.c * acc.c, 1e-50), 'b': el.b * acc.b / greatest(el.a * acc.a + el.b * acc.b + el.c * acc.c, 1e-50), 'c': el.c * acc.c / greatest(el.a * acc.a + el.b * acc.b + el.c * acc.c, 1e-50)}) AS w
  FROM (SELECT *, pow(1.0 - x, r) * pow(x, a) AS l0, pow(0.5 * (1.0 - x), r) * pow(0.5 * (1.0 - x), a) AS l1, pow(x, r) * pow(1.0 - x, a) AS l2, greatest(p0 + p1 + p2, 1e-10) AS t FROM p))"""
_EM_GT = "CASE WHEN w.a > w.b AND w.a > w.c THEN '0/0' WHEN w.b > w.a AND w.b > w.c THEN '0/1' ELSE '1/1' END"
_RATIO = "CASE WHEN r + a = 0 THEN './.' WHEN r::DOUBLE / (r + a) >= {t} THEN '0/0' WHEN r::DOUBLE / (r + a) <= 1 - {t}::DOUBLE THEN '1/1' ELSE '0/1' END"


@query("genotype_em", f"WITH {_GRID}, {_LIN}, {_EM} SELECT id, ln, sk, {_EM_GT} AS gt FROM em")
def genotype_em(spark, sf_dir):
    return _by_depths(spark, sf_dir, G.genotype_em)


@query("genotype_ratio", f"WITH {_GRID}, {_LIN} SELECT id, ln, sk, {_RATIO.format(t=0.7)} AS gt FROM lin")
def genotype_ratio(spark, sf_dir):
    grid, r, a, _ = _depths(spark, sf_dir)
    return grid.select("id", "ln", "sk", G.genotype_ratio(r, a).alias("gt"))


@query("genotype_vote", f"WITH {_GRID}, {_LIN}, {_EM} SELECT id, ln, sk, CASE WHEN {_EM_GT} = {_RATIO.format(t=0.8)} THEN {_EM_GT} ELSE {_BAYES} END AS gt FROM em")
def genotype_vote(spark, sf_dir):
    return _by_depths(spark, sf_dir, G.genotype_vote)


@query("agg_vote", f"WITH {_GRID}, {_LIN}, {_EM} SELECT CASE WHEN {_EM_GT} = {_RATIO.format(t=0.8)} THEN {_EM_GT} ELSE {_BAYES} END AS gt, count(*) AS n FROM em GROUP BY 1")
def agg_vote(spark, sf_dir):
    return _by_depths(spark, sf_dir, G.genotype_vote).groupBy("gt").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- evidence and genotypes of calls
EVIDENCE_SQL = """iv AS (SELECT *, start + CASE WHEN svtype IN ('INS', 'BND') THEN 1 ELSE svlen END AS e, CASE WHEN svtype IN ('INS', 'BND') THEN 1000 ELSE 2000 END AS bias FROM loc),
  evidence AS (SELECT c.call_id, c.svtype, c.start, c.e, r.read_name, r.ref_start, r.ref_end, row_number() OVER (PARTITION BY c.call_id ORDER BY r.ref_start, r.read_ordinal) AS nth
    FROM iv c JOIN reads r ON r.contig = c.contig AND r.ref_start < c.e + c.bias AND r.ref_end > greatest(0, c.start - c.bias) WHERE (r.flag & 2308) = 0 AND r.mapq >= 20 AND NOT list_contains(c.reads, r.read_name)),
  shown AS (SELECT call_id, count(DISTINCT read_name) AS found FROM (SELECT *, least((e - start) / 2, 2000) AS part FROM evidence WHERE nth <= 200) WHERE CASE WHEN svtype IN ('INS', 'BND') THEN ref_start < start - 1000 AND ref_end > e + 1000 ELSE (ref_start < start AND ref_end > start + part) OR (ref_start < e - part AND ref_end > e) END GROUP BY 1),
  ref AS (SELECT i.*, CAST(CASE WHEN svtype = 'BND' THEN least(coalesce(found, 0), len(reads) * CASE WHEN len(reads) <= 2 THEN 20 WHEN len(reads) <= 5 THEN 9 WHEN len(reads) <= 15 THEN 7 ELSE 5 END) ELSE coalesce(found, 0) END AS BIGINT) AS ref_support FROM iv i LEFT JOIN shown USING (call_id))"""


@query("overlap_join_genotype", f"{CALLS_SQL}, {LOCAL_SQL}, {EVIDENCE_SQL} SELECT call_id, svtype, read_name, nth FROM evidence")
def overlap_join_genotype(spark, sf_dir):
    near = U.evidence_reads(placed_calls(spark, sf_dir), projection(spark, sf_dir, "reads"), ID, None)
    return near.select("call_id", "svtype", "read_name", F.col("nth").cast("bigint").alias("nth"))


@query("topk_first_200_reads", f"{_calls_sql(CROWDED)}, {LOCAL_SQL}, {EVIDENCE_SQL} SELECT call_id, read_name, nth FROM evidence WHERE nth <= 200")
def topk_first_200_reads(spark, sf_dir):
    """At the crowded place calls have thousands of reads."""
    near = U.evidence_reads(placed_calls(spark, sf_dir), crowded_reads(spark, sf_dir), ID)
    return near.select("call_id", "read_name", F.col("nth").cast("bigint").alias("nth"))


@query("ref_support", f"{_calls_sql(CROWDED)}, {LOCAL_SQL}, {EVIDENCE_SQL} SELECT call_id, svtype, ref_support FROM ref")
def ref_support(spark, sf_dir):
    """All types over the crowded reads, so that the bound of breakends binds."""
    calls = placed_calls(spark, sf_dir)
    return calls.select("call_id", "svtype").join(U.reference_support(calls, crowded_reads(spark, sf_dir), ID), "call_id")


_MINS = "least_of AS (SELECT *, local AS l, coverage AS c, 0.0 AS error FROM ref, cov)"
CALLED_SQL = f"""{CALLS_SQL}, {COVERAGE_SQL}, {LOCAL_SQL}, {EVIDENCE_SQL}, {_MINS}, mins AS (SELECT *, {_min_support_sql()} AS min_support, len(reads) AS alt FROM least_of),
  s AS (SELECT *, least(greatest(CAST(CASE svtype WHEN 'INS' THEN CASE WHEN min_support <= 3 THEN 0.01 ELSE 0.05 END WHEN 'BND' THEN CASE WHEN min_support <= 2 THEN 0.01 ELSE 0.05 END ELSE CASE WHEN min_support <= 2 THEN 0.0 WHEN min_support <= 4 THEN 0.01 ELSE 0.05 END END AS DOUBLE), 1e-6), 1.0 - 1e-6) AS er FROM mins),
  k AS (SELECT *, ref_support * ln(1.0 - er) + alt * ln(er) AS s0, (ref_support + alt) * ln(0.5::DOUBLE) AS s1, ref_support * ln(er) + alt * ln(1.0 - er) AS s2 FROM s),
  called AS (SELECT call_id, contig, svtype, start, svlen, support, min_support, ref_support, CASE WHEN alt < min_support THEN CASE svtype WHEN 'BND' THEN '0/0' ELSE './.' END WHEN ref_support + alt < min_support OR ref_support + alt <= 0 THEN './.' WHEN s0 >= s1 AND s0 >= s2 THEN '0/0' WHEN s1 >= s2 THEN '0/1' ELSE '1/1' END AS gt FROM k)"""


def called(spark, sf_dir) -> DataFrame:
    """Calls of all types with coverage, local depth, support threshold, reference support and genotype."""
    reads = projection(spark, sf_dir, "reads")
    local = U.count_support(placed_calls(spark, sf_dir), reads, ID)
    sized = local.join(F.broadcast(coverage(reads)))  # one row
    sized = sized.withColumn("min_support", G.min_support(F.col("svtype"), F.col("coverage"), F.col("local"), F.lit(0.0)))
    return U.genotype(cut(sized), reads, ID)


COLUMNS = ["call_id", "contig", "svtype", "start", "svlen", "support", "min_support", "ref_support", "gt"]
_KEPT = "support >= min_support AND svlen >= CASE svtype WHEN 'BND' THEN 1 ELSE 40 END"


@query("geno_skip", f"{CALLED_SQL} SELECT call_id, svtype, min_support, gt FROM called")
def geno_skip(spark, sf_dir):
    return called(spark, sf_dir).select("call_id", "svtype", "min_support", "gt")


@query("call_filter", f"{CALLED_SQL} SELECT call_id, contig, svtype, start, svlen, support FROM called WHERE {_KEPT}")
def call_filter(spark, sf_dir):
    return called(spark, sf_dir).filter(_KEPT).select("call_id", "contig", "svtype", "start", "svlen", "support")


@query("call_all", f"{CALLED_SQL} SELECT {', '.join(COLUMNS)} FROM called WHERE {_KEPT}")
def call_all(spark, sf_dir):
    """All five types from clusters to filtered genotypes."""
    return called(spark, sf_dir).filter(_KEPT).select(*COLUMNS)


@query("call_insertions", f"{CALLED_SQL} SELECT {', '.join(COLUMNS)} FROM called WHERE svtype = 'INS' AND {_KEPT}")
def call_insertions(spark, sf_dir):
    return call_all(spark, sf_dir).filter("svtype = 'INS'")


@query("sink_vcf_bnd_pair", f"""{with_ctes('bnd')}, b AS (SELECT rec_ordinal, chrom, pos, chr2, "end" AS p2, gt, CASE WHEN rec_ordinal % 2 = 0 THEN 'fwd' ELSE 'rev' END AS d1, CASE WHEN rec_ordinal % 4 < 2 THEN 'fwd' ELSE 'rev' END AS d2 FROM bnd),
  alts AS (SELECT *, chr2 || ':' || p2 AS t, chrom || ':' || pos AS h FROM b)
  SELECT rec_ordinal, concat_ws(chr(9), chrom, pos, '.', 'N', CASE WHEN d1 = 'fwd' AND d2 = 'fwd' THEN 'N[' || t || '[' WHEN d1 = 'fwd' THEN 'N]' || t || ']' WHEN d2 = 'fwd' THEN ']' || t || ']N' ELSE '[' || t || '[N' END, '.', 'PASS', 'SVTYPE=BND;', 'GT', gt) AS line FROM alts
  UNION ALL SELECT rec_ordinal, concat_ws(chr(9), chr2, p2, '.', 'N', CASE WHEN d1 = 'fwd' AND d2 = 'fwd' THEN ']' || h || ']N' WHEN d1 = 'fwd' THEN '[' || h || '[N' WHEN d2 = 'fwd' THEN 'N[' || h || '[' ELSE 'N]' || h || ']' END, '.', 'PASS', 'SVTYPE=BND;', 'GT', gt) FROM alts""")
def sink_vcf_bnd_pair(spark, sf_dir):
    d1, d2 = F.when(F.col("rec_ordinal") % 2 == 0, "fwd").otherwise("rev"), F.when(F.col("rec_ordinal") % 4 < 2, "fwd").otherwise("rev")
    lines = V.bnd_lines(F.col("chrom"), F.col("pos"), d1, F.col("chr2"), F.col("end"), d2, F.col("gt"))
    return projection(spark, sf_dir, "bnd").select("rec_ordinal", F.explode(lines).alias("line"))


# ---------------------------------------------------------------- refinement
EVENTS_SQL = f"""ops AS (SELECT r.*, k AS op_nth, CAST(regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 1)[k] AS BIGINT) AS n, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 2)[k] AS op FROM reads r, generate_series(1, len(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]'))) t(k) WHERE (flag & 2308) = 0 AND mapq >= 20),
  ev AS (SELECT read_ordinal, contig, read_name, op, n AS ev_len, ev_start FROM (SELECT *, ref_start + coalesce(CAST(sum(CASE WHEN op IN ('M','D','=','X','N') THEN n ELSE 0 END) OVER (PARTITION BY read_ordinal ORDER BY op_nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS ev_start FROM ops) WHERE op IN ('D','I') AND n >= 40)"""
PRED_SQL = "pred AS (SELECT o_orderkey AS id, 'chr' || (o_custkey % 5 + 1) AS contig, CASE WHEN o_custkey % 2 = 0 THEN 'DEL' ELSE 'INS' END AS svtype, (o_orderkey * 7919) % 2000000 + 300 + o_custkey % 900 AS start, 45 + o_custkey % 60 AS svlen FROM orders)"
_NEAR = "abs(ev_start - start) <= 700"
REFINE_SQL = f"""{READS}, {EVENTS_SQL}, {PRED_SQL},
  near AS (SELECT p.id, r.read_ordinal, row_number() OVER (PARTITION BY p.id ORDER BY r.ref_start, r.read_ordinal) AS nth FROM pred p JOIN reads r ON r.contig = p.contig AND r.ref_start < p.start + CASE WHEN p.svtype = 'INS' THEN 1 ELSE p.svlen END + 200 AND r.ref_end > greatest(0, p.start - 200) WHERE (r.flag & 2308) = 0 AND r.mapq >= 20),
  pairs AS (SELECT p.id, e.read_name, e.ev_start, e.ev_start + CASE WHEN p.svtype = 'INS' THEN 0 ELSE e.ev_len END AS ev_end, e.ev_len, p.start, p.svlen, p.svtype FROM pred p JOIN near n USING (id) JOIN ev e ON e.read_ordinal = n.read_ordinal WHERE n.nth <= 5000 AND CASE e.op WHEN 'D' THEN 'DEL' ELSE 'INS' END = p.svtype),
  fit AS (SELECT * FROM pairs WHERE ev_len::DOUBLE / svlen BETWEEN 0.25 AND 4.0 AND ({_NEAR} OR (svtype = 'DEL' AND (abs(ev_end - start - svlen) <= 700 OR greatest(0, least(ev_end, start + svlen) - greatest(ev_start, start))::DOUBLE / greatest(1, least(ev_len, svlen)) >= 0.2)))),
  seen AS (SELECT id, count(DISTINCT read_name) AS evidence, CAST(round_even(median(ev_start), 0) AS BIGINT) AS ms, CAST(round_even(median(ev_end), 0) AS BIGINT) AS me, CAST(round_even(median(ev_len), 0) AS BIGINT) AS ml FROM fit GROUP BY 1),
  j AS (SELECT p.*, evidence, ms, CASE WHEN svtype = 'INS' THEN ml ELSE greatest(1, me - ms) END AS nl, CASE WHEN svtype = 'INS' THEN abs(ms - start) ELSE greatest(abs(ms - start), abs(me - start - svlen)) END AS shift FROM pred p LEFT JOIN seen USING (id)),
  refined AS (SELECT *, CASE WHEN NOT list_contains({{types}}, svtype) THEN 'type_skip' WHEN evidence IS NULL THEN 'no_event' WHEN evidence < 2 THEN 'low_evidence' WHEN nl < 40 THEN 'short_len' WHEN shift > 500 THEN 'over_shift' WHEN nl::DOUBLE / svlen NOT BETWEEN 0.5 AND 2.0 THEN 'len_ratio' WHEN ms = start AND nl = svlen THEN 'same_value' ELSE 'updated' END AS reason FROM j)
  SELECT id, CAST(CASE WHEN reason = 'type_skip' THEN 0 ELSE coalesce(evidence, 0) END AS BIGINT) AS evidence, CASE WHEN reason IN ('updated','same_value') THEN ms ELSE start END AS new_start, CASE WHEN reason IN ('updated','same_value') THEN nl ELSE svlen END AS new_len, reason FROM refined"""


def predicted(spark, sf_dir) -> DataFrame:
    return spark.sql(PRED_SQL[len("pred AS (") : -1].replace("FROM orders", "FROM {t}"), t=table(spark, sf_dir, "orders"))


def _refined(spark, sf_dir, types) -> DataFrame:
    return U.refine(predicted(spark, sf_dir), projection(spark, sf_dir, "reads"), ["id"], types).select("id", "evidence", "new_start", "new_len", "reason")


@query("refine_del", REFINE_SQL.replace("{types}", "['DEL']") + " WHERE svtype = 'DEL'")
def refine_del(spark, sf_dir):
    return _refined(spark, sf_dir, ("DEL",)).filter("reason <> 'type_skip'")


@query("refine_ins", REFINE_SQL.replace("{types}", "['INS']") + " WHERE svtype = 'INS'")
def refine_ins(spark, sf_dir):
    return _refined(spark, sf_dir, ("INS",)).filter("reason <> 'type_skip'")


@query("refine_driver", REFINE_SQL.replace("{types}", "['DEL', 'INS']"))
def refine_driver(spark, sf_dir):
    return _refined(spark, sf_dir, ("DEL", "INS"))


_NEAR_READS = REFINE_SQL[: REFINE_SQL.index("  pairs AS")].rstrip().rstrip(",").replace(READS, CROWDED, 1)


@query("first_5000_reads", f"{_NEAR_READS} SELECT id, read_ordinal, nth FROM near WHERE nth <= 5000")
def first_5000_reads(spark, sf_dir):
    good = crowded_reads(spark, sf_dir).filter(is_primary(F.col("flag"), True) & (F.col("mapq") >= 20)).select("contig", "read_ordinal", "ref_start", "ref_end")
    return U.refine_reads(predicted(spark, sf_dir), good, ["id"]).select("id", "read_ordinal", F.col("nth").cast("bigint").alias("nth"))


@query("overlap_join_refine", f"{READS}, {PRED_SQL} SELECT p.id, r.read_ordinal FROM pred p JOIN reads r ON r.contig = p.contig AND r.ref_start < p.start + 201 AND r.ref_end > greatest(0, p.start - 200) WHERE (r.flag & 2308) = 0 AND r.mapq >= 20 AND p.svtype = 'INS'")
def overlap_join_refine(spark, sf_dir):
    from svloom.operators.ranges import range_join

    calls = predicted(spark, sf_dir).filter("svtype = 'INS'")
    calls = calls.withColumn("__s", F.greatest(F.lit(0), F.col("start") - 200)).withColumn("__e", F.col("start") + 201)
    good = projection(spark, sf_dir, "reads").filter(is_primary(F.col("flag"), True) & (F.col("mapq") >= 20)).select("contig", "read_ordinal", "ref_start", "ref_end")
    return range_join(calls, good, ["contig"], ("__s", "__e"), ("ref_start", "ref_end"), 1000, spread=True).select("id", "read_ordinal")
