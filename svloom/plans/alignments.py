"""Queries over alignment records: flags, CIGAR walks, split alignments, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svloom.functions import alignment as A
from svloom.functions import signatures as S
from svloom.operators.cut import scratch
from svloom.plans.registry import query
from svloom.sources.bam import read_bam, write_bam
from svloom.sources.fixtures import projection, table, with_ctes

READS, SEGMENTS = with_ctes("reads"), with_ctes("segments")
OPS = "SELECT r.*, k AS nth, CAST(regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 1)[k] AS BIGINT) AS n, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 2)[k] AS op FROM reads r, generate_series(1, len(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]'))) t(k)"
CLASS = "CASE flag WHEN 0 THEN 1 WHEN 16 THEN 2 WHEN 2048 THEN 3 WHEN 2064 THEN 4 ELSE 0 END"


@query("flag_class", f"{READS} SELECT read_ordinal, CAST({CLASS} AS INT) AS flag_class, CASE WHEN ({CLASS}) % 2 = 0 THEN 'reverse' ELSE 'forward' END AS strand FROM reads")
def flag_class(spark, sf_dir):
    c = A.flag_class(F.col("flag"))
    return projection(spark, sf_dir, "reads").select("read_ordinal", c.alias("flag_class"), A.strand_of_flag(F.col("flag")).alias("strand"))


@query("filter_primary_generate", f"{READS} SELECT read_ordinal, flag FROM reads WHERE (flag & 3332) = 0")
def filter_primary_generate(spark, sf_dir):
    return projection(spark, sf_dir, "reads").filter(A.is_primary(F.col("flag"), keep_duplicates=False)).select("read_ordinal", "flag")


@query("filter_primary_call", f"{READS} SELECT read_ordinal, flag FROM reads WHERE (flag & 2308) = 0")
def filter_primary_call(spark, sf_dir):
    return projection(spark, sf_dir, "reads").filter(A.is_primary(F.col("flag"), keep_duplicates=True)).select("read_ordinal", "flag")


@query("filter_mapq", f"{READS} SELECT read_ordinal, mapq FROM reads WHERE mapq >= 20")
def filter_mapq(spark, sf_dir):
    return projection(spark, sf_dir, "reads").filter("mapq >= 20").select("read_ordinal", "mapq")


_SPANS = f"{READS}, spans AS (SELECT *, list_sum([CAST(x AS BIGINT) for x in regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1)]) AS covers, list_sum([CAST(x AS BIGINT) for x in regexp_extract_all(cigar, '(\\d+)[MIS=X]', 1)]) AS bases FROM reads)"


def _as_bam(spark, sf_dir) -> str:
    """The reads in a sorted and indexed file, and its path."""
    path, reads = f"{scratch(spark, 'bam')}/reads.bam", projection(spark, sf_dir, "reads")
    contigs = reads.groupBy("contig").agg((F.max("ref_end") + 10_000).alias("length")).withColumn("ord", F.substring("contig", 4, 9).cast("int"))
    nothing = [F.lit(None).cast("int").alias(c) for c in ("q_aln_start", "q_aln_end", "read_len")]
    write_bam(reads.select("read_ordinal", "read_name", "flag", "contig", "ref_start", "ref_end", "mapq", "cigar", "nm", F.lit(None).cast("string").alias("sa"), F.col("query_len").cast("int"), *nothing), contigs, path)
    return path


@query("scan_reads_interval", f"{_SPANS} SELECT read_name, contig, flag, mapq, cigar, nm, ref_start, CAST(ref_start + covers AS BIGINT) AS ref_end, CAST(bases AS INT) AS query_len FROM spans WHERE contig = 'chr2' AND ref_start < 900000 AND ref_start + covers > 400000")
def scan_reads_interval(spark, sf_dir):
    """Of an indexed file, only the blocks that may hold the range are read."""
    return read_bam(spark, _as_bam(spark, sf_dir), "chr2", 400_000, 900_000).select("read_name", "contig", "flag", "mapq", "cigar", "nm", "ref_start", "ref_end", "query_len")


@query("scan_reads_contig", f"{READS} SELECT read_ordinal, contig FROM reads WHERE contig = 'chr3'")
def scan_reads_contig(spark, sf_dir):
    return projection(spark, sf_dir, "reads").filter("contig = 'chr3'").select("read_ordinal", "contig")


@query("contig_canonical", f"{READS} SELECT read_ordinal, 'chr' || replace(contig, 'chr', '') AS canonical, replace(contig, 'chr', '') AS bare FROM reads")
def contig_canonical(spark, sf_dir):
    return projection(spark, sf_dir, "reads").select("read_ordinal", A.canonical_contig(A.bare_contig(F.col("contig"))).alias("canonical"), A.bare_contig(F.col("contig")).alias("bare"))


@query("region_key", f"{READS} SELECT read_ordinal, contig || '_' || (ref_start // 100000 * 100000) || '_' || (ref_start // 100000 * 100000 + 100000) AS region FROM reads")
def region_key(spark, sf_dir):
    start = F.floor(F.col("ref_start") / 100000) * 100000
    return projection(spark, sf_dir, "reads").select("read_ordinal", F.concat_ws("_", "contig", start.cast("string"), (start + 100000).cast("string")).alias("region"))


#: Words that name a sequencing platform, and the platforms' codes.
PLATFORM_WORDS = {"ccs": ("ccs", "hifi"), "clr": ("clr",), "ont": ("ont", "nanopore")}
PLATFORM_CODES = {"ccs": 0, "clr": 1, "ont": 2}


def platform_code(path: F.Column) -> F.Column:
    """The code of the one platform that a path names between non-alphanumeric characters; null for none or several."""
    named = {p: F.lower(path).rlike(rf"(^|[^a-z0-9])({'|'.join(words)})([^a-z0-9]|$)") for p, words in PLATFORM_WORDS.items()}
    total = sum(x.cast("int") for x in named.values())
    out = F
    for p, x in named.items():
        out = out.when((total == 1) & x, PLATFORM_CODES[p])
    return out


PATH = "concat('/data/', CASE o_orderkey % 5 WHEN 0 THEN 'HG2.ccs.bam' WHEN 1 THEN 'clr_run/x.bam' WHEN 2 THEN 'my-ONT/y' WHEN 3 THEN 'contig/z' ELSE 'ont/ccs.bam' END)"
_NAMED = {p: f"CAST(regexp_matches(lower(path), '(^|[^a-z0-9])({'|'.join(w)})([^a-z0-9]|$)') AS INT)" for p, w in PLATFORM_WORDS.items()}


@query("platform_infer", f"SELECT o_orderkey AS id, CASE WHEN {' + '.join(_NAMED.values())} <> 1 THEN NULL WHEN {_NAMED['ccs']} = 1 THEN 0 WHEN {_NAMED['clr']} = 1 THEN 1 ELSE 2 END AS platform FROM (SELECT o_orderkey, {PATH} AS path FROM orders)")
def platform_infer(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), platform_code(F.expr(PATH)).alias("platform"))


@query(
    "cigar_parse_string",
    f"""{READS}, ops AS ({OPS}), clip AS (SELECT read_ordinal, coalesce(min(nth) FILTER (WHERE op NOT IN ('S', 'H')), 1000) AS body FROM ops GROUP BY 1)
    SELECT o.read_ordinal, min(ref_start) AS ref_start, min(ref_start) + CAST(coalesce(sum(n) FILTER (WHERE op IN ('M','D','N','=','X')), 0) AS BIGINT) AS ref_end,
    CAST(coalesce(sum(n) FILTER (WHERE nth < body), 0) AS BIGINT) AS read_start, CAST(coalesce(sum(n) FILTER (WHERE nth < body), 0) + coalesce(sum(n) FILTER (WHERE op IN ('M','I','=','X')), 0) AS BIGINT) AS read_end
    FROM ops o JOIN clip USING (read_ordinal) GROUP BY 1""",
)
def cigar_parse_string(spark, sf_dir):
    return projection(spark, sf_dir, "reads").select("read_ordinal", A.cigar_span(F.col("ref_start"), F.col("cigar")).alias("s")).select("read_ordinal", "s.*")


def _walked(moving: str) -> str:
    return f"""ops AS ({OPS}), walked AS (SELECT *, ref_start + coalesce(CAST(sum(CASE WHEN op IN ({moving}) THEN n ELSE 0 END) OVER (PARTITION BY read_ordinal ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM ops)"""


#: The indels of reads as a CTE ev of read_ordinal, op, start, size.
INDELS_SQL = f"{READS}, {_walked("'M','D','=','X'")}, ev AS (SELECT read_ordinal, op, start, n AS size FROM walked WHERE op IN ('D','I') AND n >= 40)"


def _indel_oracle(moving: str, where: str = "") -> str:
    return f"""{READS}, {_walked(moving)}
    SELECT read_ordinal, op, start, n FROM walked WHERE op IN ('D','I') AND n >= 40 {where}"""


def indel_rows(reads: DataFrame, skip_moves: bool) -> DataFrame:
    events = F.explode(A.indels(A.cigar_ops(F.col("cigar")), F.col("ref_start"), skip_moves)).alias("e")
    return reads.select("read_ordinal", "read_name", "contig", events).select("read_ordinal", "read_name", "contig", "e.op", "e.start", "e.n")


@query("cigar_walk_indels", _indel_oracle("'M','D','=','X'"))
def cigar_walk_indels(spark, sf_dir):
    return indel_rows(projection(spark, sf_dir, "reads"), False).select("read_ordinal", "op", "start", "n")


@query("refine_extract", _indel_oracle("'M','D','=','X','N'"))
def refine_extract(spark, sf_dir):
    return indel_rows(projection(spark, sf_dir, "reads"), True).select("read_ordinal", "op", "start", "n")


@query("cigar_region_clip", _indel_oracle("'M','D','=','X'", "AND ((op = 'D' AND 200000 <= start + n AND 1200000 >= start) OR (op = 'I' AND 200000 <= start AND start <= 1200000))"))
def cigar_region_clip(spark, sf_dir):
    rows = indel_rows(projection(spark, sf_dir, "reads"), False)
    inside = F.when(F.col("op") == "D", (F.col("start") + F.col("n") >= 200000) & (F.col("start") <= 1200000)).otherwise(F.col("start").between(200000, 1200000))
    return rows.filter(inside).select("read_ordinal", "op", "start", "n")


@query(
    "clip_positions",
    f"""{READS}, marked AS (SELECT *, CASE WHEN ({CLASS}) % 2 = 0 THEN ref_end ELSE ref_start END AS pos FROM reads)
    SELECT read_ordinal, 'ms' AS kind, pos FROM marked WHERE regexp_matches(cigar, '[SH]$') UNION ALL SELECT read_ordinal, 'sm', pos FROM marked WHERE regexp_matches(cigar, '^\\d+[SH]')""",
)
def clip_positions(spark, sf_dir):
    reads = projection(spark, sf_dir, "reads")
    kinds = F.array_compact(F.array(F.when(F.col("cigar").rlike("[SH]$"), "ms"), F.when(F.col("cigar").rlike(r"^\d+[SH]"), "sm")))
    pos = F.when(A.strand_of_flag(F.col("flag")) == "reverse", F.col("ref_end")).otherwise(F.col("ref_start"))
    return reads.select("read_ordinal", F.explode(kinds).alias("kind"), pos.alias("pos"))


@query(
    "aligned_positions",
    f"""{READS}, ops AS ({OPS}), walked AS (SELECT *, ref_start + coalesce(CAST(sum(CASE WHEN op IN ('M','D','=','X','N') THEN n ELSE 0 END) OVER (PARTITION BY read_ordinal ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM ops)
    SELECT read_ordinal, start, start + n AS "end" FROM walked WHERE op IN ('M','=','X')""",
)
def aligned_positions(spark, sf_dir):
    blocks = projection(spark, sf_dir, "reads").select("read_ordinal", F.explode(A.aligned_blocks(A.cigar_ops(F.col("cigar")), F.col("ref_start"))).alias("b"))
    return blocks.select("read_ordinal", "b.start", (F.col("b.start") + F.col("b.n")).alias("end"))


ERRORS = f"""errors AS (SELECT read_ordinal, contig, mapq, seg_len, CAST(greatest(edits - gaps, 0) AS BIGINT) AS mismatches, edits / seg_len AS error FROM
  (SELECT read_ordinal, min(contig) AS contig, min(mapq) AS mapq, CAST(sum(n) FILTER (WHERE op NOT IN ('S','H','D')) AS BIGINT) AS seg_len, CAST(coalesce(sum(n) FILTER (WHERE op IN ('I','D')), 0) AS BIGINT) AS gaps,
  coalesce(min(nm), CAST(coalesce(sum(n) FILTER (WHERE op IN ('I','D')), 0) AS BIGINT)) AS edits FROM ({OPS}) GROUP BY 1) WHERE seg_len > 0)"""


def read_errors(reads: DataFrame) -> DataFrame:
    rows = reads.select("read_ordinal", "contig", "mapq", A.alignment_error(A.cigar_ops(F.col("cigar")), F.col("nm")).alias("e"))
    return rows.filter("e is not null").select("read_ordinal", "contig", "mapq", "e.*")


@query("alignment_error", f"{READS}, {ERRORS} SELECT read_ordinal, seg_len, mismatches, round(error, 6) AS error FROM errors")
def alignment_error(spark, sf_dir):
    return read_errors(projection(spark, sf_dir, "reads")).select("read_ordinal", "seg_len", "mismatches", F.round("error", 6).alias("error"))


QUALITY = "abs(2.0 * ln(1 + mapq) / (1 + exp(-0.1 * (mapq - 20))) - 5.0 * sqrt(error) - 0.1 * mismatches / (1 + exp(-0.01 * (mismatches - 50))) - 8.0 * pow(mismatches / seg_len, 2.0))"


@query("alignment_quality", f"{READS}, {ERRORS} SELECT read_ordinal, round({QUALITY}, 5) AS score FROM errors")
def alignment_quality(spark, sf_dir):
    rows = read_errors(projection(spark, sf_dir, "reads"))
    score = A.alignment_quality(F.col("mapq"), F.col("error"), F.col("mismatches"), F.col("mismatches") / F.col("seg_len"))
    return rows.select("read_ordinal", F.round(score, 5).alias("score"))


@query("error_mean_contig", f"{READS}, {ERRORS} SELECT contig, round(avg(error), 6) AS mean_error FROM errors GROUP BY 1")
def error_mean_contig(spark, sf_dir):
    return read_errors(projection(spark, sf_dir, "reads")).groupBy("contig").agg(F.round(F.avg("error"), 6).alias("mean_error"))


# ---------------------------------------------------------------- split alignments
SA = "concat('chr', o_custkey % 7 + 1, ',', o_orderkey * 11 % 900000, ',', CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '+' END, ',', 20 + o_orderkey % 400, 'S', 60 + o_custkey % 700, 'M', 10 + o_orderkey % 30, 'D', 200, 'S,', o_custkey % 61, ',3;', CASE WHEN o_orderkey % 2 = 0 THEN concat('chr9,', o_orderkey, ',+,', 5 + o_custkey % 100, 'H', 300, 'M,', o_orderkey % 61, ',1;') ELSE '' END)"


def _sa_rows(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (1000 + F.col("o_orderkey") % 9000).alias("read_len"), F.explode(A.split_alignments(F.expr(SA))).alias("a"))
    span = rows.select("id", "read_len", "a.contig", "a.strand", "a.mapq", A.cigar_span(F.col("a.pos"), F.col("a.cigar")).alias("s"))
    flip = F.col("strand") == "-"
    start = F.when(flip, F.col("read_len") - F.col("s.read_end")).otherwise(F.col("s.read_start"))
    end = F.when(flip, F.col("read_len") - F.col("s.read_start")).otherwise(F.col("s.read_end"))
    return span.select("id", "contig", "strand", "mapq", F.col("s.ref_start").alias("r_start"), F.col("s.ref_end").alias("r_end"), start.alias("q_start"), end.alias("q_end"))


_SA_SQL = f"""parts AS (SELECT o_orderkey AS id, 1000 + o_orderkey % 9000 AS read_len, unnest(list_filter(string_split({SA}, ';'), lambda x: x <> '')) AS p FROM orders),
  cols AS (SELECT id, read_len, string_split(p, ',') AS f FROM parts),
  spans AS (SELECT id, read_len, f[1] AS contig, CAST(f[2] AS BIGINT) AS r_start, f[3] AS strand, CAST(f[5] AS INT) AS mapq, CAST(regexp_extract(f[4], '^(\\d+)', 1) AS BIGINT) AS clip,
    coalesce(CAST(list_sum(list_transform(regexp_extract_all(f[4], '(\\d+)M', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT), 0) AS m, coalesce(CAST(list_sum(list_transform(regexp_extract_all(f[4], '(\\d+)D', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT), 0) AS d FROM cols),
  sa AS (SELECT id, contig, strand, mapq, r_start, r_start + m + d AS r_end, CASE WHEN strand = '-' THEN read_len - clip - m ELSE clip END AS q_start, CASE WHEN strand = '-' THEN read_len - clip ELSE clip + m END AS q_end FROM spans)"""


@query("sa_split", f"WITH {_SA_SQL} SELECT * FROM sa")
def sa_split(spark, sf_dir):
    return _sa_rows(spark, sf_dir)


@query("sa_quality_filter", f"WITH {_SA_SQL} SELECT id, contig, mapq, q_end - q_start AS q_span, r_end - r_start AS r_span FROM sa WHERE mapq >= 10 AND least(q_end - q_start, r_end - r_start) >= 80")
def sa_quality_filter(spark, sf_dir):
    rows = _sa_rows(spark, sf_dir).withColumn("q_span", F.col("q_end") - F.col("q_start")).withColumn("r_span", F.col("r_end") - F.col("r_start"))
    return rows.filter((F.col("mapq") >= 10) & (F.least("q_span", "r_span") >= 80)).select("id", "contig", "mapq", "q_span", "r_span")


# ---------------------------------------------------------------- segments and signatures
ORDER = ["q_start", "q_end", "tie", "tie2"]
FIELDS = ["q_start", "q_end", "r_start", "r_end", "mapq", "contig", "strand"]


@query("segment_span_mapq", f"{SEGMENTS} SELECT read_name, q_start, greatest(q_end - q_start, 0) AS q_span, greatest(r_end - r_start, 0) AS r_span, coalesce(nullif(mapq, 0), 20) AS mapq FROM segments")
def segment_span_mapq(spark, sf_dir):
    span = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(0))
    return projection(spark, sf_dir, "segments").select("read_name", "q_start", span("q_start", "q_end").alias("q_span"), span("r_start", "r_end").alias("r_span"), F.coalesce(F.nullif("mapq", F.lit(0)), F.lit(20)).alias("mapq"))


def segment_pairs_of(segments: DataFrame, long_flag: bool = True) -> DataFrame:
    """Neighbouring segments of a read, and the first with the last where the first two contigs differ (3 or more)."""
    window = Window.partitionBy("read_name").orderBy(*ORDER)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct(*FIELDS)
    rows = segments.withColumn("c", own).withColumn("nth", F.row_number().over(window)).withColumn("n", F.lead(own).over(window))
    rows = rows.withColumn("last", F.last(own).over(whole)).withColumn("count", F.count("*").over(whole))
    near = rows.filter("n is not null").select("read_name", "nth", "c", "n", F.lit(False).alias("long_pair"))
    ends = rows.filter("nth = 1 and count >= 3 and c.contig <> n.contig").select("read_name", F.lit(0).alias("nth"), "c", F.col("last").alias("n"), F.lit(long_flag).alias("long_pair"))
    flat = [F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in "cn" for f in FIELDS]
    return near.unionAll(ends).select("read_name", "nth", "long_pair", *flat)


_PAIR_FIELDS = ", ".join(f"c_{f}" for f in FIELDS) + ", " + ", ".join(f"n_{f}" for f in FIELDS)
_LEADS = ", ".join(f"{f} AS c_{f}, lead({f}) OVER w AS n_{f}, last_value({f}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l_{f}" for f in FIELDS)
PAIRS_SQL = f"""rows AS (SELECT read_name, CAST(row_number() OVER w AS INT) AS nth, count(*) OVER (PARTITION BY read_name) AS total, {_LEADS} FROM segments WINDOW w AS (PARTITION BY read_name ORDER BY {', '.join(ORDER)})),
  pairs AS (SELECT read_name, nth, false AS long_pair, {_PAIR_FIELDS} FROM rows WHERE n_q_start IS NOT NULL
  UNION ALL SELECT read_name, 0, true, {', '.join(f'c_{f}' for f in FIELDS)}, {', '.join(f'l_{f}' for f in FIELDS)} FROM rows WHERE nth = 1 AND total >= 3 AND c_contig <> n_contig)"""


@query("segment_pairs", f"{SEGMENTS}, {PAIRS_SQL} SELECT * FROM pairs")
def segment_pairs(spark, sf_dir):
    return segment_pairs_of(projection(spark, sf_dir, "segments"))


GEOMETRY_SQL = """geo AS (SELECT *, c_contig = n_contig AS same_contig, c_strand = n_strand AS same_strand, n_q_start - c_q_end AS dist_read,
  CASE WHEN c_strand = n_strand AND c_strand = '+' THEN n_r_start - c_r_end WHEN c_strand = n_strand THEN c_r_start - n_r_end WHEN c_r_end > n_r_end THEN n_r_end - c_r_start ELSE c_r_end - n_r_start END AS dist_ref,
  least(c_mapq, n_mapq) AS q, least(greatest(c_q_end - c_q_start, 0), greatest(c_r_end - c_r_start, 0)) AS c_span, least(greatest(n_q_end - n_q_start, 0), greatest(n_r_end - n_r_start, 0)) AS n_span FROM pairs)"""


@query("pair_geometry", f"{SEGMENTS}, {PAIRS_SQL}, {GEOMETRY_SQL} SELECT read_name, nth, same_contig, same_strand, dist_read, dist_ref, dist_read - dist_ref AS deviation FROM geo")
def pair_geometry(spark, sf_dir):
    pairs = segment_pairs_of(projection(spark, sf_dir, "segments"))
    return pairs.select("read_name", "nth", *[v.alias(k) for k, v in S.pair_geometry().items()])


@query("valid_ins", f"{SEGMENTS}, {PAIRS_SQL}, {GEOMETRY_SQL} SELECT read_name, nth, CASE WHEN dist_read - dist_ref >= 1000 THEN q >= 10 AND least(c_span, n_span) >= 80 ELSE q >= 20 AND least(c_span, n_span) >= 200 END AS valid FROM geo")
def valid_ins(spark, sf_dir):
    pairs = segment_pairs_of(projection(spark, sf_dir, "segments"))
    return pairs.select("read_name", "nth", S.valid_ins(S.pair_geometry()["deviation"]).alias("valid"))


@query("valid_short_inv", f"{SEGMENTS}, {PAIRS_SQL}, {GEOMETRY_SQL} SELECT read_name, nth, abs(dist_ref) >= 5000 OR (c_span >= 500 AND n_span >= 500 AND dist_read BETWEEN -200 AND 500) AS valid FROM geo")
def valid_short_inv(spark, sf_dir):
    pairs = segment_pairs_of(projection(spark, sf_dir, "segments"))
    return pairs.select("read_name", "nth", S.valid_short_inv(F.abs(S.pair_geometry()["dist_ref"])).alias("valid"))


def _classify_sql(strict: bool, lo: int = 100_000, hi: int = 900_000) -> str:
    inside = (lambda s: f"({s} BETWEEN {lo} AND {hi})") if strict else (lambda s: "true")
    good, size = ("q >= 20", lambda s: f"({s} >= 40 AND {s} <= 2000000)") if strict else ("true", lambda s: "true")
    ins_start = "CASE WHEN long_pair THEN least(near, far) ELSE (near + far) // 2 END" if strict else "(near + far) // 2"
    vins = "CASE WHEN dev >= 1000 THEN q >= 10 AND least(c_span, n_span) >= 80 ELSE q >= 20 AND least(c_span, n_span) >= 200 END" if strict else "true"
    vinv = "(inv_size >= 5000 OR (c_span >= 500 AND n_span >= 500 AND dist_read BETWEEN -200 AND 500))" if strict else "true"
    return f"""{SEGMENTS}, {PAIRS_SQL}, {GEOMETRY_SQL}, d AS (SELECT *, dist_read - dist_ref AS dev, c_strand = '+' AS plus, CASE WHEN c_strand = '+' THEN c_r_end ELSE c_r_start END AS near, CASE WHEN c_strand = '+' THEN n_r_start ELSE n_r_end END AS far,
      n_r_start - c_r_end >= -5 AS behind, c_r_start - n_r_end >= -5 AS before, dist_ref >= -40 OR long_pair AS colinear FROM geo),
    e AS (SELECT *, CASE WHEN plus THEN c_r_end ELSE n_r_end END AS del_start, CASE WHEN plus THEN n_r_start ELSE c_r_start END AS dup_start, CASE WHEN plus THEN c_r_end - n_r_start ELSE n_r_end - c_r_start END AS dup_size,
      CASE WHEN plus AND behind THEN c_r_end WHEN plus THEN n_r_end WHEN behind THEN c_r_start ELSE n_r_start END AS inv_start,
      CASE WHEN plus AND behind THEN n_r_end - c_r_end WHEN plus THEN c_r_end - n_r_end WHEN behind THEN n_r_start - c_r_start ELSE c_r_start - n_r_start END AS inv_size,
      {ins_start} AS ins_start, CASE WHEN n_strand = '+' THEN n_r_start ELSE n_r_end END AS side_same, CASE WHEN plus THEN n_r_end ELSE n_r_start END AS side_diff FROM d),
    k AS (SELECT *, CASE WHEN NOT same_contig THEN 'TRA'
      WHEN NOT same_strand THEN CASE WHEN (behind OR before) AND {good} AND {inside('inv_start')} AND {size('inv_size')} AND {vinv} THEN 'INV' END
      WHEN NOT colinear THEN CASE WHEN {good} AND {size('dup_size')} THEN 'DUP' END
      WHEN dev > 0 THEN CASE WHEN dev >= 40 AND {vins} AND {inside('ins_start')} THEN 'INS' END
      WHEN dev < 0 THEN CASE WHEN -dev >= 40 AND {good} AND {inside('del_start')} THEN 'DEL' END END AS svtype, CASE WHEN same_strand THEN side_same ELSE side_diff END AS next_side FROM e)
    SELECT read_name, nth, svtype, CASE svtype WHEN 'TRA' THEN CASE WHEN c_contig > n_contig THEN next_side ELSE near END WHEN 'INV' THEN inv_start WHEN 'DUP' THEN dup_start WHEN 'INS' THEN ins_start ELSE del_start END AS start,
      CASE svtype WHEN 'INV' THEN inv_size WHEN 'DUP' THEN dup_size WHEN 'INS' THEN dev WHEN 'DEL' THEN -dev END AS size, CASE WHEN svtype = 'TRA' THEN least(c_contig, n_contig) ELSE c_contig END AS contig,
      CASE WHEN svtype = 'TRA' THEN greatest(c_contig, n_contig) END AS contig2, CASE WHEN svtype = 'TRA' THEN CASE WHEN c_contig > n_contig THEN near ELSE next_side END END AS end2,
      CASE WHEN svtype = 'TRA' THEN CASE WHEN plus THEN 'fwd' ELSE 'rev' END END AS dir1, CASE WHEN svtype = 'TRA' THEN CASE WHEN n_strand = '+' THEN 'fwd' ELSE 'rev' END END AS dir2
    FROM k WHERE svtype IS NOT NULL"""


def signatures_of(pairs: DataFrame, strict: bool, region=(100_000, 900_000)) -> DataFrame:
    found = S.classify((F.lit(region[0]), F.lit(region[1])) if strict else None, strict)
    return pairs.select("read_name", "nth", found.alias("v")).filter("v is not null").select("read_name", "nth", "v.*")


@query("classify_signature_call", _classify_sql(True))
def classify_signature_call(spark, sf_dir):
    return signatures_of(segment_pairs_of(projection(spark, sf_dir, "segments")), True)


@query("classify_signature_generate", _classify_sql(False))
def classify_signature_generate(spark, sf_dir):
    return signatures_of(segment_pairs_of(projection(spark, sf_dir, "segments")), False)
