"""Queries over call sets of trios and over VCF text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.functions import variants as V
from svloom.operators import trio as T
from svloom.operators.cut import cut, scratch
from svloom.plans.registry import query
from svloom.sources.fixtures import projection, with_ctes
from svloom.sources.writers import mdr_report, write_trio_file

TRIO, BND, TEXTS, CALLS = with_ctes("trio"), with_ctes("bnd"), with_ctes("texts"), with_ctes("calls")


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter("sample = 'child'").drop("sample"), rows.filter("sample <> 'child'").drop("sample")


def number_sql(key: str) -> str:
    item = f"list_filter(string_split(info, ';'), lambda x: starts_with(x, '{key}='))"
    return f"coalesce(CAST(abs(trunc(TRY_CAST(substr({item}[-1], {len(key) + 2}) AS DOUBLE))) AS BIGINT), 0)"


def word_sql(key: str) -> str:
    return f"coalesce(substr(list_filter(string_split(info, ';'), lambda x: starts_with(x, '{key}='))[-1], {len(key) + 2}), '')"


@query("parse_info_mdr", f"{TEXTS} SELECT id, {number_sql('SVLEN')} AS svlen, {number_sql('END')} AS \"end\", substr({word_sql('SVTYPE')}, 1, 3) AS svtype, {word_sql('CHR2')} AS chr2 FROM texts")
def parse_info_mdr(spark, sf_dir):
    i = F.col("info")
    return projection(spark, sf_dir, "texts").select("id", V.whole(V.info_value(i, "SVLEN")).alias("svlen"), V.whole(V.info_value(i, "END")).alias("end"), V.sv_type(i, False).alias("svtype"), F.coalesce(V.info_value(i, "CHR2"), F.lit("")).alias("chr2"))


@query("parse_info_mier", f"{TEXTS} SELECT id, {number_sql('SVLEN')} AS svlen, {number_sql('END')} AS \"end\", CASE WHEN upper(substr({word_sql('SVTYPE')}, 1, 3)) = 'TRA' THEN 'BND' ELSE upper(substr({word_sql('SVTYPE')}, 1, 3)) END AS svtype FROM texts")
def parse_info_mier(spark, sf_dir):
    i = F.col("info")
    return projection(spark, sf_dir, "texts").select("id", V.whole(V.info_value(i, "SVLEN")).alias("svlen"), V.whole(V.info_value(i, "END")).alias("end"), V.sv_type(i, True).alias("svtype"))


ALT_SQL = """CASE WHEN starts_with(alt, ']') THEN ']]N' WHEN starts_with(alt, '[') THEN '[[N' WHEN alt[2] = ']' THEN 'N]]' ELSE 'N[[' END AS form,
  CASE WHEN alt[1] IN (']', '[') THEN substr(split_part(alt, ':', 1), 2) ELSE substr(split_part(alt, ':', 1), 3) END AS chr2, coalesce(TRY_CAST(regexp_extract(alt, ':(\\d+)', 1) AS BIGINT), 0) AS pos2"""


@query("parse_bnd_alt", f"{TEXTS} SELECT id, {ALT_SQL} FROM texts")
def parse_bnd_alt(spark, sf_dir):
    return projection(spark, sf_dir, "texts").select("id", V.bnd_alt(F.col("alt")).alias("b")).select("id", "b.form", "b.chr2", "b.pos2")


@query("parse_gt", f"{TEXTS}, g AS (SELECT id, CASE WHEN list_position(string_split(format, ':'), 'GT') > 0 THEN string_split(sample, ':')[list_position(string_split(format, ':'), 'GT')] END AS gt FROM texts) SELECT id, CASE WHEN gt IS NULL OR gt IN ('', '.', './.', '.|.') THEN '1/1' ELSE replace(gt, '|', '/') END AS gt FROM g")
def parse_gt(spark, sf_dir):
    return projection(spark, sf_dir, "texts").select("id", V.genotype_of(F.col("format"), F.col("sample")).alias("gt"))


@query("len_ok", f"{TRIO} SELECT rec_ordinal, least(svlen, 700) / greatest(svlen, 700, 1) >= 0.7 AS ok FROM trio")
def len_ok(spark, sf_dir):
    return projection(spark, sf_dir, "trio").select("rec_ordinal", V.len_ok(F.col("svlen"), F.lit(700)).alias("ok"))


KIND_SQL = f"CASE WHEN upper(substr({word_sql('SVTYPE')}, 1, 3)) = 'TRA' THEN 'BND' ELSE upper(substr({word_sql('SVTYPE')}, 1, 3)) END"


@query("child_match_key", f"""{TEXTS}, t AS (SELECT id, id * 2 AS pos, CASE WHEN id % 3 = 0 THEN replace(info, 'CHR2=', 'OTHER=') ELSE info END AS info, alt FROM texts),
  k AS (SELECT id, pos, {KIND_SQL} AS svtype, {number_sql('END')} AS stop, {number_sql('SVLEN')} AS given, {word_sql('CHR2')} AS named, {ALT_SQL} FROM t)
  SELECT id, svtype, CASE WHEN svtype = 'BND' AND stop = 0 THEN pos2 ELSE stop END AS "end", CASE WHEN given = 0 AND stop >= pos THEN stop - pos + 1 ELSE given END AS svlen,
  CASE WHEN svtype = 'BND' THEN coalesce(nullif(named, ''), chr2) END AS chr2, CASE WHEN svtype = 'BND' THEN form END AS form FROM k""")
def child_match_key(spark, sf_dir):
    info = F.when(F.col("id") % 3 == 0, F.replace("info", F.lit("CHR2="), F.lit("OTHER="))).otherwise(F.col("info"))
    return projection(spark, sf_dir, "texts").select("id", V.match_key(F.col("id") * 2, info, F.col("alt")).alias("k")).select("id", "k.*")


@query("parents_union", f"{TRIO} SELECT svtype, count(*) AS n FROM trio WHERE sample IN ('father', 'mother') GROUP BY 1")
def parents_union(spark, sf_dir):
    rows = projection(spark, sf_dir, "trio")
    return rows.filter("sample = 'father'").unionAll(rows.filter("sample = 'mother'")).groupBy("svtype").agg(F.count("*").alias("n"))


_LEN = "least(p.svlen, c.svlen) / greatest(p.svlen, c.svlen, 1) >= 0.7"
_INS = f"c.svtype = 'INS' AND p.svtype = 'INS' AND p.chrom = c.chrom AND abs(p.pos - c.pos) <= 1000 AND {_LEN}"
_IV = f"c.svtype = p.svtype AND c.svtype <> 'INS' AND p.chrom = c.chrom AND greatest(p.pos - 1000, c.pos) <= least(p.\"end\" + 1000, c.\"end\") AND {_LEN}"
_BND = "p.chrom = c.chrom AND p.chr2 = c.chr2 AND p.form = c.form AND abs(p.pos - c.pos) <= 1000 AND abs(p.\"end\" - c.\"end\") <= 1000"


def _exists(ctes: str, name: str, on: str) -> str:
    return f"{ctes} SELECT c.rec_ordinal, c.svtype FROM {name} c WHERE c.sample = 'child' AND EXISTS (SELECT 1 FROM {name} p WHERE p.sample <> 'child' AND {on})"


@query("trio_match_ins", _exists(TRIO, "trio", _INS))
def trio_match_ins(spark, sf_dir):
    return T.matches(*_split(projection(spark, sf_dir, "trio")), "INS").select("rec_ordinal", "svtype")


@query("trio_match_interval", _exists(TRIO, "trio", _IV))
def trio_match_interval(spark, sf_dir):
    child, parents = _split(projection(spark, sf_dir, "trio"))
    return T.matches(child, parents, *T.INTERVALS).select("rec_ordinal", "svtype")


@query("trio_match_bnd", _exists(BND, "bnd", _BND))
def trio_match_bnd(spark, sf_dir):
    return T.matches(*_split(projection(spark, sf_dir, "bnd")), "BND").select("rec_ordinal", "svtype")


def _first(ctes: str, name: str, on: str, order: str, where: str) -> str:
    return f"""{ctes}, hit AS (SELECT c.rec_ordinal, p.gt, row_number() OVER (PARTITION BY c.rec_ordinal ORDER BY {order}, p.rec_ordinal) AS k FROM {name} c JOIN {name} p ON {on} WHERE c.sample = 'child' AND p.sample = 'father')
    SELECT c.rec_ordinal, coalesce(h.gt, './.') AS parent_gt FROM {name} c LEFT JOIN hit h ON h.rec_ordinal = c.rec_ordinal AND k = 1 WHERE c.sample = 'child' AND {where}"""


@query("trio_first_match_gt", _first(TRIO, "trio", _INS, "p.pos // 1000", "c.svtype = 'INS'"))
def trio_first_match_gt(spark, sf_dir):
    rows = projection(spark, sf_dir, "trio")
    return T.first_match_gt(rows.filter("sample = 'child'"), rows.filter("sample = 'father'"), "INS")


@query("trio_first_match_interval", _first(TRIO, "trio", _IV, "greatest(floor((c.pos - 1000) / 1000000), floor((p.pos - 1000) / 1000000))", "c.svtype = 'DUP'"))
def trio_first_match_interval(spark, sf_dir):
    rows = projection(spark, sf_dir, "trio")
    return T.first_match_gt(rows.filter("sample = 'child'"), rows.filter("sample = 'father'"), "DUP")


@query("trio_first_match_bnd", _first(BND, "bnd", _BND, "p.pos // 1000, p.\"end\" // 1000", "true"))
def trio_first_match_bnd(spark, sf_dir):
    rows = projection(spark, sf_dir, "bnd")
    return T.first_match_gt(rows.filter("sample = 'child'"), rows.filter("sample = 'father'"), "BND")


_ANY = f"(({_INS}) OR ({_IV} AND c.svtype <> 'BND') OR (c.svtype = 'BND' AND p.svtype = 'BND' AND {_BND}))"
_RATES = f"""{CALLS}, j AS (SELECT c.svtype, EXISTS (SELECT 1 FROM calls p WHERE p.sample <> 'child' AND p.chrom = c.chrom AND p.svtype = c.svtype AND {_ANY}) AS hit FROM calls c WHERE c.sample = 'child'),
  s AS (SELECT coalesce(v.svtype, 'ALL') AS svtype, count(j.hit) AS total, count(*) FILTER (WHERE j.hit) AS matched FROM (VALUES ('DEL'), ('INS'), ('DUP'), ('INV'), ('BND')) v(svtype) LEFT JOIN j ON j.svtype = v.svtype GROUP BY ROLLUP (v.svtype)),
  r AS (SELECT svtype, total, matched, total - matched AS inconsistent, coalesce(round(100.0 * (total - matched) / nullif(total, 0), 6), 0.0) AS rate FROM s)"""


@query("agg_mdr", f"{_RATES} SELECT * FROM r")
def agg_mdr(spark, sf_dir):
    return T.discordance(*_split(cut(projection(spark, sf_dir, "calls"))))


@query("agg_type_counts", f"{TRIO} SELECT sample, " + ", ".join(f"count(*) FILTER (WHERE svtype = '{t}') AS {t.lower()}" for t in ("DEL", "INS", "DUP", "INV")) + " FROM trio GROUP BY 1")
def agg_type_counts(spark, sf_dir):
    wide = projection(spark, sf_dir, "trio").groupBy("sample").pivot("svtype", ["DEL", "INS", "DUP", "INV"]).agg(F.count("rec_ordinal"))
    return wide.select("sample", *[F.coalesce(t, F.lit(0).cast("bigint")).alias(t.lower()) for t in ("DEL", "INS", "DUP", "INV")])


_GT = f"""{CALLS}, hit AS (SELECT c.rec_ordinal, p.sample, p.gt, row_number() OVER (PARTITION BY c.rec_ordinal, p.sample ORDER BY
    CASE WHEN c.svtype IN ('INS', 'BND') THEN p.pos // 1000 ELSE greatest(floor((c.pos - 1000) / 1000000), floor((p.pos - 1000) / 1000000)) END, CASE WHEN c.svtype = 'BND' THEN p."end" // 1000 ELSE 0 END, p.rec_ordinal) AS k
    FROM calls c JOIN calls p ON p.chrom = c.chrom AND p.svtype = c.svtype AND {_ANY} WHERE c.sample = 'child' AND p.sample <> 'child')
  SELECT concat_ws(chr(9), c.chrom, c.pos, '.', 'N', '<' || c.svtype || '>', '.', 'PASS', 'SVTYPE=' || c.svtype || ';SVLEN=' || c.svlen, 'GT', coalesce(f.gt, './.'), coalesce(m.gt, './.'), c.gt) AS line
  FROM calls c LEFT JOIN hit f ON f.rec_ordinal = c.rec_ordinal AND f.k = 1 AND f.sample = 'father' LEFT JOIN hit m ON m.rec_ordinal = c.rec_ordinal AND m.k = 1 AND m.sample = 'mother' WHERE c.sample = 'child'
  UNION ALL SELECT '##source=calls' UNION ALL SELECT concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', 'father', 'mother', 'child') UNION ALL SELECT svtype || ' ' || count(*) FROM calls WHERE sample = 'child' GROUP BY svtype"""


@query("sink_trio_vcf", _GT)
def sink_trio_vcf(spark, sf_dir):
    """The committed file read back, and its counts by type."""
    rows, folder = cut(projection(spark, sf_dir, "calls")), scratch(spark, "trio")
    kind, fixed = F.col("svtype"), [F.lit(x) for x in (".", "N", ".", "PASS")]
    record = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), fixed[0], fixed[1], F.concat(F.lit("<"), kind, F.lit(">")), fixed[2], fixed[3], F.concat(F.lit("SVTYPE="), kind, F.lit(";SVLEN="), F.col("svlen").cast("string")))
    child, father, mother = (rows.filter(F.col("sample") == who) for who in ("child", "father", "mother"))
    head = spark.createDataFrame([(0, 0, "##source=calls")], "step int, rec_ordinal long, line string")
    counts = write_trio_file(head, child.withColumn("record", record), father, mother, folder, "trio.vcf")
    lines = spark.read.text(f"{folder}/trio.vcf").select(F.col("value").alias("line"))
    return lines.unionAll(spark.createDataFrame([(f"{t} {n}",) for t, n in counts.items() if n], "line string"))


@query("sink_mdr_report", f"""{_RATES} SELECT CAST(list_position(['DEL', 'INS', 'DUP', 'INV', 'BND', 'ALL'], svtype) AS INT) AS place,
  format('{{:<5}} {{:>9d}} {{:>12d}} {{:>9.2f}}', CASE svtype WHEN 'ALL' THEN 'Total' ELSE svtype END, total, inconsistent, CAST(rate AS DOUBLE)) AS line FROM r
  UNION ALL SELECT 0 AS place, format('{{:<5}} {{:>9}} {{:>12}} {{:>9}}', 'SV', 'TOTAL', 'INCONSISTENT', 'MDR(%)') AS line""")
def sink_mdr_report(spark, sf_dir):
    return mdr_report(T.discordance(*_split(cut(projection(spark, sf_dir, "calls")))))
