"""Queries through files: derived rows are written below the shared folder, and what a reader makes of them is the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svloom.functions import variants as V
from svloom.operators import support as U
from svloom.operators.cut import cut, scratch
from svloom.plans.calls import REFINE_SQL, predicted
from svloom.plans.registry import query
from svloom.plans.trios import ALT_SQL, KIND_SQL, number_sql, word_sql
from svloom.sources import readers, writers
from svloom.sources.array_store import read_arrays, write_arrays
from svloom.sources.fixtures import predictions, projection, with_ctes

SIG, TEXTS, CALLS, TRIO = with_ctes("sig"), with_ctes("texts"), with_ctes("calls"), with_ctes("trio")
WINDOWS = with_ctes("windows")
KEYS, REGION = ["contig", "region"], 1_000_000
_END = "CASE WHEN svtype = 'INS' THEN start ELSE start + svlen END"


def _text(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]).alias("value")


# ---------------------------------------------------------------- BED and VCF text
@query("scan_bed_labels", f"{SIG} SELECT contig, start, CASE WHEN svtype = 'INS' THEN start + 1 ELSE start + svlen END AS \"end\", svtype FROM sig")
def scan_bed_labels(spark, sf_dir):
    path = scratch(spark, "label-bed")
    projection(spark, sf_dir, "sig").select(_text("contig", "start", F.lit("."), F.col("start") + F.col("svlen"), "svtype")).write.text(path)
    return readers.read_label_bed(spark, path)


@query("scan_vcf_truth", f"{SIG} SELECT substr(contig, 4) AS contig, start, greatest({_END}, start + 1) AS stop, svtype FROM sig")
def scan_vcf_truth(spark, sf_dir):
    path, calls = scratch(spark, "truth-vcf"), projection(spark, sf_dir, "sig").withColumn("gt", F.lit("0/1"))
    contigs = calls.groupBy("contig").agg(F.max(F.col("start") + F.col("svlen")).alias("length")).withColumn("ord", F.substring("contig", 4, 9).cast("long"))
    writers.write_vcf(calls, contigs, path)
    return readers.read_truth_vcf(spark, path)


def _records(spark, sf_dir, path: str, compression: str) -> str:
    """Records with all kinds of INFO and ALT, as text."""
    rows = projection(spark, sf_dir, "texts")
    lines = rows.select(_text(F.concat(F.lit("chr"), F.col("id") % 7), F.col("id") * 2, F.lit("."), F.lit("N"), "alt", F.lit("."), F.lit("PASS"), "info", "format", "sample"))
    lines.write.option("compression", compression).text(path)
    return path


def _records_sql(kind: str, more: str = "") -> str:
    return f"""{TEXTS}, k AS (SELECT id, 'chr' || (id % 7) AS chrom, id * 2 AS pos, {kind} AS kind, {number_sql('END')} AS stop, {number_sql('SVLEN')} AS given, {word_sql('CHR2')} AS named, {ALT_SQL},
    string_split(sample, ':')[list_position(string_split(format, ':'), 'GT')] AS raw, list_position(string_split(format, ':'), 'GT') > 0 AS typed FROM texts)
    SELECT chrom, pos, kind AS svtype, CASE WHEN kind = 'BND' AND stop = 0 THEN pos2 ELSE stop END AS "end", CASE WHEN given = 0 AND stop >= pos THEN stop - pos + 1 ELSE given END AS svlen,
    CASE WHEN kind = 'BND' THEN coalesce(nullif(named, ''), chr2) END AS chr2, CASE WHEN kind = 'BND' THEN form END AS form{more} FROM k"""


_RECORD = ["chrom", "pos", "svtype", "end", "svlen", "chr2", "form"]


@query("scan_vcf_mdr", _records_sql(f"substr({word_sql('SVTYPE')}, 1, 3)"))
def scan_vcf_mdr(spark, sf_dir):
    return readers.read_vcf(spark, _records(spark, sf_dir, scratch(spark, "vcf"), "none")).select(*_RECORD)


@query("scan_vcf_mier", _records_sql(KIND_SQL, ", CASE WHEN NOT coalesce(typed, false) OR raw IS NULL OR raw IN ('', '.', './.', '.|.') THEN '1/1' ELSE replace(raw, '|', '/') END AS gt"))
def scan_vcf_mier(spark, sf_dir):
    return readers.read_vcf(spark, _records(spark, sf_dir, scratch(spark, "vcf-gz"), "gzip"), True).select(*_RECORD, "gt")


@query("scan_sample_dir", f"""{CALLS} SELECT sample, chrom, pos, svtype, CASE WHEN svtype = 'INS' THEN pos ELSE "end" END AS "end", svlen, chr2, form, CASE gt WHEN './.' THEN '1/1' ELSE gt END AS gt FROM calls""")
def scan_sample_dir(spark, sf_dir):
    rows, folder = projection(spark, sf_dir, "calls"), scratch(spark, "samples")
    mate = F.concat(F.col("chr2"), F.lit(":"), F.col("end"))
    alt = F.when(F.col("form").startswith("N"), F.concat(F.substring("form", 1, 2), mate, F.substring("form", 3, 1))).otherwise(F.concat(F.substring("form", 1, 1), mate, F.substring("form", 2, 2)))
    breakend = _text("chrom", "pos", F.lit("."), F.lit("N"), alt, F.lit("."), F.lit("PASS"), F.lit("SVTYPE=TRA;"), F.lit("GT"), "gt")
    line = F.when(F.col("svtype") == "BND", breakend).otherwise(V.vcf_line(*[F.col(c) for c in ("chrom", "pos", "svlen", "svtype", "gt")]))
    kind = F.when(F.col("svtype") == "BND", "tra").otherwise(F.lower("svtype"))
    rows.select(line.alias("value"), F.concat("sample", F.lit("_"), kind, F.lit(".vcf")).alias("file")).write.partitionBy("file").text(folder)
    out = None
    for sample in ("father", "mother", "child"):
        found = readers.read_sample(spark, folder, f"file={sample}", True).select(F.lit(sample).alias("sample"), *_RECORD, "gt")
        out = found if out is None else out.unionByName(found)
    return out


# ---------------------------------------------------------------- call files
#: Calls of all types, some of a type that no file has and some before the contig.
_MIXED = f"""{CALLS}, c AS (SELECT rec_ordinal, chrom, CASE WHEN rec_ordinal % 89 = 0 THEN -pos ELSE pos END AS pos, svlen, "end", CASE WHEN rec_ordinal % 97 = 0 THEN 'CNV' ELSE svtype END AS svtype, chr2, form, gt FROM calls),
  o AS (SELECT *, CASE WHEN svtype IN ('INS', 'DEL', 'DUP', 'INV') THEN CASE WHEN pos >= 0 AND (svtype = 'INS' OR pos + svlen >= 0) THEN '' ELSE 'bad_place' END WHEN svtype = 'BND' THEN CASE WHEN pos >= 0 THEN '' ELSE 'bad_place' END ELSE 'unknown_type' END AS fault,
    CASE WHEN form LIKE 'N%' THEN 'fwd' ELSE 'rev' END AS d1, CASE WHEN substr(replace(form, 'N', ''), 1, 1) = '[' THEN 'fwd' ELSE 'rev' END AS d2, chr2 || ':' || "end" AS t, chrom || ':' || pos AS h FROM c),
  l AS (SELECT lower(svtype) AS kind, gt, concat_ws(chr(9), chrom, pos, '.', 'N', '<' || svtype || '>', '.', 'PASS', 'SVLEN=' || svlen || ';SVTYPE=' || svtype || ';END=' || CASE WHEN svtype = 'INS' THEN pos ELSE pos + svlen END || ';', 'GT') AS line FROM o WHERE fault = '' AND svtype <> 'BND'
    UNION ALL SELECT 'tra', gt, concat_ws(chr(9), chrom, pos, '.', 'N', CASE WHEN d1 = 'fwd' AND d2 = 'fwd' THEN 'N[' || t || '[' WHEN d1 = 'fwd' THEN 'N]' || t || ']' WHEN d2 = 'fwd' THEN ']' || t || ']N' ELSE '[' || t || '[N' END, '.', 'PASS', 'SVTYPE=BND;', 'GT') FROM o WHERE fault = '' AND svtype = 'BND'
    UNION ALL SELECT 'tra', gt, concat_ws(chr(9), chr2, "end", '.', 'N', CASE WHEN d1 = 'fwd' AND d2 = 'fwd' THEN ']' || h || ']N' WHEN d1 = 'fwd' THEN '[' || h || '[N' WHEN d2 = 'fwd' THEN 'N[' || h || '[' ELSE 'N]' || h || ']' END, '.', 'PASS', 'SVTYPE=BND;', 'GT') FROM o WHERE fault = '' AND svtype = 'BND'),
  head AS (SELECT '##fileformat=VCFv4.2' AS line UNION ALL SELECT '{writers.HEADER_TOP[1]}' UNION ALL SELECT '##contig=<ID=' || chrom || ',length=' || max("end") || '>' FROM calls GROUP BY chrom UNION ALL SELECT unnest([{", ".join("'" + x + "'" for x in writers.HEADER_END)}])),
  left_out AS (SELECT CASE fault WHEN '' THEN 'written' ELSE fault END AS fault, sum(CASE WHEN fault = '' AND svtype = 'BND' THEN 2 ELSE 1 END) AS n FROM o GROUP BY 1)"""


def _mixed(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, breakends and contigs."""
    every = projection(spark, sf_dir, "calls")
    rows = every.withColumn("start", F.when(F.col("rec_ordinal") % 89 == 0, -F.col("pos")).otherwise(F.col("pos"))).withColumn("svtype", F.when(F.col("rec_ordinal") % 97 == 0, "CNV").otherwise(F.col("svtype"))).withColumnRenamed("chrom", "contig")
    second = F.when(F.substring(F.replace("form", F.lit("N")), 1, 1) == "[", "fwd").otherwise("rev")
    bnd = rows.filter("svtype = 'BND'").select("contig", "start", F.when(F.col("form").startswith("N"), "fwd").otherwise("rev").alias("dir1"), F.col("chr2").alias("contig2"), "end", second.alias("dir2"), "gt")
    contigs = every.groupBy(F.col("chrom").alias("contig")).agg(F.max("end").alias("length")).withColumn("ord", F.substring("contig", 4, 9).cast("long"))
    return rows.filter("svtype <> 'BND'").select("contig", "start", "svlen", "svtype", "gt"), bnd, contigs


def _read_back(spark, folder: str, counts: dict[str, int]) -> DataFrame:
    """file, line of all files in folder, and a line for each count."""
    lines = spark.read.text(f"{folder}/*.vcf").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("line"))
    return lines.unionByName(spark.createDataFrame([("counts", f"{k} {n}") for k, n in counts.items() if n], "file string, line string"))


@query("sink_vcf", f"{_MIXED} SELECT 'calls.vcf' AS file, line FROM head UNION ALL SELECT 'calls.vcf', line || chr(9) || gt FROM l UNION ALL SELECT 'counts', fault || ' ' || n FROM left_out")
def sink_vcf(spark, sf_dir):
    """One committed file with all types, and what was left out of it."""
    folder, (calls, bnd, contigs) = scratch(spark, "vcf-file"), _mixed(spark, sf_dir)
    return _read_back(spark, folder, writers.write_vcf_file(calls, contigs, folder, "calls.vcf", bnd))


@query("sink_vcf_split_by_type", f"""{_MIXED}, f AS (SELECT unnest(['all', 'del', 'ins', 'dup', 'inv', 'tra']) AS kind) SELECT 's_' || kind || '.vcf' AS file, line FROM f, head UNION ALL SELECT 's_all.vcf', line || chr(9) || gt FROM l
  UNION ALL SELECT 's_' || kind || '.vcf', line || chr(9) || CASE WHEN kind = 'tra' THEN './.' ELSE gt END FROM l UNION ALL SELECT 'counts', fault || ' ' || n FROM left_out""")
def sink_vcf_split_by_type(spark, sf_dir):
    """Six files of one pass and one commit, read back."""
    folder, (calls, bnd, contigs) = scratch(spark, "vcf-files"), _mixed(spark, sf_dir)
    return _read_back(spark, folder, writers.write_call_files(calls, bnd, contigs, folder, "s"))


# ---------------------------------------------------------------- stores
def _windows(spark, sf_dir) -> DataFrame:
    return predictions(spark, sf_dir).withColumn("region", F.floor(F.col("window_start") / REGION))


def _stored(spark, path: str, *columns: str) -> DataFrame:
    return readers.read_store(spark, path).select("contig", F.col("region").cast("long").alias("region"), "window_start", *columns)


_HALVES = "(window_start // 2000 * (k + 1)) % 512 / 8.0"


@query("scan_npy_store", f"""{WINDOWS}, r AS (SELECT 'r' || (window_start // {REGION} % 7) || '/' || contig || '_' || (window_start // {REGION}) AS stem, row_number() OVER (PARTITION BY contig, window_start // {REGION} ORDER BY window_start) - 1 AS row, window_start, CAST(prob >= 0.03 AS INT) AS label FROM windows)
  SELECT stem, row, CAST(window_start AS INT) AS first, CAST(window_start + 2000 AS INT) AS last, label, k AS channel, CAST({_HALVES} AS DOUBLE) AS value FROM r, generate_series(0, 3) t(k)""")
def scan_npy_store(spark, sf_dir):
    """Feature, index and label arrays, written by tasks and read back by ranges of rows; windows beyond the whole numbers of INT are indexed by BIGINT."""
    path, at = scratch(spark, "arrays"), F.col("window_start")
    windows = cut(_windows(spark, sf_dir))
    far = windows.agg(F.max("window_start")).first()[0] or 0
    kind = "int" if far + 2000 < 1 << 31 else "bigint"
    rows = windows.withColumn("stem", F.concat(F.lit("r"), F.col("region") % 7, F.lit("/"), "contig", F.lit("_"), "region"))
    values = F.array(*[F.floor(at / 2000) * (k + 1) % 512 / 8.0 for k in range(4)])
    rows = rows.select("stem", "window_start", F.array(at.cast(kind), (at + 2000).cast(kind)).alias("index"), values.alias("features"), (F.col("prob") >= 0.03).cast("int").alias("label"))
    write_arrays(rows, path, ["window_start"])
    found = read_arrays(spark, path, kind).select("stem", "row", F.get("index", 0).alias("first"), F.get("index", 1).alias("last"), "label", F.posexplode("features").alias("channel", "value"))
    return found.withColumn("channel", F.col("channel").cast("long")).withColumn("value", F.col("value").cast("double"))


@query("scan_store_count", f"{WINDOWS} SELECT count(*) AS samples FROM windows")
def scan_store_count(spark, sf_dir):
    path = scratch(spark, "counted")
    writers.write_store(_windows(spark, sf_dir), path, KEYS)
    return readers.count_store(spark, path)


@query("scan_store_discovery", f"{WINDOWS} SELECT DISTINCT 'stem=' || contig || '_' || (window_start // {REGION}) AS store FROM windows")
def scan_store_discovery(spark, sf_dir):
    path, stem = scratch(spark, "stores"), F.concat_ws("_", "contig", F.col("region").cast("string"))
    rows = _windows(spark, sf_dir).withColumn("stem", F.explode(F.array(*[F.concat(stem, F.lit(x)) for x in ("", "_index", "_label", "_predict")])))
    writers.write_store(rows.select("contig", "stem", "window_start", "prob"), path, ["contig", "stem"])
    return readers.find_stores(spark, path)


@query("sink_feature_store", f"{WINDOWS} SELECT contig, window_start // {REGION} AS region, window_start, CASE WHEN window_start // {REGION} % 2 = 0 THEN -1.0 ELSE CAST(prob AS DOUBLE) END AS prob FROM windows")
def sink_feature_store(spark, sf_dir):
    """Even regions are there already and stay as they are; the others are added."""
    path, rows = scratch(spark, "resumed"), _windows(spark, sf_dir)
    rows = rows.withColumn("prob", F.col("prob").cast("double"))
    writers.write_store(rows.filter("region % 2 = 0").withColumn("prob", F.lit(-1.0)), path, KEYS)
    writers.write_store(rows, path, KEYS)
    return _stored(spark, path, "prob")


@query("sink_labels", f"{WINDOWS} SELECT contig, window_start // {REGION} AS region, window_start, CAST(prob >= 0.5 AS INT) AS label FROM windows")
def sink_labels(spark, sf_dir):
    """Labels that are there are not written over."""
    path, rows = scratch(spark, "labels"), _windows(spark, sf_dir)
    label = (F.col("prob") >= 0.5).cast("byte")
    writers.write_store(rows.withColumn("label", label).drop("prob"), path, KEYS)
    writers.write_store(rows.withColumn("label", (1 - label).cast("byte")).drop("prob"), path, KEYS)
    return _stored(spark, path, "label").withColumn("label", F.col("label").cast("int"))


@query("sink_predictions", f"{WINDOWS} SELECT contig, window_start // {REGION} AS region, window_start, CAST(prob AS DOUBLE) AS prob FROM windows")
def sink_predictions(spark, sf_dir):
    """Predictions of a second run take the place of the first one's."""
    path, rows = scratch(spark, "predictions"), _windows(spark, sf_dir).withColumn("prob", F.col("prob").cast("double"))
    writers.write_store(rows.withColumn("prob", F.col("prob") + 1), path, KEYS, overwrite=True)
    writers.write_store(rows, path, KEYS, overwrite=True)
    return _stored(spark, path, "prob")


# ---------------------------------------------------------------- reports
@query("sink_refine_tsv", REFINE_SQL.replace("{types}", "['DEL', 'INS']"))
def sink_refine_tsv(spark, sf_dir):
    path = scratch(spark, "refined")
    refined = U.refine(predicted(spark, sf_dir), projection(spark, sf_dir, "reads"), ["id"], ("DEL", "INS"))
    writers.write_refine_report(refined.select("id", "contig", "svtype", "start", "svlen", "evidence", "new_start", "new_len", "reason"), path)
    rows = spark.read.option("sep", "\t").option("header", True).schema("id long, contig string, svtype string, start long, svlen long, evidence long, new_start long, new_len long, reason string").csv(path)
    return rows.select("id", "evidence", "new_start", "new_len", "reason")


@query("sink_debug_snapshot", f"{CALLS} SELECT CASE svtype WHEN 'BND' THEN 'breakends' ELSE 'calls' END AS stored, sample, rec_ordinal, pos FROM calls")
def sink_debug_snapshot(spark, sf_dir):
    path, rows = scratch(spark, "snapshot"), projection(spark, sf_dir, "calls")
    writers.write_snapshot(path, calls=rows.filter("svtype <> 'BND'"), breakends=rows.filter("svtype = 'BND'"))
    parts = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("stored"), "sample", "rec_ordinal", "pos") for name in ("calls", "breakends")]
    return parts[0].unionByName(parts[1])


@query("distinct_reads", f"{SIG} SELECT contig, svtype, start // 2000 AS bin, count(DISTINCT read_name) AS n_reads FROM sig GROUP BY ALL")
def distinct_reads(spark, sf_dir):
    return projection(spark, sf_dir, "sig").groupBy("contig", "svtype", F.floor(F.col("start") / 2000).alias("bin")).agg(F.countDistinct("read_name").alias("n_reads"))
