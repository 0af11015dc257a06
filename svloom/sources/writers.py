"""Sinks: VCF text, tables of windows that can be resumed, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from svloom.functions.variants import bnd_lines, vcf_line
from svloom.operators.cut import cut, drop, file_system
from svloom.operators.trio import TYPES, trio_lines
from svloom.sources.committed import write_lines
from svloom.sources.config import normal_spec
from svloom.sources.readers import REPLACES, STORE_KEY, WRITE, read_store, read_vcf, store_writes

#: Contigs up to so many are broadcast.
BROADCAST_ROWS = 1_000_000
#: Fixed text of a VCF header.
HEADER_TOP = ("##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="All filters passed">')
HEADER_END = (
    '##INFO=<ID=END,Number=1,Type=Integer,Description="End position of the variant">', '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of structural variant">',
    '##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="Length of the variant">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE",
)
#: Fixed column names of a VCF.
COLUMNS = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


def header_lines(contigs: DataFrame) -> DataFrame:
    """ordinal, line of a header; contigs has contig, length, ord."""
    spark = contigs.sparkSession
    top = spark.createDataFrame([(k, line) for k, line in enumerate(HEADER_TOP)], "ordinal long, line string")
    middle = contigs.select((F.col("ord") + 1000).cast("long").alias("ordinal"), F.format_string("##contig=<ID=%s,length=%d>", "contig", "length").alias("line"))
    end = spark.createDataFrame([(1 << 40 | k, line) for k, line in enumerate(HEADER_END)], "ordinal long, line string")
    return top.unionAll(middle).unionAll(end)


def _ordered(lines: DataFrame, order: DataFrame) -> DataFrame:
    """lines with the ordinal of their contig, null where it has none.

    A shuffle by contig would give a task all lines of one, so few contigs are broadcast.
    """
    order = cut(order)
    return lines.join(F.broadcast(order) if order.count() <= BROADCAST_ROWS else order, "contig", "left")


def write_vcf(calls: DataFrame, contigs: DataFrame, path: str) -> None:
    """Header and data lines in text parts whose order by name is the file's; calls has contig, start, svlen, svtype, gt.

    Rows of unknown type or with negative coordinates give no line. Lines are sorted by ranges: few calls make one part.
    """
    lines = calls.select("contig", "start", vcf_line(*[F.col(c) for c in ("contig", "start", "svlen", "svtype", "gt")]).alias("line")).filter("line is not null")
    order = contigs.select("contig", (F.lit(1 << 41) + F.col("ord")).alias("ordinal"))
    body = _ordered(lines, order).select(F.coalesce("ordinal", F.lit(1 << 42)).alias("ordinal"), "start", "line")
    whole = header_lines(contigs).select("ordinal", F.lit(0).cast("long").alias("start"), "line").unionByName(body)
    whole.orderBy("ordinal", "start", "line").select("line").write.mode("overwrite").text(path)


#: The files of a call set, by type.
FILE_OF = {"DEL": "del", "INS": "ins", "DUP": "dup", "INV": "inv", "BND": "tra"}


def _placed_lines(calls: DataFrame, breakends: DataFrame | None) -> DataFrame:
    """kind, contig, start, line, plain (the line with an open genotype), fault: a row for each line, or for each call that gives none."""
    line = vcf_line(*[F.col(c) for c in ("contig", "start", "svlen", "svtype", "gt")])
    known = F.coalesce(F.col("svtype").isin("INS", "DEL", "INV", "DUP"), F.lit(False))
    fault = F.when(~known, "unknown_type").when(line.isNull(), "bad_place")
    rows = calls.select(F.when(known, F.col("svtype")).alias("kind"), "contig", "start", line.alias("line"), F.lit(None).cast("string").alias("plain"), fault.alias("fault"))
    if breakends is None:
        return rows

    def lines(gt: Column) -> Column:
        return bnd_lines(*[F.col(c) for c in ("contig", "start", "dir1", "contig2", "end", "dir2")], gt)

    whole = F.coalesce((F.col("start") >= 0) & (F.col("end") >= 0) & F.col("contig").isNotNull() & F.col("contig2").isNotNull(), F.lit(False))
    ends = F.array(F.struct("contig", F.col("start").cast("long").alias("start")), F.struct(F.col("contig2").alias("contig"), F.col("end").cast("long").alias("start")))
    pairs = breakends.filter(whole).select(F.explode(F.arrays_zip(ends.alias("e"), lines(F.col("gt")).alias("line"), lines(F.lit("./.")).alias("plain"))).alias("m"))
    broken = breakends.filter(~whole).select(F.lit(None).cast("string").alias("kind"), "contig", "start", F.lit(None).cast("string").alias("line"), F.lit(None).cast("string").alias("plain"), F.lit("bad_place").alias("fault"))
    return rows.unionByName(pairs.select(F.lit("BND").alias("kind"), "m.e.contig", "m.e.start", "m.line", "m.plain", F.lit(None).cast("string").alias("fault"))).unionByName(broken)


def _write_files(calls: DataFrame, breakends: DataFrame | None, contigs: DataFrame, folder: str, files: list[str], file_of: Column) -> dict[str, int]:
    seen = Observation("lines")
    counts = [F.count_if(F.col("fault").isNull()).alias("written"), *[F.count_if(F.coalesce(F.col("fault") == x, F.lit(False))).alias(x) for x in ("unknown_type", "bad_place")]]
    placed = cut(_placed_lines(calls, breakends).observe(seen, *counts))
    place = contigs.select("contig", (F.lit(1 << 41) + F.col("ord")).alias("ordinal"))
    body = _ordered(placed.filter("fault is null"), place).withColumn("f", F.explode(file_of))
    body = body.select("f.file", F.coalesce("ordinal", F.lit(1 << 42)).alias("ordinal"), F.col("start").cast("long").alias("start"), "f.line")
    head = header_lines(contigs).select(F.explode(F.array(*map(F.lit, files))).alias("file"), "ordinal", F.lit(0).cast("long").alias("start"), "line")
    order = ["file", "ordinal", "start", "line"]
    write_lines(head.unionByName(body).repartitionByRange(*order).sortWithinPartitions(*order), folder)
    drop(placed)
    return seen.get


def write_vcf_file(calls: DataFrame, contigs: DataFrame, folder: str, name: str, breakends: DataFrame | None = None) -> dict[str, int]:
    """One VCF file in folder, in whole or not at all: header, then the lines by contig and place, both mates of each breakend.

    calls: contig, start, svlen, svtype, gt; breakends: contig, start, dir1, contig2, end, dir2, gt. The counts of lines written and of calls
    left out (unknown_type; bad_place: negative or none) are returned.
    """
    return _write_files(calls, breakends, contigs, folder, [name], F.array(F.struct(F.lit(name).alias("file"), "line")))


def write_call_files(calls: DataFrame, breakends: DataFrame, contigs: DataFrame, folder: str, name: str) -> dict[str, int]:
    """<name>_all.vcf and one file a type in one pass and one commit; breakends have an open genotype in their own file.

    Where it fails, the tables stand below <folder>/<name>_debug.
    """
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in FILE_OF.items() for x in pair]), F.col("kind"))
    files = [f"{name}_{x}.vcf" for x in ("all", *FILE_OF.values())]
    both = F.array(F.struct(F.lit(files[0]).alias("file"), "line"), F.struct(F.concat(F.lit(f"{name}_"), kind, F.lit(".vcf")).alias("file"), F.coalesce("plain", "line").alias("line")))
    try:
        return _write_files(calls, breakends, contigs, folder, files, both)
    except Exception:
        write_snapshot(f"{folder}/{name}_debug", calls=calls, breakends=breakends, contigs=contigs)
        raise


def _trio_title(spark: SparkSession, names: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(1, 0, "\t".join((*COLUMNS, *names)))], "step int, rec_ordinal long, line string")


def _trio_head(spark: SparkSession, child: str) -> DataFrame:
    """The header lines of the child's own file."""
    return spark.read.text(child).withColumn("rec_ordinal", F.monotonically_increasing_id()).filter("value like '##%'").select(F.lit(0).alias("step"), "rec_ordinal", F.col("value").alias("line"))


def write_trio_vcf(child: str, father: str, mother: str, path: str, spark: SparkSession, names: tuple[str, str, str] = ("father", "mother", "child")) -> None:
    """The child's VCF with the genotypes of father, mother and child, in parts as write_vcf's.

    Header lines and the first eight columns are the child's own; records of other types are left out.
    """
    rows = trio_lines(*[read_vcf(spark, p, True) for p in (child, father, mother)]).select(F.lit(2).alias("step"), "rec_ordinal", "line")
    _trio_head(spark, child).unionAll(_trio_title(spark, names)).unionAll(rows).orderBy("step", "rec_ordinal").select("line").write.mode("overwrite").text(path)


def write_trio_file(head: DataFrame, child: DataFrame, father: DataFrame, mother: DataFrame, folder: str, name: str, names: tuple[str, str, str] = ("father", "mother", "child")) -> dict[str, int]:
    """One trio VCF in folder, in whole or not at all; the number of lines of each type is returned.

    head: step (0), rec_ordinal, line; child, father and mother as read_vcf gives them.
    """
    rows = cut(trio_lines(child, father, mother))
    lines = head.unionByName(_trio_title(child.sparkSession, names)).unionByName(rows.select(F.lit(2).alias("step"), "rec_ordinal", "line"))
    write_lines(lines.repartitionByRange("step", "rec_ordinal").sortWithinPartitions("step", "rec_ordinal").select(F.lit(name).alias("file"), "line"), folder)
    found = {r.svtype: r.n for r in rows.groupBy("svtype").agg(F.count("*").alias("n")).collect()}
    drop(rows)
    return {t: found.get(t, 0) for t in TYPES}


def write_trios(platforms: dict[str, tuple[str, str, str]], folder: str, spark: SparkSession) -> None:
    """<platform>_trio.vcf for the files (child, father, mother) of each platform, and trio_vcf_manifest.tsv with the counts by type."""
    rows = ["\t".join(("platform", "trio_vcf", *TYPES))]
    for platform, paths in platforms.items():
        name = f"{platform}_trio.vcf"
        counts = write_trio_file(_trio_head(spark, paths[0]), *[read_vcf(spark, p, True) for p in paths], folder, name)
        rows.append("\t".join((platform, f"{folder}/{name}", *[str(counts[t]) for t in TYPES])))
    manifest = spark.createDataFrame([("trio_vcf_manifest.tsv", x) for x in rows], "file string, line string").coalesce(1)
    write_lines(manifest, folder)


def write_snapshot(path: str, **tables: DataFrame) -> None:
    """Tables as they stand before the last step (calls, breakends, contigs, say), each in its folder below path, to look into later."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def write_store(windows: DataFrame, path: str, keys: list[str], overwrite: bool = False, spec: dict | None = None) -> None:
    """Windows by contig and region; regions that are there already are left out, or with overwrite replaced.

    A write is a folder of few files with the rows of a region together, whatever the number of regions; keys are columns, marked in the
    footers. Readers take a region from its newest write (readers.read_store), and a write that has no newest region any more is deleted. So
    stores are few files, and nothing is renamed or listed for each region.
    spec: the specification of the features, kept as metadata of their column in every file's footer.
    """
    spark = windows.sparkSession
    if spec is not None:
        windows = windows.withMetadata("features", {"feature_spec": json.dumps(normal_spec(spec))})
    writes = store_writes(spark, path)
    if writes and not overwrite:
        windows = windows.join(read_store(spark, path).select(*keys).distinct(), keys, "left_anti")
    for place, key in enumerate(keys, 1):
        windows = windows.withMetadata(key, {STORE_KEY: place})
    folder = f"{path}/{WRITE}={max(writes, default=-1) + 1}/{REPLACES}={int(overwrite)}"
    windows.repartition(*keys).sortWithinPartitions(*keys).write.mode("append").parquet(folder)
    if writes and overwrite:
        newest = spark.read.parquet(path).groupBy(*keys).agg(F.max(WRITE).alias(WRITE))
        live = {r[WRITE] for r in newest.select(WRITE).distinct().collect()}
        for n in set(writes) - live:
            fs, at = file_system(spark, f"{path}/{WRITE}={n}")
            fs.delete(at, True)


def write_refine_report(summary: DataFrame, path: str) -> bool:
    """The refinement summary as tab-separated text; nothing is written for an empty one."""
    if summary.isEmpty():
        return False
    summary.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    return True


def mdr_report(table: DataFrame) -> DataFrame:
    """place, line: a title, a fixed-width line for each type of a discordance table, and the total."""
    spark = table.sparkSession
    title = spark.createDataFrame([(0, f"{'SV':<5} {'TOTAL':>9} {'INCONSISTENT':>12} {'MDR(%)':>9}")], "place int, line string")
    place = F.array_position(F.lit([*TYPES, "ALL"]), F.col("svtype")).cast("int")
    shown = F.when(F.col("svtype") == "ALL", "Total").otherwise(F.col("svtype"))
    return title.unionAll(table.select(place.alias("place"), F.format_string("%-5s %9d %12d %9.2f", shown, "total", "inconsistent", "rate").alias("line")))


def feature_config(window: int, channels: list[str], dtype: str = "float") -> str:
    """The JSON document that stands beside a feature store."""
    return json.dumps({"window_size": window, "n_channels": len(channels), "channels": channels, "dtype": dtype}, indent=1)
