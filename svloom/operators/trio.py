"""Child calls against parents' calls: matches, first matches, lines of a trio and discordance.

Rows have rec_ordinal, chrom, pos, end, svlen, svtype and gt, breakends also chr2 and form. Interval types share one join with
the type among its keys, so there are three joins whatever the number of types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svloom.functions.variants import len_ok
from svloom.operators.ranges import band_join

OFFSET, BIAS, BIN = 1000, 0.7, 1_000_000
TYPES = ("DEL", "INS", "DUP", "INV", "BND")
INTERVALS = ("DEL", "DUP", "INV")


def _interval_pairs(child: DataFrame, parent: DataFrame, offset: int, bias: float, how: str) -> DataFrame:
    """Pairs of one type; parent intervals are widened by offset on both sides; the overlap is closed."""
    p = parent.withColumnsRenamed({c: f"p_{c}" for c in parent.columns})
    span = lambda lo, hi: F.sequence(F.floor(lo / BIN), F.floor(hi / BIN))
    p = p.withColumn("__plo", F.floor((F.col("p_pos") - offset) / BIN)).withColumn("__pb", F.explode(span(F.col("p_pos") - offset, F.col("p_end") + offset)))
    c = child.withColumn("__lo", F.floor((F.col("pos") - offset) / BIN)).withColumn("__b", F.explode(span(F.col("pos") - offset, F.col("end") + offset)))
    meets = F.greatest(F.col("p_pos") - offset, F.col("pos")) <= F.least(F.col("p_end") + offset, F.col("end"))
    on = (F.col("__b") == F.col("__pb")) & (F.col("chrom") == F.col("p_chrom")) & (F.col("svtype") == F.col("p_svtype")) & meets & len_ok(F.col("p_svlen"), F.col("svlen"), bias)
    if how == "left_semi":
        return c.join(p, on, "left_semi").select(*child.columns).dropDuplicates(["rec_ordinal"])
    first = F.col("__b") == F.greatest("__lo", "__plo")
    return c.join(p, on & first).withColumn("bucket", F.col("__b")).drop("__lo", "__b", "__plo", "__pb")


def _joined(child: DataFrame, parents: DataFrame, types: tuple, offset: int, bias: float, how: str) -> list[DataFrame]:
    """The joins for types; inner pairs have bucket and bucket2, the order in which matches of a child row count."""
    of = lambda rows, kinds: rows.filter(F.col("svtype").isin(*kinds))
    width, out = max(offset, 1), []
    if "INS" in types:
        out.append(band_join(of(child, ["INS"]), of(parents, ["INS"]), ["chrom"], "pos", "pos", offset, len_ok(F.col("p_svlen"), F.col("svlen"), bias), how))
    if "BND" in types:
        near = F.abs(F.col("end") - F.col("p_end")) <= offset
        out.append(band_join(of(child, ["BND"]), of(parents, ["BND"]), ["chrom", "chr2", "form"], "pos", "pos", offset, near, how))
    spans = [t for t in INTERVALS if t in types]
    if spans:
        out.append(_interval_pairs(of(child, spans), of(parents, spans), offset, bias, how))
    if how == "left_semi":
        return out
    at = lambda name: F.floor(F.col(name) / width)
    zero = F.lit(0).cast("bigint")
    return [rows.withColumn("bucket2", zero) if "bucket" in rows.columns else rows.withColumn("bucket", at("p_pos")).withColumn("bucket2", F.when(F.col("svtype") == "BND", at("p_end")).otherwise(zero)) for rows in out]


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def matches(child: DataFrame, parents: DataFrame, *types: str, offset: int = OFFSET, bias: float = BIAS) -> DataFrame:
    """Child rows of the types (all if none is named) with a matching parent row."""
    return _union(_joined(child, parents, types or TYPES, offset, bias, "left_semi"))


def first_match_gt(child: DataFrame, parents: DataFrame, *types: str, offset: int = OFFSET, bias: float = BIAS) -> DataFrame:
    """rec_ordinal, parent_gt of the first matching parent row by bucket and order in the file, ./. without one."""
    types = types or TYPES
    best = _first(child, parents.withColumn("parent", F.lit("parent")), types, offset, bias).select("rec_ordinal", F.col("gts")["parent"].alias("parent_gt"))
    mine = child.filter(F.col("svtype").isin(*types)).select("rec_ordinal")
    return mine.join(best, "rec_ordinal", "left").select("rec_ordinal", F.coalesce("parent_gt", F.lit("./.")).alias("parent_gt"))


def _first(child: DataFrame, parents: DataFrame, types: tuple, offset: int, bias: float) -> DataFrame:
    """rec_ordinal, gts: the genotype of the first match by the column parent; the smallest key is kept before the shuffle."""
    pairs = _union([rows.select("rec_ordinal", "p_parent", "bucket", "bucket2", "p_rec_ordinal", "p_gt") for rows in _joined(child, parents, types, offset, bias, "inner")])
    best = pairs.groupBy("rec_ordinal", "p_parent").agg(F.min_by("p_gt", F.struct("bucket", "bucket2", "p_rec_ordinal")).alias("gt"))
    return best.groupBy("rec_ordinal").agg(F.map_from_entries(F.collect_list(F.struct("p_parent", "gt"))).alias("gts"))


def trio_lines(child: DataFrame, father: DataFrame, mother: DataFrame, offset: int = OFFSET, bias: float = BIAS) -> DataFrame:
    """rec_ordinal, svtype, line: a VCF line of each child row with the genotypes of father, mother and child.

    child also has record, the first eight columns of its line. Both parents are matched in the same joins.
    """
    columns = ["rec_ordinal", "chrom", "pos", "end", "svlen", "svtype", "chr2", "form", "gt"]
    parents = father.select(*columns, F.lit("father").alias("parent")).unionAll(mother.select(*columns, F.lit("mother").alias("parent")))
    mine = child.filter(F.col("svtype").isin(*TYPES))
    found = _first(mine.select(*columns), parents, TYPES, offset, bias)
    gt = lambda name: F.coalesce(F.col("gts")[name], F.lit("./."))
    return mine.join(found, "rec_ordinal", "left").select("rec_ordinal", "svtype", F.concat_ws("\t", "record", F.lit("GT"), gt("father"), gt("mother"), "gt").alias("line"))


def discordance(child: DataFrame, parents: DataFrame, types=TYPES, offset: int = OFFSET, bias: float = BIAS) -> DataFrame:
    """svtype, total, matched, inconsistent, rate (percent) of each of the types, found or not, and of ALL."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    rows = child.filter(F.col("svtype").isin(*types)).select("svtype", one.alias("total"), none.alias("matched"))
    rows = rows.unionAll(matches(child, parents, *types, offset=offset, bias=bias).select("svtype", none, one))
    rows = rows.unionAll(child.sparkSession.createDataFrame([(t, 0, 0) for t in types], "svtype string, total long, matched long"))
    sums = rows.rollup("svtype").agg(F.sum("total").alias("total"), F.sum("matched").alias("matched"))
    lost = F.col("total") - F.col("matched")
    return sums.select(F.coalesce("svtype", F.lit("ALL")).alias("svtype"), "total", "matched", lost.alias("inconsistent"), F.coalesce(F.round(F.try_divide(100.0 * lost, F.col("total")), 6), F.lit(0.0)).alias("rate"))
