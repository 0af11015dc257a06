"""Column expressions over alignment records: flags, CIGAR strings, split-alignment tags, quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SAM flag bits.
UNMAPPED, SECONDARY, DUPLICATE, SUPPLEMENTARY = 4, 256, 1024, 2048


def flag_class(flag: Column) -> Column:
    """1 forward, 2 reverse, 3 and 4 their supplementary forms, 0 for any other flag."""
    return F.when(flag == 0, 1).when(flag == 16, 2).when(flag == 2048, 3).when(flag == 2064, 4).otherwise(0)


def strand_of_flag(flag: Column) -> Column:
    """Even classes are "reverse"; after the primary filter only flag 0 is forward."""
    return F.when(flag_class(flag) % 2 == 0, "reverse").otherwise("forward")


def is_primary(flag: Column, keep_duplicates: bool) -> Column:
    bits = UNMAPPED | SECONDARY | SUPPLEMENTARY | (0 if keep_duplicates else DUPLICATE)
    return flag.bitwiseAND(F.lit(bits)) == 0


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n: bigint, op: string>> of a CIGAR string."""
    lengths = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1)), lambda x: x.cast("bigint"))
    return F.arrays_zip(lengths.alias("n"), F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2)).alias("op"))


def op_sum(ops: Column, kinds: str) -> Column:
    """Sum of the lengths of the ops of these kinds."""
    mine = F.filter(ops, lambda x: x["op"].isin(*kinds))
    return F.aggregate(mine, F.lit(0).cast("bigint"), lambda total, x: total + x["n"])


def leading_clip(cigar: Column) -> Column:
    """Sum of the S and H ops before the first other op."""
    return op_sum(cigar_ops(F.regexp_extract(cigar, r"^((?:\d+[SH])*)", 1)), "SH")


def cigar_span(ref_start: Column, cigar: Column) -> Column:
    """struct(ref_start, ref_end, read_start, read_end) of an alignment given as a CIGAR string."""
    ops, clip = cigar_ops(cigar), leading_clip(cigar)
    return F.struct(
        ref_start.alias("ref_start"), (ref_start + op_sum(ops, "MDN=X")).alias("ref_end"),
        clip.alias("read_start"), (clip + op_sum(ops, "MI=X")).alias("read_end"),
    )


def walk(ops: Column, start: Column, skip_moves: bool) -> Column:
    """array<struct<op, start, n>>: every op with the reference position before it.

    skip_moves: whether N moves the position (it does for refinement, and does not for signatures).
    """
    moving = "MD=XN" if skip_moves else "MD=X"
    zero = F.struct(start.cast("bigint").alias("at"), F.array().cast("array<struct<op:string,start:bigint,n:bigint>>").alias("out"))

    def step(acc, x):
        placed = F.struct(x["op"].alias("op"), acc["at"].alias("start"), x["n"].alias("n"))
        moved = acc["at"] + F.when(x["op"].isin(*moving), x["n"]).otherwise(F.lit(0))
        return F.struct(moved.alias("at"), F.concat(acc["out"], F.array(placed)).alias("out"))

    return F.aggregate(ops, zero, step, lambda acc: acc["out"])


def indels(ops: Column, start: Column, skip_moves: bool = False, min_size: int = 40) -> Column:
    """The D and I ops of at least min_size with their reference start."""
    return F.filter(walk(ops, start, skip_moves), lambda x: x["op"].isin("D", "I") & (x["n"] >= min_size))


def aligned_blocks(ops: Column, start: Column) -> Column:
    """The M, = and X blocks with their reference start (N and D move, nothing else does)."""
    return F.filter(walk(ops, start, True), lambda x: x["op"].isin("M", "=", "X"))


def alignment_error(ops: Column, nm: Column) -> Column:
    """struct(seg_len, mismatches, error); null where no base counts. nm null: the indel bases."""
    length, gaps = F.aggregate(ops, F.lit(0).cast("bigint"), lambda t, x: t + F.when(x["op"].isin("S", "H", "D"), 0).otherwise(x["n"])), op_sum(ops, "ID")
    edits = F.coalesce(nm, gaps)
    return F.when(length > 0, F.struct(length.alias("seg_len"), F.greatest(edits - gaps, F.lit(0)).alias("mismatches"), (edits / length).alias("error")))


def alignment_quality(mapq: Column, error: Column, mismatches: Column, mismatch_rate: Column) -> Column:
    """Logistic-weighted mapping quality less penalties for errors and mismatches, as a magnitude."""
    return F.abs(
        2.0 * F.log(1 + mapq) / (1 + F.exp(-0.1 * (mapq - 20)))
        - 5.0 * F.sqrt(error)
        - 0.1 * mismatches / (1 + F.exp(-0.01 * (mismatches - 50)))
        - 8.0 * F.pow(mismatch_rate, F.lit(2.0))
    )


def split_alignments(sa: Column) -> Column:
    """array<struct<contig, pos, strand, cigar, mapq, nm>> of an SA tag; the empty part after the last ; goes."""
    parts = F.filter(F.split(sa, ";"), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            F.get(F.split(x, ","), 0).alias("contig"), F.get(F.split(x, ","), 1).cast("bigint").alias("pos"), F.get(F.split(x, ","), 2).alias("strand"),
            F.get(F.split(x, ","), 3).alias("cigar"), F.get(F.split(x, ","), 4).cast("int").alias("mapq"), F.get(F.split(x, ","), 5).cast("int").alias("nm"),
        ),
    )


def canonical_contig(name: Column) -> Column:
    return F.when(name.startswith("chr"), name).otherwise(F.concat(F.lit("chr"), name))


def bare_contig(name: Column) -> Column:
    return F.regexp_replace(name, "^chr", "")
