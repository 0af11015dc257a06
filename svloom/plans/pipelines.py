"""The two entry points as plans: signals of reads for a model, and calls from a model's probabilities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.functions import alignment as A
from svloom.functions import genotypes as G
from svloom.functions import signatures as S
from svloom.operators import clusters as C
from svloom.operators import islands as I
from svloom.operators import pileup as P
from svloom.operators import support as U
from svloom.operators.cut import cut
from svloom.operators.ranges import range_join
from svloom.plans.alignments import segment_pairs_of
from svloom.sources.config import CallConfig

READ_BIN = 20_000


def read_segments(reads: DataFrame, quality: bool) -> DataFrame:
    """The primary and split segments of reads with an SA tag, in read coordinates.

    Positions of split segments are used as written in the tag, one base behind those of the primary ones.
    quality: the caller's tests of mapping quality and span.
    """
    tagged = reads.filter("sa is not null and sa <> ''")
    own_strand = F.when(F.col("flag").bitwiseAND(F.lit(16)) == 0, "+").otherwise("-")
    length = F.col("read_len").cast("bigint")
    start, end = F.col("q_aln_start").cast("bigint"), F.col("q_aln_end").cast("bigint")
    primary = tagged.select(
        "read_name", F.when(own_strand == "+", start).otherwise(length - end).alias("q_start"), F.when(own_strand == "+", end).otherwise(length - start).alias("q_end"),
        F.col("ref_start").alias("r_start"), F.col("ref_end").alias("r_end"), "mapq", "contig", own_strand.alias("strand"),
    )
    parts = tagged.select("read_name", "query_len", F.explode(A.split_alignments(F.col("sa"))).alias("a")).select("read_name", "query_len", "a.*", A.cigar_span(F.col("a.pos"), F.col("a.cigar")).alias("s"))
    size = F.col("query_len").cast("bigint")
    minus = F.col("strand") == "-"
    other = parts.select(
        "read_name", F.when(minus, size - F.col("s.read_end")).otherwise(F.col("s.read_start")).alias("q_start"), F.when(minus, size - F.col("s.read_start")).otherwise(F.col("s.read_end")).alias("q_end"),
        F.col("s.ref_start").alias("r_start"), F.col("s.ref_end").alias("r_end"), "mapq", "contig", "strand",
    )
    if quality:
        other = other.filter((F.col("mapq") >= 10) & (F.least(F.col("q_end") - F.col("q_start"), F.col("r_end") - F.col("r_start")) >= 80))
    return primary.unionByName(other).withColumn("tie", F.col("r_start")).withColumn("tie2", F.col("r_end"))


def cigar_signatures(reads: DataFrame, growing: bool) -> DataFrame:
    """read_name, contig, svtype, start, svlen of the merged indels of reads; growing: the caller's insertion rule."""
    events = reads.select("read_name", "contig", F.explode(A.indels(A.cigar_ops(F.col("cigar")), F.col("ref_start"))).alias("e")).select("read_name", "contig", "e.op", "e.start", F.col("e.n").alias("size"))
    keys = ["read_name", "contig"]
    dels = I.merge_cigar_deletions(events.filter("op = 'D'"), keys).withColumn("svtype", F.lit("DEL"))
    merge = I.merge_running_insertions if growing else I.merge_cigar_insertions
    ins = merge(events.filter("op = 'I'"), keys).withColumn("svtype", F.lit("INS"))
    return dels.unionByName(ins).withColumnRenamed("size", "svlen")


def generate_signals(reads: DataFrame, region: int = P.REGION) -> DataFrame:
    """contig, region_start, channel, start, end, cnt, z, z0: the sparse signals of both strands, z0 where there is none.

    All channels are intervals with a strand and go through one sweep; breakpoints are intervals of length 1.
    """
    good = reads.filter(A.is_primary(F.col("flag"), keep_duplicates=False))
    forward = (A.strand_of_flag(F.col("flag")) == "forward").alias("forward")
    strands = good.select("read_name", "contig", forward)
    ops = A.cigar_ops(F.col("cigar"))

    def signal(rows: DataFrame, name: str, start: F.Column, end: F.Column) -> DataFrame:
        return rows.select("contig", P.channel_of(name, F.col("forward")).alias("channel"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))

    segments = cut(segment_pairs_of(read_segments(good, quality=False), long_flag=False))
    indel = cigar_signatures(good, growing=False).join(strands, ["read_name", "contig"])
    begin, stop = F.col("start"), F.col("start") + F.col("svlen")
    found = segments.select("read_name", S.classify(None, strict=False).alias("v")).filter("v is not null").select("read_name", "v.*").withColumnRenamed("size", "svlen")
    split = found.drop("contig").join(strands, "read_name")
    body = split.filter(F.col("svlen").between(1, P.MAX_SPLIT))
    tra = split.filter("svtype = 'TRA'")
    clips = good.select("contig", forward, F.when(A.strand_of_flag(F.col("flag")) == "reverse", F.col("ref_end")).otherwise(F.col("ref_start")).alias("at"), F.col("cigar").rlike("[SH]$").alias("ms"), F.col("cigar").rlike(r"^\d+[SH]").alias("sm"))
    blocks = good.select("contig", forward, F.explode(A.aligned_blocks(ops, F.col("ref_start"))).alias("b"))
    parts = [
        signal(indel.filter("svtype = 'DEL'"), "DEL_cigar", begin, stop), signal(indel.filter("svtype = 'INS'"), "INS_cigar", begin, begin + 1),
        signal(body.filter("svtype = 'DEL'"), "DEL_split", begin, stop), signal(split.filter("svtype = 'INS'"), "INS_split", begin, begin + 1),
        signal(body.filter("svtype = 'INV'"), "INV_split", begin, stop), signal(body.filter("svtype = 'DUP'"), "DUP_split", begin, stop),
        signal(tra, "BND_split", begin, begin + 1), signal(tra, "BND_split", F.col("end2"), F.col("end2") + 1),
        signal(clips.filter("ms"), "clip_ms", F.col("at"), F.col("at") + 1), signal(clips.filter("sm"), "clip_sm", F.col("at"), F.col("at") + 1),
        signal(blocks, "depth", F.col("b.start"), F.col("b.start") + F.col("b.n")),
    ]
    intervals = parts[0]
    for part in parts[1:]:
        intervals = intervals.unionAll(part)
    keys = ["contig", "region_start", "channel"]
    runs = P.sweep(P.clip_to_region(intervals, region), keys)
    scored = P.zscores(runs, keys, region)
    return scored.select(*keys, "start", "end", "cnt", "z", (-F.col("mean") / (F.col("sd") + 1e-10)).alias("z0"))


def dense_windows(signals: DataFrame, region: int = P.REGION, window: int = P.WINDOW, n_channels: int = P.N_CHANNELS) -> DataFrame:
    """contig, window_start, features: window x n_channels values in rows of positions, for a model.

    All windows of the regions that have a signal are made. A position without a signal has its channel's score of 0 in
    the region, a channel without one in the region has 0. A window's runs come as one row and are laid out in its task.
    """
    tiles = P.window_tiles(signals, window)
    run = F.struct("channel", (F.col("start") - F.col("window_start")).alias("lo"), (F.col("end") - F.col("window_start")).alias("hi"), "z")
    runs = tiles.groupBy("contig", "window_start").agg(F.collect_list(run).alias("runs"))
    base = signals.select("contig", "region_start", "channel", "z0").distinct().groupBy("contig", "region_start").agg(F.collect_list(F.struct("channel", "z0")).alias("base"))
    offsets = F.sequence(F.lit(0).cast("bigint"), F.lit((region // window - 1) * window).cast("bigint"), F.lit(window).cast("bigint"))
    grid = base.select("contig", "base", F.explode(F.transform(offsets, lambda k: F.col("region_start") + k)).alias("window_start"))

    def lay_out(batches):
        for batch in batches:
            rows = []
            for zeros, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                values = np.zeros((window, n_channels))
                for x in zeros:
                    values[:, x["channel"]] = x["z0"]
                for x in parts or ():
                    values[x["lo"] : x["hi"], x["channel"]] = x["z"]
                rows.append(values.ravel())
            features = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * window * n_channels, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), features], names=["contig", "window_start", "features"])

    joined = grid.join(runs, ["contig", "window_start"], "left").select("contig", "window_start", "base", "runs")
    return joined.mapInArrow(lay_out, "contig string, window_start long, features array<double>")


def near_reads(reads: DataFrame, predictions: DataFrame, threshold: float) -> DataFrame:
    """Primary reads over positive windows, once for each run of windows: g_start and g_end are added."""
    positive = predictions.filter(F.col("prob") >= threshold).select("contig", F.col("window_start").alias("start"), (F.col("window_start") + P.WINDOW).alias("end"))
    regions = I.merge_adjacent(positive, ["contig"], "start", "end").withColumnsRenamed({"start": "g_start", "end": "g_end"})
    good = reads.filter(A.is_primary(F.col("flag"), keep_duplicates=True))
    return range_join(regions.select("contig", "g_start", "g_end"), good, ["contig"], ("g_start", "g_end"), ("ref_start", "ref_end"), READ_BIN)


def chosen(rows: DataFrame, config: CallConfig) -> DataFrame:
    """Rows of the contigs that the configuration names, of all if it names none."""
    return rows.filter(F.col("contig").isin(*config.contigs)) if config.contigs else rows


def contig_errors(near: DataFrame) -> DataFrame:
    errors = near.select("contig", A.alignment_error(A.cigar_ops(F.col("cigar")), F.col("nm")).alias("e")).filter("e is not null")
    return errors.groupBy("contig").agg(F.avg("e.error").alias("error"))


def split_signatures(used: DataFrame, config: CallConfig) -> DataFrame:
    """read_name, g_start, g_end and v, the variant of each pair of neighbouring segments of a read."""
    spans = used.select("read_name", "g_start", "g_end").distinct()
    pairs = segment_pairs_of(read_segments(used, quality=True).distinct()).join(spans, "read_name")
    return pairs.select("read_name", "g_start", "g_end", S.classify((F.col("g_start"), F.col("g_end")), True, config.max_dup_inv_len).alias("v")).filter("v is not null")


def supported(calls: DataFrame, reads: DataFrame, contigs: DataFrame, error: DataFrame, config: CallConfig) -> DataFrame:
    """calls (with cluster, a number of each) with local depth, support threshold, reference support and genotype."""
    bases = reads.filter(A.is_primary(F.col("flag"), keep_duplicates=True)).agg(F.sum("query_len").alias("bases"))
    depth = bases.join(contigs.agg(F.sum("length").alias("length"))).select(F.coalesce(F.ceil(F.try_divide("bases", "length")), F.lit(0)).cast("bigint").alias("coverage"))
    noisy = calls.join(error, "contig", "left").withColumn("error", F.coalesce("error", F.lit(0.0)))
    local = U.count_support(noisy, reads, ["contig", "cluster"]).join(F.broadcast(depth))  # one row
    need = G.min_support(F.col("svtype"), F.col("coverage"), F.col("local"), F.col("error"))
    local = cut(local.withColumn("min_support", G.adjust_support(F.col("svtype"), F.col("svlen"), need, config.support_scale, config.support_cap, config.support_scale, inv_scale=config.support_scale)))
    return U.genotype(local, reads, ["contig", "cluster"], config.geno_method).filter(F.col("support") >= F.col("min_support"))


def call_breakends(reads: DataFrame, contigs: DataFrame, predictions: DataFrame, threshold: float, config: CallConfig = CallConfig()) -> DataFrame:
    """Translocation calls from the split reads over positive windows.

    contig, start, dir1, contig2, end, dir2, support, reads, local, min_support, ref_support, gt; both contigs are known ones.
    """
    reads, predictions = chosen(reads, config), chosen(predictions, config)
    near = cut(near_reads(reads, predictions, threshold))
    found = split_signatures(near.filter("mapq >= 20"), config).filter("v.svtype = 'TRA'")
    tra = found.select(F.col("v.contig").alias("contig"), F.col("v.start").alias("start"), F.col("v.dir1").alias("dir1"), F.col("v.contig2").alias("contig2"), F.col("v.end2").alias("end"), F.col("v.dir2").alias("dir2"), "read_name")
    calls = C.leader_clusters(tra).withColumnRenamed("end", "end2").withColumn("svtype", F.lit("BND")).withColumn("svlen", F.lit(1).cast("bigint"))
    calls = cut(calls.withColumn("cluster", F.xxhash64("contig", "start", "dir1", "contig2", "end2", "dir2", "reads")))
    known = contigs.select(F.col("contig").alias("known"))
    both = supported(calls, reads, contigs, contig_errors(near), config).join(known, F.col("contig") == F.col("known"), "left_semi").join(known, F.col("contig2") == F.col("known"), "left_semi")
    return both.select("contig", "start", "dir1", "contig2", F.col("end2").alias("end"), "dir2", "support", "reads", "local", "min_support", "ref_support", "gt")


def call_variants(reads: DataFrame, contigs: DataFrame, predictions: DataFrame, threshold: float, config: CallConfig = CallConfig()) -> DataFrame:
    """Calls from the reads over positive windows: contig, svtype, start, svlen, support, reads, min_support, gt.

    predictions: contig, window_start, prob. A read over two positive intervals counts in both. Translocations are
    call_breakends'. With config.refine, start and length of the types it names come from the reads over a call.
    """
    reads, predictions = chosen(reads, config), chosen(predictions, config)
    near = cut(near_reads(reads, predictions, threshold))
    error = contig_errors(near)
    used = near.filter("mapq >= 20")

    events = used.select("read_name", "contig", "g_start", "g_end", F.explode(A.indels(A.cigar_ops(F.col("cigar")), F.col("ref_start"))).alias("e")).select("read_name", "contig", "g_start", "g_end", "e.op", "e.start", F.col("e.n").alias("size"))
    inside = F.when(F.col("op") == "D", (F.col("g_start") <= F.col("start") + F.col("size")) & (F.col("g_end") >= F.col("start"))).otherwise(F.col("start").between(F.col("g_start"), F.col("g_end")))
    keys = ["read_name", "contig", "g_start", "g_end"]
    events = events.filter(inside)
    dels = I.merge_cigar_deletions(events.filter("op = 'D'"), keys).withColumn("svtype", F.lit("DEL"))
    ins = I.merge_running_insertions(events.filter("op = 'I'"), keys).withColumn("svtype", F.lit("INS"))
    cigar = dels.unionByName(ins).select(*keys, "svtype", "start", F.col("size").alias("svlen"), F.lit("cigar").alias("source"))

    found = split_signatures(used, config).filter("v.svtype <> 'TRA'")
    split = found.select("read_name", F.col("v.contig").alias("contig"), "g_start", "g_end", F.col("v.svtype").alias("svtype"), F.col("v.start").alias("start"), F.col("v.size").alias("svlen"), F.lit("split").alias("source"))

    rows = cigar.unionByName(split)
    merged = I.merge_read_insertions(rows.filter("svtype = 'INS'").withColumn("allele", F.lit("None")).withColumn("score", F.lit(0.0)), keys, ["start", "svlen", "source"])
    sig = rows.filter("svtype <> 'INS'").unionByName(merged.withColumn("svtype", F.lit("INS")).select(*rows.columns)).withColumn("ord", F.monotonically_increasing_id())
    sig = cut(sig)
    noisy = sig.join(error, "contig", "left").withColumn("error", F.coalesce("error", F.lit(0.0)))
    sized = None
    for high in (True, False):
        part = C.with_eps(C.drop_oversized(noisy.filter((F.col("error") > G.NOISY) == F.lit(high)), config.max_dup_inv_len), high, config.bands.get("INS"), config.bands.get("INV"))
        sized = part if sized is None else sized.unionByName(part)
    clustered = cut(C.density_clusters(sized.select("contig", "svtype", "start", "svlen", "eps", "read_name", "source", "error", "ord")))
    group = ["contig", "svtype", "eps", "cluster"]
    split_len = I.length_subclusters(clustered.filter("svtype <> 'INS'"), group, ["start", "read_name", "ord"])
    others = C.summarise(split_len, [*group, "part"]).drop("eps", "cluster", "part")
    trimmed = C.trim_members(clustered.filter("svtype = 'INS'"), group, ["start", "read_name", "ord"])
    calls = C.summarise(trimmed, group).drop("eps", "cluster").unionByName(others)
    calls = C.drop_oversized(calls, config.max_dup_inv_len, ("DEL", "DUP", "INV"))
    calls = cut(calls.withColumn("cluster", F.xxhash64("contig", "svtype", "start", "svlen", "reads")))
    kept = supported(calls, reads, contigs, error, config).filter("svlen >= 40")
    if config.refine:
        moved = U.refine(cut(kept), reads, ["contig", "cluster"], config.refine_types, config.refine_window, config.refine_min_evidence, config.refine_max_shift)
        kept = moved.withColumn("start", F.col("new_start")).withColumn("svlen", F.col("new_len"))
    return kept.select("contig", "svtype", "start", "svlen", "support", "reads", "sources", "local", "min_support", "ref_support", "gt")
