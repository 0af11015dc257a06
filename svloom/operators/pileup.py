"""Sparse pileups: intervals become differences at their ends, and a running sum per position change.

Nothing is expanded to positions but where a dense window is asked for at the model's border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svloom.sources.config import SIGNALS

#: Channels of both strands, reverse strand first.
N_CHANNELS = 2 * len(SIGNALS)
REGION, WINDOW, MAX_SPLIT = 10_000_000, 2000, 1_000_000


def channel_of(signal: str, forward: Column) -> Column:
    return F.lit(SIGNALS.index(signal)) + F.when(forward, len(SIGNALS)).otherwise(0)


def clip_to_region(intervals: DataFrame, region: int = REGION) -> DataFrame:
    """A row for each region that [start, end) touches, clipped to it: region_start is added."""
    lo, hi = F.floor(F.greatest("start", F.lit(0)) / region), F.floor((F.col("end") - 1) / region)
    rows = intervals.filter((F.col("end") > 0) & (F.col("end") > F.col("start"))).withColumn("region_start", F.explode(F.transform(F.sequence(lo, hi), lambda k: k * region)))
    return rows.withColumn("start", F.greatest("start", "region_start")).withColumn("end", F.least(F.col("end"), F.col("region_start") + region))


def sweep(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end, cnt: maximal runs of positions between changes that at least one interval covers."""
    delta = intervals.select(*keys, F.col("start").alias("pos"), F.lit(1).alias("d")).unionAll(intervals.select(*keys, F.col("end").alias("pos"), F.lit(-1).alias("d")))
    steps = delta.groupBy(*keys, "pos").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(*keys).orderBy("pos")
    runs = steps.withColumn("cnt", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.lead("pos").over(order))
    return runs.filter("cnt > 0 and end is not null").select(*keys, F.col("pos").alias("start"), "end", "cnt")


def points(rows: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """keys, start, end, cnt of single positions."""
    return rows.groupBy(*keys, pos).agg(F.count("*").alias("cnt")).select(*keys, F.col(pos).alias("start"), (F.col(pos) + 1).alias("end"), "cnt")


def region_moments(runs: DataFrame, keys: list[str], length: int) -> DataFrame:
    """mean and sd of a signal over all `length` positions, those without a row counting as 0."""
    width = F.col("end") - F.col("start")
    sums = runs.groupBy(*keys).agg(F.sum(F.col("cnt") * width).alias("s1"), F.sum(F.col("cnt") * F.col("cnt") * width).alias("s2"))
    mean = F.col("s1") / length
    return sums.select(*keys, mean.alias("mean"), F.sqrt(F.greatest(F.col("s2") / length - mean * mean, F.lit(0.0))).alias("sd"))


def zscores(runs: DataFrame, keys: list[str], length: int) -> DataFrame:
    """runs with z; positions without a row have -mean / (sd + 1e-10)."""
    moments = region_moments(runs, keys, length)
    return runs.join(moments, keys).withColumn("z", (F.col("cnt") - F.col("mean")) / (F.col("sd") + 1e-10))


def window_tiles(runs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Runs cut at the window grid: window_start is added."""
    lo, hi = F.floor(F.col("start") / window), F.floor((F.col("end") - 1) / window)
    cut = runs.withColumn("window_start", F.explode(F.transform(F.sequence(lo, hi), lambda k: k * window)))
    return cut.withColumn("start", F.greatest("start", "window_start")).withColumn("end", F.least(F.col("end"), F.col("window_start") + window))


def window_grid(contigs: DataFrame, region: int = REGION, window: int = WINDOW) -> DataFrame:
    """contig, region_start, window_start of all whole windows; a region goes past its contig's end."""
    regions = contigs.withColumn("region_start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(region).cast("bigint"))))
    offsets = F.sequence(F.lit(0).cast("bigint"), F.lit((region // window - 1) * window).cast("bigint"), F.lit(window).cast("bigint"))
    return regions.select("contig", "region_start", F.explode(F.transform(offsets, lambda k: F.col("region_start") + k)).alias("window_start"))


def subregion_size(requested: int, window: int = WINDOW) -> int:
    """A requested subregion rounded down to whole windows, one at least."""
    return max(window, requested // window * window)


def signal_matrix(runs: DataFrame, keys: list[str], channels: list[int]) -> DataFrame:
    """One row for each position that has a signal, one column ch<k> for each channel. For small axes."""
    dense = runs.withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
    wide = dense.groupBy(*keys, "pos").pivot("channel", channels).agg(F.sum("cnt"))
    return wide.select(*keys, "pos", *[F.coalesce(F.col(str(c)), F.lit(0).cast("bigint")).alias(f"ch{c}") for c in channels])
