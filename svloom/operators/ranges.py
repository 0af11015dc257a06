"""Interval joins as equi-joins on bins.

Both sides are dealt to the bins that their intervals touch; a pair that shares several bins is given out in
the first of them only, so nothing has to be made distinct. Intervals are half-open and not empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_bins(df: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    """A row for each bin that [start, end) touches: __lo (its first bin) and __bin are added; empty ones touch their start's."""
    lo, hi = F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width)
    return df.withColumn("__lo", lo).withColumn("__bin", F.explode(F.sequence(F.col("__lo"), hi)))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], width: int, how: str = "inner", spread: bool = False) -> DataFrame:
    """Pairs with equal keys and left.start < right.end and left.end > right.start.

    how: inner (all columns; the right side's keys are left out), left_semi or left_anti; rows of left that repeat
    share one fate. Choose width near the usual interval length.
    spread: for an inner join that gives out far more rows than it reads. It is a merge join, whose rows of a bin lie together, and has many
    tasks however few bytes they read; choose a narrower width, as every row of a bin is compared.
    """
    ls, le = left_range
    rs, re = right_range
    marked = [f"__r_{c}" for c in right.columns]
    r = with_bins(right, F.col(rs), F.col(re), width).withColumnsRenamed(dict(zip(right.columns, marked, strict=True)) | {"__lo": "__rlo", "__bin": "__rbin"})
    lhs = with_bins(left, F.col(ls), F.col(le), width)
    on = (F.col("__bin") == F.col("__rbin")) & (F.col(ls) < F.col(f"__r_{re}")) & (F.col(le) > F.col(f"__r_{rs}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__r_{k}"))
    if how == "inner":
        if spread:
            # a number of partitions that is named is not lowered by the bytes
            tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * left.sparkSession.sparkContext.defaultParallelism)
            lhs, r = lhs.repartition(tasks, *keys, "__bin"), r.repartition(tasks, *[f"__r_{k}" for k in keys], "__rbin").hint("merge")
        hits = lhs.join(r, on & (F.col("__bin") == F.greatest("__lo", "__rlo")))
        others = [(m, c) for m, c in zip(marked, right.columns, strict=True) if c not in keys]
        return hits.select(*left.columns, *[F.col(m).alias(c if c not in left.columns else f"right_{c}") for m, c in others])
    matched = lhs.join(r, on, "left_semi").select(*[F.col(c).alias(f"__m_{c}") for c in left.columns]).distinct()
    same = None
    for c in left.columns:
        pair = F.col(c).eqNullSafe(F.col(f"__m_{c}"))
        same = pair if same is None else same & pair
    return left.join(matched, same, how)


def places_below(points: DataFrame, places: DataFrame, keys: list[str], point: str, place: str, name: str, piece: int = 1 << 20) -> DataFrame:
    """The different (keys, point) of points with the number of rows of places whose place is smaller; keys are not null.

    Rows are added up to places before they are sorted, in pieces of the axis; what lies before a piece is a running sum over a
    table of one row a piece.
    """
    asked = points.select(*keys, F.col(point).cast("bigint").alias("__at")).distinct().select(*keys, "__at", F.lit(0).cast("bigint").alias("__n"), F.lit(True).alias("__asked"))
    there = places.groupBy(*keys, F.col(place).cast("bigint").alias("__at")).agg(F.count("*").alias("__n")).withColumn("__asked", F.lit(False))
    rows = there.unionByName(asked).withColumn("__piece", F.floor(F.col("__at") / piece))
    within = Window.partitionBy(*keys, "__piece").orderBy("__at").rangeBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("__own", F.coalesce(F.sum("__n").over(within), F.lit(0))).filter("__asked")
    along = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy(*keys, "__piece").agg(F.sum("__n").alias("__n")).select(*keys, "__piece", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__ahead"))
    return own.join(ahead, [*keys, "__piece"]).select(*keys, F.col("__at").alias(point), (F.col("__own") + F.col("__ahead")).alias(name))


def range_count(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], width: int, row_id: list[str], name: str = "n") -> DataFrame:
    """left with the number of overlapping right rows, 0 where there is none; row_id tells left's rows apart.

    No pair is made: the rows that overlap [start, end) are those that begin before end but for those that end by start.
    Running sums go over pieces of a hundred widths.
    """
    (ls, le), (rs, re) = left_range, right_range
    whole = right.select(*keys, rs, (F.col(re) - 1).alias("__re")).filter(" and ".join(f"{c} is not null" for c in [*keys, rs, "__re"]) + f" and {rs} <= __re + 1")
    asked = left.filter(" and ".join(f"{c} is not null" for c in [*keys, ls, le]) + f" and {ls} < {le}").select(*keys, F.col(ls).alias("__ls"), F.col(le).alias("__le"))
    begun = places_below(asked, whole, keys, "__le", rs, "__begun", 100 * width).withColumnsRenamed({c: f"__b_{c}" for c in keys})
    ended = places_below(asked, whole, keys, "__ls", "__re", "__ended", 100 * width).withColumnsRenamed({c: f"__e_{c}" for c in keys})
    out = left
    for found, mark, at, column in ((begun, "b", "__le", le), (ended, "e", "__ls", ls)):
        on = F.col(column) == F.col(at)
        for k in keys:
            on = on & (F.col(k) == F.col(f"__{mark}_{k}"))
        out = out.join(found, on, "left")
    n = F.when(F.col(ls) < F.col(le), F.col("__begun") - F.col("__ended"))
    return out.select(*left.columns, F.coalesce(n, F.lit(0)).cast("bigint").alias(name))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, distance: int, extra: Column | None = None, how: str = "inner") -> DataFrame:
    """Pairs with equal keys whose positions differ by at most distance; right columns get the prefix p_.

    how: inner, or left_semi for left's own rows. Only right is dealt to its bin and the two beside it, so a row of left is in
    one bin, each pair meets once, and nothing has to be made distinct.
    """
    r = right.withColumnsRenamed({c: f"p_{c}" for c in right.columns})
    width = max(distance, 1)
    bins = F.floor(F.col(f"p_{right_pos}") / width)
    r = r.withColumn("__pb", F.explode(F.sequence(bins - 1, bins + 1)))
    lhs = left.withColumn("__b", F.floor(F.col(left_pos) / width))
    on = (F.col("__b") == F.col("__pb")) & (F.abs(F.col(left_pos) - F.col(f"p_{right_pos}")) <= distance)
    for k in keys:
        on = on & (F.col(k) == F.col(f"p_{k}"))
    on = on if extra is None else on & extra
    return lhs.join(r, on, how).drop("__b", "__pb")
