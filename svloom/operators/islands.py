"""Gaps and islands: neighbouring rows are merged by windows over an order."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svloom.operators.cut import cut


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of rows: a run ends where breaks (an expression that may use lag over `w(...)`) holds."""
    window = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__new", F.coalesce(breaks, F.lit(True)).cast("bigint"))
    return marked.withColumn(name, F.sum("__new").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


#: Positions of one piece of an axis: a contig is sorted piece by piece, whatever its length and rows.
AXIS_PIECE = 1 << 20


def axis_islands(df: DataFrame, keys: list[str], order: list[str], carry: str, breaks: Callable[[Column], Column], name: str = "island", piece: int = AXIS_PIECE) -> DataFrame:
    """As islands, along an axis: order[0] is a position, and breaks tells from the value of `carry` in the row before.

    df is evaluated once: its rows are sorted within pieces of the axis, numbered there, and written. Whether a piece begins with
    a new run, and how many runs lie before it, comes from a table of one row a piece. Nulls are a value like others.
    """
    here = [*keys, "__piece"]
    within = Window.partitionBy(*here).orderBy(*order)
    rows = df.withColumn("__piece", F.floor(F.col(order[0]) / piece)).withColumn("__nth", F.row_number().over(within)).withColumn("__before", F.lag(carry).over(within))
    rows = rows.withColumn("__new", F.when(F.col("__nth") == 1, 0).otherwise(F.coalesce(breaks(F.col("__before")), F.lit(True)).cast("bigint")))
    rows = cut(rows.withColumn("__own", F.sum("__new").over(within.rowsBetween(Window.unboundedPreceding, 0))).drop("__before", "__new"))

    along = Window.partitionBy(*keys).orderBy(F.col("__piece").asc_nulls_first())
    pieces = rows.groupBy(*here).agg(F.max("__own").alias("__n"), F.min_by(F.struct(*df.columns), "__nth").alias("__first"), F.max_by(carry, "__nth").alias("__last"))
    pieces = pieces.select(*here, "__n", F.lag("__last").over(along).alias("__before"), *[F.col(f"__first.{c}").alias(c) for c in df.columns if c not in keys])
    pieces = pieces.select(*here, "__n", F.coalesce(breaks(F.col("__before")), F.lit(True)).cast("bigint").alias("__new"))
    ahead = F.coalesce(F.sum(F.col("__n") + F.col("__new")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(*[F.col(c).alias(f"__k{k}") for k, c in enumerate(here)], (ahead + F.col("__new")).alias("__ahead"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__k{k}")) for k, c in enumerate(here)])
    return rows.join(pieces, same).select(*df.columns, (F.col("__own") + F.col("__ahead")).alias(name))


def axis_rank(df: DataFrame, keys: list[str], order: list[str], name: str = "nth", piece: int = AXIS_PIECE) -> DataFrame:
    """The place of each row among those of its keys, 1 first; keys are not null, and order[0] is a position.

    Rows are sorted in pieces of the axis; where a piece begins is a running sum over a table of one row a piece.
    """
    part = F.floor(F.col(order[0]) / piece).alias("__piece")
    counts = df.groupBy(*keys, part).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__piece", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*keys, "__piece").orderBy(*order))
    return df.select("*", part).withColumn("__own", own).join(starts, [*keys, "__piece"]).withColumn(name, F.col("__before") + F.col("__own")).drop("__piece", "__own", "__before")


def before(column: str, keys: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))


def gap_sessions(df: DataFrame, keys: list[str], position: str, gap: float, order: list[str], name: str = "island") -> DataFrame:
    """A new run where the position is more than gap behind its predecessor's."""
    return islands(df, keys, order, F.col(position) - before(position, keys, order) > gap, name)


def merge_adjacent(windows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Runs in which every window begins where the one before ends; overlapping ones are not merged."""
    order = [start, end]
    numbered = axis_islands(windows, keys, order, end, lambda last: last != F.col(start))
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_windows")).drop("island")


def merge_cigar_deletions(events: DataFrame, keys: list[str], gap: int = 150) -> DataFrame:
    """Deletions (start, size) of a read whose distance is at most gap become one that spans them."""
    order = ["start", "size"]
    ends = events.withColumn("__end", F.col("start") + F.col("size"))
    numbered = islands(ends, keys, order, F.col("start") - before("__end", keys, order) > gap)
    out = numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("__end").alias("end"))
    return out.select(*keys, "start", (F.col("end") - F.col("start")).alias("size"))


def merge_cigar_insertions(events: DataFrame, keys: list[str], gap: int = 150) -> DataFrame:
    """Insertions of a read within gap of the one before are added up at the first one's place."""
    numbered = gap_sessions(events, keys, "start", gap, ["start", "size"])
    return numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.sum("size").alias("size")).drop("island")


#: Reach of the caller's insertion merge by the larger of both sizes, and for rows of a whole read.
RUNNING_REACH = ((100, 200), (500, 400))
RUNNING_FAR = 600
READ_REACH = ((100, 200), (500, 400), (2000, 800))
READ_FAR, OTHER_SOURCE = 1200, 100


def reach(size: Column, steps, far: int) -> Column:
    out = F
    for below, value in steps:
        out = out.when(size < below, value)
    return out.otherwise(far)


def merge_running_insertions(events: DataFrame, keys: list[str]) -> DataFrame:
    """Insertions of a read merged left to right, the reach growing with what has been merged.

    The rule depends on the merged size, so it is a fold over the sorted insertions of a read (few rows).
    """
    rows = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("bigint").alias("start"), F.col("size").cast("bigint").alias("size")))).alias("rows"))
    empty = F.array().cast("array<struct<start:bigint,last:bigint,size:bigint>>")

    def step(acc, x):
        top = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (x["start"] - top["last"] <= reach(F.greatest(top["size"], x["size"]), RUNNING_REACH, RUNNING_FAR))
        merged = F.struct(top["start"].alias("start"), x["start"].alias("last"), (top["size"] + x["size"]).alias("size"))
        fresh = F.struct(x["start"].alias("start"), x["start"].alias("last"), x["size"].alias("size"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(acc, F.array(fresh)))

    merged = rows.select(*keys, F.explode(F.aggregate("rows", empty, step)).alias("m"))
    return merged.select(*keys, F.col("m.start").alias("start"), F.col("m.size").alias("size"))


def merge_read_insertions(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insertion rows (start, svlen, source, allele, score) of a read from all sources, merged by distance.

    The reach depends on a row and the one before it. A group's place is the median of its anchors: long split
    rows, else long rows, else all; its length is the longest anchor's if there are long rows.
    """
    longest = F.greatest("svlen", before("svlen", keys, order))
    allowed = reach(longest, READ_REACH, READ_FAR) + F.when(before("source", keys, order) != F.col("source"), OTHER_SOURCE).otherwise(0)
    numbered = islands(rows, keys, order, F.col("start") - before("start", keys, order) > allowed)
    long_row, split = F.col("svlen") >= 1000, F.col("source").startswith("split")
    middle = lambda c, cond=F.lit(True): F.bround(F.median(F.when(cond, F.col(c)))).cast("bigint")
    groups = numbered.groupBy(*keys, "island").agg(
        F.count("*").alias("n"), F.max(long_row & split).alias("long_split"), F.max(long_row).alias("any_long"),
        middle("start", long_row & split).alias("at_ls"), middle("start", long_row).alias("at_l"), middle("start").alias("at_all"), middle("svlen").alias("len_all"),
        F.max(F.when(long_row & split, F.col("svlen"))).alias("max_ls"), F.max("svlen").alias("max_all"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.max("score").alias("score"), F.max(F.col("allele") == "A").alias("seen"),
    )
    start = F.when(F.col("long_split"), F.col("at_ls")).when(F.col("any_long"), F.col("at_l")).otherwise(F.col("at_all"))
    size = F.when(F.col("long_split"), F.col("max_ls")).when(F.col("any_long"), F.col("max_all")).otherwise(F.col("len_all"))
    source = F.when((F.size("sources") > 1) & F.col("long_split"), "split_rescue").when(F.size("sources") > 1, "split+cigar").otherwise(F.element_at("sources", 1))
    return groups.select(*keys, start.alias("start"), size.cast("bigint").alias("svlen"), source.alias("source"), F.when(F.col("seen"), "A").otherwise("None").alias("allele"), "score", "n")


def length_subclusters(df: DataFrame, keys: list[str], order: list[str], share: float = 0.7) -> DataFrame:
    """Splits a cluster's rows, sorted by length, where the step is more than share of the upper median length.

    The share is taken as a decimal: 0.7 * 90 is 63, which in doubles it is not.
    """
    by = ["svlen", *order]
    rows = Window.partitionBy(*keys)
    # the middle by its rank, nulls come first: no list of a cluster is made, and one sort serves the median and the steps
    n, known = F.count("*").over(rows), F.count("svlen").over(rows)
    ranked = df.filter(" and ".join(f"{k} is not null" for k in keys)).withColumn("__nth", F.row_number().over(rows.orderBy(*by)))
    ranked = ranked.withColumn("__middle", n - known + F.floor(known / 2) + 1)
    joined = ranked.withColumn("__median", F.max(F.when(F.col("__nth") == F.col("__middle"), F.col("svlen"))).over(rows)).drop("__nth", "__middle")
    step = (F.col("svlen") - before("svlen", keys, by)).cast("decimal(20,0)")
    return islands(joined, keys, by, step > F.lit(Decimal(str(share))) * F.col("__median").cast("decimal(20,0)"), "part").drop("__median")
