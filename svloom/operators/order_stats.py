"""Exact medians of groups of any size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svloom.operators.cut import cut, drop

#: Bits of a value that one histogram tells apart: at most 2**LEVEL_BITS sums for each group and level.
LEVEL_BITS = 10


def medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and the median of each of columns (whole numbers; nulls don't count, a column of nulls alone has a null median).

    The middle of a group is found by histograms: counts of values by their highest bits, then, of the bucket that holds the middle
    alone, by the next ones. A task sums rows to buckets before anything is shuffled, so no task holds a group's
    values, however large the group. The two middle values of an even number are looked for as two places.
    """
    out = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    for name in columns:
        out = _joined(out, _median(df, keys, name), keys)
    return out.select(*keys, *columns)


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left with right's columns by keys; null is a value like others."""
    named = right.withColumnsRenamed({c: f"__r_{c}" for c in keys})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys])
    return left.join(named, same, how).drop(*[f"__r_{c}" for c in keys])


def _median(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    values = cut(df.select(*keys, F.col(name).cast("bigint").alias("__v")).filter("__v is not null"))
    spans = values.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    # the bits above those in which the values of any group differ need no look
    left = int((spans.agg(F.bit_or(F.col("__low").bitwiseXOR(F.col("__high")))).first()[0] or 0) & ((1 << 64) - 1)).bit_length()
    places = F.array_distinct(F.array(F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)))
    # a row for each place that is looked for, with its rank from 0 among the values of the prefix
    prefix = F.shiftright("__low", left) if left < 64 else F.lit(0).cast("bigint")
    state = cut(spans.select(*keys, F.explode(places).alias("__place"), prefix.alias("__p")).withColumn("__rank", F.col("__place")))
    while left > 0:
        rest = left - min(LEVEL_BITS, left)
        own = (F.shiftright("__v", left) if left < 64 else F.lit(0).cast("bigint")).alias("__p")
        met = _joined(values.select(*keys, own, F.shiftright("__v", rest).alias("__b")), state, [*keys, "__p"], "inner")
        counts = met.groupBy(*keys, "__place", "__rank", "__b").agg(F.count("*").alias("__c"))
        run = Window.partitionBy(*keys, "__place").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
        beyond = counts.withColumn("__upto", F.sum("__c").over(run)).filter("__upto > __rank")
        first = beyond.groupBy(*keys, "__place", "__rank").agg(F.min(F.struct("__b", "__upto", "__c")).alias("s"))
        new = cut(first.select(*keys, "__place", F.col("s.__b").alias("__p"), (F.col("__rank") - (F.col("s.__upto") - F.col("s.__c"))).alias("__rank")))
        drop(state)
        state, left = new, rest
    return state.groupBy(*keys).agg(F.avg("__p").alias(name))
