"""Read support, genotype evidence and breakpoint refinement of calls against reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from svloom.functions import genotypes as G
from svloom.functions.alignment import cigar_ops, indels, is_primary
from svloom.operators.cut import cut
from svloom.operators.islands import axis_rank
from svloom.operators.ranges import places_below, range_count, with_bins

MIN_MAPQ, FIRST_READS, REFINE_READS, READ_BIN = 20, 200, 5000, 10_000
#: Positions of a cell whose calls share a list of reads.
LIST_CELL = 200
#: Positions of a cell whose calls meet one list of reads pair by pair, and the reads of one array of that list.
PAIR_CELL, LIST_READS = 1000, 8192
#: As PAIR_CELL, where calls want many first reads: wider than a read usually is, so that the lists are about the reads.
FIRST_CELL = 4000
#: A table of genotypes by depths of so many rows is broadcast.
BROADCAST_ROWS = 1_000_000
#: Positions of a cell whose calls are refined by one list of reads, and the calls that one group has.
REFINE_CELL, REFINE_CALLS = 1000, 4000
#: Positions of a piece of an axis whose cells get their reads in one pass, and the rows of a batch of those reads.
CELL_PIECE, CELL_BATCH = 16_000, 10_000
_SEEN = ("evidence", "m_start", "m_end", "m_len")


def count_support(calls: DataFrame, reads: DataFrame, row_id: list[str], reach: int = 1000) -> DataFrame:
    """calls with local: the primary reads over the place, 0 if there are none."""
    point = F.col("svtype").isin("INS", "BND")
    placed = calls.withColumn("__s", F.when(point, F.greatest(F.lit(0), F.col("start") - reach)).otherwise(F.col("start")))
    placed = placed.withColumn("__e", F.when(point, F.col("start") + reach).otherwise(F.col("start") + F.greatest(F.col("svlen"), F.lit(1))))
    primary = reads.filter(is_primary(F.col("flag"), keep_duplicates=True))
    return range_count(placed, primary, ["contig"], ("__s", "__e"), ("ref_start", "ref_end"), READ_BIN, row_id, "local").drop("__s", "__e")


def _placed(calls: DataFrame) -> DataFrame:
    """calls with end and the range [__s, __e) in which reads are looked for."""
    bias = G.search_bias(F.col("svtype"))
    end = F.col("start") + F.when(F.col("svtype").isin("INS", "BND"), 1).otherwise(F.col("svlen"))
    return calls.withColumn("end", end).withColumn("__s", F.greatest(F.lit(0), F.col("start") - bias)).withColumn("__e", F.col("end") + bias)


def _good(reads: DataFrame) -> DataFrame:
    good = is_primary(F.col("flag"), keep_duplicates=True) & (F.col("mapq") >= MIN_MAPQ)
    return reads.filter(good).select("contig", "read_name", "read_ordinal", "ref_start", "ref_end")


def _cell_reads(batches: Iterator[pa.RecordBatch], own: list[str], width: int) -> Iterator[pa.RecordBatch]:
    """The reads of each cell (contig, __cell, own, __sure) from pieces whose cells come before their reads in file order.

    A cell is closed when `__most` of its reads overlap all of it behind their start. Of a piece only its cells are held.
    """
    none = np.zeros(0, np.int64)
    now, cells, most, far, held = None, none, none, none, none
    for batch in batches:
        if not batch.num_rows:
            continue
        contigs = batch.column("contig").dictionary_encode()
        code, piece = contigs.indices.to_numpy(), batch.column("__piece").to_numpy()
        is_cell = batch.column("__cell").is_valid().to_numpy(zero_copy_only=False)
        cell, need, upto, start, end = (batch.column(c).fill_null(0).to_numpy().astype(np.int64) for c in ("__cell", "__most", "__far", "ref_start", "ref_end"))
        first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (piece[1:] != piece[:-1])))
        rows, places, sures = [none], [none], [none]
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows], strict=True):
            if (key := (contigs.dictionary[int(code[lo])].as_py(), int(piece[lo]))) != now:
                now, cells, most, far, held = key, none, none, none, none
            split = lo + int(np.count_nonzero(is_cell[lo:hi]))
            if split > lo:
                cells, most, far = (np.append(x, y[lo:split]) for x, y in ((cells, cell), (most, need), (far, upto)))
                held = np.append(held, np.zeros(split - lo, np.int64))
            begin, stop, still = start[split:hi], end[split:hi], np.flatnonzero(held < most)
            if not len(begin) or not len(still):
                continue
            left = np.searchsorted(cells[still], begin // width, "left")
            n = np.searchsorted(cells[still], (np.maximum(stop, begin + 1) - 1) // width, "right") - left
            read = np.repeat(np.arange(len(begin)), n)
            which = still[np.arange(len(read)) + np.repeat(left - np.cumsum(n) + n, n)]
            meets = begin[read] < far[which]
            read, which = read[meets], which[meets]
            order = np.argsort(which, kind="stable")
            read, which = read[order], which[order]
            sure = (stop[read] >= (cells[which] + 1) * width).astype(np.int64)
            before = np.cumsum(sure) - sure
            run = np.searchsorted(which, which, "left")
            kept = before - before[run] + held[which] < most[which]
            held = held + np.bincount(which, sure, len(cells)).astype(np.int64)
            rows.append(read[kept] + split)
            places.append(cells[which[kept]])
            sures.append(sure[kept])
        found, at, over = (np.concatenate(x) for x in (rows, places, sures))
        for k in range(0, len(found), CELL_BATCH):
            part = batch.take(pa.array(found[k : k + CELL_BATCH]))
            columns = [part.column("contig"), pa.array(at[k : k + CELL_BATCH]), *(part.column(c) for c in own), pa.array(over[k : k + CELL_BATCH])]
            yield pa.RecordBatch.from_arrays(columns, names=["contig", "__cell", *own, "__sure"])


def _met_by_cell(cells: DataFrame, good: DataFrame, width: int) -> DataFrame:
    """contig, __cell, the columns of good and __sure: of each of cells (contig, __cell, __most, __far) the reads that touch it.

    They begin before __far, and are those up to the one with which __most of them end behind the cell (__sure). Reads are dealt to pieces of
    many cells, not to the cells, so what is shuffled is about the reads, and what leaves a task about what the lists need.
    """
    many = max(1, CELL_PIECE // width)
    own = [c for c in good.columns if c != "contig"]
    dealt = with_bins(good, F.col("ref_start"), F.col("ref_end"), width * many).drop("__lo").withColumnRenamed("__bin", "__piece")
    asked = cells.withColumn("__piece", F.floor(F.col("__cell") / many)).select("*", *[F.lit(None).cast(good.schema[c].dataType).alias(c) for c in own])
    nulls = [F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in ("__cell", "__most", "__far")]
    # a cell's reads go only to pieces that have cells
    dealt = dealt.join(asked.select("contig", "__piece").distinct(), ["contig", "__piece"], "left_semi").select("*", *nulls)
    order = [F.col("__cell").isNull(), F.coalesce("__cell", F.col("ref_start").cast("bigint")), "read_ordinal"]
    rows = asked.unionByName(dealt).repartition("contig", "__piece").sortWithinPartitions("contig", "__piece", *order)
    schema = StructType([cells.schema["contig"], cells.schema["__cell"], *[good.schema[c] for c in own], StructField("__sure", LongType())])
    return rows.mapInArrow(lambda batches: _cell_reads(batches, own, width), schema)


def _listed(placed: DataFrame, good: DataFrame, most: Column | None, width: int) -> DataFrame:
    """contig, __cell and the columns of good: for each cell of calls the reads among which its calls find their first ones.

    placed: contig, __s, __e (not null, __s < __e) and __cell, which is __s by width. A cell gets the reads that may overlap
    one of its calls, in file order, up to as many as any of them needs (most, an aggregate; None: all) that overlap every call which
    does not end before them. So a list is about as long as what a call needs, however deep the reads are. It is made of reads over the
    cell's left edge, of reads that begin in the cell, and of the first reads behind it, which are told by their rank.
    """
    at = ["contig", "__cell"]
    cells = cut(placed.groupBy(*at).agg(F.lit(1 << 62).alias("__most") if most is None else most.alias("__most"), F.max("__e").alias("__far")))
    edge = F.col("__cell") * width
    own = [c for c in good.columns if c != "contig"]
    near = cut(_met_by_cell(cells, good, width))
    held = near.groupBy(*at).agg(F.sum("__sure").alias("__held"))
    open_cells = cells.join(held, at, "left").withColumn("__lack", F.col("__most") - F.coalesce("__held", F.lit(0))).filter("__lack > 0")
    behind = open_cells.select(*at, "__lack", (edge + width).alias("__from"), F.greatest("__far", edge + width).alias("__far"))
    for name in ("__from", "__far"):
        behind = behind.join(places_below(behind.select("contig", name), good.select("contig", "ref_start"), ["contig"], name, "ref_start", f"{name}_n"), ["contig", name])
    wanted = behind.withColumn("__last", F.least(F.col("__from_n") + F.col("__lack"), "__far_n")).filter("__from_n < __last")
    # ranks in pieces, as a long call may reach very many reads
    wanted = wanted.select(*at, "__last", F.explode(F.sequence(F.col("__from_n") + 1, F.col("__last"), F.lit(LIST_READS).cast("bigint"))).alias("__piece"))
    wanted = wanted.select(*at, F.explode(F.sequence(F.col("__piece"), F.least(F.col("__piece") + LIST_READS - 1, "__last"))).alias("__rank"))
    later = wanted.join(axis_rank(good, ["contig"], ["ref_start", "read_ordinal"], "__rank").hint("merge"), ["contig", "__rank"])
    return near.select(*at, *own).unionByName(later.select(*at, *own))


def _whole(reads: DataFrame) -> DataFrame:
    return reads.filter("contig is not null and ref_start <= ref_end")


def _first_near(calls: DataFrame, reads: DataFrame, first: int, how: str) -> DataFrame:
    """calls, end and near: the first eligible reads of a call in file order that do not support it, as an array in that order.

    Calls lie in cells of LIST_CELL positions by their __s; a cell has one list of reads for all its calls (_listed). how: inner, or left
    for calls without a list as well, whose near is null. The arrays are large: what a call needs of them is to be taken before a shuffle.
    """
    width, at = LIST_CELL, ["contig", "__cell"]
    good = cut(_whole(_good(reads)).filter("read_name is not null"))
    per_name = good.groupBy("read_name").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    placed = _placed(calls).withColumn("__cell", F.when(F.col("contig").isNotNull() & (F.col("__s") < F.col("__e")), F.floor(F.col("__s") / width)))
    most = F.lit(first) + F.coalesce(F.size(F.array_distinct("reads")), F.lit(0)) * per_name
    columns = ["ref_start", "read_ordinal", "ref_end", "read_name"]
    rows = _listed(placed.filter("__cell is not null"), good, F.max(most), width)
    listed = rows.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("__list"))
    fits = lambda x: (x["ref_start"] < F.col("__e")) & (x["ref_end"] > F.col("__s")) & ~F.array_contains("reads", x["read_name"])
    return placed.join(listed.hint("merge"), at, how).select(*calls.columns, "end", F.slice(F.filter("__list", fits), 1, first).alias("near"))


def _each_near(placed: DataFrame, good: DataFrame, row_id: list[str], first: int | None, fits: Callable[[Column], Column] | None = None, width: int | None = None) -> DataFrame:
    """placed with a row for each of the first reads that overlap [__s, __e) and fit, in file order: the columns of good and nth, from 1.

    Only lists of a cell's reads are shuffled, never pairs: a list goes out in arrays of LIST_READS, and a call filters those that it may
    overlap. Where a cell has several arrays, a call's reads are first counted in each, as a row a call and array, so that nth
    goes on from one to the next; arrays behind the first reads wanted are not read again. fits goes with all reads (first is None).
    width: positions of a cell; a read is in the list of each cell that it touches, and a call is compared with all of its cell's list.
    """
    width = width or PAIR_CELL
    at, here = ["contig", "__cell"], ["contig", "__cell", "__array"]
    good = cut(good.filter("contig is not null and ref_start is not null and ref_end is not null"))
    dealt = placed.filter("contig is not null and __s is not null and __e is not null").withColumn("__cell", F.floor(F.col("__s") / width))
    most = None
    if first is not None:
        inverted = good.filter("ref_end < ref_start").count()  # a list counts reads behind its cell as ones that overlap
        most = F.max(F.lit(first + inverted).cast("bigint"))
    rows = _listed(dealt, good, most, width)
    order = Window.partitionBy(*at).orderBy("ref_start", "read_ordinal")
    rows = rows.withColumn("__array", F.floor((F.row_number().over(order) - 1) / LIST_READS))
    own = ["ref_start", "read_ordinal", *[c for c in good.columns if c not in ("contig", "ref_start", "read_ordinal")]]
    bounds = [F.min("ref_start").alias("__from"), F.max("ref_end").alias("__upto")]
    lists = cut(rows.groupBy(*here).agg(F.sort_array(F.collect_list(F.struct(*own))).alias("__list"), *bounds))

    fit = lambda x: (x["ref_start"] < F.col("__e")) & (x["ref_end"] > F.col("__s")) & (F.lit(True) if fits is None else fits(x))
    near = F.filter("__list", fit)
    arrays = lists.select(*here, "__from", "__upto")
    met = dealt.join(arrays, at).filter("__from < __e and __upto > __s").drop("__from", "__upto").withColumn("__ahead", F.lit(0).cast("bigint"))
    read = lists.select(*here, "__list").hint("merge")  # one row of a list at a time
    if not lists.filter("__array > 0").isEmpty():
        several = arrays.filter("__array > 0").select(*at).distinct()
        many = met.join(several, at, "left_semi").drop("__ahead")
        counted = cut(many.join(read, here).select(*many.columns, F.size(near).cast("bigint").alias("__n")))
        earlier = Window.partitionBy(*row_id).orderBy("__array").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("__ahead", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).filter("__n > 0")
        counted = counted if first is None else counted.filter(F.col("__ahead") < first)
        met = met.join(several, at, "left_anti").unionByName(counted.drop("__n"))
    kept = near if first is None else F.slice(near, F.lit(1), (first - F.col("__ahead")).cast("int"))
    found = met.join(read, here).select(*placed.columns, "__ahead", kept.alias("__near"))
    pairs = found.select(*placed.columns, "__ahead", F.posexplode("__near").alias("__pos", "__read"))
    return pairs.select(*placed.columns, *[F.col(f"__read.{c}").alias(c) for c in own], (F.col("__ahead") + F.col("__pos") + 1).alias("nth"))


def evidence_reads(calls: DataFrame, reads: DataFrame, row_id: list[str], first: int | None = FIRST_READS) -> DataFrame:
    """The first eligible reads of each call in file order that do not support it; all of them if first is None.

    calls: contig, start, svlen, svtype, reads and row_id. Primary reads of mapq 20 count, in the type's reach.
    """
    if first is not None:
        near = _first_near(calls, reads, first, "inner").select(*calls.columns, "end", F.posexplode("near").alias("nth", "read"))
        columns = [F.col(f"read.{c}").alias(c) for c in ("read_name", "read_ordinal", "ref_start", "ref_end")]
        return near.select(*calls.columns, "end", *columns, (F.col("nth") + 1).alias("nth"))
    near = _each_near(_placed(calls), _good(reads), row_id, None, fits=lambda x: ~F.array_contains("reads", x["read_name"]))
    return near.drop("__s", "__e")


def reference_support(calls: DataFrame, reads: DataFrame, row_id: list[str]) -> DataFrame:
    """row_id, ref_support: different reads that cover a breakpoint as the reference would."""
    needed = calls.select(*row_id, *[c for c in ("contig", "svtype", "start", "svlen", "reads") if c not in row_id])
    out = _first_near(needed, reads, FIRST_READS, "left").withColumn("alt", F.size("reads"))
    overlap = F.least((F.col("end") - F.col("start")) / 2, F.lit(2000))

    def shows(x):
        over_start = (x["ref_start"] < F.col("start")) & (x["ref_end"] > F.col("start") + overlap)
        over_end = (x["ref_start"] < F.col("end") - overlap) & (x["ref_end"] > F.col("end"))
        through = (x["ref_start"] < F.col("start") - 1000) & (x["ref_end"] > F.col("end") + 1000)
        return F.when(F.col("svtype").isin("INS", "BND"), through).otherwise(over_start | over_end)

    found = F.size(F.array_distinct(F.transform(F.filter("near", shows), lambda x: x["read_name"])))
    out = out.withColumn("found", F.when(F.col("near").isNull(), 0).otherwise(found))
    bounded = F.when(F.col("svtype") == "BND", F.least(F.col("found"), G.bnd_ref_bound(F.col("alt")))).otherwise(F.col("found"))
    return out.select(*row_id, bounded.cast("bigint").alias("ref_support"))


def genotype(calls: DataFrame, reads: DataFrame, row_id: list[str], method: str = "loggl") -> DataFrame:
    """calls (with min_support, support and reads) with ref_support and gt."""
    joined = calls.join(reference_support(calls, reads, row_id), row_id)
    alt, ref = F.size("reads").cast("bigint"), F.col("ref_support")
    error = G.geno_error_rate(F.col("svtype"), F.col("min_support"))
    called = G.genotype_loggl(ref, alt, error) if method == "loggl" else G.genotype_vote(ref, alt, error)
    skip = F.when(F.col("svtype") == "BND", "0/0").otherwise("./.")
    return joined.withColumn("gt", F.when(alt < F.col("min_support"), skip).when(ref + alt < F.col("min_support"), "./.").otherwise(called))


def genotype_of_depths(rows: DataFrame, method: Callable[[Column, Column, Column], Column], name: str = "gt") -> DataFrame:
    """rows (ref, alt, error and others) with the genotype by method, computed once for each different triple of depths and error."""
    triple = ["ref", "alt", "error"]
    known = cut(rows.select(*triple).distinct().withColumn(name, method(*map(F.col, triple))))
    few = known.count() <= BROADCAST_ROWS
    known = known.withColumnsRenamed({c: f"__{c}" for c in triple})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in triple])
    return rows.join(F.broadcast(known) if few else known, same).select(*rows.columns, name)


def refine_reads(calls: DataFrame, reads: DataFrame, row_id: list[str], window: int = 200, first: int = REFINE_READS) -> DataFrame:
    """calls (insertions and deletions) with the first reads in file order that overlap them, at most `first` a call: `nth` is the read's place.

    The columns of reads but contig are added.
    """
    return _each_near(_refine_span(calls, window), reads, row_id, first, width=FIRST_CELL).drop("__s", "__e")


def _refine_span(calls: DataFrame, window: int) -> DataFrame:
    """Insertions and deletions with the range [__s, __e) in which reads are looked for."""
    span = F.when(F.col("svtype") == "INS", 1).otherwise(F.greatest(F.lit(1), F.col("svlen")))
    placed = calls.filter(F.col("svtype").isin("INS", "DEL")).withColumn("__s", F.greatest(F.lit(0), F.col("start") - window))
    return placed.withColumn("__e", F.col("start") + span + window)


def _whole_median(values: np.ndarray) -> int:
    """The median of whole numbers, halves to the even neighbour."""
    n = len(values)
    middle = np.partition(values, [(n - 1) // 2, n // 2])
    low, half = divmod(int(middle[(n - 1) // 2]) + int(middle[n // 2]), 2)
    return low + (half and low & 1)


def _seen_in_cell(calls: pa.Table, reads: pa.Table, row_id: list[str], limit: int, first: int) -> pa.Table:
    """The rows of _events_seen of the calls of a cell, given the cell's reads."""

    def numbers(column) -> np.ndarray:
        return column.fill_null(-(1 << 63)).to_numpy().astype(np.int64)

    starts, ordinals = numbers(reads["ref_start"]), numbers(reads["read_ordinal"])
    order = np.lexsort((ordinals, starts))
    starts, ends = starts[order], numbers(reads["ref_end"])[order]
    names = reads["read_name"].combine_chunks().dictionary_encode()
    name = names.indices.fill_null(-1).to_numpy().astype(np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lists = reads["events"].combine_chunks()
    owner, events = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy()), lists.flatten()
    is_ins = events.field("op").to_numpy(zero_copy_only=False) == "I"
    at, size = (numbers(events.field(c)) for c in ("start", "n"))
    kinds = {k: (place[owner[m]], name[owner[m]], at[m], size[m]) for k, m in (("INS", is_ins), ("DEL", ~is_ins))}
    found: list[tuple[int, int, int, int, int]] = []
    low, high, begin, length = (numbers(calls[c]) for c in ("__s", "__e", "start", "pred_len"))
    for k, kind in enumerate(calls["svtype"].to_pylist()):
        over = (starts < high[k]) & (ends > low[k])
        if np.count_nonzero(over) > first:
            over[np.flatnonzero(over)[first] :] = False
        read, who, start, n = kinds[kind]
        fits = np.abs(start - begin[k]) <= limit
        if kind == "DEL":
            end = begin[k] + length[k]
            fits |= np.abs(start + n - end) <= limit
            fits |= np.maximum(0, np.minimum(start + n, end) - np.maximum(start, begin[k])) / np.maximum(1, np.minimum(n, length[k])) >= 0.2
        share = n / length[k]
        fits = np.flatnonzero(fits & (share >= 0.25) & (share <= 4.0))
        fits = fits[over[read[fits]]]
        if len(fits):
            start, n, who = start[fits], n[fits], np.unique(who[fits])
            found.append((k, len(who) - int(who[0] < 0), _whole_median(start), _whole_median(start if kind == "INS" else start + n), _whole_median(n)))
    rows = calls.select(row_id).take(pa.array([x[0] for x in found], pa.int64()))
    for i, column in enumerate(_SEEN, 1):
        rows = rows.append_column(column, pa.array([x[i] for x in found], pa.int64()))
    return rows


def _events_seen(calls: DataFrame, walked: DataFrame, row_id: list[str], window: int, limit: int, first: int = REFINE_READS) -> DataFrame:
    """row_id, evidence, m_start, m_end, m_len: names and medians of the events that fit a call, of its first reads in file order.

    walked: reads with their events. Calls lie in cells of REFINE_CELL positions; those of a cell meet its list of reads (_listed) in
    one group, or in several of about REFINE_CALLS where a cell has more. Only a row a call leaves a group.
    """
    placed = _refine_span(calls.withColumn("pred_len", F.greatest(F.lit(1), F.col("svlen"))), window).filter("contig is not null and __s < __e")
    placed = placed.select(*row_id, *[c for c in ("contig", "svtype", "start", "pred_len", "__s", "__e") if c not in row_id]).withColumn("__cell", F.floor(F.col("__s") / REFINE_CELL))
    placed, at = cut(placed), ["contig", "__cell"]
    listed = _listed(placed, cut(_whole(walked)), F.max(F.lit(first).cast("bigint")), REFINE_CELL)
    shares = placed.groupBy(*at).agg(F.ceil(F.count("*") / REFINE_CALLS).alias("__shares"))
    dealt = placed.join(shares, at).withColumn("__share", F.pmod(F.xxhash64(*row_id), "__shares")).drop("__shares")
    # renamed to have columns of their own, as both sides of the cogroup use them
    met = listed.join(shares.toDF(*shares.columns), at).withColumn("__share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__shares") - 1))).drop("__shares")
    keys = [*at, "__share"]
    schema = StructType([*[placed.schema[c] for c in row_id], *[StructField(c, LongType()) for c in _SEEN]])
    return dealt.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(lambda c, r: _seen_in_cell(c, r, row_id, limit, first), schema)


def refine(calls: DataFrame, reads: DataFrame, row_id: list[str], types=("DEL",), window: int = 200, min_evidence: int = 2, max_shift: int = 500, ratio: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """Calls with start and length from the indels of the reads over them: new_start, new_len, evidence, reason.

    Primary reads of mapq 20 count. A read's alignment is walked once, whatever the number of calls that it overlaps, and no pair of
    a call and a read is written: calls meet the list of reads of their cell.
    """
    good = reads.filter(is_primary(F.col("flag"), keep_duplicates=True) & (F.col("mapq") >= MIN_MAPQ))
    walked = good.select("contig", "read_name", "read_ordinal", "ref_start", "ref_end", indels(cigar_ops(F.col("cigar")), F.col("ref_start"), True).alias("events"))
    seen = _events_seen(calls.filter(F.col("svtype").isin(*types)), walked, row_id, window, window + max_shift)
    joined = calls.join(seen, row_id, "left").withColumn("pred_len", F.greatest(F.lit(1), F.col("svlen")))
    is_ins = F.col("svtype") == "INS"
    new_len = F.when(is_ins, F.col("m_len")).otherwise(F.greatest(F.lit(1), F.col("m_end") - F.col("m_start")))
    shift = F.when(is_ins, F.abs(F.col("m_start") - F.col("start"))).otherwise(F.greatest(F.abs(F.col("m_start") - F.col("start")), F.abs(F.col("m_end") - F.col("start") - F.col("pred_len"))))
    share = new_len / F.col("pred_len")
    reason = (
        F.when(~F.col("svtype").isin(*types), "type_skip").when(~F.col("svtype").isin("INS", "DEL"), "not_supported").when(F.col("evidence").isNull(), "no_event")
        .when(F.col("evidence") < min_evidence, "low_evidence").when(new_len < 40, "short_len").when(shift > max_shift, "over_shift").when((share < ratio[0]) | (share > ratio[1]), "len_ratio")
        .when((F.col("m_start") == F.col("start")) & (new_len == F.col("pred_len")), "same_value").otherwise("updated")
    )
    done = reason.isin("updated", "same_value")
    tried = ~reason.isin("type_skip", "not_supported")
    return joined.select(*calls.columns, F.when(tried, F.coalesce("evidence", F.lit(0))).otherwise(0).cast("bigint").alias("evidence"), F.when(done, F.col("m_start")).otherwise(F.col("start")).cast("bigint").alias("new_start"), F.when(done, new_len).otherwise(F.col("svlen")).cast("bigint").alias("new_len"), reason.alias("reason"))
