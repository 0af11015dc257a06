"""Density, leader and trimming clusters of signatures.

Insertions lie on a line, so their density clusters are gap sessions. Other types are two-dimensional (start, end) and
clustered by a grid of cells, but for short runs of points that are alone, which are clustered where they stand. Nothing sweeps a dense
place in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from svloom.operators.components import components
from svloom.operators.cut import cut, drop
from svloom.operators.islands import axis_islands

#: (largest length, eps) bands of insertions and inversions, on noisy and on clean reads.
INS_BANDS = {True: ((300, 150), (1000, 220), (5000, 300), (10**12, 420)), False: ((300, 220), (1000, 300), (5000, 420), (10**12, 600))}
INV_BANDS = {True: ((3000, 280), (10000, 420), (10**12, 650)), False: ((3000, 360), (10000, 520), (10**12, 800))}
NOISY_EPS = {"DEL": 1000, "INS": 300, "DUP": 500, "INV": 500}
CLEAN_EPS = 1500
MIN_MEMBER, MAX_SIZE = 50, 2_000_000


def parse_bands(spec: str) -> tuple[tuple[int, float], ...]:
    """Bands from "length:eps,length:eps"; sorted, all numbers above 0."""
    bands = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        length, sep, eps = part.partition(":")
        if not sep or float(length) <= 0 or float(eps) <= 0:
            raise ValueError(f"not a band: {part!r}")
        bands.append((int(float(length)), float(eps)))
    if not bands:
        raise ValueError("no bands")
    return tuple(sorted(bands))


def band_eps(svlen: Column, bands) -> Column:
    """The eps of the band of a length; null above the last band."""
    out = F
    for most, eps in bands:
        out = out.when(svlen <= most, float(eps))
    return out.otherwise(F.lit(None).cast("double"))


def with_eps(sig: DataFrame, noisy: bool = False, ins_bands=None, inv_bands=None) -> DataFrame:
    """Adds eps, which with contig and type makes the rows that may cluster; rows beyond the bands go."""
    kind, size = F.col("svtype"), F.col("svlen")
    flat = F
    for name, eps in NOISY_EPS.items():
        flat = flat.when(kind == name, float(eps if noisy else CLEAN_EPS))
    eps = F.when(kind == "INS", band_eps(size, ins_bands or INS_BANDS[noisy])).when(kind == "INV", band_eps(size, inv_bands or INV_BANDS[noisy])).otherwise(flat)
    return sig.withColumn("eps", eps).filter("eps is not null")


def drop_oversized(sig: DataFrame, cap: int = MAX_SIZE, types=("DUP", "INV")) -> DataFrame:
    return sig.filter(~(F.col("svtype").isin(*types) & (F.col("svlen") > cap))) if cap else sig


def insertion_clusters(sig: DataFrame, keys: list[str], eps: float, order: list[str]) -> DataFrame:
    """Density clusters of points (start, start + 1): their distance is the root of 2 times that of the starts."""
    return axis_islands(sig, keys, ["start", *[c for c in order if c != "start"]], "start", lambda last: F.col("start") - last > eps / math.sqrt(2), "cluster")


#: The most points of a run that is clustered alone, and the width, in eps, of a piece of an axis in which runs are looked for.
RUN_POINTS, RUN_PIECE = 256, 64
#: Cells of the upper half around a cell, (columns, rows) away, in which a point can be near one of its own.
_BESIDE = [(1, y) for y in range(-2, 3)] + [(2, y) for y in range(-1, 2)]
_ABOVE = [(0, 1), (0, 2)]


def _near_labels(at: np.ndarray, end: np.ndarray, eps: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For each point, in the order of runs and places, the first point of its component; points of different runs are never near."""
    left, right = [], []
    i, step = np.arange(len(at)), 1
    while len(i):
        i = i[i + step < len(at)]
        i = i[(run[i] == run[i + step]) & (at[i + step] - at[i] <= eps[i])]
        near = i[(at[i + step] - at[i]) ** 2 + (end[i + step] - end[i]) ** 2 <= eps[i] ** 2]
        left.append(near)
        right.append(near + step)
        step += 1
    label, u, v = np.arange(len(at)), np.concatenate([*left, i]), np.concatenate([*right, i])
    while len(u):
        old = label.copy()
        np.minimum.at(label, label[v], old[u])
        np.minimum.at(label, label[u], old[v])
        while (label[label] != label).any():
            label = label[label]
        if (label[u] == label[v]).all():
            break
    return label


def _runs_alone(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by __part, keys and __at, with the first cell (__cx, __cy) of the cluster if their run has at most `most` points and no point
    outside its part can be near it. At most that many points and a batch are held.
    """
    held, long_run = None, False

    def settled(table: pa.Table, last: bool) -> tuple[pa.Table, pa.Table | None]:
        nonlocal long_run
        at, end, eps, low, high, x, y = (table[c].to_numpy() for c in ("__at", "__end", "__eps", "__low", "__high", "__x", "__y"))
        new = np.ones(len(at), bool)
        new[1:] = at[1:] - at[:-1] > eps[1:]
        for c in [*keys, "__part"]:
            code = table[c].combine_chunks().dictionary_encode()
            code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.fill_null(-1).to_numpy()
            new[1:] |= code[1:] != code[:-1]
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        behind = np.append(first[1:], len(at))
        # the last run may go on in the next batch, until it is too long to be alone
        keep = len(at) if last or behind[-1] - first[-1] > most or (len(first) == 1 and long_run) else first[-1]
        alone = (behind - first <= most) & (at[first] - low[first] >= eps[first]) & (high[first] - at[behind - 1] > eps[first])
        alone[0] &= not long_run
        long_run = keep == len(at) and not last and (len(first) > 1 or long_run or behind[-1] - first[-1] > most)
        label = _near_labels(at[:keep], end[:keep], eps[:keep], np.where(alone[run[:keep]], run[:keep], -1 - np.arange(keep)))
        order = np.lexsort((y[:keep], x[:keep], label))
        group = np.append(True, label[order][1:] != label[order][:-1]) if keep else np.ones(0, bool)
        least = np.empty(keep, np.int64)
        least[order] = order[group][np.cumsum(group) - 1]
        none = ~alone[run[:keep]]
        out = table.slice(0, keep)
        for name, values in (("__cx", x), ("__cy", y)):
            out = out.append_column(name, pa.array(values[least], pa.int64(), mask=none))
        return out, table.slice(keep) if keep < len(at) else None

    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            out, held = settled(table if held is None else pa.concat_tables([held, table]), False)
            yield from out.to_batches()
    if held is not None:
        yield from settled(held, True)[0].to_batches()


def density_clusters(sig: DataFrame, keys: tuple[str, ...] = ("contig", "svtype", "eps")) -> DataFrame:
    """Adds cluster to signatures (contig, svtype, start, svlen, eps); two points at most eps apart are in one.

    With two points enough for a core, density clusters are the components of the graph of near points. A run is what neighbours on the
    axis of starts within eps make; points of different runs are never near. Runs of few points are clustered in one pass over the sorted
    rows of a piece of the axis; longer ones, and those at the edge of a piece, by a grid (_grid_clusters). A cluster is known by its
    first cell.
    """
    keys, side = list(keys), F.col("eps") / math.sqrt(2)
    end = F.col("start") + F.when(F.col("svtype") == "INS", 1).otherwise(F.col("svlen"))
    wide = F.col("eps") * RUN_PIECE
    whole = F.lit(True)
    for c in [*keys, "start", "svlen"]:
        whole = whole & F.col(c).isNotNull()
    # rows with nulls go to parts of their own, where nothing is alone
    part = F.when(whole, F.floor(F.col("start") / wide)).otherwise(F.pmod(F.xxhash64(*sig.columns), F.lit(4096)) - (1 << 62))
    rows = sig.withColumn("__part", part).repartition(*keys, "__part").sortWithinPartitions("__part", *keys, "start")
    low = F.when(whole, (F.col("__part") * wide).cast("double")).otherwise(F.lit(math.inf))
    derived = {"__at": F.col("start").cast("double"), "__end": end.cast("double"), "__eps": F.col("eps").cast("double"), "__x": F.floor(F.col("start") / side), "__y": F.floor(end / side)}
    rows = rows.select("*", *[F.coalesce(c, F.lit(0)).alias(name) for name, c in derived.items()], low.alias("__low"), F.coalesce(((F.col("__part") + 1) * wide).cast("double"), F.lit(0.0)).alias("__high"))
    most = RUN_POINTS
    schema = StructType([*rows.schema.fields, StructField("__cx", LongType()), StructField("__cy", LongType())])
    met = cut(rows.mapInArrow(lambda batches: _runs_alone(batches, keys, most), schema).select(*sig.columns, "__cx", "__cy"))
    alone = met.filter("__cx is not null").select(*sig.columns, F.struct(F.col("__cx").alias("x"), F.col("__cy").alias("y")).alias("cluster"))
    rest = met.filter("__cx is null").select(*sig.columns)
    return alone.unionByName(_grid_clusters(rest, keys))


def _grid_clusters(sig: DataFrame, keys: list[str]) -> DataFrame:
    """density_clusters by a grid, whatever the number of points of a place.

    Points lie in cells as wide as the root of eps**2 / 2, so those of a cell are near one another, and only ten cells on one side need a
    look. Of two cells side by side the nearest points are the outermost ones of their rows (one above the other: of their columns),
    so a cell of any number of points brings at most as many as it is wide.
    """
    side = F.col("eps") / math.sqrt(2)
    end = F.col("start") + F.when(F.col("svtype") == "INS", 1).otherwise(F.col("svlen"))
    cell = F.struct(F.floor(F.col("start") / side).alias("x"), F.floor(end / side).alias("y"))
    points = cut(sig.withColumn("__end", end).withColumn("__cell", cell))

    def edges(line: str, across: str, beside: list[tuple[int, int]]) -> DataFrame:
        """Cells that are joined, from the outermost points of each line of a cell."""
        outer = points.groupBy(*keys, "__cell", F.col(line).alias("line")).agg(F.min(across).alias("lo"), F.max(across).alias("hi"))
        offset = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in beside]))
        right = outer.select(*keys, F.col("__cell").alias("v"), F.col("line").alias("line2"), "lo", offset.alias("o"))
        right = right.select(*keys, F.struct((F.col("v.x") - F.col("o.x")).alias("x"), (F.col("v.y") - F.col("o.y")).alias("y")).alias("u"), "v", "line2", "lo")
        left = outer.select(*keys, F.col("__cell").alias("u"), "line", "hi")
        apart = (F.col("lo") - F.col("hi")) * (F.col("lo") - F.col("hi")) + (F.col("line") - F.col("line2")) * (F.col("line") - F.col("line2"))
        # right is sized without its explosion, so Spark must not choose to broadcast it
        return left.join(right.hint("merge"), [*keys, "u"]).filter(apart <= F.col("eps") * F.col("eps")).select(*keys, "u", "v").distinct()

    found = components(edges("__end", "start", _BESIDE).unionByName(edges("start", "__end", _ABOVE)), keys)
    first = found.select(*keys, F.col("u").alias("__cell"), F.col("v").alias("__first"))
    return points.join(first, [*keys, "__cell"], "left").withColumn("cluster", F.coalesce("__first", "__cell")).select(*sig.columns, "cluster")


def summarise(clustered: DataFrame, keys: list[str], cap: int = MAX_SIZE) -> DataFrame:
    """One call for each cluster: medians rounded up, support by rows; single rows stay as they are.

    Where rows have an ord, call_id is the first of its rows, written out.
    """
    size = F.count("*").over(Window.partitionBy(*keys))
    sized = clustered.withColumn("__n", size)
    member = (F.col("__n") == 1) | ((F.col("svlen") >= MIN_MEMBER) & ~(F.col("svtype").isin("DUP", "INV") & (F.col("svlen") > cap)))
    name = [F.min(F.concat_ws(":", "contig", "svtype", "start", "svlen", "read_name", "ord")).alias("call_id")] if "ord" in clustered.columns else []
    return sized.filter(member).groupBy(*keys).agg(
        F.ceil(F.median("start")).cast("bigint").alias("start"), F.ceil(F.median("svlen")).cast("bigint").alias("svlen"), F.count("*").alias("support"),
        F.array_sort(F.collect_list("read_name")).alias("reads"), F.array_sort(F.collect_set("source")).alias("sources"), *name,
    )


def trim_members(clustered: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of each cluster that trim_length_outliers leaves, in the order of length."""
    lengths = clustered.groupBy(*keys).agg(F.array_sort(F.collect_list("svlen")).alias("__l")).withColumn("__kept", trim_length_outliers(F.col("__l")))
    spans = lengths.select(*keys, F.array_position("__l", F.get("__kept", 0)).alias("__first"), F.size("__kept").alias("__n"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("svlen", *order))
    rows = clustered.withColumn("__nth", nth).join(spans, keys)
    return rows.filter((F.col("__nth") >= F.col("__first")) & (F.col("__nth") < F.col("__first") + F.col("__n"))).drop("__nth", "__first", "__n")


def trim_length_outliers(lengths: Column) -> Column:
    """The middle of a sorted array of lengths after the outliers at its ends are dropped one by one.

    While more than two are left: the largest goes if it is more than twice and 30 above the upper median,
    else the smallest if the median is more than twice and 30 above it.
    """

    def step(acc, _):
        n = F.size(acc)
        middle, low, high = F.get(acc, F.floor(n / 2).cast("int")), F.get(acc, 0), F.get(acc, n - 1)
        drop_high = (n > 2) & (high > 2 * middle) & (high - middle > 30)
        drop_low = (n > 2) & (middle > 2 * low) & (middle - low > 30)
        return F.when(drop_high, F.slice(acc, 1, F.greatest(n - 1, F.lit(0)))).when(drop_low, F.slice(acc, 2, F.greatest(n - 1, F.lit(0)))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1))), lengths, step)


def leader_clusters(tra: DataFrame, reach: int = 1000) -> DataFrame:
    """Translocations (contig, start, dir1, contig2, end, dir2, read_name) by first fit to cluster leaders.

    Rows of one pair of contigs have the order (read_name, start, end); a row joins the first cluster whose first member
    is within reach at both ends. So leaders are the rows with no earlier leader in reach, and they are found in rounds: of the
    open rows of a grid cell as wide as the reach, which are all near one another, only the first can lead, and it does if no
    earlier open row is near it; then the rows near a new leader are no longer open. A row meets the nine cells around its own
    with one row each, however many rows there are. The number of rounds is that of the longest chain of near rows in ascending order.
    """
    keys, side = ["contig", "contig2"], max(reach, 1)
    cell = F.struct(F.floor(F.col("start") / side).alias("x"), F.floor(F.col("end") / side).alias("y"))
    rows = cut(tra.withColumn("__id", F.monotonically_increasing_id()).withColumn("__order", F.struct("read_name", "start", "end", "__id")).withColumn("__cell", cell))
    around = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)]))

    def beside(leads: DataFrame) -> DataFrame:
        """At most one row of a cell, dealt to the cells around it."""
        dealt = leads.select(*keys, F.col("__cell").alias("__home"), F.col("__order").alias("__lead"), around.alias("__o"))
        return dealt.select(*keys, "__home", "__lead", F.struct((F.col("__home.x") + F.col("__o.x")).alias("x"), (F.col("__home.y") + F.col("__o.y")).alias("y")).alias("__cell"))

    near = (F.abs(F.col("__order.start") - F.col("__lead.start")) <= reach) & (F.abs(F.col("__order.end") - F.col("__lead.end")) <= reach)
    open_rows, leaders = cut(rows.select(*keys, "__cell", "__order")), None
    while not open_rows.isEmpty():
        first = open_rows.groupBy(*keys, "__cell").agg(F.min("__order").alias("__order"))
        met = open_rows.join(beside(first), [*keys, "__cell"])
        blocked = met.filter(near & (F.col("__order") < F.col("__lead"))).select(*keys, F.col("__home").alias("__cell")).distinct()
        new = cut(first.join(blocked, [*keys, "__cell"], "left_anti"))
        leaders = new if leaders is None else leaders.unionByName(new)
        settled = open_rows.join(beside(new), [*keys, "__cell"]).filter(near).select("__order").distinct()
        rest = cut(open_rows.join(settled, "__order", "left_anti").select(*open_rows.columns))
        drop(open_rows)
        open_rows = rest
    if leaders is None:
        leaders = open_rows
    own = rows.join(beside(leaders), [*keys, "__cell"]).filter(near).groupBy("__id").agg(F.min("__lead").alias("__lead"))
    clustered = rows.join(own, "__id")
    middle = [F.ceil(F.median(c)).cast("bigint").alias(c) for c in ("start", "end")]
    named = [F.min_by(c, "__order").alias(c) for c in ("dir1", "dir2")]
    out = clustered.groupBy(*keys, "__lead").agg(*middle, *named, F.count("*").alias("support"), F.array_sort(F.collect_list("read_name")).alias("reads"))
    return out.select("contig", "start", "dir1", "contig2", "end", "dir2", "support", "reads")
