"""Column expressions that turn pairs of read segments into variant signatures.

Segment columns are q_start, q_end, r_start, r_end, mapq, contig, strand with a prefix c_ (current) or
n_ (next).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_SIZE, OVERLAP, MIN_MAPQ, MAX_SIZE = 40, 5, 20, 2_000_000


def _c(name: str) -> Column:
    return F.col(f"c_{name}")


def _n(name: str) -> Column:
    return F.col(f"n_{name}")


def pair_geometry() -> dict[str, Column]:
    """same_contig, same_strand, dist_read, dist_ref and deviation of a pair."""
    same = _c("strand") == _n("strand")
    opposite = F.when(_c("r_end") > _n("r_end"), _n("r_end") - _c("r_start")).otherwise(_c("r_end") - _n("r_start"))
    dist_ref = F.when(same & (_c("strand") == "+"), _n("r_start") - _c("r_end")).when(same, _c("r_start") - _n("r_end")).otherwise(opposite)
    dist_read = _n("q_start") - _c("q_end")
    return {"same_contig": _c("contig") == _n("contig"), "same_strand": same, "dist_read": dist_read, "dist_ref": dist_ref, "deviation": dist_read - dist_ref}


def spans() -> list[Column]:
    """Read and reference spans of both segments."""
    return [F.greatest(f(end) - f(start), F.lit(0)) for f in (_c, _n) for start, end in (("q_start", "q_end"), ("r_start", "r_end"))]


def valid_ins(size: Column) -> Column:
    """Long insertions pass with weaker evidence than short ones."""
    mapq, span = F.least(_c("mapq"), _n("mapq")), F.least(*spans())
    return F.when(size >= 1000, (mapq >= 10) & (span >= 80)).otherwise((mapq >= 20) & (span >= 200))


def valid_short_inv(size: Column) -> Column:
    """Short inversions need long segments that nearly touch on the read."""
    c_span, n_span = (F.least(*spans()[k : k + 2]) for k in (0, 2))
    gap = _n("q_start") - _c("q_end")
    return (size >= 5000) | ((c_span >= 500) & (n_span >= 500) & (gap >= -200) & (gap <= 500))


def classify(region: tuple[Column, Column] | None = None, strict: bool = True, max_size: int = MAX_SIZE) -> Column:
    """struct(svtype, start, size, contig, contig2, end2, dir1, dir2) of a pair, null if it shows no variant.

    strict: the caller's quality, size and region tests; without them the generator's rules hold.
    """
    g = pair_geometry()
    plus = _c("strand") == "+"
    inside = (lambda s: (s >= region[0]) & (s <= region[1])) if region else (lambda s: F.lit(True))
    good = (F.least(_c("mapq"), _n("mapq")) >= MIN_MAPQ) if strict else F.lit(True)
    near = F.when(plus, _c("r_end")).otherwise(_c("r_start"))
    far = F.when(plus, _n("r_start")).otherwise(_n("r_end"))
    cap = (lambda s: s <= max_size) if strict and max_size else (lambda s: F.lit(True))

    def sv(kind: str, start: Column, size: Column, test: Column) -> Column:
        none = F.lit(None)
        fields = {"svtype": F.lit(kind), "start": start.cast("bigint"), "size": size.cast("bigint"), "contig": _c("contig"), "contig2": none.cast("string"), "end2": none.cast("bigint"), "dir1": none.cast("string"), "dir2": none.cast("string")}
        return F.when(test, F.struct(*[v.alias(k) for k, v in fields.items()]))

    # insertions and deletions
    middle = F.floor((near + far) / 2)
    ins_start = F.when(F.col("long_pair"), F.least(near, far)).otherwise(middle) if strict else middle
    ins = sv("INS", ins_start, g["deviation"], (g["deviation"] >= MIN_SIZE) & (valid_ins(g["deviation"]) if strict else F.lit(True)) & inside(ins_start))
    del_start = F.when(plus, _c("r_end")).otherwise(_n("r_end"))
    dele = sv("DEL", del_start, -g["deviation"], (-g["deviation"] >= MIN_SIZE) & good & inside(del_start))
    # duplications
    dup_start = F.when(plus, _n("r_start")).otherwise(_c("r_start"))
    dup_size = F.when(plus, _c("r_end")).otherwise(_n("r_end")) - dup_start
    dup = sv("DUP", dup_start, dup_size, good & ((dup_size >= MIN_SIZE) & cap(dup_size) if strict else F.lit(True)))
    # inversions: the next segment lies behind the current one, or before it
    behind, before = _n("r_start") - _c("r_end") >= -OVERLAP, _c("r_start") - _n("r_end") >= -OVERLAP
    inv_start = F.when(plus, F.when(behind, _c("r_end")).otherwise(_n("r_end"))).otherwise(F.when(behind, _c("r_start")).otherwise(_n("r_start")))
    inv_end = F.when(plus, F.when(behind, _n("r_end")).otherwise(_c("r_end"))).otherwise(F.when(behind, _n("r_start")).otherwise(_c("r_start")))
    inv_size = inv_end - inv_start
    inv_good = (good & inside(inv_start) & (inv_size >= MIN_SIZE) & cap(inv_size) & valid_short_inv(inv_size)) if strict else F.lit(True)
    inv = sv("INV", inv_start, inv_size, (behind | before) & inv_good)
    # translocations: sides are ordered by contig name, their directions stay as read
    next_side = F.when(plus == (_n("strand") == "+"), F.when(plus, _n("r_start")).otherwise(_n("r_end"))).otherwise(F.when(plus, _n("r_end")).otherwise(_n("r_start")))
    swap = _c("contig") > _n("contig")
    tra = F.struct(
        F.lit("TRA").alias("svtype"), F.when(swap, next_side).otherwise(near).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("size"),
        F.least(_c("contig"), _n("contig")).alias("contig"), F.greatest(_c("contig"), _n("contig")).alias("contig2"), F.when(swap, near).otherwise(next_side).cast("bigint").alias("end2"),
        F.when(plus, "fwd").otherwise("rev").alias("dir1"), F.when(_n("strand") == "+", "fwd").otherwise("rev").alias("dir2"),
    )
    colinear = (g["dist_ref"] >= -MIN_SIZE) | F.col("long_pair")
    return (
        F.when(~g["same_contig"], tra)
        .when(~g["same_strand"], inv)
        .when(~colinear, dup)
        .when(g["deviation"] > 0, ins)
        .when(g["deviation"] < 0, dele)
    )
