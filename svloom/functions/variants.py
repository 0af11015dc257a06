"""Column expressions that parse and format VCF fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def info_value(info: Column, key: str) -> Column:
    """The value of a key of an INFO field; the last one counts, items without = are no keys."""
    items = F.filter(F.split(info, ";"), lambda x: F.substring_index(x, "=", 1).eqNullSafe(F.lit(key)) & x.contains("="))
    return F.substring(F.try_element_at(items, F.lit(-1)), len(key) + 2, 1 << 20)


def whole(value: Column) -> Column:
    """Text to the magnitude of its integer part, 0 where it is no number."""
    return F.coalesce(F.abs(value.try_cast("double")).cast("bigint"), F.lit(0).cast("bigint"))


def sv_type(info: Column, upper: bool) -> Column:
    """First three letters of SVTYPE; upper: in capitals, with TRA as BND."""
    kind = F.coalesce(info_value(info, "SVTYPE"), F.lit(""))
    if not upper:
        return F.substring(kind, 1, 3)
    kind = F.substring(F.upper(kind), 1, 3)
    return F.when(kind == "TRA", "BND").otherwise(kind)


def bnd_alt(alt: Column) -> Column:
    """struct(chr2, pos2, form) of a breakend ALT; what cannot be read is empty or 0."""
    leads = alt.startswith("]") | alt.startswith("[")
    form = F.when(alt.startswith("]"), "]]N").when(alt.startswith("["), "[[N").when(F.substring(alt, 2, 1) == "]", "N]]").otherwise("N[[")
    name = F.substring(F.substring_index(alt, ":", 1), F.when(leads, 2).otherwise(3), F.lit(1 << 20))
    place = F.regexp_extract(alt, r"^[^:]*:\s*([+-]?\d+)\s*(?:[\[\]:]|$)", 1).try_cast("bigint")
    return F.struct(name.alias("chr2"), F.coalesce(place, F.lit(0).cast("bigint")).alias("pos2"), form.alias("form"))


def match_key(pos: Column, info: Column, alt: Column, upper: bool = True) -> Column:
    """struct(svtype, end, svlen, chr2, form): what a record is matched by.

    A breakend's mate comes from CHR2 and END of INFO, else from ALT. A missing length is that of the interval.
    """
    kind, given, stop = sv_type(info, upper), whole(info_value(info, "SVLEN")), whole(info_value(info, "END"))
    named, mate, bnd = F.coalesce(info_value(info, "CHR2"), F.lit("")), bnd_alt(alt), kind == "BND"
    return F.struct(
        kind.alias("svtype"), F.when(bnd & (stop == 0), mate["pos2"]).otherwise(stop).alias("end"), F.when((given == 0) & (stop >= pos), stop - pos + 1).otherwise(given).alias("svlen"),
        F.when(bnd, F.when(named == "", mate["chr2"]).otherwise(named)).alias("chr2"), F.when(bnd, mate["form"]).alias("form"),
    )


def genotype_of(format_: Column, sample: Column) -> Column:
    """GT by its place in FORMAT; missing ones are 1/1, phased ones are written with /."""
    place = F.array_position(F.split(format_, ":"), "GT")
    gt = F.when(place > 0, F.get(F.split(sample, ":"), (place - 1).cast("int")))
    return F.when(gt.isNull() | gt.isin("", ".", "./.", ".|."), "1/1").otherwise(F.replace(gt, F.lit("|"), F.lit("/")))


def len_ok(a: Column, b: Column, bias: float = 0.7) -> Column:
    return F.least(a, b) / F.greatest(a, b, F.lit(1)) >= bias


def vcf_line(contig: Column, pos: Column, svlen: Column, svtype: Column, gt: Column) -> Column:
    """A data line; null for unknown types and negative coordinates. Insertions end where they begin."""
    end = F.when(svtype == "INS", pos).otherwise(pos + svlen)
    info = F.concat(F.lit("SVLEN="), svlen.cast("string"), F.lit(";SVTYPE="), svtype, F.lit(";END="), end.cast("string"), F.lit(";"))
    line = F.concat_ws("\t", contig, pos.cast("string"), F.lit("."), F.lit("N"), F.concat(F.lit("<"), svtype, F.lit(">")), F.lit("."), F.lit("PASS"), info, F.lit("GT"), F.coalesce(gt, F.lit("./.")))
    return F.when(svtype.isin("INS", "DEL", "INV", "DUP") & (pos >= 0) & (end >= 0), line)


def bnd_lines(contig1: Column, start1: Column, dir1: Column, contig2: Column, start2: Column, dir2: Column, gt: Column) -> Column:
    """The two mate lines of a breakend."""
    here, there = F.concat(contig1, F.lit(":"), start1.cast("string")), F.concat(contig2, F.lit(":"), start2.cast("string"))

    def alt(first: str, second: str) -> tuple[Column, Column]:
        wrap = {"N[[": ("N[", "["), "N]]": ("N]", "]"), "]]N": ("]", "]N"), "[[N": ("[", "[N")}
        return tuple(F.concat(F.lit(wrap[f][0]), x, F.lit(wrap[f][1])) for f, x in ((first, there), (second, here)))

    forms = {("fwd", "fwd"): alt("N[[", "]]N"), ("fwd", "rev"): alt("N]]", "[[N"), ("rev", "fwd"): alt("]]N", "N[[")}
    other = alt("[[N", "N]]")
    alts = []
    for k in (0, 1):
        out = F
        for (a, b), pair in forms.items():
            out = out.when((dir1 == a) & (dir2 == b), pair[k])
        alts.append(out.otherwise(other[k]))
    gt = F.coalesce(gt, F.lit("./."))
    row = lambda c, s, a: F.concat_ws("\t", c, s.cast("string"), F.lit("."), F.lit("N"), a, F.lit("."), F.lit("PASS"), F.lit("SVTYPE=BND;"), F.lit("GT"), gt)
    return F.array(row(contig1, start1, alts[0]), row(contig2, start2, alts[1]))
