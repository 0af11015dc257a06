"""Support thresholds and genotypes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOISY = 0.1
#: mu, sigma, rho of the support curve by type.
CURVES = {"INS": (0.5, 0.7, 0.3), "DEL": (0.5, 0.65, 0.35), "INV": (0.6, 0.7, 0.3), "DUP": (0.5, 0.7, 0.3), "BND": (0.5, 0.65, 0.35)}
#: On noisy reads: mu, and whether it holds up to (-1) or from (1) a coverage.
NOISY_MU = {"INS": (0.6, -1, 10), "BND": (0.6, -1, 10), "DEL": (0.6, 1, 20), "INV": (0.7, 1, 20), "DUP": (0.5, 1, 20)}


def min_support(svtype: Column, coverage: Column, local: Column, error: Column) -> Column:
    """Reads that a call needs, from the global coverage and the reads at its place."""
    out = None
    for kind, (mu, sigma, rho) in CURVES.items():
        noisy_mu, side, limit = NOISY_MU[kind]
        beyond = coverage <= limit if side < 0 else coverage >= limit
        m = F.when((error > NOISY) & beyond, noisy_mu).otherwise(mu)
        tilt = F.when(coverage > 0, F.tanh(F.try_divide(local - coverage, coverage))).otherwise(0.0)
        value = F.greatest(F.lit(1), F.bround(m * F.pow(coverage.cast("double"), F.lit(sigma)) * (1 + rho * tilt)).cast("bigint"))
        if kind in ("DEL", "INV", "DUP"):
            value = F.when(coverage >= 80, F.lit(10).cast("bigint")).otherwise(value)
        out = F.when(svtype == kind, value) if out is None else out.when(svtype == kind, value)
    return out


def adjust_support(
    svtype: Column, svlen: Column, support: Column, scale: float = 1.0, cap: int = 0, ins_scale: float = 1.0, ins_floor: int = 0, ins_short_len: int = 300, ins_short_bonus: int = 0,
    ins_long_len: int = 0, ins_long_delta: int = 0, inv_scale: float = 1.0, inv_floor: int = 0, inv_short_len: int = 3000, inv_short_bonus: int = 0,
) -> Column:
    """Scale and cap, then the bonuses and floors of insertions and inversions; at least 1."""

    def scaled(by: float) -> Column:
        value = F.greatest(F.lit(1), F.bround(support * by).cast("bigint"))
        return F.least(value, F.lit(cap)) if cap > 0 else value

    ins = scaled(ins_scale) + F.when(svlen <= ins_short_len, max(0, ins_short_bonus)).otherwise(0)
    if ins_long_len > 0:
        ins = ins + F.when(svlen >= ins_long_len, ins_long_delta).otherwise(0)
    inv = scaled(inv_scale) + F.when(svlen <= inv_short_len, max(0, inv_short_bonus)).otherwise(0)
    ins, inv = F.greatest(ins, F.lit(max(0, ins_floor))), F.greatest(inv, F.lit(max(0, inv_floor)))
    return F.greatest(F.lit(1), F.when(svtype == "INS", ins).when(svtype == "INV", inv).otherwise(scaled(scale))).cast("bigint")


def bnd_ref_bound(n: Column) -> Column:
    """How many reference reads are looked at for a breakend with n supporting reads."""
    return n * F.when(n <= 2, 20).when(n <= 5, 9).when(n <= 15, 7).otherwise(5)


def geno_error_rate(svtype: Column, support: Column) -> Column:
    ins = F.when(support <= 3, 0.01).otherwise(0.05)
    other = F.when(support <= 2, 0.0).when(support <= 4, 0.01).otherwise(0.05)
    return F.when(svtype == "INS", ins).when(svtype == "BND", F.when(support <= 2, 0.01).otherwise(0.05)).otherwise(other)


def search_bias(svtype: Column) -> Column:
    return F.when(svtype.isin("DEL", "INV", "DUP"), 2000).otherwise(1000)


def _first_best(scores: list[tuple[str, Column]]) -> Column:
    """The name of the largest score, the first one on ties."""
    best = F.greatest(*[s for _, s in scores])
    out = F
    for name, score in scores:
        out = out.when(score == best, name)
    return out


def genotype_loggl(ref: Column, alt: Column, error: Column, bias: float = 0.5) -> Column:
    """Log-likelihood genotype; all priors are equal."""
    e = F.least(F.greatest(error, F.lit(1e-6)), F.lit(1.0 - 1e-6))
    prior = F.log(F.lit(1.0 / 3.0))
    het_ref, het_alt = bias * (1.0 - e) + (1.0 - bias) * e, (1.0 - bias) * (1.0 - e) + bias * e
    scores = [("0/0", prior + (ref * F.log(1.0 - e) + alt * F.log(e))), ("0/1", prior + (ref * F.log(het_ref) + alt * F.log(het_alt))), ("1/1", prior + (ref * F.log(e) + alt * F.log(1.0 - e)))]
    return F.when(ref + alt <= 0, "./.").otherwise(_first_best(scores))


def genotype_bayes(ref: Column, alt: Column, error: Column, bias: float = 0.7) -> Column:
    """Posterior of three genotypes in linear space; it underflows to 0/0 at great depths."""
    third = F.lit(1.0 / 3.0)
    p = [
        F.pow(1.0 - error, ref) * F.pow(error, alt) * third,
        F.pow(bias * (1.0 - error), ref) * F.pow((1.0 - bias) * (1.0 - error), alt) * third,
        F.pow(error, ref) * F.pow(1.0 - error, alt) * third,
    ]
    total = F.greatest(p[0] + p[1] + p[2], F.lit(1e-10))
    return _first_best([(name, x / total) for name, x in zip(("0/0", "0/1", "1/1"), p, strict=True)])


def genotype_em(ref: Column, alt: Column, error: Column, rounds: int = 100) -> Column:
    """Fixed number of rounds over three weights; the likelihoods are computed once and carried along."""
    first = F.struct(
        (F.pow(1.0 - error, ref) * F.pow(error, alt)).alias("l0"), (F.pow(0.5 * (1.0 - error), ref) * F.pow(0.5 * (1.0 - error), alt)).alias("l1"),
        (F.pow(error, ref) * F.pow(1.0 - error, alt)).alias("l2"), *[F.lit(0.3).alias(f"p{k}") for k in range(3)],
    )

    def step(acc, _):
        weighted = F.struct(*[(acc[f"l{k}"] * acc[f"p{k}"]).alias(f"w{k}") for k in range(3)])
        total = lambda w: F.greatest(w["w0"] + w["w1"] + w["w2"], F.lit(1e-50))
        after = lambda w: F.struct(*[acc[f"l{k}"].alias(f"l{k}") for k in range(3)], *[(w[f"w{k}"] / total(w)).alias(f"p{k}") for k in range(3)])
        return F.get(F.transform(F.array(weighted), after), 0)

    def best(p):
        return F.when((p["p0"] > p["p1"]) & (p["p0"] > p["p2"]), "0/0").when((p["p1"] > p["p0"]) & (p["p1"] > p["p2"]), "0/1").otherwise("1/1")

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step, best)


def genotype_ratio(ref: Column, alt: Column, threshold: float = 0.7) -> Column:
    ratio = F.try_divide(ref.cast("double"), (ref + alt).cast("double"))
    return F.when(ref + alt == 0, "./.").when(ratio >= threshold, "0/0").when(ratio <= 1 - threshold, "1/1").otherwise("0/1")


def vote(bayes: Column, em: Column, ratio: Column) -> Column:
    """Majority of three, the first on a tie."""
    return F.when(em == ratio, em).otherwise(bayes)


def genotype_vote(ref: Column, alt: Column, error: Column) -> Column:
    return vote(genotype_bayes(ref, alt, error), genotype_em(ref, alt, error), genotype_ratio(ref, alt, 0.8))
