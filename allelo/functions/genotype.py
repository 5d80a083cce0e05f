"""Column expressions for genotype calls and person metadata.

All functions return native ``Column`` expressions, so they compile into
whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from allelo.functions import vocab

# A diploid call is one digit, a phased ('|') or unphased ('/')
# separator, and one digit; anything else (haploid, multi-digit alleles,
# '.' for missing) counts as the missing value.
DIPLOID_CALL = r"^[0-9][|/][0-9]\z"
PHASED_CALL = r"^[0-9]+\|[0-9]+\z"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dosage(gt, missing: float = 0.0) -> Column:
    """Alternate-allele count of a VCF call (text before the first ':').

    ``0|1`` -> 1, ``1/1`` -> 2, ``1|2`` -> 3 (the two digits are summed),
    ``./.``, ``0``, ``10|1`` -> ``missing``.
    """
    call = F.substring_index(_c(gt), ":", 1)
    a0, sep, a1 = F.substring(call, 1, 1), F.substring(call, 2, 1), F.substring(call, 3, 1)
    digit = lambda c: (c >= F.lit("0")) & (c <= F.lit("9"))
    # same test as DIPLOID_CALL, written as character checks (no regex per cell)
    ok = (F.length(call) == 3) & digit(a0) & digit(a1) & ((sep == "|") | (sep == "/"))
    both = a0.cast("double") + a1.cast("double")
    return F.when(ok, both).otherwise(F.lit(float(missing)))


def dosage_sqrt(gt) -> Column:
    """Legacy square-root dosage ``sqrt(a0 + a1)`` for phased calls; NULL otherwise."""
    g = _c(gt)
    a0 = F.substring_index(g, "|", 1).cast("double")
    a1 = F.substring_index(g, "|", -1).cast("double")
    return F.when(g.rlike(PHASED_CALL), F.sqrt(a0 + a1))


def locus_key(contig, pos) -> Column:
    """``"chr:pos"`` text key."""
    return F.concat_ws(":", _c(contig).cast("string"), _c(pos).cast("string"))


def bmi(height, weight) -> Column:
    """kg/m^2; heights above 10 are centimetres; non-positive inputs give 0."""
    h, w = _c(height).cast("double"), _c(weight).cast("double")
    metres = F.when(h > 10, h / 100.0).otherwise(h)
    return F.when((h > 0) & (w > 0), w / (metres * metres)).otherwise(F.lit(0.0))


def sex_code(sex, ignore_case: bool = False) -> Column:
    """Exact ``FEMALE`` -> 0, ``MALE`` -> 1, anything else -> -1."""
    s = F.upper(_c(sex)) if ignore_case else _c(sex)
    return F.when(s == "FEMALE", 0).when(s == "MALE", 1).otherwise(-1)


def sentinel_double(value, null_string: str) -> Column:
    """Numeric parse where the configured null string means 0."""
    v = _c(value)
    return F.when(v.isNull() | (v == null_string), F.lit(0.0)).otherwise(v.cast("double"))


def super_population(pop, vocabulary: str = "phase3") -> Column:
    """Population code -> super-population; unknown codes give NULL."""
    mapping = vocab.SUPER_POPULATION[vocabulary]
    pairs = []
    for sup, pops in mapping:
        for p in pops:
            pairs += [F.lit(p), F.lit(sup)]
    return F.create_map(*pairs)[_c(pop)]


def label_code(label, scheme: str = "super") -> Column:
    """Fixed label codes (``EUR 0, AFR 1, AMR 2, EAS 3`` ...), unknown -> -1."""
    codes = vocab.LABEL_CODES[scheme]
    m = F.create_map(*[x for k, v in codes for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[_c(label)], F.lit(-1))


def round_half_up(x) -> Column:
    """JVM ``Math.round`` semantics (``floor(x + 0.5)``) as BIGINT."""
    return F.floor(_c(x).cast("double") + 0.5).cast("bigint")


def encode(allele, encoding: str) -> Column:
    """Additive (0,1,2), dominant (0 | 1,2), recessive (0,1 | 2), heterosis (0,2 | 1)."""
    a = _c(allele)
    if encoding == "additive":
        return a.cast("double")
    if encoding == "dominant":
        return F.when(a > 0, 1.0).otherwise(0.0)
    if encoding == "recessive":
        return F.when(a >= 2, 1.0).otherwise(0.0)
    if encoding == "heterosis":
        return F.when(a == 1, 1.0).otherwise(0.0)
    raise ValueError(f"unknown encoding {encoding!r}")
