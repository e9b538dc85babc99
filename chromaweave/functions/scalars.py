"""Column functions without state: names, sequences, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements; the IUPAC table has Y complement R here.
PLAIN = ("acgtACGT", "tgcaTGCA")
IUPAC = ("AGCTagctWSKMYRnN", "TCGAtcgaWSMKRYnN")
AMBIGUOUS = "[NRYKMSWBDHV]"


def reverse_complement(seq: Column, iupac: bool = False) -> Column:
    return F.reverse(F.translate(seq, *(IUPAC if iupac else PLAIN)))


def parse_number(text: Column) -> Column:
    """DOUBLE value of an integer or decimal text, else null."""
    return F.coalesce(text.try_cast("bigint").cast("double"), text.try_cast("double"))


def gc_content(seq: Column) -> Column:
    """Share of C and G; null for an empty sequence."""
    rest = F.length(F.regexp_replace(F.lower(seq), "[cg]", ""))
    return (F.length(seq) - rest) / F.nullif(F.length(seq), F.lit(0)).cast("double")


def del_n(seq: Column) -> Column:
    """Without N at its ends; null where another ambiguous base is left."""
    trimmed = F.regexp_replace(F.upper(seq), "^N+|N+$", "")
    return F.when(~trimmed.rlike(AMBIGUOUS), trimmed)


def wrap(seq: Column, width: int = 70) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def degree_penalty(degree: Column, mu: float, squared: bool = False) -> Column:
    """0 for leaves, else -mu * degree (or its square)."""
    if mu <= 0:
        raise ValueError("mu must be positive")
    d = degree.cast("double")
    return F.when(degree == 1, F.lit(0.0)).otherwise(-mu * (d * d if squared else d))


def nlog10(x: Column, least: float = 1e-323) -> Column:
    return F.abs(F.log10(F.greatest(x, F.lit(least))))


def _affinity_terms(total: float, fp: float, typ: float) -> tuple[float, float]:
    """The weight of a score and the background."""
    import math

    typ = 1.000001 if typ <= 1 else float(typ)
    w = math.log(typ) / ((fp - total) or 0.1)
    return w, 2 * typ * math.exp(w * total)


def affinity(scores: Column, total: float, fp: float, typ: float) -> Column:
    """Regional affinity of normalised window scores: sum of weights over itself plus a background."""
    w, b = _affinity_terms(total, fp, typ)
    a = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(F.lit(w) * x))
    return a / (a + b)


def affinity_of_rows(score: Column, total: float, fp: float, typ: float) -> Column:
    """:func:`affinity` of a group's rows, as an aggregate that combines before it shuffles."""
    w, b = _affinity_terms(total, fp, typ)
    a = F.sum(F.exp(F.lit(w) * score))
    return a / (a + b)


def region_key(header: Column) -> Column:
    """chrom:mid of 'chrom:lo-hi' or 'genome_chrom_lo_hi_strand' headers; null for others."""

    def mid(pattern):
        lo, hi = F.regexp_extract(header, pattern, 2), F.regexp_extract(header, pattern, 3)
        return F.concat_ws(":", F.regexp_extract(header, pattern, 1), F.floor((lo.cast("long") + hi.cast("long")) / 2).cast("string"))

    tools, galaxy = r"^([^:\s]+):([0-9]+)-([0-9]+)", r"^[^_\s]+_([^_\s]+)_([0-9]+)_([0-9]+)"
    return F.when(header.rlike(tools), mid(tools)).when(header.rlike(galaxy), mid(galaxy))


def tf_names(cluster: Column, delim: str = ".") -> Column:
    """Names of a cluster without empty ones and ones with a space."""
    return F.filter(F.split(cluster, "\\" + delim), lambda x: (x != "") & ~x.contains(" "))


def clean_cluster(cluster: Column) -> Column:
    """Distinct sorted names without '$'; the original names where nothing is left."""
    parts = F.split(cluster, r"\.")
    good = F.filter(parts, lambda x: (x != "") & ~x.contains("$"))
    return F.array_join(F.array_sort(F.array_distinct(F.when(F.size(good) > 0, good).otherwise(parts))), ".")


def source_names(source: Column) -> Column:
    """Factor names of a motif's source text, joined by '.': groups between ';', of which the third tab field counts, or all of a group without tabs.

    Names are upper-cased and sorted; those with brackets, ':', '-', '/', '.', a blank or
    'Delta', and groups that speak of species or inclusion, are left out.
    """
    groups = F.transform(F.split(source, ";"), lambda g: F.transform(F.split(g, "\t"), lambda x: F.trim(x)))
    plain = lambda g: (F.size(g) == 1) & ~F.element_at(g, 1).contains("Species") & ~F.element_at(g, 1).contains("included")
    names = F.transform(groups, lambda g: F.when(F.size(g) > 2, F.get(g, F.lit(2))).when(plain(g), F.element_at(g, 1)))
    good = F.filter(names, lambda n: n.isNotNull() & (n != "") & ~n.rlike(r"[():/. -]|Delta"))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(good, F.upper))), ".")
