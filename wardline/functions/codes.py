"""Code-mapping column expressions.

All of these are plain Column expressions, so they run inside whole-stage
codegen and push no data through Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal levels of a medication-change flag (after trim + lower).
DOSE_LEVELS = {"no": 0.0, "down": 1.0, "steady": 2.0, "up": 3.0}

# ICD-9 root-code ranges (inclusive) per diagnosis group.
# Circulatory 390-459 and 785; Respiratory 460-519 and 786; Digestive 520-579
# and 787; Diabetes 250-251; Injury 800-999; Musculoskeletal 710-739;
# Neoplasms 140-239; Genitourinary 580-629 and 788; everything else Other.
ICD_GROUPS = [
    ("Circulatory", [(390, 459), (785, 785)]),
    ("Respiratory", [(460, 519), (786, 786)]),
    ("Digestive", [(520, 579), (787, 787)]),
    ("Diabetes", [(250, 251)]),
    ("Injury", [(800, 999)]),
    ("Musculoskeletal", [(710, 739)]),
    ("Neoplasms", [(140, 239)]),
    ("Genitourinary", [(580, 629), (788, 788)]),
]
# Groups whose codes stay individual (icd_<n>) in the fine grouping.
ICD_FINE_KEEP = ("Circulatory", "Respiratory", "Digestive", "Diabetes")

# Column-name character substitutions.
NAME_SUBSTITUTIONS = [("[", "_"), ("]", "_"), ("<", "_lt_"), (">", "_gt_"), (",", "_")]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dose_ordinal(c) -> Column:
    """No/Down/Steady/Up -> 0/1/2/3 (case and surrounding spaces ignored); else NULL."""
    v = F.lower(F.trim(_c(c).cast("string")))
    expr = None
    for level, code in DOSE_LEVELS.items():
        expr = (F.when(v == level, F.lit(code)) if expr is None
                else expr.when(v == level, F.lit(code)))
    return expr.otherwise(F.lit(None).cast("double"))


def icd_root(c) -> Column:
    """Integer root of an ICD-9 code ('250.83' -> 250); NULL for V/E codes,
    non-numeric roots and missing values."""
    s = _c(c).cast("string")
    root = F.split(s, r"\.").getItem(0)
    return (F.when(root.startswith("V") | root.startswith("E"), F.lit(None).cast("int"))
            .otherwise(root.try_cast("int")))


def _in_ranges(n: Column, ranges) -> Column:
    cond = None
    for lo, hi in ranges:
        part = (n == lo) if lo == hi else n.between(lo, hi)
        cond = part if cond is None else (cond | part)
    return cond


def icd_coarse(c) -> Column:
    """Nine coarse diagnosis groups (Circulatory ... Other)."""
    return icd_coarse_from_root(icd_root(c))


def icd_coarse_from_root(n: Column) -> Column:
    """Coarse group from an integer root code (NULL -> Other)."""
    expr = None
    for name, ranges in ICD_GROUPS:
        cond = _in_ranges(n, ranges)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return F.coalesce(expr.otherwise(F.lit("Other")), F.lit("Other"))


def icd_fine(c) -> Column:
    """Fine grouping: circulatory/respiratory/digestive/diabetes codes kept as
    ``icd_<n>``; other groups by name; the rest ``Other``."""
    return icd_fine_from_root(icd_root(c))


def icd_fine_from_root(n: Column) -> Column:
    """Fine group from an integer root code (NULL -> Other)."""
    keep = None
    for name, ranges in ICD_GROUPS:
        if name in ICD_FINE_KEEP:
            cond = _in_ranges(n, ranges)
            keep = cond if keep is None else (keep | cond)
    expr = F.when(keep, F.concat(F.lit("icd_"), n.cast("string")))
    for name, ranges in ICD_GROUPS:
        if name not in ICD_FINE_KEEP:
            expr = expr.when(_in_ranges(n, ranges), F.lit(name))
    return F.coalesce(expr.otherwise(F.lit("Other")), F.lit("Other"))


def sanitize_name(name: str) -> str:
    """Column name safe for model libraries: [ ] , -> _ ; < -> _lt_ ; > -> _gt_."""
    out = str(name)
    for a, b in NAME_SUBSTITUTIONS:
        out = out.replace(a, b)
    return out


def binary_flag(c, positive) -> Column:
    """1 where the column equals ``positive``, else 0 (missing -> 0)."""
    return _c(c).eqNullSafe(F.lit(positive)).cast("int")
