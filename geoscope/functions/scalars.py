"""Column expressions. All are native Spark expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: class families, their markers and the order in which they are tried ---
# ("contains" looks anywhere in the class name, "starts" only at its beginning)
CLASS_FAMILIES = [
    ("contains", ["Iron"], "Météorites de fer"),
    ("contains", ["Pallasite", "Mesosiderite"], "Métallo-rocheuses"),
    ("contains", ["Eucrite", "Diogenite", "Howardite"], "Achondrites HED"),
    ("contains", ["Ureilite", "Angrite", "Aubrite"], "Autres achondrites"),
    ("starts", ["H"], "Chondrites H"),
    ("starts", ["L"], "Chondrites L"),
    ("starts", ["LL"], "Chondrites LL"),
    ("starts", ["CI", "CM", "CO", "CV", "CK", "CR"], "Chondrites carbonées"),
    ("starts", ["E"], "Chondrites E"),
    ("contains", ["Martian", "Shergottite", "Nakhlite"], "Météorites martiennes"),
    ("contains", ["Lunar"], "Météorites lunaires"),
]
NO_FAMILY = "Autres"
# --- end of fixed values ---


def _double(value: Column | str | float) -> Column:
    if isinstance(value, (int, float)):
        return F.lit(float(value))
    return F.col(value) if isinstance(value, str) else value


def clamp(value: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), _double(value)))


def log_transform(value: Column | str, floor: float = 0.1) -> Column:
    """log10 in which values at or below zero count as ``floor``."""
    v = _double(value).cast("double")
    return F.log10(F.when(v <= 0, F.lit(float(floor))).otherwise(v))


def class_group(recclass: Column | str, fixed_order: bool = False) -> Column:
    """Family of a raw class name.

    By default the ``L`` prefix is tried before ``LL`` and before ``Lunar``, so both end in
    "Chondrites L"; ``fixed_order`` tries the longer markers first.
    """
    c = _double(recclass)
    rules = list(CLASS_FAMILIES)
    if fixed_order:
        rules.sort(key=lambda rule: not any(m in ("LL", "Lunar") for m in rule[1]))
    out = None
    for how, markers, family in rules:
        hits = [c.contains(m) if how == "contains" else c.startswith(m) for m in markers]
        test = hits[0]
        for hit in hits[1:]:
            test = test | hit
        out = F.when(test, F.lit(family)) if out is None else out.when(test, F.lit(family))
    return out.otherwise(F.lit(NO_FAMILY))


def probability_band(p: Column | str) -> Column:
    p = _double(p)
    return (
        F.when(p >= 0.75, "very_probable").when(p >= 0.5, "probable").when(p >= 0.25, "possible").otherwise("unlikely")
    )


def _tier(score: Column, low: float, high: float) -> Column:
    return F.when(score < low, "danger").when(score < high, "warning").otherwise("success")


def confidence_tier(score: Column | str) -> Column:
    return _tier(_double(score), 40, 75)


def reliability_tier(score: Column | str) -> Column:
    return _tier(_double(score), 30, 70)


def fall_code(fall: Column | str) -> Column:
    """Fell → 0, Found → 1, anything else → null."""
    f = _double(fall)
    return F.when(f == "Fell", 0).when(f == "Found", 1)


def share(part: Column | str, whole: Column | str) -> Column:
    """part / whole as a double; null when whole is zero."""
    return F.try_divide(_double(part).cast("double"), _double(whole).cast("double"))


NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"


def number(name: str) -> Column:
    """Numeric value of a text column, null when it is not written as a number. The pattern keeps
    out what a cast alone would accept: NaN, and the Java-only spellings ``1d`` / ``1f``."""
    text = F.col(name)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))
