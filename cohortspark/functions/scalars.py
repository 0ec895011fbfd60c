"""Scoring, recoding and labelling expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import ratio, text_or_na

# Fixed value: the character range from space to slash is blanked in subscale names.
LABEL_GAPS = "[ -/]"


def slider_to_scale(x: Column, points: int, minimum: float) -> Column:
    """0..100 slider position to the units of a ``points``-point scale starting at ``minimum``."""
    return x / F.lit(100.0 / (points - 1)) + F.lit(float(minimum))


def zero_hundred_to_scale(x: Column, slope: float = 0.03, offset: float = 1.0) -> Column:
    """Linear rescale of a 0..100 answer, by default to 1..4."""
    return x * F.lit(slope) + F.lit(offset)


def band_to_unit(x: Column, low: float, high: float) -> Column:
    """Map ``low..high`` to 0..1."""
    return (x - F.lit(float(low))) / F.lit(float(high - low))


def reverse_code(x: Column, reverse: Column, ends_sum: float) -> Column:
    """Mirror ``x`` where ``reverse`` holds; an unknown flag gives NULL."""
    return F.when(reverse, F.lit(float(ends_sum)) - x).when(~reverse, x)


def binary_answer(code: Column, reverse: Column) -> Column:
    """Answer code 1/2 as true/false, flipped for reversed items; anything else is NULL."""
    plain = F.when(code == 1, True).when(code == 2, False)
    return F.when(reverse, ~plain).when(~reverse, plain)


def ordinal(label: Column, levels: Sequence[str]) -> Column:
    """Place of a label in a list of levels, from 1; NULL for any other label.

    Beside its label this is an ordered factor: comparisons and sorting go by the ordinal.
    """
    place = F.array_position(F.array(*[F.lit(level) for level in levels]), label)
    return F.nullif(place, F.lit(0)).cast("int")


def recode(x: Column, mapping: Mapping) -> Column:
    """Replace known values, keep the others."""
    result = x
    for old, new in reversed(list(mapping.items())):
        result = F.when(x == F.lit(old), F.lit(new)).otherwise(result)
    return result


def pick_by_version(version: Column, columns: Sequence[str]) -> Column:
    """Value of the column named by ``version``; NULL for an unknown name."""
    chosen = F.lit(None)
    for name in reversed(columns):
        chosen = F.when(version == F.lit(name), F.col(f"`{name}`")).otherwise(chosen)
    return chosen


def unite(*parts: Column, sep: str = "_") -> Column:
    """Paste parts with a separator; missing parts show as ``NA``."""
    return F.concat_ws(sep, *[text_or_na(p) for p in parts])


def subscale_label(scale: str | Column, subscale: Column, kind: Column | None = None) -> Column:
    """``<scale>_[<kind>_]<subscale>`` in lower case with gaps as underscores."""
    head = F.lit(scale) if isinstance(scale, str) else scale
    tidy = F.lower(F.regexp_replace(subscale, LABEL_GAPS, "_"))
    return unite(*[p for p in (head, kind, tidy) if p is not None])


def response_deficit(n: Column, label: Column, wide_label: str, wide: int, narrow: int) -> Column:
    """A tenth of the unanswered trials: ``wide`` expected under ``wide_label``, else ``narrow``."""
    missed = lambda full: F.lit(-0.1) * (n - F.lit(full))
    return F.when(label == wide_label, missed(wide)).when(label != wide_label, missed(narrow))


def bounded_logit(p: Column, low: float = 0.005, high: float = 0.995) -> Column:
    """Logit of a proportion whose exact 0 and 1 are pulled inside."""
    inside = F.when(p == 0, F.lit(low)).when(p == 1, F.lit(high)).otherwise(p)
    return F.ln(ratio(inside, 1 - inside))
