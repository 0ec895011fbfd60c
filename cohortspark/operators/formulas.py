"""Model formulas: fixed terms, factor contrasts and one group of random effects."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reshape import col

_NAME = r"[^\W\d][\w.]*"
_RANDOM = re.compile(rf"\(([^()|]+)\|\s*({_NAME})\s*\)")


@dataclass(frozen=True)
class Formula:
    """Outcome, fixed terms in order, and per group an intercept and maybe a slope."""

    outcome: str
    terms: tuple[str, ...]
    group: str | None = None
    slope: str | None = None


def _expanded(text: str, formula: str) -> list[str]:
    """Terms of a sum: ``a*b`` stands for ``a + b + a:b``; repeats go, lower orders stay first."""
    terms: list[str] = []
    for part in filter(None, (p.strip() for p in text.split("+"))):
        if part == "1":
            continue
        names = [n.strip() for n in part.replace("*", ":").split(":")]
        if not all(re.fullmatch(_NAME, n) for n in names):
            raise ValueError(f"cannot read the term {part!r} of {formula!r}")
        if "*" in part:
            if ":" in part:
                raise ValueError(f"write the products of {part!r} one by one")
            for size in range(1, 1 << len(names)):
                chosen = ":".join(n for k, n in enumerate(names) if size >> k & 1)
                terms.append(chosen)
        else:
            terms.append(":".join(names))
    order = sorted(dict.fromkeys(terms), key=lambda t: t.count(":"))
    return order if "*" in text else list(dict.fromkeys(terms))


def parse_formula(formula: str) -> Formula:
    """``y ~ a + b + a:b + (1 + x | g)`` as a :class:`Formula`.

    The intercept is always there; a random slope needs a random intercept. Names are letters,
    digits, dots and underscores. Anything else raises ``ValueError``.
    """
    outcome, tilde, right = formula.partition("~")
    outcome = outcome.strip()
    if not tilde or not re.fullmatch(_NAME, outcome):
        raise ValueError(f"no outcome in {formula!r}")
    random = _RANDOM.findall(right)
    fixed = _RANDOM.sub("", right)
    if len(random) > 1 or re.search(r"[()|]", fixed):
        raise ValueError(f"one group of random effects can be fitted: {formula!r}")
    terms = tuple(_expanded(fixed, formula))
    if not random:
        return Formula(outcome, terms)
    effects, group = random[0]
    parts = [p.strip() for p in effects.split("+")]
    slopes = [p for p in parts if p != "1"]
    if "1" not in parts or len(slopes) > 1 or not all(re.fullmatch(_NAME, s) for s in slopes):
        raise ValueError(f"random effects are (1 | g) or (1 + x | g): {formula!r}")
    return Formula(outcome, terms, group, slopes[0] if slopes else None)


def with_factors(
    df: DataFrame, formula: Formula, levels: Mapping[str, Sequence[object]]
) -> tuple[DataFrame, Formula]:
    """Treatment contrasts of the factors among the terms, as columns ``name[level]``.

    ``levels`` lists each factor's levels in order; the first is the reference and has no
    column. Products with a factor become one term per level. A value that is no level, and a
    missing one, is missing in all columns of its factor.
    """
    columns, names = {}, {}
    for factor, listed in levels.items():
        if len(set(listed)) < 2 or len(set(listed)) != len(listed):
            raise ValueError(f"{factor} needs two or more levels, all different")
        if any(re.search(r"[:`]", str(level)) for level in listed):
            raise ValueError(f"a level of {factor} holds a sign that terms are built with")
        known = col(factor).isin(*listed)
        names[factor] = [f"{factor}[{level}]" for level in listed[1:]]
        for name, level in zip(names[factor], listed[1:], strict=True):
            columns[name] = F.when(known, (col(factor) == F.lit(level)).cast("double"))
    terms: list[str] = []
    for term in formula.terms:
        found = [""]
        for part in term.split(":"):
            found = [f"{head}:{name}" if head else name for head in found for name in names.get(part, [part])]
        terms += found
    if formula.slope in names:
        raise ValueError("a random slope needs a number, not a factor")
    return df.withColumns(columns), Formula(formula.outcome, tuple(terms), formula.group, formula.slope)
