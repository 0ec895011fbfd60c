"""Missing-value rules: NaN counts as missing, dirty text never raises, 0/0 is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that yields NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


# The JVM parser accepts a trailing type letter ("1d", "2F") and NaN; neither is a number here.
NOT_A_NUMBER = "[dDfFnN] *$"


def to_number(text: Column) -> Column:
    """Text to double; NULL when it is not a plain number."""
    number = text.cast("string").try_cast("double")
    return F.when(~text.cast("string").rlike(NOT_A_NUMBER), number)


def number_sql(name: str) -> str:
    """:func:`to_number` of a text column as SQL, for selecting many columns at once."""
    return f"CASE WHEN NOT `{name}` RLIKE '{NOT_A_NUMBER}' THEN try_cast(`{name}` AS DOUBLE) END"


def to_int(text: Column) -> Column:
    """Text or number to int, cutting the fraction; NULL when unparseable or out of range."""
    return to_number(text).try_cast("int")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column."""
    floats = [name for name, kind in df.dtypes if kind in ("float", "double")]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats})


def sentinel_null(
    df: DataFrame, number: float = -99, text: str = "-99", columns: list[str] | None = None
) -> DataFrame:
    """Blank a missing-answer code: ``number`` in numeric columns, ``text`` in string columns."""
    wanted = set(df.columns if columns is None else columns)
    changed = {}
    for name, kind in df.dtypes:
        if name not in wanted:
            continue
        if kind.startswith(NUMERIC_TYPES):
            changed[name] = F.expr(f"nullif(`{name}`, cast({number} as {kind}))")
        elif kind == "string":
            changed[name] = F.nullif(F.col(f"`{name}`"), F.lit(text))
    return df.withColumns(changed) if changed else df


def text_or_na(col: Column) -> Column:
    """A missing part of a pasted label becomes the text ``NA``."""
    return F.coalesce(col.cast("string"), F.lit("NA"))


def all_or_null(aggregate: Column, inner: Column) -> Column:
    """Aggregate that is NULL as soon as one input value is missing."""
    return F.when(F.count(inner) == F.count(F.lit(1)), aggregate)
