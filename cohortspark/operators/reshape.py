"""Wide to long and back.

Wide-to-long goes through ``inline(array(struct ...))``: a generator keeps the
partitioning of its input, so a frame already hashed by participant is melted,
scored and widened again without another exchange.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import item_number, slider_to_scale


def col(name: str) -> Column:
    """Column by exact name, dots and blanks included."""
    return F.col(f"`{name}`")


def melt(df: DataFrame, ids: Sequence[str], rows: Sequence[dict[str, Column]]) -> DataFrame:
    """Emit one output row per dict in ``rows`` for every input row; NULL values are kept."""
    records = [F.struct(*[c.alias(name) for name, c in row.items()]) for row in rows]
    return df.select(*[col(i) for i in ids], F.inline(F.array(*records)))


def unpivot(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str
) -> DataFrame:
    """Key/value rows from the listed columns."""
    return melt(df, ids, [{name: F.lit(v), value: col(v)} for v in values])


def _item(text: str) -> Column:
    """Question number of an item column, NULL where the name has none."""
    return F.lit(item_number(text)).cast("int")


def items_long_likert(df: DataFrame, ids: Sequence[str], prefix: str) -> DataFrame:
    """Columns ``<prefix>_<item>`` to rows ``(item, response)``."""
    head = f"{prefix}_"
    names = [c for c in df.columns if c.startswith(head)]
    return melt(
        df,
        ids,
        [
            {"item": _item(c[len(head) :]), "response": col(c).cast("double")}
            for c in names
        ],
    )


def items_long_slider(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], points: int, minimum: float
) -> DataFrame:
    """Columns ``<item>_<scale>_<filler>`` (0..100) to rows in scale units."""
    return melt(
        df,
        ids,
        [
            {
                "item": _item(c.split("_")[0]),
                "response": slider_to_scale(col(c).cast("double"), points, minimum),
            }
            for c in columns
        ],
    )


def unpivot_pairs(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    measures: Sequence[str],
    cast: str = "int",
) -> DataFrame:
    """Columns ``<item>_<measure>[_x]`` to one row per item with a column per measure."""
    by_item: dict[str, dict[str, str]] = {}
    for c in columns:
        item, measure = c.split("_")[:2]
        by_item.setdefault(item, {})[measure] = c
    rows = []
    for item, found in by_item.items():
        row = {"item": _item(item)}
        for m in measures:
            row[m] = (col(found[m]) if m in found else F.lit(None)).cast(cast)
        rows.append(row)
    return melt(df, ids, rows)


def unpivot_two_keys(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns ``<item>_<scale>_<q_type>_<x>`` to rows ``(item, q_type, response)``."""
    rows = []
    for c in columns:
        parts = c.split("_")
        rows.append(
            {
                "item": _item(parts[0]),
                "q_type": F.lit(parts[2]),
                "response": col(c).cast("double"),
            }
        )
    return melt(df, ids, rows)


def score_type_long(
    df: DataFrame, kinds: Sequence[str] = ("patched", "adj"), sep: str = "__"
) -> DataFrame:
    """Columns ``<kind><sep><name>`` to one row per kind with a column per name."""
    pattern = re.compile(f"({'|'.join(kinds)}){re.escape(sep)}(.+)")
    found: dict[str, dict[str, str]] = {k: {} for k in kinds}
    ids, names = [], []
    for c in df.columns:
        hit = pattern.fullmatch(c)
        if hit is None:
            ids.append(c)
            continue
        found[hit[1]][hit[2]] = c
        if hit[2] not in names:
            names.append(hit[2])
    rows = []
    for kind in kinds:
        row = {"score_type": F.lit(kind)}
        for n in names:
            row[n] = (col(found[kind][n]) if n in found[kind] else F.lit(None)).cast("double")
        rows.append(row)
    return melt(df, ids, rows)


def widen(
    df: DataFrame,
    ids: Sequence[str],
    names_from: str,
    values: Sequence[str],
    measures: Sequence[str],
    rename: Callable[[str, str], str] = lambda measure, value: f"{measure}__{value}",
) -> DataFrame:
    """One column per listed value and measure; the value list comes from the key, never a job."""
    cells = [F.max(col(m)).alias(m) for m in measures]
    wide = df.groupBy(*ids).pivot(names_from, list(values)).agg(*cells)
    made = (lambda m, v: f"{v}_{m}") if len(measures) > 1 else (lambda m, v: v)
    return wide.withColumnsRenamed({made(m, v): rename(m, v) for m in measures for v in values})


def subscales_wide(
    df: DataFrame, ids: Sequence[str], subscales: Sequence[str], sep: str = "__"
) -> DataFrame:
    """Subscale rows to ``adj<sep><subscale>`` and ``patched<sep><subscale>`` columns."""
    slim = df.withColumnsRenamed({"score_adj": "adj", "score_patched": "patched"})
    return widen(slim, ids, "subscale", subscales, ["adj", "patched"], lambda m, v: f"{m}{sep}{v}")


def split_column(df: DataFrame, column: str, into: tuple[str, str]) -> DataFrame:
    """Split at the first run of non-alphanumeric characters; the rest stays together."""
    parts = r"^([\p{L}\p{N}]*)[^\p{L}\p{N}]+((?s:.*))$"
    text = col(column)
    whole = text.rlike(parts)
    return df.withColumns(
        {
            into[0]: F.when(whole, F.regexp_extract(text, parts, 1)).otherwise(text),
            into[1]: F.when(whole, F.regexp_extract(text, parts, 2)),
        }
    )


def expand_grid(
    df: DataFrame, nested: Sequence[str], factor: str, levels: Column | DataFrame
) -> DataFrame:
    """Observed combinations of ``nested``, each with every level of a design factor.

    ``levels`` is an array of literals, or a table with a column ``factor`` whose distinct
    values count. A table is copied once per salt and joined on the salt of a combination, so
    neither side is gathered in one place.
    """
    observed = df.select(*nested).distinct()
    if not isinstance(levels, DataFrame):
        return observed.withColumn(factor, F.explode(levels))
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*[col(c) for c in nested]), F.lit(salts))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    copies = levels.select(factor).distinct().withColumn("_salt", every)
    joined = observed.withColumn("_salt", salt).join(copies, "_salt")
    return joined.select(*[col(c) for c in nested], factor)
