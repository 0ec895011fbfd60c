"""Questionnaire scoring.

Two forms with the same results. ``score_items`` aggregates long item rows.
``score_wide`` scores respondents whose answers all sit in one row: each subscale is
an expression over its columns, so nothing is exploded or shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import (
    all_or_null,
    binary_answer,
    columns_containing,
    columns_starting,
    item_number,
    ratio,
    reverse_code,
    slider_to_scale,
    subscale_label,
    to_int,
    zero_hundred_to_scale,
)
from cohortspark.functions.scalars import LABEL_GAPS
from cohortspark.plans.scales import KeyItem, Scale, SurveyKeys

from .reshape import col


def pair_response(days: Column, nearly_daily: Column) -> Column:
    """Days per week scaled to 0..3, or 4 when the two-week question is a yes (1)."""
    scaled = days.cast("double") * F.lit(3.0 / 7.0)
    return F.when(nearly_daily == 1, F.lit(4.0)).otherwise(scaled)


def attach_key(
    long: DataFrame, key: DataFrame | Sequence[KeyItem], on: Sequence[str] = ("item",)
) -> DataFrame:
    """Look up subscale and reverse flag of every item row.

    A list of key items is broadcast: it holds one entry per printed question. A key
    table is joined without a hint, so Spark broadcasts it only if it is small.
    """
    if not isinstance(key, DataFrame):
        rows = [(k.item, k.subscale, k.reverse) for k in key]
        schema = "item int, subscale string, reverse boolean"
        key = F.broadcast(long.sparkSession.createDataFrame(rows, schema))
    return long.join(key, list(on), "left")


def score_items(
    long: DataFrame,
    by: Sequence[str],
    fun: Callable[[Column], Column] = F.sum,
    patch: float | None = None,
    patched: str = "response_patched",
) -> DataFrame:
    """Score, patched score, answered, seen and prorated score per group of item rows."""
    if patch is not None:
        filled = F.coalesce(F.col("response"), F.lit(float(patch)))
        long = long.withColumn(patched, filled)
    score = fun(F.col("response"))
    if fun is F.sum:
        score = F.coalesce(score, F.lit(0.0))
    cells = [score.alias("score")]
    if patched in long.columns:
        cells.append(all_or_null(fun(F.col(patched)), F.col(patched)).alias("score_patched"))
    cells += [
        F.count("response").alias("n_items_responded"),
        F.count(F.lit(1)).alias("n_items_seen"),
    ]
    adjusted = ratio(F.col("score"), F.col("n_items_responded")) * F.col("n_items_seen")
    return long.groupBy(*by).agg(*cells).withColumn("score_adj", adjusted)


def score_binary_items(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count of true answers, prorated; ``response`` holds booleans."""
    return score_items(long.withColumn("response", F.col("response").cast("int")), by)


def label_subscales(scored: DataFrame, scale: str) -> DataFrame:
    """Turn subscale names into column-safe labels."""
    kind = F.col("q_type") if "q_type" in scored.columns else None
    return scored.withColumn("subscale", subscale_label(scale, F.col("subscale"), kind))


def _label(scale: str, subscale: str | None, kind: str | None = None) -> str:
    tidy = "NA" if subscale is None else re.sub(LABEL_GAPS, "_", subscale).lower()
    return "_".join(p for p in (scale, kind, tidy) if p)


def _item_columns(
    df: DataFrame, scale: Scale
) -> list[tuple[int | None, str | None, Column]]:
    """(item, kind, answer in scale units) for every item column of a scale.

    Columns without a question number (orders, free text) are items that no key lists.
    """
    number = lambda c: col(c).try_cast("double")
    if scale.layout == "binary":
        # the item number follows a five-character prefix
        return [(item_number(c[5:]), None, number(c)) for c in columns_starting(df, scale.name)]
    names = [c for c in columns_containing(df, scale.name) if c not in scale.ignore]
    if scale.layout == "likert":
        return [(item_number(c[len(scale.name) + 1 :]), None, number(c)) for c in names]
    if scale.layout == "slider":
        return [
            (item_number(c.split("_")[0]), None, slider_to_scale(number(c), scale.points, scale.minimum))
            for c in names
        ]
    if scale.layout == "two_keys":
        split = [(c.split("_"), c) for c in names]
        return [(item_number(s[0]), s[2], zero_hundred_to_scale(number(c))) for s, c in split]
    first, second = scale.kinds
    pairs: dict[str, dict[str, Column]] = {}
    for c in names:
        item, kind = c.split("_")[:2]
        pairs.setdefault(item, {})[kind] = to_int(col(c))
    absent = F.lit(None).cast("int")
    return [
        (item_number(item), None, pair_response(found.get(first, absent), found.get(second, absent)))
        for item, found in pairs.items()
    ]


def _scored(answers: Sequence[str], fun: str, patch: float) -> tuple[Column, Column]:
    """(prorated, patched) score of one subscale of one respondent, from answer columns."""
    plus = lambda part: " + ".join(part.format(a) for a in answers)
    seen = F.lit(float(len(answers)))
    answered = F.expr(plus("int({} is not null)"))
    score = F.expr(plus("coalesce({}, 0D)"))
    filled = F.expr(plus(f"coalesce({{}}, {float(patch)}D)"))
    if fun == "mean":
        score, filled = ratio(score, answered), filled / seen
    return ratio(score, answered) * seen, filled


def _answers(
    df: DataFrame, scale: Scale, keys: SurveyKeys
) -> list[tuple[str, Column]]:
    """(subscale label, scored answer) for every item of one scale."""
    found = []
    for item, kind, answer in _item_columns(df, scale):
        # an item listed under several subscales counts in each of them
        for entry in keys.entries(scale.name, item):
            if scale.subscales == "items":
                label = _label(scale.name, "pos" if item in scale.positive_items else "neg")
            elif scale.subscales == "none":
                label = scale.name
            else:
                label = _label(scale.name, entry.subscale, kind)
            flag = F.lit(entry.reverse).cast("boolean")
            scored = answer
            if scale.layout == "binary":
                scored = binary_answer(answer, flag).cast("double")
            elif scale.ends_sum is not None:
                scored = reverse_code(answer, flag, scale.ends_sum)
            found.append((label, scored))
    return found


def add_scores(
    df: DataFrame, scales: Sequence[Scale], keys: SurveyKeys, id_column: str = "subj_num"
) -> DataFrame:
    """Add ``adj__<label>`` and ``patched__<label>`` per subscale; binary scales only ``<label>``.

    One input row per respondent. Answers become columns first, so each is computed once.
    """
    answers: dict[str, Column] = {}
    groups: list[tuple[Scale, str, list[str]]] = []
    for scale in scales:
        by_label: dict[str, list[str]] = {}
        for label, answer in _answers(df, scale, keys):
            name = f"_answer{len(answers)}"
            answers[name] = answer
            by_label.setdefault(label, []).append(name)
        groups += [(scale, label, columns) for label, columns in by_label.items()]
    # respondents without an id are not scored
    known = col(id_column).isNotNull()
    scores: dict[str, Column] = {}
    for scale, label, columns in groups:
        adj, patched = _scored(columns, scale.fun, scale.patch or 0)
        if scale.layout == "binary":
            scores[label] = adj
        else:
            scores[f"adj__{label}"] = F.when(known, adj)
            scores[f"patched__{label}"] = F.when(known, patched)
    return df.withColumns(answers).withColumns(scores).drop(*answers)


def score_wide(
    df: DataFrame,
    scales: Sequence[Scale],
    keys: SurveyKeys,
    id_column: str = "subj_num",
    ids: Sequence[str] | None = None,
) -> DataFrame:
    """The id columns (``id_column`` unless ``ids`` names others) and all score columns."""
    scored = add_scores(df, scales, keys, id_column)
    made = [c for c in scored.columns if c not in df.columns]
    return scored.select(*[col(c) for c in (*(ids or [id_column]), *made)])
