"""Respondent tables: demographics, one survey round, the follow-up, all rounds bound."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import (
    columns_between,
    columns_starting,
    sentinel_null,
)
from cohortspark.plans.scales import (
    FOLLOWUP_MISSING,
    FOLLOWUP_SCALES,
    FOLLOWUP_TOTALS,
    FOLLOWUP_Z,
    MEAN_TOTALS,
    MISSING_LIMITS,
    ROUND_MISSING,
    ROUND_SCALES,
    ROUND_TOTALS,
    ROUND_Z,
    Scale,
    SurveyKeys,
)

from .dedup import keep_first
from .joins import apply_aliases, left_join, union_tagged
from .reshape import col, score_type_long
from .scoring import add_scores, score_wide
from .stats import row_mean, row_total, with_missing_counts, zscore

# Fixed value: label of respondents who ticked several options.
SEVERAL = "More than one race"


def ticked_option(
    df: DataFrame, columns: Mapping[str, Column | str], into: str, unticked: str = "Off"
) -> DataFrame:
    """One output row per ticked column with that column's value; a single NULL row if none.

    ``columns`` maps a tick column to the value it stands for.
    """
    values = [
        F.when(F.nullif(col(c).cast("string"), F.lit(unticked)).isNotNull(), v) for c, v in columns.items()
    ]
    if not values:
        return df.withColumn(into, F.lit(None).cast("double"))
    return df.withColumn(into, F.explode_outer(F.array_compact(F.array(*values))))


def multi_select_label(columns: Sequence[str], several: str = SEVERAL) -> Column:
    """The ticked label, or ``several`` if more than one of the columns is filled."""
    ticked = F.array_compact(F.array(*[col(c) for c in columns]))
    return F.when(F.size(ticked) > 1, F.lit(several)).when(F.size(ticked) == 1, ticked[0])


def multi_select_summary(
    long: DataFrame, ids: Sequence[str], label: str, into: str, several: str = SEVERAL
) -> DataFrame:
    """The same summary for long tick rows: one row per respondent, combined map-side."""
    return long.filter(col(label).isNotNull()).groupBy(*ids).agg(
        F.when(F.count("*") > 1, F.lit(several)).otherwise(F.max(label)).alias(into)
    )


def demographic_columns(df: DataFrame) -> list[str]:
    """Demographic columns present in a label export."""
    head = ["age", "handedness"] if "handedness" in df.columns else ["age"]
    return (
        [*head, "gender"] + columns_starting(df, "race") + ["ethnicity", "edu"]
        + columns_starting(df, "dx")
    )


def demographics(labels: DataFrame, keep: Sequence[str] = (), id_column: str = "subj_num"):
    """Demographics of one-row-per-respondent label data; two ticked ``ses`` give two rows."""
    races, steps = columns_starting(labels, "race"), columns_starting(labels, "ses")
    out = labels
    if "handedness" in labels.columns:
        out = out.withColumn("handedness", F.substring("handedness", 11, 2**31 - 1))
    summary = multi_select_label(races) if races else F.lit(None).cast("string")
    out = out.withColumn("race_summary", summary)
    # the step number starts at the fifth character; the first step is 7
    out = ticked_option(out, {c: F.lit(float(c[4:]) - 6) for c in steps}, "ses")
    chosen = [id_column, *demographic_columns(labels), "ses", "race_summary", *keep]
    return out.select(*[col(c) for c in chosen])


def _with_totals(df: DataFrame, totals: Mapping[str, str], exclude: str | None) -> DataFrame:
    return df.withColumns(
        {
            name: (row_mean if name in MEAN_TOTALS else row_total)(df, text, exclude)
            for name, text in totals.items()
        }
    )


# an id that is never NULL, so that duplicates and joins share one hash partitioning
_KEY = ("_id", "_no_id")


def _keyed(df: DataFrame) -> DataFrame:
    known = {"_id": F.coalesce("subj_num", F.lit("")), "_no_id": F.col("subj_num").isNull()}
    return df.withColumns(known)


def _clean(
    export: DataFrame, id_column: str, order_by: Sequence[Column], aliases: DataFrame | None
) -> DataFrame:
    renamed = _keyed(export.withColumnRenamed(id_column, "subj_num"))
    first = keep_first(renamed, _KEY, order_by)
    if aliases is not None:
        first = _keyed(apply_aliases(first, aliases, "subj_num"))
    return sentinel_null(first, columns=[c for c in first.columns if c not in _KEY])


def survey_round(
    numeric: DataFrame,
    labels: DataFrame,
    keys: SurveyKeys,
    order_by: Sequence[Column],
    id_column: str = "prolific_id",
    aliases: DataFrame | None = None,
    scales: Sequence[Scale] = ROUND_SCALES,
    missing: Mapping[str, str] = ROUND_MISSING,
    totals: Mapping[str, str] = ROUND_TOTALS,
    exclude: str | None = None,
    last_counted: str = "dx_med",
) -> DataFrame:
    """One round: the first row per respondent in ``order_by``, scored, a row per score type.

    ``exclude="^nas_"`` keeps missing counts out of the totals.
    """
    answers = _clean(numeric, id_column, order_by, aliases)
    texts = _clean(labels, id_column, order_by, aliases)
    span = columns_between(texts, "subj_num", last_counted)
    counted = with_missing_counts(texts, missing, within=span)
    people = demographics(counted, keep=[*missing, "nas_total", *_KEY])
    scores = score_wide(answers, scales, keys, ids=_KEY)
    scored = left_join(people, scores, _KEY, na_matches=False).drop(*_KEY)
    return _with_totals(score_type_long(scored), totals, exclude)


def survey_followup(
    numeric: DataFrame,
    keys: SurveyKeys,
    order_by: Sequence[Column],
    response_id: str = "ResponseId",
    link: str = "subj_num",
    scales: Sequence[Scale] = FOLLOWUP_SCALES,
    missing: Mapping[str, str] = FOLLOWUP_MISSING,
    totals: Mapping[str, str] = FOLLOWUP_TOTALS,
    exclude: str | None = None,
    match: str = "prefix",
) -> DataFrame:
    """Follow-up: the first response per linked respondent in ``order_by``, scored."""
    renamed = numeric.withColumnsRenamed({link: "subj_num_2"}).withColumnsRenamed(
        {response_id: "subj_num"}
    )
    first = keep_first(renamed, ["subj_num_2"], order_by).filter("subj_num is not null")
    answers = sentinel_null(first)
    scored = add_scores(answers, scales, keys)
    scores = [c for c in scored.columns if c not in answers.columns]
    counted = with_missing_counts(scored, missing, match=match, within=answers.columns)
    lead = ("subj_num", "nas_total", *missing, "subj_num_2")
    table = counted.select(*lead, *[col(c) for c in scores])
    return _with_totals(score_type_long(table), totals, exclude)


def mask_incomplete(df: DataFrame, limits: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Blank a total whose missing count is above its limit or unknown."""
    return df.withColumns(
        {total: F.when(F.col(nas) <= limit, F.col(total)) for total, (nas, limit) in limits.items()}
    )


def bind_rounds(
    rounds: Mapping[str, DataFrame],
    followup: DataFrame,
    tag: str = "expt_type",
    score_type: str = "patched",
    limits: Mapping[str, tuple[str, float]] = MISSING_LIMITS,
    z: Sequence[str] = ROUND_Z + FOLLOWUP_Z,
) -> DataFrame:
    """All rounds with the follow-up attached, incomplete totals masked, scores standardised."""
    # the score type is chosen before the join: both sides carry the same one
    one = lambda d: d.filter(F.col("score_type") == score_type).drop("score_type")
    stacked = one(union_tagged(dict(rounds), tag))
    linked = one(followup).drop("subj_num", "nas_total")
    joined = left_join(stacked, linked, [("subj_num", "subj_num_2")])
    named = joined.withColumn(
        "gender", F.coalesce(F.col("gender").cast("string"), F.lit("Not reported"))
    )
    return zscore(mask_incomplete(named, limits), {c: f"{c}_z" for c in z})
