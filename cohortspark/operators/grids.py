"""Mixed models of a whole grid of contrasts and response types at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import bounded_logit
from cohortspark.session import cut_lineage

from .formulas import Formula, parse_formula, with_factors
from .models import MixedFit, lmm_grid, lmm_stats, model_frame
from .quadrature import MarginalFit, glmm_grid, grid_table

# The models of the two response types.
FORMULA_CAT = (
    "resp ~ stim_level + PC1 + PC2 + stim_level:PC1 + stim_level:PC2 + rt_quantile_75 + n_trials_responded"
    " + (1 + stim_level | subj_num)"
)
FORMULA_CONT = (
    "resp_qlogis ~ stim_level + PC1 + PC2 + stim_level:PC1 + stim_level:PC2 + n_trials_responded"
    " + (1 + stim_level | subj_num)"
)


def fit_formulas(
    df: DataFrame, formula: str | Formula, fit: str, family: str = "gaussian",
    levels: Mapping[str, Sequence[object]] | None = None, **options,
) -> dict[object, MixedFit | MarginalFit]:
    """The mixed model of a formula for every value of ``fit``; one job per iteration serves all.

    ``family`` is ``gaussian`` (a random slope is needed) or ``binomial`` (outcome 0 or 1).
    ``levels`` makes factors of columns. Rows with a missing value leave. ``options`` go to
    ``lmm_grid`` or ``glmm_grid``.
    """
    model = parse_formula(formula) if isinstance(formula, str) else formula
    if model.group is None:
        raise ValueError("a mixed model needs a group")
    rows, model = with_factors(df, model, levels or {})
    if family == "binomial":
        return glmm_grid(rows, model.outcome, model.terms, fit, model.group, model.slope, **options)
    if family != "gaussian" or model.slope is None:
        raise ValueError("gaussian models with a random slope, or binomial ones, can be fitted")
    kept = rows.filter(F.col(fit).isNotNull() & F.col(model.group).isNotNull())
    stats = cut_lineage(lmm_stats(kept, model.outcome, model.terms, [fit, model.group]))
    return lmm_grid(stats, model.terms, fit, model.group, model.slope, **options)


def _fit_blocks(
    trials: DataFrame, scores: DataFrame, blocks: Sequence[str], resp_type: str, on: Sequence[str]
) -> dict[str, MixedFit | MarginalFit]:
    """Models of several contrasts from one pass over the trials of a response type."""
    frame = model_frame(trials, scores, tuple(blocks), resp_type, on)
    if resp_type == "cat":
        return fit_formulas(frame, FORMULA_CAT, "emo_block", "binomial")
    logit = frame.withColumn("resp_qlogis", bounded_logit(F.col("resp")))
    return fit_formulas(logit, FORMULA_CONT, "emo_block")


def fit_cell(
    trials: DataFrame, scores: DataFrame, emo_block: str, resp_type: str, on: Sequence[str] = ("subj_num",),
) -> MixedFit | MarginalFit:
    """The model of one contrast and response type."""
    return _fit_blocks(trials, scores, (emo_block,), resp_type, on)[emo_block]


def fit_grid(
    trials: DataFrame,
    scores: DataFrame,
    blocks: Sequence[str] = ("0 to +", "0 to -"),
    types: Sequence[str] = ("cat", "cont"),
    on: Sequence[str] = ("subj_num",),
) -> DataFrame:
    """All models of the grid: ``emo_block, resp_type`` and their coefficients.

    The trials of a response type are reduced once, and its models iterate together: the
    number of jobs does not grow with the number of contrasts. Contrasts without complete rows
    have no model.
    """
    tables = []
    for kind in types:
        fits = _fit_blocks(trials, scores, blocks, kind, on)
        table = grid_table(trials.sparkSession, fits, "emo_block", trials.schema["emo_block"].dataType)
        tables.append(table.select("emo_block", F.lit(kind).alias("resp_type"), *table.columns[1:]))
    return reduce(DataFrame.unionByName, tables)
