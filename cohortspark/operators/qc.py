"""Participant quality control.

Everything but the reaction-time quantile comes from one pass over the trials: a
map-side combined aggregate per participant and block, then windows over the few
block rows of each participant.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import all_or_null, ordinal, recode, response_deficit

from .joins import left_join
from .stats import group_quantile, zscore


@dataclass(frozen=True)
class Rules:
    """Exclusion rules and the keys that identify a participant."""

    subject_keys: tuple[str, ...] = ("subj_num",)
    # Block sizes, cutoffs and slider tolerance.
    block_sizes: tuple[int, ...] = (43, 54)
    blocks_needed: int = 6
    timeouts_one_block: int = 10
    timeouts_two_blocks: int = 5
    rt_probability: float = 0.75
    rt_floor: float = 500
    lazy_limit: float = 20
    lazy_tolerance: float = 0.01
    age_limit: float = 35


FLAGS = ("enough_trials_seen", "enough_resps", "not_too_fast", "slider_not_lazy", "age_valid")
ROSTER = (
    "subj_num", "expt_type", "age", "n_complete_blocks", "timeouts_1block", "timeouts_2block",
    "rt_75", "n_lazy", *FLAGS,
)

# Contrast labels, their order, and the trial numbers expected per block.
CONTRASTS = {
    "neutral_amusement": "0 to +",
    "neutral_positive": "0 to +",
    "neutral_fear": "0 to -",
    "neutral_negative": "0 to -",
    "amusement_fear": "+ to -",
    "positive_negative": "+ to -",
}
CONTRAST_LEVELS = ("0 to +", "0 to -", "+ to -")
WIDE_CONTRAST, WIDE_TRIALS, NARROW_TRIALS = "+ to -", 54, 43


def complete_blocks(
    trials: DataFrame, subject: Sequence[str], block: str, sizes: Sequence[int]
) -> DataFrame:
    """Number of blocks whose row count is exactly one of ``sizes``; others have no row."""
    counts = trials.groupBy(*subject, block).count().filter(F.col("count").isin(*sizes))
    return counts.groupBy(*subject).agg(F.count("*").alias("n_complete_blocks"))


def responded_trials(
    trials: DataFrame, subject: Sequence[str], block: str, timeout: str = "timeout"
) -> DataFrame:
    """Rows minus timeouts per participant and block."""
    late = F.coalesce(F.sum(timeout), F.lit(0))
    return trials.groupBy(*subject, block).agg(
        (F.count("*") - late).cast("long").alias("n_trials_responded")
    )


def timeout_rules(
    trials: DataFrame,
    subject: Sequence[str],
    block: str,
    one: float,
    two: float,
    timeout: str = "timeout",
) -> DataFrame:
    """Any block with ``one`` timeouts; at least two blocks with ``two`` timeouts."""
    late = trials.groupBy(*subject, block).agg(
        F.coalesce(F.sum(timeout), F.lit(0)).alias("n_timeouts")
    )
    return late.groupBy(*subject).agg(
        F.bool_or(F.col("n_timeouts") >= one).alias("timeouts_1block"),
        (F.count_if(F.col("n_timeouts") >= two) >= 2).alias("timeouts_2block"),
    )


def rt_quantiles(
    answered: DataFrame, subject: Sequence[str], rt: str = "rt", p: float = 0.75
) -> DataFrame:
    """Upper reaction-time quantile per participant and its z-score over participants."""
    found = group_quantile(answered, subject, rt, p, "rt_75")
    return zscore(found, {"rt_75": "rt_quantile_75"})


def _slider_counts(resp: Column, start: Column, tolerance: float, on: Column) -> dict[str, Column]:
    """Per-block counts of answers at either end and at the slider start, over ``on`` rows."""
    near = F.abs(resp - start) < F.lit(tolerance)
    count = lambda test: F.count_if(on & test)
    answered = F.count_if(on) > 0
    # an unknown start makes the whole block's lazy count unknown
    known = F.count_if(on & near.isNull()) == 0
    return {
        "n_0s": F.when(answered, count(resp == 0)),
        "n_100s": F.when(answered, count(resp == 1)),
        "n_lazy": F.when(answered & known, count(near)),
        "_slider": F.count_if(on),
    }


def _block_mean(name: str) -> Column:
    """Mean over slider blocks, one decimal, half to even; unknown if one block is unknown."""
    return F.bround(all_or_null(F.avg(name), F.col(name)), 1).alias(name)


def slider_profile(
    answered: DataFrame,
    subject: Sequence[str],
    block: str,
    resp: str = "resp",
    start: str = "slider_start",
    tolerance: float = 0.01,
) -> DataFrame:
    """Mean number per block of answers at 0, at 1 and within ``tolerance`` of the start."""
    counts = _slider_counts(F.col(resp), F.col(start), tolerance, F.lit(True))
    blocks = answered.groupBy(*subject, block).agg(*[c.alias(n) for n, c in counts.items()])
    return blocks.groupBy(*subject).agg(*[_block_mean(n) for n in ("n_0s", "n_100s", "n_lazy")])


def _block_table(trials: DataFrame, rules: Rules) -> DataFrame:
    answered = F.col("resp").isNotNull()
    slider = answered & (F.col("resp_type") == "cont")
    counts = _slider_counts(
        F.col("resp"), F.col("slider_start"), rules.lazy_tolerance, F.coalesce(slider, F.lit(False))
    )
    return trials.groupBy("subj_num", "expt_type", "block").agg(
        F.count("*").alias("_n"),
        F.coalesce(F.sum("timeout"), F.lit(0)).alias("_late"),
        *[c.alias(n) for n, c in counts.items()],
    )


def qc_profile(
    trials: DataFrame, covariates: DataFrame, rules: Rules = Rules()
) -> DataFrame:
    """Metrics and flags per participant x experiment x age x block.

    ``covariates`` holds ``subj_num, expt_type, age``. It joins the block table, not
    the trials, so only aggregated rows meet it.
    """
    subject = list(rules.subject_keys)
    quantiles = rt_quantiles(timed_answers(trials), subject, p=rules.rt_probability)
    profile = block_profile(trials, covariates, rules)
    return add_flags(left_join(profile, quantiles, subject), rules)


def timed_answers(trials: DataFrame) -> DataFrame:
    """The trials whose reaction times count."""
    return trials.filter((F.col("resp_type") == "cat") & F.col("resp").isNotNull())


def block_profile(
    trials: DataFrame, covariates: DataFrame, rules: Rules = Rules()
) -> DataFrame:
    """The part of :func:`qc_profile` that a participant's own trials decide, but the quantile."""
    subject = list(rules.subject_keys)
    parts = left_join(
        _block_table(trials, rules),
        covariates.select("subj_num", "expt_type", "age"),
        ["subj_num", "expt_type"],
    )
    # a participant's few block rows meet once, for the grouping and for the windows
    parts = parts.repartition(*subject)
    whole = lambda c: F.when(F.count(c) == F.count_if(F.col("_slider") > 0), F.sum(c))
    person = [c for c in ("subj_num", "expt_type", "age") if c not in subject]
    blocks = parts.groupBy(*subject, "block").agg(
        F.sum("_n").alias("_n"),
        F.sum("_late").alias("_late"),
        whole("n_0s").alias("_0s"),
        whole("n_100s").alias("_100s"),
        whole("n_lazy").alias("_lazy"),
        F.sum("_slider").alias("_slider"),
        F.collect_set(F.struct(*person)).alias("_person"),
    )
    over = Window.partitionBy(*subject)
    complete = F.count_if(F.col("_n").isin(*rules.block_sizes)).over(over)
    sliders = F.count_if(F.col("_slider") > 0).over(over)

    def mean(name: str) -> Column:
        known = F.count(F.when(F.col("_slider") > 0, F.col(name))).over(over)
        value = F.avg(F.when(F.col("_slider") > 0, F.col(name))).over(over)
        return F.bround(F.when((known == sliders) & (sliders > 0), value), 1)

    profile = blocks.select(
        *subject,
        "block",
        F.when(complete > 0, complete).alias("n_complete_blocks"),
        (F.col("_n") - F.col("_late")).cast("long").alias("n_trials_responded"),
        F.bool_or(F.col("_late") >= rules.timeouts_one_block).over(over).alias("timeouts_1block"),
        (F.count_if(F.col("_late") >= rules.timeouts_two_blocks).over(over) >= 2).alias(
            "timeouts_2block"
        ),
        mean("_0s").alias("n_0s"),
        mean("_100s").alias("n_100s"),
        mean("_lazy").alias("n_lazy"),
        F.array_distinct(F.flatten(F.collect_set("_person").over(over))).alias("_persons"),
    )
    # the few experiment and age records of the participant, for every block
    return profile.select("*", F.inline("_persons")).drop("_persons")


def add_flags(profile: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The five inclusion flags; an unknown metric leaves its flag unknown."""
    return profile.withColumns(
        {
            "enough_trials_seen": F.col("n_complete_blocks") == rules.blocks_needed,
            "enough_resps": ~(F.col("timeouts_1block") | F.col("timeouts_2block")),
            "not_too_fast": F.coalesce(F.col("rt_75") > rules.rt_floor, F.lit(False)),
            "slider_not_lazy": F.col("n_lazy") < rules.lazy_limit,
            "age_valid": F.col("age") <= rules.age_limit,
        }
    )


def passing(profile: DataFrame, flags: Sequence[str] = FLAGS) -> DataFrame:
    """Rows for which every flag holds."""
    for flag in flags:
        profile = profile.filter(F.col(flag))
    return profile


def qc_keep(trials: DataFrame, profile: DataFrame) -> DataFrame:
    """Trials of passing participants with the contrast as an ordered factor (its label and
    ``emo_block_level``) and response metrics.

    ``profile`` has one passing row per participant, experiment and block.
    """
    good = passing(profile).select(
        "subj_num", "expt_type", "block", "n_trials_responded", "rt_quantile_75"
    )
    keys = ["subj_num", "expt_type", "block"]
    renamed = good.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = test if same is None else same & test
    kept = trials.join(renamed, same, "inner").drop(*[f"_{k}" for k in keys])
    label = recode(F.col("emo_block"), CONTRASTS)
    kept = kept.withColumn("emo_block", F.when(label.isin(*CONTRAST_LEVELS), label))
    kept = kept.withColumn("emo_block_level", ordinal(F.col("emo_block"), CONTRAST_LEVELS))
    deficit = response_deficit(
        F.col("n_trials_responded"), F.col("emo_block"), WIDE_CONTRAST, WIDE_TRIALS, NARROW_TRIALS
    )
    return kept.withColumn("n_trials_responded", deficit)


def qc_roster(profile: DataFrame) -> DataFrame:
    """One row per participant x experiment with metrics and flags, excluded or not."""
    return profile.select(*ROSTER).distinct()
