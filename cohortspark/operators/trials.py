"""Trial logs of several experiments brought to one schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import (
    band_to_unit,
    pick_by_version,
    recode,
    to_int,
    to_number,
    unite,
)

from .dedup import keep_first
from .joins import left_join, union_tagged
from .ordering import next_value
from .reshape import col

# Log column names and the names they get.
LOG_COLUMNS = {
    "Participant Public ID": "subj_num",
    "Trial Number": "trial_num",
    "Screen Name": "trial_screen",
    "Reaction Time": "rt",
    "Response": "resp",
    "Timed Out": "timeout",
    "Spreadsheet Name": "cb_order",
    "display": "resp_type",
    "promptLText": "prompt_l",
    "promptRText": "prompt_r",
}
COUNTERBALANCE = (
    "counterbalance-hhri", "counterbalance-ib52", "counterbalance-57z1", "counterbalance-4r2c",
)
STIMULUS_LISTS = ("fnameV1", "fnameV2", "fnameV3", "fnameV4", "fnameV5")
RESPONSE_TYPES = {"trialCat": "cat", "trialCont": "cont"}
TRIAL_RUNS = (1, 2, 3, 4, 5, 6)
TRIAL_SCREEN = "gif"
RT_OFFSET = 5000
NO_RESPONSE = 999
CAT_FIRST = "CatFirst"

# Upper ends and lower ends of the rated stimulus levels.
LEVEL_BANDS = {"amuse": (0, 5), "fear": (0, 5), "bipolar": (-2, 2)}

ORDINAL = ("source", "file_rank", "split_start", "row_ord")


@dataclass(frozen=True)
class Experiment:
    """Labels of one experiment; ``slider_start`` is a column name or a constant."""

    name: str
    positive: str
    negative: str
    slider_start: str | float


# The two experiments.
AMUSEMENT_FEAR = Experiment("amusement_fear", "amusement", "fear", 0.5)
POSITIVE_NEGATIVE = Experiment("positive_negative", "positive", "negative", "sliderStart")


def rescale_stimuli(stimuli: DataFrame) -> DataFrame:
    """Stimulus levels to 0..1."""
    return stimuli.withColumns(
        {c: band_to_unit(F.col(c).cast("double"), *ends) for c, ends in LEVEL_BANDS.items()}
    )


def response_code(
    text: Column, block: Column, positive: str, negative: str, neutral: str = "neutral"
) -> Column:
    """Labels to 0/1, numbers kept: the negative label is 1 in every block, the positive
    one depends on what it stands against."""
    is_positive = text == positive.upper()
    return (
        F.when(text == neutral.upper(), 0)
        .when(text == negative.upper(), 1)
        .when((block == f"cat_{neutral}_{positive}") & is_positive, 1)
        .when((block == f"cat_{positive}_{negative}") & is_positive, 0)
        .otherwise(to_int(text))
    )


def response_scaled(resp: Column, resp_type: Column, timeout: Column) -> Column:
    """Blank the no-response code, slider answers to 0..1, untouched timed-out sliders to NULL."""
    answered = F.nullif(resp.cast("int"), F.lit(NO_RESPONSE)).cast("double")
    value = F.when(resp_type == "cont", answered / 100).when(resp_type != "cont", answered)
    return F.when((value == 0.5) & (timeout == 1), None).otherwise(value)


def level_by_block(
    block: Column, positive: str, negative: str, neutral: str = "neutral"
) -> Column:
    """The stimulus dimension that a block varies."""
    both = lambda pair: block.isin(f"cat_{pair}", f"cont_{pair}")
    return (
        F.when(both(f"{neutral}_{positive}"), F.col("amuse"))
        .when(both(f"{neutral}_{negative}"), F.col("fear"))
        .when(both(f"{positive}_{negative}"), F.col("bipolar"))
    )


def slider_timeouts(
    rows: DataFrame, keys: Sequence[str], order_by: Sequence[str], chunk: str
) -> DataFrame:
    """A slider row takes the timeout mark of the row that follows it."""
    seen = next_value(rows, keys, order_by, "timeout", "_next", chunk)
    slider = F.col("resp_type") == "cont"
    marked = F.when(slider, F.col("_next")).when(~slider, F.col("timeout"))
    return seen.withColumn("timeout", marked).drop("_next")


def clean_trials(log: DataFrame, experiment: Experiment, stimuli: DataFrame) -> DataFrame:
    """One experiment's log to the common trial schema.

    ``log`` holds text columns named as in the export plus the ordinal columns that
    :func:`cohortspark.sources.read_trials` adds; ``stimuli`` is rescaled.
    """
    kept = log.filter(to_number(F.col("randomise_trials")).isin(*TRIAL_RUNS))
    start = experiment.slider_start
    slider_start = to_number(F.col(start)) / 100 if isinstance(start, str) else F.lit(start)
    rows = kept.select(
        *[col(old).alias(new) for old, new in LOG_COLUMNS.items()],
        *[col(c) for c in (*COUNTERBALANCE, *STIMULUS_LISTS)],
        slider_start.alias("slider_start"),
        *ORDINAL,
    ).filter(F.col("trial_screen") == TRIAL_SCREEN)

    rows = rows.withColumns(
        {
            "trial_num": to_int(F.col("trial_num")),
            "rt": to_number(F.col("rt")) - RT_OFFSET,
            "timeout": to_int(F.col("timeout")).cast("double"),
            "resp_type": recode(F.col("resp_type"), RESPONSE_TYPES),
            "list_version": F.coalesce(*[col(c) for c in COUNTERBALANCE]),
        }
    )
    rows = rows.withColumns(
        {
            "rt_secs": F.col("rt") / 1000,
            "fname_seen": pick_by_version(F.col("list_version"), STIMULUS_LISTS),
            "cb_resp_order": F.when(F.endswith("cb_order", F.lit(CAT_FIRST)), "cat_first").when(
                ~F.endswith("cb_order", F.lit(CAT_FIRST)), "cont_first"
            ),
        }
    ).drop(*COUNTERBALANCE, *STIMULUS_LISTS)

    # submit rows carry the slider's timeout and leave only afterwards
    rows = slider_timeouts(rows, ["file_rank", "subj_num"], ["row_ord"], "split_start")
    rows = rows.withColumns(
        {
            "block": F.lower(unite(F.col("resp_type"), F.col("prompt_l"), F.col("prompt_r"))),
            "emo_block": F.lower(unite(F.col("prompt_l"), F.col("prompt_r"))),
            "resp_label": F.col("resp"),
        }
    )
    sides = (experiment.positive, experiment.negative)
    rows = rows.withColumn("resp", response_code(F.col("resp_label"), F.col("block"), *sides))
    rows = rows.filter(F.col("resp").isNotNull())

    rows = left_join(rows, stimuli, [("fname_seen", "fname")], na_matches=False)
    return rows.withColumns(
        {
            "stim_level": level_by_block(F.col("block"), *sides),
            "resp": response_scaled(F.col("resp"), F.col("resp_type"), F.col("timeout")),
            "expt_type": F.lit(experiment.name),
        }
    )


def combine_trials(experiments: Sequence[DataFrame]) -> DataFrame:
    """Stack experiments and keep the first showing of a stimulus per participant and block."""
    ranked = {str(i): e.drop("trial_screen") for i, e in enumerate(experiments)}
    stacked = union_tagged(ranked, "_experiment")
    first = keep_first(
        stacked,
        ["subj_num", "block", "fname_seen"],
        [F.col("_experiment").cast("int"), "file_rank", "split_start", "row_ord"],
    )
    return first.drop("_experiment", *ORDINAL)
