"""A study from raw exports to stage tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.grids import fit_grid
from cohortspark.operators.pca import fit_pca, pca_input, pca_scores
from cohortspark.operators.qc import Rules, qc_keep, qc_profile, qc_roster
from cohortspark.operators.surveys import bind_rounds, survey_followup, survey_round
from cohortspark.operators.trials import (
    AMUSEMENT_FEAR,
    POSITIVE_NEGATIVE,
    Experiment,
    clean_trials,
    combine_trials,
    rescale_stimuli,
)
from cohortspark.sources import (
    changed_inputs,
    input_manifest,
    read_stage,
    read_stimuli,
    read_survey,
    read_trials,
    survey_keys,
    write_stage,
)

from .scales import FOLLOWUP_SCALES, PCA_COLUMNS, ROUND_SCALES


@dataclass(frozen=True)
class Study:
    """Input paths and the choices that differ between studies.

    ``totals_exclude="^nas_"`` keeps missing counts out of the totals;
    ``followup_match="contains"`` finds item columns that start with the item number.
    """

    rounds: Mapping[str, tuple[str, str]]
    followup: str
    keys: Mapping[str, str]
    stimuli: str
    logs: Mapping[str, Sequence[str]]
    output: str
    experiments: Sequence[Experiment] = (AMUSEMENT_FEAR, POSITIVE_NEGATIVE)
    aliases: str | None = None
    extra_header_rows: int = 2
    # off: survey answers hold no line breaks, and exports may be split
    multi_line: bool = True
    totals_exclude: str | None = None
    followup_match: str = "prefix"
    rules: Rules = field(default_factory=Rules)
    score_keys: tuple[str, ...] = ("subj_num",)
    pca_columns: tuple[str, ...] = PCA_COLUMNS

    def inputs(self) -> list[str]:
        """Every input file."""
        surveys = [p for pair in self.rounds.values() for p in pair] + [self.followup]
        logs = [p for group in self.logs.values() for p in group]
        return [*surveys, *self.keys.values(), self.stimuli, *logs]


def inputs_changed(spark: SparkSession, study: Study) -> DataFrame:
    """Input files that are new, differ or are gone since the manifest of the last run, if any."""
    current = input_manifest(spark, study.inputs())
    try:
        previous = read_stage(spark, study.output, "manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        previous = None
    return changed_inputs(current, previous)


def questionnaires(spark: SparkSession, study: Study) -> DataFrame:
    """Scores of all participants; stage ``qs_allsubs``."""
    keys = survey_keys(spark, study.keys)
    position = [F.col("split_start"), F.col("row_ord")]
    aliases = spark.read.csv(study.aliases, header=True) if study.aliases else None
    in_round = [s.name for s in ROUND_SCALES]
    in_followup = [s.name for s in FOLLOWUP_SCALES]
    rounds = {}
    for name, (numeric, labels) in study.rounds.items():
        rows = study.extra_header_rows
        codes = read_survey(spark, numeric, rows, in_round, study.multi_line)
        texts = read_survey(spark, labels, rows, multi_line=study.multi_line)
        # an export lists the newest response first
        table = survey_round(
            codes, texts, keys, position, aliases=aliases, exclude=study.totals_exclude
        ).withColumn("age", F.col("age").try_cast("double"))
        rounds[name] = write_stage(table, study.output, f"qs_{name}")
    later = read_survey(
        spark, study.followup, study.extra_header_rows, in_followup, study.multi_line
    )
    started = F.coalesce(
        F.col("StartDate").try_cast("timestamp"), F.to_timestamp(F.lit("9999-12-31"))
    )
    followup = survey_followup(
        later,
        keys,
        [started, *position],
        exclude=study.totals_exclude,
        match=study.followup_match,
    )
    followup = write_stage(followup, study.output, "qs_followup")
    return write_stage(bind_rounds(rounds, followup), study.output, "qs_allsubs")


def trials(spark: SparkSession, study: Study) -> DataFrame:
    """Cleaned trials of all participants; stage ``task_allsubs``."""
    stimuli = rescale_stimuli(read_stimuli(spark, study.stimuli))
    parts = [
        clean_trials(read_trials(spark, study.logs[e.name]), e, stimuli)
        for e in study.experiments
    ]
    return write_stage(combine_trials(parts), study.output, "task_allsubs", ["expt_type"])


def scrubbed(spark: SparkSession, study: Study) -> tuple[DataFrame, DataFrame]:
    """Quality profile and kept trials; stages ``scrub_data``, ``task_goodsubs``, ``badsubs``."""
    task = read_stage(spark, study.output, "task_allsubs")
    people = read_stage(spark, study.output, "qs_allsubs")
    profile = write_stage(qc_profile(task, people, study.rules), study.output, "scrub_data")
    write_stage(qc_roster(profile), study.output, "badsubs")
    good = write_stage(qc_keep(task, profile), study.output, "task_goodsubs", ["emo_block"])
    return profile, good


def components(spark: SparkSession, study: Study) -> DataFrame:
    """Component scores of complete, passing participants; stage ``pcs_goodsubs``."""
    people = read_stage(spark, study.output, "qs_allsubs")
    roster = read_stage(spark, study.output, "badsubs")
    table = write_stage(
        pca_input(people, roster, study.pca_columns), study.output, "qs_goodsubs"
    )
    fit = fit_pca(table, study.pca_columns)
    write_stage(fit.scaling(table), study.output, "qs_pca_scaling")
    write_stage(fit.loadings(table), study.output, "qs_pca_loadings")
    write_stage(fit.variance(table), study.output, "qs_pca_variance")
    scores = pca_scores(table, fit, ["subj_num", "expt_type"])
    return write_stage(scores, study.output, "pcs_goodsubs")


def models(spark: SparkSession, study: Study) -> DataFrame:
    """Coefficients of every contrast and response type; stage ``models``."""
    good = read_stage(spark, study.output, "task_goodsubs")
    scores = read_stage(spark, study.output, "pcs_goodsubs")
    fitted = fit_grid(good, scores, on=study.score_keys)
    return write_stage(fitted, study.output, "models")


def run(spark: SparkSession, study: Study) -> DataFrame:
    """All stages in order; returns the model coefficients."""
    questionnaires(spark, study)
    trials(spark, study)
    scrubbed(spark, study)
    components(spark, study)
    fitted = models(spark, study)
    write_stage(input_manifest(spark, study.inputs()), study.output, "manifest")
    return fitted
