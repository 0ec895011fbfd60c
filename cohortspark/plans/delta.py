"""Trials and quality rows recomputed only where inputs have changed.

Cleaned rows of a log file are stored under a key made of its path, its digest and all that
cleaning depends on, so an unchanged file is never read again and a changed one gets a new
key. Participants are dealt to shards by their hash. A run finds the shards of participants
that a new, changed, moved or deleted file holds, combines those shards from the stored rows,
and overwrites them in place. What needs all participants, the z-scores of the quantiles, is
taken from the stored narrow rows. The list of keys is written last: a run that dies repeats
the same work on its next start, and nothing of it counts before.

Rows of keys no longer listed stay in the folder and are never read. The library's own code is
not part of a key: after a change of it, use a new output folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.joins import left_join
from cohortspark.operators.qc import add_flags, block_profile, qc_keep, qc_roster, timed_answers
from cohortspark.operators.stats import group_quantile, zscore
from cohortspark.operators.trials import (
    COUNTERBALANCE,
    LOG_COLUMNS,
    ORDINAL,
    STIMULUS_LISTS,
    Experiment,
    clean_trials,
    combine_trials,
    rescale_stimuli,
)
from cohortspark.sources import (
    file_ranks,
    input_manifest,
    read_parts,
    read_stage,
    read_stimuli,
    read_trials,
    write_parts,
    write_stage,
)

from . import study as plans

#: Shards of participants; a change recomputes those it touches.
SHARDS = 256
PEOPLE = ("subj_num", "expt_type", "age")


@dataclass(frozen=True)
class Refreshed:
    """Current trials and profile; what was cleaned and which shards were recomputed."""

    trials: DataFrame
    profile: DataFrame
    cleaned: tuple[str, ...]
    trial_shards: tuple[int, ...]
    quality_shards: tuple[int, ...]


@dataclass(frozen=True)
class _File:
    key: str
    experiment: int
    rank: int
    path: str


def _stored(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    try:
        return read_stage(spark, folder, name)
    except AnalysisException as error:
        # a run that dies while it overwrites a stage may leave an empty folder
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("subj_num"), F.lit(shards)).cast("int")


def _digests(spark: SparkSession, paths: Sequence[str]) -> dict[int, str]:
    """Length and digest of each file, by its place in ``paths``: one row per input file."""
    rows = input_manifest(spark, list(paths)).select("path", "length", "digest").collect()
    ranks = file_ranks([r.path for r in rows], paths)
    return {ranks[r.path]: f"{r.length}-{r.digest}" for r in rows}


def _files(spark: SparkSession, study: plans.Study, shards: int) -> list[_File]:
    """Log files in their order, keyed by path, content and everything cleaning depends on."""
    base = _digests(spark, [study.stimuli])[0]
    files = []
    for number, experiment in enumerate(study.experiments):
        paths = list(study.logs[experiment.name])
        if len(set(paths)) != len(paths):
            raise ValueError("a trial file is listed twice")
        digests = _digests(spark, paths) if paths else {}
        for rank, path in enumerate(paths):
            text = "\n".join([path, digests[rank], base, repr(experiment), str(shards)])
            # a letter first, so that no key looks like a number as a folder name
            key = "f" + hashlib.sha256(text.encode()).hexdigest()[:32]
            files.append(_File(key, number, rank, path))
    return files


def _listed(spark: SparkSession, files: Iterable[_File]) -> DataFrame:
    frame = pd.DataFrame(
        [(f.key, f.experiment, f.rank) for f in files], columns=["file_key", "experiment", "rank"]
    )
    return spark.createDataFrame(frame, "file_key string, experiment int, rank int")


def _clean(
    spark: SparkSession, files: Sequence[_File], experiment: Experiment, stimuli: DataFrame
) -> DataFrame:
    log = read_trials(spark, [f.path for f in files])
    # a layout that only other files have counts as missing here
    needed = [*LOG_COLUMNS, *COUNTERBALANCE, *STIMULUS_LISTS]
    if isinstance(experiment.slider_start, str):
        needed.append(experiment.slider_start)
    absent = [c for c in needed if c not in log.columns]
    log = log.withColumns({c: F.lit(None).cast("string") for c in absent})
    keys = pd.DataFrame([(n, f.key) for n, f in enumerate(files)], columns=["_rank", "file_key"])
    places = spark.createDataFrame(keys, "_rank int, file_key string")
    rows = clean_trials(log, experiment, stimuli)
    return rows.join(places, F.col("file_rank") == F.col("_rank")).drop("_rank", "file_rank")


def _store_files(
    spark: SparkSession, study: plans.Study, fresh: Sequence[_File], shards: int
) -> None:
    """Clean the given files and store their rows, and which shards each of them holds."""
    stimuli = rescale_stimuli(read_stimuli(spark, study.stimuli))
    for number, experiment in enumerate(study.experiments):
        own = [f for f in fresh if f.experiment == number]
        if not own:
            continue
        rows = _clean(spark, own, experiment, stimuli).withColumn("subj_shard", _shard(shards))
        keys = [f.key for f in own]
        write_parts(rows, study.output, "delta_files", "file_key", keys)
        held = read_parts(spark, study.output, "delta_files").join(_listed(spark, own), "file_key", "left_semi")
        index = held.select("file_key", "subj_shard").distinct()
        write_parts(index, study.output, "delta_index", "file_key", keys)


def _shards_of(rows: DataFrame, column: str | Column = "subj_shard") -> set[int]:
    """Distinct shards: at most as many as there are."""
    return {n for (n,) in rows.select(column).distinct().collect()}


def _combined(
    spark: SparkSession, study: plans.Study, files: Sequence[_File], touched: Sequence[int]
) -> DataFrame:
    """The combined trials of the touched shards, read from the files that hold them."""
    index = read_parts(spark, study.output, "delta_index").filter(F.col("subj_shard").isin(*touched))
    holding = _listed(spark, files).join(index, "file_key", "left_semi")
    rows = read_parts(spark, study.output, "delta_files").filter(F.col("subj_shard").isin(*touched))
    placed = rows.join(holding, "file_key").withColumnRenamed("rank", "file_rank").drop("file_key")
    parts = [
        placed.filter(F.col("experiment") == number).drop("experiment")
        for number in range(len(study.experiments))
    ]
    return combine_trials(parts)


def refresh(
    spark: SparkSession, study: plans.Study, people: DataFrame, shards: int = SHARDS
) -> Refreshed:
    """Trials and quality profile of the current inputs, recomputed where they have changed.

    ``people`` holds ``subj_num, expt_type, age``; participants whose rows there have changed get
    new quality rows from their stored trials. The result equals a full run. Other ``rules``
    recompute all quality rows, another number of shards everything. A participant without an
    id is one participant. Files that trade places in the list count as changed, since
    the first showing of a stimulus decides. Hot participants are split by Spark on reading and
    writing; a shard holds all its participants, and all of them are recomputed with it.
    """
    folder = study.output
    files = _files(spark, study, shards)
    previous = _stored(spark, folder, "delta_inputs")
    old = [] if previous is None else sorted(
        (_File(r.file_key, r.experiment, r.rank, "") for r in previous.collect()),
        key=lambda f: (f.experiment, f.rank),
    )
    if not files and not old:
        raise ValueError("no trial files")
    now, before = {f.key for f in files}, {f.key for f in old}
    fresh = [f for f in files if f.key not in before]
    moved = [f.key for f in files if f.key in before] != [f.key for f in old if f.key in now]
    if fresh:
        _store_files(spark, study, fresh, shards)

    settings = repr((study.rules, shards))
    known = _stored(spark, folder, "delta_settings")
    kept = None if known is None else known.first().settings
    differ = [f for f in [*files, *old] if moved or (f.key in now) != (f.key in before)]
    first = previous is None or kept is None or not kept.endswith(f" {shards})")
    if first:
        changed = set(range(shards))
    elif differ:
        index = read_parts(spark, folder, "delta_index")
        changed = _shards_of(index.join(_listed(spark, differ), "file_key", "left_semi"))
    else:
        changed = set()
    touched = sorted(changed)
    if touched:
        combined = _combined(spark, study, files, touched)
        write_parts(combined, folder, "delta_trials", "subj_shard", touched)

    current = people.select(*PEOPLE)
    past = None if first else _stored(spark, folder, "delta_people")
    if past is None or kept != settings:
        quality = list(range(shards))
    else:
        other = current.exceptAll(past).unionAll(past.exceptAll(current))
        quality = sorted(changed | _shards_of(other, _shard(shards)))
    trials = read_parts(spark, folder, "delta_trials").filter(F.col("subj_shard") < shards)
    if quality:
        some = trials.filter(F.col("subj_shard").isin(*quality))
        rules = study.rules
        blocks = block_profile(some, current, rules).withColumn("subj_shard", _shard(shards))
        write_parts(blocks, folder, "delta_quality", "subj_shard", quality)
        subject = list(rules.subject_keys)
        found = group_quantile(timed_answers(some), subject, "rt", rules.rt_probability, "rt_75")
        found = found.withColumn("subj_shard", _shard(shards))
        write_parts(found, folder, "delta_quantiles", "subj_shard", quality)
        write_stage(current, folder, "delta_people")
        frame = pd.DataFrame({"settings": [settings]})
        write_stage(spark.createDataFrame(frame, "settings string"), folder, "delta_settings")
    if fresh or differ or first:
        write_stage(_listed(spark, files), folder, "delta_inputs")
    return Refreshed(
        trials.drop("subj_shard"), _profile(spark, study, shards),
        tuple(f.path for f in fresh), tuple(touched), tuple(quality),
    )


def _profile(spark: SparkSession, study: plans.Study, shards: int) -> DataFrame:
    """The whole profile from stored rows: a few per participant."""
    read = lambda name: read_parts(spark, study.output, name).filter(
        F.col("subj_shard") < shards
    ).drop("subj_shard")
    quantiles = zscore(read("delta_quantiles"), {"rt_75": "rt_quantile_75"})
    profile = left_join(read("delta_quality"), quantiles, list(study.rules.subject_keys))
    return add_flags(profile, study.rules)


def run_changed(spark: SparkSession, study: plans.Study, shards: int = SHARDS) -> DataFrame:
    """:func:`cohortspark.plans.study.run` for what has changed since the last such run.

    Questionnaires run if a survey or key file has changed, trials and quality rows as in
    :func:`refresh`. Components and models use all participants, so they run if anything has
    changed; otherwise the stored coefficients come back.
    """
    state = _survey_state(spark, study)
    last = _stored(spark, study.output, "delta_surveys")
    same = last is not None and last.first().state == state
    if not same:
        plans.questionnaires(spark, study)
    done = refresh(spark, study, read_stage(spark, study.output, "qs_allsubs"), shards)
    fitted = _stored(spark, study.output, "models")
    reached = _stored(spark, study.output, "delta_done")
    version = _version(spark, study, state)
    if fitted is not None and reached is not None and reached.first().version == version:
        return fitted
    profile = write_stage(done.profile, study.output, "scrub_data")
    write_stage(qc_roster(profile), study.output, "badsubs")
    write_stage(qc_keep(done.trials, profile), study.output, "task_goodsubs", ["emo_block"])
    plans.components(spark, study)
    fitted = plans.models(spark, study)
    write_stage(spark.createDataFrame(pd.DataFrame({"state": [state]})), study.output, "delta_surveys")
    write_stage(spark.createDataFrame(pd.DataFrame({"version": [version]})), study.output, "delta_done")
    return fitted


def _survey_state(spark: SparkSession, study: plans.Study) -> str:
    """Names all that the questionnaire stages depend on."""
    paths = [p for pair in study.rounds.values() for p in pair]
    paths += [study.followup, *study.keys.values(), *([study.aliases] if study.aliases else [])]
    digests = _digests(spark, list(dict.fromkeys(paths)))
    choices = (
        study.rounds, study.followup, study.keys, study.aliases, study.extra_header_rows,
        study.multi_line, study.totals_exclude, study.followup_match,
    )
    return hashlib.sha256(repr([sorted(digests.items()), choices]).encode()).hexdigest()


def _version(spark: SparkSession, study: plans.Study, state: str) -> str:
    """Names all that the stages after quality control depend on."""
    rows = read_stage(spark, study.output, "delta_inputs").orderBy("experiment", "rank").collect()
    choices = (study.rules, study.pca_columns, study.score_keys)
    return hashlib.sha256(repr([state, choices, [tuple(r) for r in rows]]).encode()).hexdigest()
