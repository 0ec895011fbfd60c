import csv
import dataclasses
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from synthetic import study as make_study

from cohortspark import sources
from cohortspark.operators.qc import Rules, qc_profile
from cohortspark.operators.trials import clean_trials, combine_trials, rescale_stimuli
from cohortspark.plans import delta
from cohortspark.plans import study as plans

SHARDS = 16
ID = "Participant Public ID"


@pytest.fixture(scope="module")
def start(spark, tmp_path_factory):
    study = plans.Study(**make_study(tmp_path_factory.mktemp("delta"), people=8))
    return study, delta.refresh(spark, study, people(spark), SHARDS)


def people(spark, **ages):
    ids = [(f"{k}{i}", e) for k, e in (("p", "amusement_fear"), ("q", "positive_negative")) for i in range(8)]
    rows = [(s, e, float(ages.get(s, 20 + n))) for n, (s, e) in enumerate(ids)]
    return spark.createDataFrame(rows, "subj_num string, expt_type string, age double")


def full(spark, study, covariates):
    """Trials and profile from all inputs at once."""
    stimuli = rescale_stimuli(sources.read_stimuli(spark, study.stimuli))
    trials = combine_trials(
        [clean_trials(sources.read_trials(spark, study.logs[e.name]), e, stimuli) for e in study.experiments]
    )
    return trials, qc_profile(trials, covariates, study.rules)


def plain(df):
    names = sorted(df.columns)
    number = lambda v: round(v, 9) if isinstance(v, float) else v
    return names, Counter(tuple(number(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def same(spark, study, covariates, done):
    trials, profile = full(spark, study, covariates)
    assert plain(done.trials) == plain(trials)
    assert plain(done.profile) == plain(profile)


def files(study, name):
    """Data files of every part of a stage."""
    folder = Path(study.output, name)
    return {p.name: {f.name for f in p.glob("part-*")} for p in folder.iterdir() if p.is_dir()}


def shards_of(spark, ids):
    frame = spark.createDataFrame([(i,) for i in ids], "subj_num string")
    return tuple(sorted({r[0] for r in frame.select(F.pmod(F.xxhash64("subj_num"), F.lit(SHARDS))).collect()}))


def rewrite(path, change):
    with open(path, encoding="utf-8") as f:
        reader = csv.DictReader(f)
        names, rows = reader.fieldnames, [change(r) for r in reader]
    with open(path, "w", encoding="utf-8", newline="") as f:
        writer = csv.DictWriter(f, names)
        writer.writeheader()
        writer.writerows(rows)


def test_add_change_move_and_delete_equal_a_full_run(spark, start):
    study, done = start
    table = people(spark)
    assert len(done.cleaned) == 4 and done.trial_shards == tuple(range(SHARDS))
    before = {n: files(study, n) for n in ("delta_files", "delta_trials", "delta_quality")}

    again = delta.refresh(spark, study, table, SHARDS)
    assert (again.cleaned, again.trial_shards, again.quality_shards) == ((), (), ())
    assert before == {n: files(study, n) for n in before}

    # another reaction time in one file: its own rows, and the shards of its participants
    path = study.logs["amusement_fear"][0]
    rewrite(path, lambda r: {**r, "Reaction Time": "9000"} if r[ID] == "p2" else r)
    changed = delta.refresh(spark, study, table, SHARDS)
    assert changed.cleaned == (path,)
    assert changed.trial_shards == changed.quality_shards == shards_of(spark, ["p0", "p2", "p4", "p6"])
    same(spark, study, table, changed)
    after = files(study, "delta_trials")
    kept = {p for p in after if after[p] == before["delta_trials"][p]}
    assert kept == {f"subj_shard={n}" for n in range(SHARDS) if n not in changed.trial_shards}
    held = files(study, "delta_files")
    assert all(held[p] == names for p, names in before["delta_files"].items()) and len(held) == 5

    # a file that repeats a participant of another one, and stands before it
    extra = str(Path(path).with_name("again_cat_first.csv"))
    Path(extra).write_text(Path(path).read_text(encoding="utf-8"), encoding="utf-8")
    rewrite(extra, lambda r: {**r, ID: "p1" if r[ID] == "p0" else "new", "Reaction Time": "8000"})
    logs = {**study.logs, "amusement_fear": [extra, *study.logs["amusement_fear"]]}
    more = dataclasses.replace(study, logs=logs)
    added = delta.refresh(spark, more, table, SHARDS)
    assert added.cleaned == (extra,) and set(added.trial_shards) == set(shards_of(spark, ["p1", "new"]))
    assert added.trials.filter("subj_num = 'p1' and rt = 3000").count() > 0
    same(spark, more, table, added)

    # the same files in another order: the first showing is another one
    turned = dataclasses.replace(study, logs={**logs, "amusement_fear": logs["amusement_fear"][::-1]})
    moved = delta.refresh(spark, turned, table, SHARDS)
    assert moved.cleaned == () and moved.trials.filter("subj_num = 'p1' and rt = 3000").count() == 0

    # without a file its participants are gone; an age moves quality rows only
    fewer = dataclasses.replace(study, logs={**study.logs, "amusement_fear": study.logs["amusement_fear"][1:]})
    gone = delta.refresh(spark, fewer, table, SHARDS)
    assert gone.cleaned == () and gone.trials.filter("subj_num in ('p0', 'new')").count() == 0
    older = people(spark, p3=99)
    aged = delta.refresh(spark, fewer, older, SHARDS)
    assert aged.trial_shards == () and aged.quality_shards == shards_of(spark, ["p3"])
    same(spark, fewer, older, aged)

    # other rules change all quality rows, and other shards start afresh, in fewer folders
    strict = dataclasses.replace(fewer, rules=Rules(rt_probability=0.5, age_limit=25))
    ruled = delta.refresh(spark, strict, older, SHARDS)
    assert ruled.trial_shards == () and ruled.quality_shards == tuple(range(SHARDS))
    before_last = plain(ruled.profile)
    resharded = delta.refresh(spark, strict, older, 5)
    assert resharded.trial_shards == tuple(range(5))
    same(spark, strict, older, resharded)
    assert plain(resharded.profile) == before_last


def test_no_files_and_files_listed_twice(spark, start, tmp_path):
    study, _ = start
    none = dataclasses.replace(study, logs={e: [] for e in study.logs}, output=str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no trial files"):
        delta.refresh(spark, none, people(spark), SHARDS)
    twice = dataclasses.replace(study, logs={e: p * 2 for e, p in study.logs.items()}, output=str(tmp_path / "twice"))
    with pytest.raises(ValueError, match="listed twice"):
        delta.refresh(spark, twice, people(spark), SHARDS)


def test_parts_without_rows_are_overwritten(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "v int, part int")
    sources.write_parts(rows, folder, "t", "part", [0, 1])
    sources.write_parts(rows.filter("part < 0"), folder, "t", "part", [1])
    assert [tuple(r) for r in sources.read_parts(spark, folder, "t").collect()] == [(1, 0)]
    sources.write_parts(rows.filter("part < 0"), folder, "t", "part", [0])
    assert sources.read_parts(spark, folder, "t").collect() == []
