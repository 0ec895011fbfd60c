import dataclasses
import csv
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from synthetic import study as make_study

from cohortspark import sources
from cohortspark.operators.trials import AMUSEMENT_FEAR, clean_trials, rescale_stimuli
from cohortspark.plans import delta
from cohortspark.plans import study as plans


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    return make_study(tmp_path_factory.mktemp("study"))


@pytest.fixture(scope="module")
def done(spark, inputs):
    study = plans.Study(**inputs)
    fitted = plans.run(spark, study)
    return study, fitted


def stage(spark, study, name):
    return sources.read_stage(spark, study.output, name)


def test_discover(spark, inputs, tmp_path_factory):
    folder = inputs["logs"]["amusement_fear"][0].rsplit("/", 1)[0]
    found = {r.source for r in sources.discover(spark, folder).collect()}
    assert found == {"amuse_cat_first", "amuse cont_first"}
    assert sources.discover(spark, folder, "last").count() == 0


def test_trial_files_keep_line_order_when_split(spark, inputs):
    """Small splits: the ordinal still gives the line order of every file."""
    paths = inputs["logs"]["amusement_fear"]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        rows = sources.read_trials(spark, paths)
        assert rows.rdd.getNumPartitions() > 20
        assert rows.select("split_start").distinct().count() > 20
        got = rows.orderBy("file_rank", "split_start", "row_ord").select("source", "Event Index", "Timed Out").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = []
    for path in paths:
        with open(path, encoding="utf-8") as f:
            stem = path.rsplit("/", 1)[1][:-4]
            expected += [(stem, r["Event Index"], int(r["Timed Out"]) if r["Timed Out"] else None) for r in csv.DictReader(f)]
    assert [tuple(r) for r in got] == expected


def test_slider_rows_take_the_submit_mark_across_splits(spark, inputs):
    paths = inputs["logs"]["amusement_fear"]
    stimuli = rescale_stimuli(sources.read_stimuli(spark, inputs["stimuli"]))
    whole = clean_trials(sources.read_trials(spark, paths), AMUSEMENT_FEAR, stimuli)
    counts = lambda d: sorted(
        tuple(r) for r in d.groupBy("subj_num", "block").agg(F.count("*"), F.sum("timeout"), F.round(F.sum("resp"), 6)).collect()
    )
    before = counts(whole)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        split = counts(clean_trials(sources.read_trials(spark, paths), AMUSEMENT_FEAR, stimuli))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert before == split
    assert sum(r[3] for r in before) > 0


def test_survey_reader(spark, inputs):
    numeric, labels = inputs["rounds"]["amusement_fear"]
    codes = sources.read_survey(spark, numeric, numbers=["tas20"])
    assert codes.count() == 42 and dict(codes.dtypes)["tas20_1"] == "double"
    first = codes.orderBy("row_ord").first()
    assert first.prolific_id == "p0" and first.row_ord == 2
    texts = sources.read_survey(spark, labels)
    assert texts.count() == 42 and texts.filter(F.col("dx_med") == 'say "a",\nb').count() == 42


def test_blanks_and_na_text_are_missing(spark, tmp_path):
    (tmp_path / "a_first.csv").write_text("x,Timed Out,y\n  1 ,1.0,NA\n   ,,b c\n")
    rows = sources.read_trials(spark, [str(tmp_path / "a_first.csv")]).orderBy("row_ord").collect()
    assert [(r.x, r["Timed Out"], r.y) for r in rows] == [("1", 1, None), (None, None, "b c")]
    assert {(r.source, r.file_rank) for r in rows} == {("a_first", 0)}


def test_keys(spark, inputs):
    keys = sources.survey_keys(spark, inputs["keys"])
    assert keys.entries("bpq", 4)[0].reverse is True and keys.entries("bpq", 5)[0].reverse is False
    assert keys.entries("als18", 1)[0].subscale == "Second/Part" and keys.entries("als18", 1)[0].reverse is None
    assert keys.entries("tas20", 99)[0].subscale is None


def test_all_stages(spark, done):
    study, fitted = done
    people = stage(spark, study, "qs_allsubs")
    assert people.groupBy("subj_num", "expt_type").count().count() == 80
    assert people.select("bpq_total_z", "swls_z", "nas_als18").dropna().count() == 80
    task = stage(spark, study, "task_allsubs")
    assert {tuple(r) for r in task.groupBy("block").count().select("count").distinct().collect()} <= {
        (n,) for n in range(1000, 2200)
    }
    assert task.filter("stim_level is null").count() == 0
    assert "trial_screen" not in task.columns and "row_ord" not in task.columns
    roster = stage(spark, study, "badsubs")
    flagged = {r.subj_num: r for r in roster.collect()}
    assert flagged["p1"].not_too_fast is False and flagged["p39"].age_valid is False
    good = stage(spark, study, "task_goodsubs")
    kept = {r.subj_num for r in good.select("subj_num").distinct().collect()}
    assert len(kept) > 60 and "p1" not in kept and "p39" not in kept
    scores = stage(spark, study, "pcs_goodsubs")
    assert {r.subj_num for r in scores.collect()} <= kept
    assert scores.agg(F.stddev_samp("PC1")).first()[0] == pytest.approx(1.0)
    assert stage(spark, study, "qs_pca_variance").count() == 12
    terms = {(r.emo_block, r.resp_type): {} for r in fitted.collect()}
    assert len(terms) == 4
    for r in fitted.collect():
        terms[r.emo_block, r.resp_type][r.term] = r.estimate
    assert all(t["stim_level"] > 1 for t in terms.values())
    assert "rt_quantile_75" in terms["0 to +", "cat"] and "rt_quantile_75" not in terms["0 to +", "cont"]


def test_run_of_changes_equals_a_full_run(spark, done):
    study, fitted = done
    own = dataclasses.replace(study, output=f"{study.output}_changed")
    rows = lambda df: {
        (r.emo_block, r.resp_type, r.term): None if r.estimate is None else round(r.estimate, 6) for r in df.collect()
    }
    assert rows(delta.run_changed(spark, own, shards=8)) == rows(fitted)
    stored = [sorted(f.name for f in Path(own.output, name).iterdir()) for name in ("models", "qs_allsubs")]
    assert rows(delta.run_changed(spark, own, shards=8)) == rows(fitted)
    assert stored == [sorted(f.name for f in Path(own.output, name).iterdir()) for name in ("models", "qs_allsubs")]


def test_manifest_finds_changes(spark, done):
    study, _ = done
    assert plans.inputs_changed(spark, study).count() == 0
    fresh = dataclasses.replace(study, output=f"{study.output}/elsewhere")
    assert {r.change for r in plans.inputs_changed(spark, fresh).collect()} == {"new"}
    with open(study.stimuli, "a", encoding="utf-8") as f:
        f.write("99,new.gif,1,1,1\n")
    changed = plans.inputs_changed(spark, study).collect()
    assert [r.path.rsplit("/", 1)[1] for r in changed] == ["info.csv"]


def manifest_changes(spark, path, previous):
    return {
        r.path.rsplit("/", 1)[1]: r.change
        for r in sources.changed_inputs(sources.input_manifest(spark, path), previous).collect()
    }


def test_manifest_sees_order_lines_new_and_deleted_files(spark, tmp_path):
    lines = [f"line {n % 400}\n" for n in range(3000)]
    for name in ("same", "order", "edit", "gone"):
        (tmp_path / f"{name}.csv").write_text("".join(lines))
    (tmp_path / "empty.csv").write_text("")
    path = str(tmp_path)
    assert set(manifest_changes(spark, path, None).values()) == {"new"}
    first = sources.input_manifest(spark, path)
    previous = spark.createDataFrame(first.collect(), first.schema)
    assert manifest_changes(spark, path, previous) == {}
    (tmp_path / "order.csv").write_text("".join([*lines[:700], lines[701], lines[700], *lines[702:]]))
    (tmp_path / "edit.csv").write_text("".join([*lines[:-1], "line x99\n"]))
    (tmp_path / "gone.csv").unlink()
    (tmp_path / "fresh.csv").write_text("a\n")
    assert manifest_changes(spark, path, previous) == {
        "order.csv": "changed", "edit.csv": "changed", "gone.csv": "deleted", "fresh.csv": "new"
    }


def test_manifest_does_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f"row {n}\n" for n in range(2000)))
    whole = sources.input_manifest(spark, str(tmp_path)).first().digest
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert sources.input_manifest(spark, str(tmp_path)).first().digest == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_sink(spark, tmp_path):
    sources.write_csv(spark.range(3), str(tmp_path), "ids")
    assert spark.read.csv(str(tmp_path / "ids"), header=True).count() == 3


def test_split_survey_export_reads_as_a_whole_one(spark, tmp_path):
    path = tmp_path / "survey.csv"
    rows = [f"s{n},{n % 5}" for n in range(400)]
    path.write_text("\n".join(["id,q_1", "what,ever", "more,words", *rows]) + "\n")
    whole = sources.read_survey(spark, str(path), 2, ["q_"]).select("id", "q_1").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        split = sources.read_survey(spark, str(path), 2, ["q_"], multi_line=False)
        assert split.rdd.getNumPartitions() > 2
        found = split.orderBy("split_start", "row_ord").select("id", "q_1").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == whole and len(found) == 400
