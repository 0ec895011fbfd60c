import dataclasses
import random

import pytest
from plans import hash_exchanges
from pyspark.sql import functions as F

from cohortspark.functions import reverse_code
from cohortspark.operators import reshape, scoring, surveys
from cohortspark.plans import scales
from cohortspark.plans.scales import KeyItem, SurveyKeys


def items(frame, *answers):
    return frame("id int, response double", *[(1, a) for a in answers])


def test_summary_sum(frame):
    r = scoring.score_items(items(frame, 1.0, None, 3.0), ["id"], patch=3).first()
    assert (r.score, r.score_patched, r.n_items_responded, r.n_items_seen, r.score_adj) == (4, 7, 2, 3, 6)


def test_summary_mean(frame):
    r = scoring.score_items(items(frame, 2.0, None, 6.0), ["id"], F.avg, 4).first()
    assert (r.score, r.score_patched, r.score_adj) == (4, 4, 6)


def test_summary_nothing_answered(frame):
    r = scoring.score_items(items(frame, None, None), ["id"], patch=1).first()
    assert (r.score, r.score_patched, r.n_items_responded, r.score_adj) == (0, 2, 0, None)


def test_pair_response(frame):
    df = frame("a int, b int", (7, 2), (2, 1), (7, None), (None, 1), (None, 2))
    got = [r[0] for r in df.select(scoring.pair_response(F.col("a"), F.col("b"))).collect()]
    assert got == [3.0, 4.0, 3.0, 4.0, None]


def test_binary_scale(frame):
    keys = SurveyKeys({"bpq": [KeyItem(i, "Big Five", i == 4) for i in (1, 2, 3, 4)]})
    df = frame("subj_num string, bpq_q1 double, bpq_q2 double, bpq_q3 double, bpq_q4 double", ("a", 1.0, 2.0, None, 2.0))
    r = scoring.score_wide(df, [scales.BPQ], keys).first()
    assert r.asDict() == {"subj_num": "a", "bpq_big_five": pytest.approx(8 / 3)}


def test_items_without_key_entry_and_without_id(frame):
    keys = SurveyKeys({"tas20": [KeyItem(1, "X", True)]})
    df = frame("subj_num string, tas20_1 double, tas20_2 double", ("a", 5.0, 4.0), (None, 1.0, 1.0))
    rows = {r.subj_num: r for r in scoring.score_wide(df, [scales.TAS20], keys).collect()}
    assert rows["a"].adj__tas20_x == 1.0
    # an unlisted item has an unknown direction: its answer counts as missing
    assert (rows["a"].adj__tas20_NA, rows["a"].patched__tas20_NA) == (None, 3.0)
    assert rows[None].adj__tas20_x is None


def test_swls_and_panas_labels(frame):
    df = frame("subj_num string, `1_swls_1` double, `2_swls_1` double", ("a", 0.0, None))
    r = scoring.score_wide(df, [scales.SWLS], SurveyKeys()).first()
    assert (r.adj__swls, r.patched__swls) == (2.0, 5.0)
    df = frame("subj_num string, i_panas_sf_1 double, i_panas_sf_10 double", ("a", 4.0, 2.0))
    r = scoring.score_wide(df, [scales.I_PANAS_SF], SurveyKeys()).first()
    assert (r.patched__i_panas_sf_neg, r.patched__i_panas_sf_pos) == (4.0, 2.0)


def test_sticsa_and_cesdr_labels(frame):
    keys = SurveyKeys({"sticsa": [KeyItem(1, "Cog-nitive")], "cesdr": [KeyItem(1, "Sad"), KeyItem(2, "Sad")]})
    df = frame(
        "subj_num string, `1_sticsa_state_1` double, `1_sticsa_trait_1` double, "
        "`1_cesdr1_1` double, `1_cesdr2` double, `2_cesdr1_1` double, `2_cesdr2` double",
        ("a", 100.0, None, 7.0, 2.0, None, None),
    )
    r = scoring.score_wide(df, [scales.STICSA, scales.CESDR], keys).first()
    assert (r.adj__sticsa_state_cog_nitive, r.patched__sticsa_trait_cog_nitive) == (4.0, 1.0)
    assert (r.adj__cesdr_sad, r.patched__cesdr_sad) == (6.0, 3.0)


def test_wide_and_long_scoring_agree(spark):
    rng = random.Random(5)
    keys = [KeyItem(i, rng.choice(["A a", "B"]), rng.random() < 0.4) for i in range(1, 21)]
    rows = [
        (f"s{n}", *[None if rng.random() < 0.2 else float(rng.randint(1, 5)) for _ in keys])
        for n in range(60)
    ]
    df = spark.createDataFrame(
        rows, "subj_num string, " + ", ".join(f"tas20_{k.item} double" for k in keys)
    )
    wide = scoring.score_wide(df, [scales.TAS20], SurveyKeys({"tas20": keys}))
    from cohortspark.operators.reshape import items_long_likert, subscales_wide

    key = spark.createDataFrame([(k.item, k.subscale, k.reverse) for k in keys],
                                "item int, subscale string, reverse boolean")
    long = scoring.attach_key(items_long_likert(df, ["subj_num"], "tas20"), key)
    long = long.withColumn("response", reverse_code(F.col("response"), F.col("reverse"), 6))
    scored = scoring.label_subscales(scoring.score_items(long, ["subj_num", "subscale"], patch=3), "tas20")
    back = subscales_wide(scored, ["subj_num"], ["tas20_a_a", "tas20_b"])
    mine = {r.subj_num: r.asDict() for r in wide.collect()}
    for r in back.collect():
        for name, value in r.asDict().items():
            assert mine[r.subj_num][name] == (pytest.approx(value) if name != "subj_num" else value)
    assert hash_exchanges(wide) == 0


def test_demographics(frame):
    df = frame(
        "subj_num string, age double, handedness string, gender string, race_a string, race_b string, "
        "ethnicity string, edu string, ses_7 string, ses_8 string, ses_9 string, dx_med string",
        ("a", 20.0, "I write w/Left", None, "Asian", "White", "x", "y", "On", "Off", None, None),
        ("b", 30.0, None, "Man", None, "White", "x", "y", "On", None, "On", "no"),
        ("c", 40.0, "I write w/Right", "Man", None, None, "x", "y", None, "Off", None, "no"),
    )
    out = surveys.demographics(df)
    assert out.columns[:4] == ["subj_num", "age", "handedness", "gender"] and "ses_7" not in out.columns
    got = sorted(((r.subj_num, r.ses, r.race_summary, r.handedness) for r in out.collect()), key=str)
    assert got == [
        ("a", 1.0, "More than one race", "Left"), ("b", 1.0, "White", None), ("b", 3.0, "White", None),
        ("c", None, None, "Right"),
    ]
    assert "handedness" not in surveys.demographics(df.drop("handedness")).columns


def test_mask(frame):
    df = frame("t double, n int", (1.0, 10), (2.0, 11), (3.0, None))
    got = [r.t for r in surveys.mask_incomplete(df, {"t": ("n", 10)}).collect()]
    assert got == [1.0, None, None]


def test_round_keeps_newest_and_counts_compat_totals(frame):
    keys = SurveyKeys({"tas20": [KeyItem(1, "x", False), KeyItem(2, "y", False)]})
    numeric = frame(
        "prolific_id string, tas20_1 double, tas20_2 double, o int",
        ("a", 5.0, -99.0, 1), ("a", 1.0, 1.0, 2), (None, 2.0, 2.0, 3),
    )
    labels = frame(
        "prolific_id string, age string, gender string, race_x string, ethnicity string, edu string, "
        "ses_7 string, tas20_1 string, tas20_2 string, dx_med string, o int",
        ("a", "20", "M", None, "e", "d", "On", "Often", "-99", "none", 1),
        ("a", "20", "M", None, "e", "d", "On", "Never", "Never", "none", 2),
        (None, "20", "M", None, "e", "d", None, "Never", "Never", "none", 3),
    )
    run = lambda **k: {
        (r.subj_num, r.score_type): r
        for r in surveys.survey_round(numeric, labels, keys, [F.asc("o")], scales=[scales.TAS20],
                                      totals={"tas20_total": "tas20"}, **k).collect()
    }
    rows = run()
    assert len(rows) == 4
    r = rows["a", "patched"]
    assert (r.tas20_x, r.tas20_y, r.nas_tas20, r.nas_total, r.tas20_total) == (5.0, 3.0, 1, 1, 9.0)
    assert rows["a", "adj"].tas20_y is None
    assert rows[None, "patched"].tas20_x is None
    assert run(exclude="^nas_")["a", "patched"].tas20_total == 8.0
    aliases = frame("alias string, target string", ("a", "fixed"))
    assert ("fixed", "adj") in run(aliases=aliases)


def test_round_shuffles_each_export_once(spark, tmp_path):
    """Duplicates, scores and the join of both exports use the same partitioning."""
    keys = SurveyKeys({"tas20": [KeyItem(1, "x", False)]})
    spark.createDataFrame([("a", 5.0, 1)], "prolific_id string, tas20_1 double, o int").write.parquet(str(tmp_path / "n"))
    spark.createDataFrame(
        [("a", "20", "M", None, "e", "d", "Often", "none", 1)],
        "prolific_id string, age string, gender string, race_x string, ethnicity string, edu string, "
        "tas20_1 string, dx_med string, o int",
    ).write.parquet(str(tmp_path / "l"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = surveys.survey_round(
            spark.read.parquet(str(tmp_path / "n")), spark.read.parquet(str(tmp_path / "l")), keys,
            [F.asc("o")], scales=[scales.TAS20], totals={"tas20_total": "tas20"},
        )
        assert hash_exchanges(out) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.count() == 2


def test_followup_and_binding(frame):
    keys = SurveyKeys({"als18": [KeyItem(1, "x")]})
    export = frame(
        "ResponseId string, subj_num string, StartDate int, `1_als18_1` double, `1_swls_1` double",
        ("r2", "a", 2, 0.0, 0.0), ("r1", "a", 1, 100.0, 50.0), ("r3", "b", 3, None, None),
    )
    later = surveys.survey_followup(export, keys, [F.asc_nulls_last("StartDate")],
                                    scales=[scales.ALS18, scales.SWLS],
                                    totals={"als18_total": "als18"}, match="contains",
                                    missing={"nas_als18": "als18", "nas_swls": "swls"})
    rows = {(r.subj_num_2, r.score_type): r for r in later.collect()}
    assert rows["a", "patched"].subj_num == "r1" and rows["a", "patched"].als18_total == 3.0
    assert (rows["b", "patched"].nas_als18, rows["b", "patched"].als18_total) == (1, 1.0)
    rounds = {
        name: frame("subj_num string, gender string, score_type string, bpq_total double",
                    ("a", None, "patched", v), ("z", "W", "patched", v + 1), ("a", None, "adj", 0.0))
        for name, v in (("one", 1.0), ("two", 2.0))
    }
    bound = surveys.bind_rounds(rounds, later, limits={"als18_total": ("nas_als18", 0)},
                                z=["bpq_total", "als18_total"])
    got = {(r.expt_type, r.subj_num): r for r in bound.collect()}
    assert len(got) == 4
    assert got["one", "a"].gender == "Not reported" and got["one", "a"].als18_total == 3.0
    assert got["two", "z"].als18_total is None and got["two", "z"].als18_total_z is None
    assert got["one", "z"].bpq_total_z == pytest.approx(0.0)


def test_repeated_items_count_in_each_subscale_as_in_the_long_form(spark, frame):
    key = [KeyItem(1, "a"), KeyItem(1, "b"), KeyItem(2, "b")]
    df = frame("subj_num string, irq_1 double, irq_2 double", ("x", 4.0, 5.0))
    long = scoring.attach_key(reshape.items_long_likert(df, ["subj_num"], "irq"), key)
    by_label = {r.subscale: r.score for r in scoring.score_items(long, ["subscale"]).collect()}
    assert by_label == {"a": 4.0, "b": 9.0}
    scale = dataclasses.replace(scales.TAS20, name="irq")
    keys = SurveyKeys({"irq": [dataclasses.replace(k, reverse=False) for k in key]})
    wide = scoring.score_wide(df, [scale], keys).first()
    assert (wide.adj__irq_a, wide.adj__irq_b) == (4.0, 9.0)


def test_item_columns_without_a_number_are_items_without_a_key_entry(frame):
    df = frame("subj_num string, tas20_1 double, tas20_order string, tas20_3_TEXT string", ("x", 4.0, "9", "text"))
    keys = SurveyKeys({"tas20": [KeyItem(1, "x", False)]})
    row = scoring.score_wide(df, [scales.TAS20], keys).first()
    assert row.adj__tas20_x == 4.0 and row.adj__tas20_NA is None
    long = reshape.items_long_likert(df.drop("tas20_3_TEXT"), ["subj_num"], "tas20")
    assert sorted((r.item for r in long.collect()), key=str) == [1, None]
