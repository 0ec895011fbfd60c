from plans import final_plan
from pyspark.sql import functions as F

from cohortspark.operators import qc
from cohortspark.operators import trials as tr


def test_response_codes(frame):
    df = frame(
        "t string, b string",
        ("NEUTRAL", "cat_neutral_amusement"), ("AMUSEMENT", "cat_neutral_amusement"), ("999", "cat_neutral_amusement"),
        ("AMUSEMENT", "cat_amusement_fear"), ("FEAR", "cat_amusement_fear"), ("FEAR", "cont_x_y"),
        ("AMUSEMENT", "cont_x_y"), ("45.7", "cont_x_y"), ("submitResp", "cont_x_y"), ("AMUSEMENT", None),
    )
    got = [r[0] for r in df.select(tr.response_code(F.col("t"), F.col("b"), "amusement", "fear")).collect()]
    assert got == [0, 1, 999, 0, 1, 1, None, 45, None, None]


def test_response_scaling(frame):
    df = frame(
        "r int, k string, t double",
        (45, "cont", 0.0), (50, "cont", 1.0), (50, "cont", 0.0), (50, "cont", None), (999, "cat", 0.0), (1, "cat", 1.0),
    )
    got = [r[0] for r in df.select(tr.response_scaled(F.col("r"), F.col("k"), F.col("t"))).collect()]
    assert got == [0.45, None, 0.5, 0.5, None, 1.0]


def test_stimuli(frame):
    df = frame("fname string, amuse double, fear double, bipolar double", ("a", 5.0, 0.0, -2.0), ("b", 0.0, 5.0, 2.0), ("c", 1.0, 1.0, 0.0))
    got = [(r.amuse, r.fear, r.bipolar) for r in tr.rescale_stimuli(df).collect()]
    assert got == [(1.0, 0.0, 0.0), (0.0, 1.0, 1.0), (0.2, 0.2, 0.5)]


def test_complete_blocks_and_timeouts(frame, values):
    sizes = {"a": 43, "b": 54, "c": 42}
    df = frame("s int, b string, timeout int", *[(1, b, 0) for b, n in sizes.items() for _ in range(n)], (2, "a", 0))
    assert values(qc.complete_blocks(df, ["s"], "b", (43, 54))) == [(1, 2)]
    late = {1: (10, 0, 0), 2: (5, 5, 0), 3: (9, 4, 4)}
    rows = [(s, str(b), 1) for s, ns in late.items() for b, n in enumerate(ns) for _ in range(n)]
    rows += [(s, str(b), None) for s in late for b in range(3)]
    df = frame("s int, b string, timeout int", *rows)
    assert values(qc.timeout_rules(df, ["s"], "b", 10, 5)) == [(1, True, False), (2, False, True), (3, False, False)]
    counts = {(r.s, r.b): r.n_trials_responded for r in qc.responded_trials(df, ["s"], "b").collect()}
    assert counts[1, "0"] == 1


def test_slider_profile(frame):
    rows = [(1, "x", r) for r in (0.5, 0.505, 0.52)] + [(1, "y", r) for r in (0.0, 1.0, 1.0, 0.0)]
    df = frame("s int, b string, resp double", *rows).withColumn("slider_start", F.lit(0.5))
    r = qc.slider_profile(df, ["s"], "b").first()
    assert (r.n_0s, r.n_100s, r.n_lazy) == (1.0, 1.0, 1.0)
    # quarters round half to even
    rows = [(1, "x", 0.5)] + [(1, b, 0.9) for b in "yzw"]
    df = frame("s int, b string, resp double", *rows).withColumn("slider_start", F.lit(0.5))
    assert qc.slider_profile(df, ["s"], "b").first().n_lazy == 0.2
    unknown = df.withColumn("slider_start", F.when(F.col("b") != "x", 0.5))
    assert qc.slider_profile(unknown, ["s"], "b").first().n_lazy is None


def make_trials(frame, people):
    """people: (subj, expt, blocks, per block, rt, timeouts per block, slider resp)."""
    rows = []
    for subj, expt, blocks, size, rt, late, slider in people:
        for b in range(blocks):
            kind = "cat" if b % 2 else "cont"
            pair = ["neutral_amusement", "neutral_fear", "amusement_fear"][b // 2 % 3]
            for t in range(size):
                resp = 1.0 if kind == "cat" else slider
                rows.append((subj, expt, f"{kind}_{pair}", pair, kind, float(rt + t), resp, 1.0 if t < late else 0.0, 0.5))
    return frame(
        "subj_num string, expt_type string, block string, emo_block string, resp_type string, rt double, "
        "resp double, timeout double, slider_start double", *rows)


def test_flags_and_keep(frame):
    people = [
        ("good", "af", 6, 43, 600, 1, 0.9), ("short", "af", 5, 43, 600, 0, 0.9),
        ("odd", "af", 6, 40, 600, 0, 0.9), ("late", "af", 6, 43, 600, 5, 0.9),
        ("fast", "af", 6, 43, 100, 0, 0.9), ("lazy", "af", 6, 43, 600, 0, 0.5),
        ("old", "af", 6, 54, 600, 0, 0.9), ("ageless", "af", 6, 54, 600, 0, 0.9), ("only", "af", 1, 43, 600, 0, 0.9),
    ]
    trials = make_trials(frame, people)
    ages = frame("subj_num string, expt_type string, age double",
                 *[(p[0], "af", 36.0 if p[0] == "old" else 20.0) for p in people if p[0] != "ageless"])
    profile = qc.qc_profile(trials, ages).cache()
    rows = {r.subj_num: r for r in profile.collect()}
    flags = {s: tuple(r[f] for f in qc.FLAGS) for s, r in rows.items()}
    assert flags["good"] == (True,) * 5
    assert flags["short"] == (False, True, True, True, True)
    assert flags["odd"][0] is None and rows["odd"].n_complete_blocks is None
    assert flags["late"] == (True, False, True, True, True)
    assert flags["fast"] == (True, True, False, True, True)
    assert flags["lazy"] == (True, True, True, False, True)
    assert flags["old"][4] is False and flags["ageless"][4] is None
    assert flags["only"][2] is False and rows["only"].rt_75 is None
    assert profile.filter("subj_num = 'good'").count() == 6
    kept = qc.qc_keep(trials, profile)
    assert {r.subj_num for r in kept.select("subj_num").distinct().collect()} == {"good"}
    assert kept.count() == 6 * 43
    got = {r.emo_block: round(r.n_trials_responded, 6) for r in kept.select("emo_block", "n_trials_responded").distinct().collect()}
    assert got == {"0 to +": 0.1, "0 to -": 0.1, "+ to -": 1.2}
    assert qc.qc_roster(profile).count() == len(people)


def test_participant_in_both_experiments(frame):
    """Pooled by default: twelve blocks fail; keyed by experiment both parts pass."""
    trials = make_trials(frame, [("p", "af", 6, 43, 600, 0, 0.9)])
    second = trials.withColumn("expt_type", F.lit("pn")).withColumn(
        "block", F.concat("block", F.lit("2"))
    )
    both = trials.unionByName(second)
    ages = frame("subj_num string, expt_type string, age double", ("p", "af", 20.0), ("p", "pn", 21.0))
    pooled = qc.qc_profile(both, ages)
    assert pooled.count() == 24 and qc.passing(pooled).count() == 0
    apart = qc.qc_profile(both, ages, qc.Rules(subject_keys=("subj_num", "expt_type")))
    assert apart.count() == 12 and qc.passing(apart).count() == 12
    # a duplicated covariate row doubles the counts, as a join of the trials would
    twice = qc.qc_profile(trials, ages.unionByName(ages))
    assert {r.n_trials_responded for r in twice.collect()} == {86}


def test_quantile_work_is_shared_with_its_moments(spark, frame, tmp_path):
    trials = make_trials(frame, [("p", "af", 6, 43, 600, 0, 0.9), ("q", "af", 6, 43, 700, 0, 0.9)])
    trials.write.parquet(str(tmp_path / "t"))
    ages = frame("subj_num string, expt_type string, age double", ("p", "af", 20.0))
    text = final_plan(qc.qc_profile(spark.read.parquet(str(tmp_path / "t")), ages))
    text = text.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in text and "CartesianProduct" not in text
