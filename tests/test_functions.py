import math

import pytest
from pyspark.sql import functions as F

from cohortspark import functions as fn


def test_reverse_code(frame, values):
    df = frame("x double, r boolean", (5.0, True), (3.0, True), (None, True), (2.0, False), (2.0, None))
    out = df.select("x", "r", fn.reverse_code(F.col("x"), F.col("r"), 6).alias("y")).collect()
    assert [r.y for r in out] == [1.0, 3.0, None, 2.0, None]
    twice = fn.reverse_code(fn.reverse_code(F.col("x"), F.col("r"), 8), F.col("r"), 8)
    kept = df.filter("r is not null").select("x", twice.alias("y")).collect()
    assert all(r.x == r.y for r in kept)


def test_slider_units(frame):
    df = frame("x double", 0.0, 50.0, 100.0)
    out = df.select(
        fn.slider_to_scale(F.col("x"), 7, 1), fn.slider_to_scale(F.col("x"), 4, 0),
        fn.zero_hundred_to_scale(F.col("x")), fn.band_to_unit(F.col("x") / 25 - 2, -2, 2),
    ).collect()
    assert [tuple(round(v, 9) for v in r) for r in out] == [
        (1.0, 0.0, 1.0, 0.0), (4.0, 1.5, 2.5, 0.5), (7.0, 3.0, 4.0, 1.0)
    ]


def test_to_int_cuts_and_never_raises(frame):
    df = frame("x string", "45.7", "-2.9", " 3 ", "submitResp", "1d", "NaN", "1e20", "", None, "1e2")
    got = [r[0] for r in df.select(fn.to_int(F.col("x"))).collect()]
    assert got == [45, -2, 3, None, None, None, None, None, None, 100]


def test_ratio_and_nan(frame):
    df = frame("a double, b double", (0.0, 0.0), (1.0, 4.0), (float("nan"), 1.0))
    out = fn.nan_to_null(df).select("a", fn.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [tuple(r) for r in out] == [(0.0, None), (1.0, 0.25), (None, None)]


def test_sentinel_by_type(frame):
    df = frame("a int, b double, c string, d string", (-99, -99.0, "-99", "Off"), (1, 2.0, "x", "On"))
    assert [tuple(r) for r in fn.sentinel_null(df).collect()] == [
        (None, None, None, "Off"), (1, 2.0, "x", "On")
    ]
    only = fn.sentinel_null(df, text="Off", columns=["d"])
    assert only.first().d is None and only.first().a == -99


def test_unite_shows_missing(frame):
    df = frame("a string, b string, c string", ("cat", None, "x"))
    assert df.select(fn.unite(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "cat_NA_x"


def test_subscale_label_blanks_the_range(frame):
    df = frame("s string", "A-b c/d", "A.b,c:d", None)
    got = [r[0] for r in df.select(fn.subscale_label("x", F.col("s"))).collect()]
    assert got == ["x_a_b_c_d", "x_a_b_c:d", "x_NA"]
    kind = df.select(fn.subscale_label("x", F.col("s"), F.lit("state"))).first()[0]
    assert kind == "x_state_a_b_c_d"


def test_recode_and_version(frame):
    df = frame("v string, a string, b string", ("a", "1", "2"), ("b", "1", "2"), ("z", "1", "2"), (None, "1", "2"))
    out = df.select(
        fn.recode(F.col("v"), {"a": "A"}), fn.pick_by_version(F.col("v"), ["a", "b"])
    ).collect()
    assert [tuple(r) for r in out] == [("A", "1"), ("b", "2"), ("z", None), (None, None)]


def test_binary_answer(frame):
    df = frame("c double, r boolean", (1.0, False), (2.0, False), (None, False), (2.0, True), (3.0, True), (1.0, None))
    got = [r[0] for r in df.select(fn.binary_answer(F.col("c"), F.col("r"))).collect()]
    assert got == [True, False, None, True, None, None]


@pytest.mark.parametrize("p, expected", [(0.0, -5.293305), (0.5, 0.0), (1.0, 5.293305)])
def test_bounded_logit(frame, p, expected):
    got = frame("p double", p).select(fn.bounded_logit(F.col("p"))).first()[0]
    assert math.isclose(got, expected, abs_tol=1e-6)


def test_response_deficit(frame):
    df = frame("l string, n int", ("+ to -", 54), ("+ to -", 50), ("0 to +", 43), ("0 to +", 40), (None, 40))
    got = [
        r[0] for r in df.select(
            F.round(fn.response_deficit(F.col("n"), F.col("l"), "+ to -", 54, 43), 9) + 0.0
        ).collect()
    ]
    assert got == [0.0, 0.4, 0.0, 0.3, None]


def test_column_choice(frame):
    df = frame("id int, tas20_1 int, TAS20_2 int, x_tas20 int, dx int", (1, 2, 3, 4, 5))
    assert fn.columns_starting(df, "tas20") == ["tas20_1", "TAS20_2"]
    assert fn.columns_containing(df, "tas20") == ["tas20_1", "x_tas20"]
    assert fn.columns_between(df, "tas20_1", "x_tas20") == ["tas20_1", "TAS20_2", "x_tas20"]
    assert "tas21_1" in fn.rename_by_pattern(df, "tas20", "tas21").columns
