import random
import re

import numpy as np
import pytest
from plans import final_plan, hash_exchanges, plan
from pyspark.sql import functions as F

from cohortspark.operators import joins, reshape, stats
from cohortspark.operators.dedup import assert_unique, keep_first
from cohortspark.operators.ordering import next_value


# --- reshape ----------------------------------------------------------------------------


def test_likert_items_keep_nulls(frame, values):
    df = frame("id string, q_1 double, q_12 double", ("a", 1.0, None))
    assert values(reshape.items_long_likert(df, ["id"], "q")) == [("a", 1, 1.0), ("a", 12, None)]


def test_slider_items(frame, values):
    df = frame("id string, `3_beq_1` double", ("a", 50.0))
    assert values(reshape.items_long_slider(df, ["id"], ["3_beq_1"], 7, 1)) == [("a", 3, 4.0)]


def test_pairs_and_two_keys(frame, values):
    df = frame("id string, `1_a_1` int, `1_b` int, `2_a_1` int", ("x", 7, 2, 5))
    assert values(reshape.unpivot_pairs(df, ["id"], df.columns[1:], ["a", "b"])) == [
        ("x", 1, 7, 2), ("x", 2, 5, None)
    ]
    df = frame("id string, `1_s_state_1` double, `1_s_trait_1` double", ("x", 1.0, 2.0))
    assert values(reshape.unpivot_two_keys(df, ["id"], df.columns[1:])) == [
        ("x", 1, "state", 1.0), ("x", 1, "trait", 2.0)
    ]


def test_score_type_rows(frame):
    df = frame(
        "id string, adj__i_panas_sf_neg double, patched__i_panas_sf_neg double, patched__swls double",
        ("a", 1.0, 2.0, 3.0),
    )
    out = reshape.score_type_long(df)
    assert out.columns == ["id", "score_type", "i_panas_sf_neg", "swls"]
    assert {r.score_type: (r.i_panas_sf_neg, r.swls) for r in out.collect()} == {
        "adj": (1.0, None), "patched": (2.0, 3.0)
    }


def test_melt_then_widen_is_identity(frame, values):
    df = frame("id int, a double, b double", *[(i, float(i), None if i % 3 else 2.0 * i) for i in range(20)])
    long = reshape.unpivot(df, ["id"], ["a", "b"], "name", "value")
    wide = reshape.widen(long, ["id"], "name", ["a", "b"], ["value"], lambda m, v: v)
    assert values(wide) == values(df)


def test_melt_adds_no_exchange(spark):
    wide = spark.range(100).select("id", F.rand().alias("a"), F.rand().alias("b")).repartition("id")
    long = reshape.unpivot(wide, ["id"], ["a", "b"], "name", "value")
    scored = long.groupBy("id", "name").agg(F.sum("value").alias("v"))
    assert hash_exchanges(scored) == 1
    assert hash_exchanges(reshape.widen(scored, ["id"], "name", ["a", "b"], ["v"])) == 1


def test_split_and_grid(frame, values):
    df = frame("q string", "12. Do you (x)*", "7", "a b c")
    assert values(reshape.split_column(df, "q", ("n", "t")), "n", "t") == [
        ("12", "Do you (x)*"), ("7", None), ("a", "b c")
    ]
    df = frame("b string, s string", ("0 to +", "pos"), ("0 to -", "neg"), ("0 to +", "pos"))
    grid = reshape.expand_grid(df, ["b", "s"], "kind", F.array(F.lit("cat"), F.lit("cont")))
    assert grid.count() == 4


# --- order and duplicates ---------------------------------------------------------------


def test_keep_first_latest_and_earliest(frame, values):
    df = frame("id string, t int, v string", ("a", 1, "x"), ("a", 2, "y"), (None, 3, "n"), (None, 4, "m"))
    assert values(keep_first(df, ["id"], [F.desc("t")])) == [("a", 2, "y"), (None, 4, "m")]
    assert values(keep_first(df, ["id"], [F.asc_nulls_last("t")])) == [("a", 1, "x"), (None, 3, "n")]


def test_keep_first_ignores_input_order_and_limits_before_exchange(spark, values):
    df = spark.range(2000).select(
        (F.col("id") % 37).alias("k"), F.col("id").alias("ord"), F.rand(1).alias("v")
    )
    first = keep_first(df, ["k"], ["ord"])
    assert values(first) == values(keep_first(df.orderBy(F.rand(3)).repartition(7), ["k"], ["ord"]))
    assert first.count() == 37
    text = plan(first)
    assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning")
    assert "Partial" in text


def test_assert_unique(frame):
    ok = frame("a int", 1, 2)
    assert assert_unique(ok, ["a"]).count() == 2
    with pytest.raises(Exception, match="more than one row per a"):
        assert_unique(frame("a int", 1, 1), ["a"]).collect()


def test_next_value_on_slider_rows(frame):
    df = frame(
        "s string, o int, kind string, timeout int",
        ("p", 1, "slider", 0), ("p", 2, "submit", 1), ("p", 3, "slider", 0), ("p", 4, "submit", 0),
    ).withColumn("c", F.lit(0))
    out = next_value(df, ["s"], ["o"], "timeout", "next", "c").filter("kind = 'slider'")
    assert [r["next"] for r in out.orderBy("o").collect()] == [1, 0]


def test_next_value_reads_its_input_once(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(500).selectExpr("id % 5 AS k", "id AS o", "id / 40 AS c", "id * 2 AS v").write.parquet(path)
    out = next_value(spark.read.parquet(path).filter("v <> 8"), ["k"], ["o"], "v", "n", "c")
    text = final_plan(out).split("== Initial Plan ==")[0]
    assert text.count("ReusedExchange") == 1 and text.count("Scan parquet") == 1
    assert {(r.o, r.n) for r in out.filter("k = 4").collect()} >= {(9, 28), (494, 998), (499, None)}


def test_grid_of_a_factor_table(frame, values):
    df = frame("b string, s int", ("x", 1), ("x", 1), ("y", None))
    kinds = frame("kind string, other int", ("cat", 1), ("cont", 2), ("cat", 3))
    grid = reshape.expand_grid(df, ["b", "s"], "kind", kinds)
    assert values(grid) == [("x", 1, "cat"), ("x", 1, "cont"), ("y", None, "cat"), ("y", None, "cont")]


@pytest.mark.parametrize("width", [1, 3, 10, 1000])
def test_next_value_crosses_chunks(spark, width):
    rng = random.Random(width)
    rows, expected = [], {}
    for key in ["a", "b", None]:
        size = 60 if key == "a" else 7
        ords = sorted(rng.sample(range(200), size))
        vals = [None if rng.random() < 0.3 else rng.randint(0, 9) for _ in ords]
        for i, (o, v) in enumerate(zip(ords, vals)):
            rows.append((key, o, v))
            expected[(key, o)] = vals[i + 1] if i + 1 < size else None
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    df = df.withColumn("c", F.floor(F.col("o") / width))
    out = next_value(df, ["k"], ["o"], "v", "n", "c")
    assert out.columns == ["k", "o", "v", "c", "n"]
    assert {(r.k, r.o): r.n for r in out.collect()} == expected


# --- joins ------------------------------------------------------------------------------


def test_missing_keys_match(frame, values):
    left = frame("k string, a int", ("x", 1), (None, 2), ("y", 3))
    right = frame("k string, b int", ("x", 10), (None, 20))
    assert values(joins.left_join(left, right, ["k"])) == [("x", 1, 10), ("y", 3, None), (None, 2, 20)]
    plain = joins.left_join(left, right, ["k"], na_matches=False)
    assert values(plain) == [("x", 1, 10), ("y", 3, None), (None, 2, None)]
    assert values(joins.semi_keep(left, right, ["k"])) == [("x", 1), (None, 2)]


def test_full_join_and_alias(frame, values):
    parts = [frame("k int, a int", (1, 1), (2, 2)), frame("k int, b int", (2, 3)), frame("k int, c int", (4, 5))]
    assert values(joins.full_join_reduce(parts, ["k"])) == [
        (1, 1, None, None), (2, 2, 3, None), (4, None, None, 5)
    ]
    people = frame("id string, v int", ("bad", 1), ("good", 2), (None, 3))
    aliases = frame("alias string, target string", ("bad", "fixed"))
    assert values(joins.apply_aliases(people, aliases, "id"), "id", "v") == [
        ("fixed", 1), ("good", 2), (None, 3)
    ]


def test_union_tagged_fills(frame, values):
    out = joins.union_tagged({"one": frame("a int", 1), "two": frame("a int, b int", (2, 3))}, "src")
    assert values(out, "a", "b", "src") == [(1, None, "one"), (2, 3, "two")]


@pytest.fixture
def small_skew_limits(spark):
    """Thresholds scaled down so that a test-sized hot key counts as skewed."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_rows(spark):
    """Participant 7 holds a third of all rows."""
    return spark.range(0, 60000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 3000).alias("k"),
        F.col("id").alias("v"),
    )


def test_skewed_join_is_split(spark, small_skew_limits):
    people = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    joined = joins.left_join(hot_rows(spark), people, ["k"])
    assert joined.count() == 60000
    assert "skew=true" in final_plan(joined)


def test_skewed_quantile_is_split_and_exact(spark, small_skew_limits):
    rows = hot_rows(spark)
    hot = rows.filter("k = 7").toPandas()["v"]
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.2")
    found = stats.group_quantile(rows, ["k"], "v", 0.75, "q")
    assert found.count() == 2000
    final = final_plan(found).split("== Initial Plan ==")[0]
    spark.conf.unset("spark.sql.adaptive.skewJoin.skewedPartitionFactor")
    # the hot key meets its bracket in several tasks, which count before they send
    assert "skew=true" in final
    # what goes to one task is counted before, by key, side and value
    assert re.search(r"hashpartitioning\(_key#\w+, _rows#\w+, _side#\w+, _groupingexpression", plan(found))
    assert found.filter("k = 7").first().q == pytest.approx(float(np.quantile(hot, 0.75)))


# --- totals, z, quantiles ---------------------------------------------------------------


def test_row_totals_compat_and_corrected(frame):
    df = frame("tas20_a double, tas20_b double, nas_tas20 int", (10.0, 5.0, 2), (None, 5.0, 1))
    out = df.select(
        stats.row_total(df, "tas20").alias("compat"),
        stats.row_total(df, "tas20", exclude="^nas_").alias("corrected"),
    ).collect()
    assert [tuple(r) for r in out] == [(17.0, 15.0), (6.0, 5.0)]
    df = frame("beq_a double, beq_b double, beq_c double, nas_beq int", (4.0, 5.0, 6.0, 0), (None, None, None, None))
    out = df.select(
        stats.row_mean(df, "beq").alias("compat"), stats.row_mean(df, "beq", "^nas_").alias("corrected")
    ).collect()
    assert [tuple(r) for r in out] == [(3.75, 5.0), (None, None)]


def test_missing_counts(frame):
    df = frame("id int, QA_1 string, qa_2 string, x_qa string", (1, None, "a", None))
    assert df.select(stats.missing_counts(df, {"n": "qa"})["n"]).first()[0] == 1
    assert df.select(stats.missing_counts(df, {"n": "qa"}, "contains")["n"]).first()[0] == 1
    out = stats.with_missing_counts(df, {"n": "qa", "none": "zz"}).first()
    assert (out.n, out.none, out.nas_total) == (1, 0, 1)


def test_zscore(frame):
    df = frame("x double, c double", (1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (None, 5.0))
    out = stats.zscore(df, {"x": "z", "c": "cz"}).collect()
    assert [r.z for r in out] == [-1.0, 0.0, 1.0, None]
    assert all(r.cz is None for r in out)
    assert stats.zscore(df, {"x": "z"}).columns == ["x", "c", "z"]
    assert "Window" not in plan(stats.zscore(df, {"x": "z"}))


@pytest.mark.parametrize("p", [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])
def test_group_quantile_is_exact(spark, p):
    """Single rows, ties, signs, sizes from denormal to huge, and a missing key."""
    rng = np.random.default_rng(int(p * 100) + 16)
    rows, expected = [], {}
    for key, size in [(1, 1), (2, 2), (3, 17), (4, 100), (5, 1501), (None, 400), (7, 300)]:
        x = rng.normal(size=size) if key != 7 else rng.integers(0, 3, size).astype(float)
        x = np.round(x, 3)
        if key == 4:
            x = x * 10.0 ** rng.integers(-300, 300, size)
        expected[key] = float(np.quantile(x, p))
        rows += [(key, float(v)) for v in x] + [(key, None)]
    rng.shuffle(rows)
    rows = [(None if k is None else int(k), v) for k, v in rows]
    df = spark.createDataFrame(rows, "k int, v double").repartition(6)
    got = {r.k: r.q for r in stats.group_quantile(df, ["k"], "v", p, "q").collect()}
    assert got.keys() == expected.keys()
    for key in got:
        assert got[key] == pytest.approx(expected[key], rel=1e-9)


@pytest.mark.parametrize("p", [0.0, 0.003, 0.5, 0.75, 1.0])
def test_bracket_of_a_large_key_is_exact_and_small(spark, p):
    """Half a million values in odd places, ties included, over many partitions."""
    value = F.when(F.col("id") % 3 == 0, F.lit(1.5)).otherwise(F.hash("id") / 1e6)
    df = spark.range(0, 500_000, 1, 16).select(F.lit("a").alias("k"), value.alias("v"))
    data = df.toPandas()["v"].to_numpy()
    found = stats.group_quantile(df, ["k"], "v", p, "q")
    assert found.first().q == pytest.approx(float(np.quantile(data, p)), rel=1e-12)
    assert plan(found).count("Exchange hashpartitioning") <= 5


def test_rank_outside_its_bracket_never_passes_for_an_answer(spark, monkeypatch):
    df = spark.range(0, 200_000, 1, 8).select(F.lit(1).alias("k"), F.rand(3).alias("v"))
    monkeypatch.setattr(stats, "SKETCH", 10)
    with pytest.raises(Exception, match="outside its bracket"):
        stats.group_quantile(df, ["k"], "v", 0.5, "q", margin=1e-4).collect()
    exact = float(np.quantile(df.toPandas()["v"], 0.5))
    assert stats.group_quantile(df, ["k"], "v", 0.5, "q", margin=0.2).first().q == pytest.approx(exact)


def test_group_quantile_runs_nothing_while_building(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), F.raise_error(F.lit("ran")).cast("double").alias("v"))
    stats.group_quantile(df, ["k"], "v", 0.75, "q")


def test_golden_quantile(frame):
    df = frame("k int, v double", *[(1, v) for v in (1.0, 2.0, 3.0, 10.0)])
    assert stats.group_quantile(df, ["k"], "v", 0.75, "q").first().q == 4.75
