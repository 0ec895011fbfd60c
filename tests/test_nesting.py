from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortspark.operators import nesting
from cohortspark.operators.nesting import nest_rows, unnest_rows

SCHEMA = "k string, `a.b` int, t string"
ROWS = st.lists(
    st.tuples(st.sampled_from(["x", "y", None]), st.one_of(st.none(), st.integers(0, 3)), st.sampled_from(["", "é", None])),
    max_size=40,
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=ROWS, size=st.integers(1, 5))
def test_rows_survive_nesting(spark, rows, size):
    df = spark.createDataFrame(rows, SCHEMA)
    nested = nest_rows(df, ["k"], size=size).cache()
    got = nested.collect()
    assert all(1 <= len(r.data) <= size for r in got)
    assert len({(r.k, r.chunk) for r in got}) == len(got)
    back = unnest_rows(nested)
    assert back.columns == ["k", "a.b", "t"]
    assert Counter(tuple(r) for r in back.collect()) == Counter(rows)
    nested.unpersist()


def test_hot_key_is_spread_and_columns_are_carried(spark):
    """A key with a third of all rows has many bounded lists, whatever its copies."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 500)).alias("k"),
        F.when(F.col("id") % 6 == 0, F.lit(-1)).otherwise(F.col("id")).alias("v"),
    )
    nested = nest_rows(df, ["k"], size=100).withColumn("size", F.size("data")).cache()
    hot = nested.filter("k = 'hot'")
    # 5,000 different rows and 5,000 copies of one
    assert hot.agg(F.sum("size"), F.max("size") <= 100, F.count("*") >= 50).first() == (5_001, True, True)
    back = unnest_rows(nested)
    assert back.columns == ["k", "size", "v"]
    same = back.select("k", "v").exceptAll(df).count() + df.exceptAll(back.select("k", "v")).count()
    assert same == 0
    nested.unpersist()


def test_copies_are_counted_out_in_runs(spark, monkeypatch):
    monkeypatch.setattr(nesting, "RUN", 7)
    df = spark.range(50).select(F.lit("k").alias("k"), (F.col("id") < 30).alias("v"))
    back = unnest_rows(nest_rows(df, ["k"]))
    assert {tuple(r) for r in back.groupBy("v").count().collect()} == {(True, 30), (False, 20)}


def test_names_sizes_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert unnest_rows(nest_rows(empty, ["k"])).collect() == []
    only_key = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert unnest_rows(nest_rows(only_key, ["k"])).count() == 3
    with pytest.raises(ValueError, match="clash"):
        nest_rows(only_key.withColumn("chunk", F.lit(1)), ["k"])
    with pytest.raises(ValueError, match="one row"):
        nest_rows(only_key, ["k"], size=0)
    other = nest_rows(only_key.withColumn("chunk", F.lit(1)), ["k"], into="rows", chunk="part")
    assert unnest_rows(other, into="rows", chunk="part").columns == ["k", "chunk"]
