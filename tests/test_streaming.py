"""Row-local operators accept an unbounded frame; nothing of their own keeps state."""

from cohortspark.functions import sentinel_null
from cohortspark.operators.reshape import items_long_likert, score_type_long
from cohortspark.operators.scoring import score_wide
from cohortspark.plans import scales
from cohortspark.plans.scales import KeyItem, SurveyKeys


def test_score_a_stream_of_respondents(spark, tmp_path):
    schema = "subj_num string, tas20_1 double, tas20_2 double"
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 5.0, -99.0), ("b", 1.0, 2.0)], schema).write.parquet(source)
    keys = SurveyKeys({"tas20": [KeyItem(1, "x", True), KeyItem(2, "x", False)]})
    stream = sentinel_null(spark.readStream.schema(schema).parquet(source))
    scored = score_type_long(score_wide(stream, [scales.TAS20], keys))
    items = items_long_likert(stream, ["subj_num"], "tas20")
    results = {}
    for name, frame in (("scored", scored), ("items", items)):
        query = frame.writeStream.format("memory").queryName(name).outputMode("append").start()
        query.processAllAvailable()
        query.stop()
        results[name] = spark.table(name).collect()
    assert {(r.subj_num, r.score_type): r.tas20_x for r in results["scored"]} == {
        ("a", "patched"): 4.0, ("a", "adj"): 2.0, ("b", "patched"): 7.0, ("b", "adj"): 7.0
    }
    assert len(results["items"]) == 4
