import csv
import io
import random

import pytest
from plans import final_plan

from cohortspark.sources.exports import read_survey

NAMES = ["prolific_id", "free, text", "score_1", "empty"]


def export(rows, end="\n"):
    out = io.StringIO()
    write = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=end)
    write.writerows([NAMES, ["id", "What did\nyou see?", "1-5", "-"], ["{a}", "{b}", "{c}", "{d}"], *rows])
    return out.getvalue()


def answers(count, seed):
    draw = random.Random(seed)
    parts = ["word", "a, b", 'said "no"', "\n", "\n\n", "é", "NA", "x" * 50, "", '"', ",", '""\n"']
    rows = []
    for n in range(count):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12))).strip()
        rows.append([f"p{n}", "t" + text + "t", str(draw.randint(1, 5)), ""])
    # one answer that covers several splits
    rows[count // 2][1] = "start\n" + "a long line of text\n" * 400 + "end"
    return rows


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_do_not_depend_on_the_splits(spark, tmp_path, small_splits, end):
    rows = answers(300, 1)
    path = tmp_path / "export.csv"
    path.write_bytes(export(rows, end).encode())
    want = [tuple(v if v not in ("", "NA") else None for v in r) for r in rows]
    want = [(a, b.replace("\r\n", "\n"), c, d) for a, b, c, d in want]
    size = path.stat().st_size
    for splits in (1, 7, 50):
        small_splits(size // splits + 1)
        assert spark.read.text(str(path)).rdd.getNumPartitions() >= splits
        found = read_survey(spark, str(path)).orderBy("split_start", "row_ord")
        got = [(r[0], r[1], r[2], r[3] or None) for r in found.collect()]
        assert got == want


def test_same_rows_as_the_reader_of_whole_files(spark, tmp_path, small_splits):
    path = tmp_path / "export.csv"
    path.write_text(export(answers(120, 2)))
    small_splits(2000)
    mine = read_survey(spark, str(path), numbers=["score"]).drop("split_start", "row_ord")
    whole = spark.read.csv(
        str(path), header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True
    ).filter("prolific_id like 'p%'")
    key = lambda rows: sorted((r[0], r[1], float(r[2]), r[3]) for r in rows)
    assert key([tuple(x or "" for x in r) for r in mine.collect()]) == key([tuple(x or "" for x in r) for r in whole.collect()])
    text = final_plan(mine)
    assert "CartesianProduct" not in text and "SinglePartition" not in text


def test_blank_lines_and_files_without_answers(spark, tmp_path, small_splits):
    path = tmp_path / "export.csv"
    path.write_text("a,b\n\nlabel,label\n \nid,id\n\n1,\"x\n\ny\"\n\n2,z\n\n")
    small_splits(5)
    found = read_survey(spark, str(path)).orderBy("row_ord").collect()
    assert [(r.a, r.b) for r in found] == [("1", "x\n\ny"), ("2", "z")]
    path = tmp_path / "none.csv"
    path.write_text("a,b\nlabel,label\nid,id\n")
    assert read_survey(spark, str(path)).count() == 0
