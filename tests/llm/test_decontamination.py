import os

import pytest

from cohortspark.llm import decontamination as de
from cohortspark.llm.queries import LLM

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def items(spark):
    def make(*rows):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, `a.b` string")

    return make


def flags(df):
    return sorted(((r.doc_id, r.contaminated, list(r["items"])) for r in df.collect()), key=str)


QUESTION = "If Alice has 12 apples and gives 5 apples to Bob then how many apples does Alice keep for herself today?"


def test_templates_replace_numbers_units_and_names():
    one = de.Templates([b"Ann walked 5 km with Bob. Then Carol ran twelve miles, (30%) more."])
    kinds = dict(zip(one.words[0], one.kind.tolist(), strict=True))
    assert kinds[b"Ann"] == kinds[b"Then"] == kinds[b"walked"] == de.LITERAL
    assert kinds[b"5"] == kinds[b"twelve"] == kinds[b"(30%)"] == de.IS_NUMBER
    assert kinds[b"km"] == kinds[b"miles,"] == de.IS_UNIT
    assert kinds[b"Bob."] == kinds[b"Carol"] == de.IS_NAME


def test_copies_and_new_parameters_are_caught_but_not_mixed_slots(docs, items):
    other = QUESTION.replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "40").replace("5", "seven")
    mixed = QUESTION.replace("does Alice", "does Zed")
    changed = "If Alice sold 12 pears and then lost 5 pears near Bob who counted how few pears did Alice find later?"
    rows = [(1, f"Before it all. {QUESTION} And after."), (2, "so: " + other), (3, mixed), (4, changed),
            (5, "plain words that have nothing to do with it at all, whatever they say"), (6, QUESTION[:45])]
    out = flags(de.find_leaks(docs(*rows), items((7, QUESTION))))
    assert [(i, c) for i, c, _ in out] == [(1, True), (2, True), (3, False), (4, False), (5, False), (6, True)]
    assert out[0][2] == out[1][2] == [7]
    kept = de.drop_leaks(docs(*rows), items((7, QUESTION)))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5] and kept.columns == docs(*rows).columns


def test_short_items_shared_windows_and_edges(docs, items):
    bench = items((3, "five words make an item"), (1, "too short"), (None, "an item without any id at all is not used"),
                  (9, None), (8, ""), (5, "five words make an item"))
    rows = [(1, "here five words make an item. ok"), (None, "five words make an item"), (2, None), (3, ""),
            (4, "too short"), (5, "twice five words make an item"), (5, "twice five words make an item"),
            (6, "word " * 100_000), (7, "an item without any id at all is not used")]
    out = flags(de.find_leaks(docs(*rows), bench))
    assert [(i, c) for i, c, _ in out if c] == [(1, True), (5, True), (5, True), (None, True)] and len(out) == len(rows)
    assert {tuple(x) for _, c, x in out if c} == {(3,)}
    assert len(de.drop_leaks(docs(*rows), bench).collect()) == 5
    assert not any(c for _, c, _ in flags(de.find_leaks(docs(*rows), bench.limit(0))))
    assert de.find_leaks(docs(*rows).limit(0), bench).count() == 0


def test_whole_table_against_plain_search(spark):
    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    bare = lambda t: [w.strip(".,").lower() for w in t.split()]
    windows = {tuple(w[n : n + 8]) for r in bench for w in [bare(r.text)] for n in range(len(w) - 7)}
    want = {i for i, t in texts.items() for w in [bare(t)] if any(tuple(w[n : n + 8]) in windows for n in range(len(w) - 7))}
    result = LLM.queries["op6_decontamination"](spark, FOLDER).collect()
    assert len(result) == len(texts) and want
    assert {r.doc_id for r in result if r.contaminated} == want


def test_every_item_of_a_window_is_tested(docs, items):
    first = "a shop sold 5 pens and then sold 5 books to them"
    second = "a shop sold 3 pens and then sold 9 books to them"
    twice = "they gave 4 red pens to us all and they gave 4 red pens to us all but 6 more"
    rows = [(1, "once " + second + " ok"), (2, first), (3, second.replace("3", "8")), (4, first.replace("5 books", "6 books"))]
    out = flags(de.find_leaks(docs(*rows), items((1, first), (2, second), (3, second))))
    assert out == [(1, True, [2]), (2, True, [1]), (3, True, [2]), (4, True, [2])]
    out = flags(de.find_leaks(docs((1, twice[len("they gave 4 red pens to us all and ") :])), items((1, twice))))
    assert out == [(1, True, [1])]


def test_opening_words_match_after_anything(docs, items):
    year, apples = "What year did Rome fall to invaders?", "Alice has 12 red apples today, right?"
    rows = [(1, "Question 3\n" + year), (2, "So, " + year), (3, 'He said "no." ' + year), (4, year.lower()[:4] + year[4:]),
            (5, apples.replace("Alice", "Bob")), (6, "then " + apples.replace("Alice", "Bob")), (7, apples),
            (8, "What did Rome do this year to please invaders?")]
    out = flags(de.find_leaks(docs(*rows), items((1, year), (2, apples))))
    assert out == [(1, True, [1]), (2, True, [1]), (3, True, [1]), (4, True, [1]),
                   (5, True, [2]), (6, True, [2]), (7, True, [2]), (8, False, [])]
    again = "This one was 5 feet. This one was told to stay at home for all of it."
    out = flags(de.find_leaks(docs((1, again.replace("This", "That", 1))), items((1, again))))
    assert out == [(1, True, [1])]


def test_marks_inside_closing_quotes_end_a_sentence():
    one = de.Templates(['She said "go." Then (why?) Bob left.” Soon Ann ran.'.encode()])
    kinds = dict(zip(one.words[0], one.kind.tolist(), strict=True))
    assert kinds[b"Then"] == kinds[b"Bob"] == kinds[b"Soon"] == de.LITERAL and kinds[b"Ann"] == de.IS_NAME


def test_verbatim_copies_of_slots_and_unspaced_text(docs, items):
    bench = [(1, "Convert 5 miles to 8 km"), (2, "7 12 19 31 50 81"), (3, "Ann Bob Carol Dan Eve Finn Gus Hal Ida Jon"),
             (4, "小明有五个苹果他又买了三个苹果现在他一共有几个苹果呢"), (5, "ประเทศไทยมีเมืองหลวงชื่อว่าอะไร")]
    rows = [(i, f"Row 3:\n{t} and so on") for i, t in bench]
    rows += [(11, "Convert 6 miles to 9 km"), (12, "7 12 19 31 50 82"), (13, "see Carol Dan Eve Finn Gus Hal Ida Jon go"),
             (14, "老师说" + bench[3][1][:16] + "，完"), (15, "小明有五个苹果而老师没有买了三个"), (16, "苹果")]
    out = {i: (c, x) for i, c, x in flags(de.find_leaks(docs(*rows), items(*bench)))}
    assert all(out[i] == (True, [i]) for i, _ in bench)
    assert [out[i] for i in (11, 12, 13, 14, 15, 16)] == [
        (False, []), (False, []), (True, [3]), (True, [4]), (False, []), (False, [])]


def test_a_common_frame_alone_is_no_leak(docs, items):
    born = "the painter was born in Paris on 4 May 1900 and soon left his parents for a life at sea"
    short, leading = "was born in Rome on 7 June 1905", "Alice has 12 red apples today and 3 pears"
    rows = [(1, "she was born in London on 7 March 1950 they say"), (2, "she was born in Paris on 4 May 1900 they say"),
            (3, born.replace("Paris", "Oslo").replace("1900", "1901")), (4, "he was born in Bonn on 9 July 1950"),
            (5, leading.replace("Alice", "Bob").replace("12", "14").replace("3", "5"))]
    out = flags(de.find_leaks(docs(*rows), items((1, born))))
    assert [c for _, c, _ in out] == [False, True, True, False, False]
    out = flags(de.find_leaks(docs(*rows), items((2, short), (3, leading))))
    assert out[3] == (4, True, [2]) and out[4] == (5, True, [3])


def test_a_conflict_leaves_windows_without_placeholders(docs, items):
    text = "When Alice went out " + "the cat sat down by a warm old stove and slept until noon " + "so Alice came back"
    out = flags(de.find_leaks(docs((1, text.replace("so Alice", "so Zed"))), items((1, text))))
    assert out == [(1, True, [1])]
