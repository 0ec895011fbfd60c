import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare, connect

from cohortspark.llm import spelling
from cohortspark.llm.queries import LLM

FOLDER = "/root/testdata/sf0.001"


def plain_counts(rows, least=7):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            value = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if value % 31 == 0:
                run = run[: value % len(run)] + run[value % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= least and n >= 2}


def plain_groups(words, ratio=10):
    """Near words by what is left when a letter goes."""
    cut, near, form = defaultdict(set), defaultdict(set), {}
    for word in words:
        for n in range(len(word)):
            cut[word[:n], word[n + 1 :]].add(word)
    for (head, tail), group in cut.items():
        for word in group:
            near[word] |= group - {word}
            if head + tail in words:
                near[word].add(head + tail)
                near[head + tail].add(word)
    for word in words:
        best = min(near[word], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * words[word]:
            form[word] = best
    rows = []
    for word, n in words.items():
        root = word
        while root in form:
            root = form[root]
        rows.append((word, form.get(word), root, n, len(near[word]), words[form[word]] if word in form else None))
    return sorted(rows)


def table(spark, words):
    return spelling.stage(spark.createDataFrame(list(words.items()), "word string, n long"), "given")


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table_against_plain_groups(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    result = LLM.queries["op12_spelling_variants"](spark, FOLDER)
    assert result.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found(result) == plain_groups(plain_counts(rows))


def test_agrees_with_sql(spark):
    name = "op12_spelling_variants"
    assert compare(spark, connect(FOLDER), LLM.queries[name], LLM.sql[name], FOLDER) == ""


def crowded(seed, letters, size, count):
    draw = random.Random(seed)
    words = {"".join(draw.choice(letters) for _ in range(draw.randint(size - 2, size + 1))) for _ in range(count)}
    return {w: draw.choice([2, 3, 20, 30, 300, 5000]) for w in words}


@pytest.mark.parametrize("letters", ["ab", "aeé×", "abcdefghij", "zàøxÿ"])
def test_crowded_words_have_all_their_links(spark, letters):
    words = crowded(len(letters), letters, 8, 500)
    assert found(spelling.spelling_groups(table(spark, words))) == plain_groups(words)


@pytest.mark.parametrize("most", [1, 8])
def test_fine_buckets_and_full_leaves_lose_nothing(spark, monkeypatch, most):
    words = crowded(5, "abcdé", 9, 400)
    monkeypatch.setattr(spelling, "BUCKET_WORDS", most)
    assert spelling.bucket_groups(table(spark, words), most) > 4
    assert found(spelling.spelling_groups(table(spark, words))) == plain_groups(words)


def each_pair(words, groups, owner=None):
    coded = sorted(w.encode("latin-1") for w in words)
    owner = np.ones(len(coded), bool) if owner is None else owner(coded)
    pairs = [(coded[a], coded[b]) for x, y in spelling.pairs_of(coded, owner, groups) for a, b in zip(x, y)]
    assert len(pairs) == len(set(map(frozenset, pairs)))
    return {frozenset(p) for p in pairs}


def test_leaf_lookup_and_small_fronts_find_the_same_pairs(monkeypatch):
    # words of the same letters: one leaf holds all of them
    draw = random.Random(2)
    words = {"".join(draw.sample("aaabbbàcc", 9)) for _ in range(300)}
    level = spelling.LEVEL_OF
    swaps = {w.replace("a", chr(c), 1) for w in words for c in range(192, 256) if level[c] == level[97]}
    want = each_pair(words | swaps, 1)
    monkeypatch.setattr(spelling, "LEAF_WORDS", 2)
    assert each_pair(words | swaps, 1) == want
    monkeypatch.setattr(spelling, "FRONT", 7)
    assert each_pair(words | swaps, 1) == want and len(want) > 300


def test_chains_long_words_and_ties(spark):
    long = "ab" * 40_000
    words = {"aaaaaaaa": 5000, "aaaaaaab": 500, "aaaaaabb": 50, "aaaaabbb": 5, "bbbbbbbb": 7, "bbbbbbbc": 70,
             "bbbbbbbd": 70, long: 2, long + "é": 20, long[1:]: 2}
    rows = {r[0]: r for r in found(spelling.spelling_groups(table(spark, words)))}
    assert [tuple(r) for r in sorted(rows.values())] == plain_groups(words)
    assert rows["aaaaabbb"][2] == "aaaaaaaa" and rows["bbbbbbbb"][1] == "bbbbbbbc"
    assert rows[long][1] == long + "é" and rows[long[1:]][4] == 1


def test_edges(spark, docs):
    text = "Straße straße STRASSE naïveté NAÏVETÉ " * 3
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, "x" * 1_000_000), (5, "y" * 9 + "1" + "y" * 9)]
    words = spelling.word_counts(docs(*rows))
    assert dict(words.collect()) == plain_counts(rows)
    assert spelling.spelling_groups(words).count() == words.count()
    empty = spelling.spelling_groups(spelling.word_counts(docs(*rows).limit(0)))
    assert empty.count() == 0 and empty.columns[0] == "word"
    with pytest.raises(ValueError):
        spelling.spelling_groups(words, ratio=1)


def test_one_edit_by_hand():
    same = [(b"abc", b"abc"), (b"abc", b"acb"), (b"abc", b"abcde"), (b"", b"")]
    near = [(b"abc", b"abd"), (b"abc", b"xabc"), (b"abc", b"ab"), (b"aab", b"ab"), (b"", b"a")]
    assert not any(spelling.one_edit(*p) for p in same) and all(spelling.one_edit(*p) for p in near)
