import re

import numpy as np
import pytest
import xxhash

from cohortspark.llm import simhash
from cohortspark.llm.components import components
from cohortspark.llm.queries import LLM

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text, size=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[n : n + size]) for n in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits=4):
    """Least index reachable, by breadth-first search over all pairs of different values."""
    values = sorted(set(fps))
    near = {v: [w for w in values if (v ^ w).bit_count() <= bits] for v in values}
    least = {v: min(i for i, f in enumerate(fps) if f == v) for v in values}
    comp = {}
    for v in values:
        if v not in comp:
            seen, todo = {v}, [v]
            while todo:
                new = [w for w in near[todo.pop()] if w not in seen]
                seen.update(new)
                todo += new
            comp.update(dict.fromkeys(seen, min(least[w] for w in seen)))
    return [comp[f] for f in fps]


def test_fingerprint_as_plain():
    for text in ("", " \t", "One", "a b C", "a b c d", "A b\x0bc d e é\x85x " * 3, "x y z w " * 9000):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("limit", [1 << 20, 500])
@pytest.mark.parametrize("max_bits", [3, 4])
def test_links_as_all_pairs(spark, monkeypatch, limit, max_bits):
    """Random centres with neighbours on both sides of the radius, and a dense cluster."""
    monkeypatch.setattr(simhash, "LEAF_VARIANTS", limit)
    rng = np.random.default_rng(5)
    flip = lambda v, n: v ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    centres = [int(rng.integers(0, 2**63)) * 2 + n % 2 for n in range(25)]
    fps = centres + [flip(c, n) for c in centres for n in (1, 3, 4, 5, 6)]
    fps += [flip(centres[0], int(rng.integers(0, 3))) for _ in range(120)] + [0, 1, 2**64 - 1]
    values = sorted(set(fps))
    signed = [(int(np.array(v, "u8").view("i8")),) for v in values]
    links = simhash.ball_links(spark.createDataFrame(signed, "fp long"), max_bits)
    roots = {r.node: r.root for r in components(links).collect()}
    mine = {}
    for v, (s,) in zip(values, signed, strict=True):
        mine.setdefault(roots.get(s, s), set()).add(v)
    theirs = {}
    for v, c in zip(values, plain_components(values, max_bits), strict=True):
        theirs.setdefault(c, set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    roots = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {roots.get(n, n) for n in range(41)} == {0} and {roots.get(n, n) for n in range(100, 160)} == {100}
    assert roots[200] == 199 and 7 in roots
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    rows = sorted(rows)
    fps = [plain_fingerprint(r.text) for r in rows]
    comps = plain_components(fps)
    want = {r.doc_id: (f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, comps, strict=True)}
    result = LLM.queries["op9_simhash"](spark, FOLDER).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in result} == want and len(result) == len(rows)


def test_edges(spark, docs):
    rows = [(5, None), (4, ""), (None, " "), (3, "one two"), (3, "one two"), (None, "a lone text"), (9, "w " * 200_000)]
    out = simhash.near_duplicates(docs(*rows)).collect()
    assert len(out) == len(rows)
    assert sorted(str(r.component_id) for r in out) == sorted(["4", "4", "4", "3", "3", "None", "9"])
    kept = simhash.keep_first(docs(*rows))
    assert kept.columns == docs(*rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "9", "None"]
    assert simhash.near_duplicates(docs(*rows).limit(0)).count() == 0


def test_odd_radius_links_around_others_of_a_variant(spark):
    """Others lie between near fingerprints in the variants that they share."""
    for fps in ([0, 4, 6, 8, 9, 10], [2, 3, 6, 7, 11, 12, 26, 27, 28, 30]):
        own = np.array(fps, np.uint64)
        a, b = simhash.bucket_links(own, own, np.ones(len(own), np.int64), 64, 1)
        places = np.searchsorted(own, a), np.searchsorted(own, b)
        assert not simhash.local_roots(len(own), *places).any()
    for base in (0, 1 << 40, 5 << 33):
        fps = [base ^ v for v in (1, 3, 8, 9)]
        links = simhash.ball_links(spark.createDataFrame([(v,) for v in fps], "fp long"), 1)
        roots = {r.node: r.root for r in components(links).collect()}
        assert len({roots.get(v, v) for v in fps}) == 1
    values = np.arange(1, 1 << 9, 2)[np.random.default_rng(3).permutation(256)[:90]].tolist()
    for bits in (1, 3):
        links = simhash.ball_links(spark.createDataFrame([(v,) for v in values], "fp long"), bits)
        roots = {r.node: r.root for r in components(links).collect()}
        want = plain_components(values, bits)
        groups = lambda keys: sorted(sorted(v for v, k in zip(values, keys, strict=True) if k == g) for g in set(keys))
        assert groups([roots.get(v, v) for v in values]) == groups(want)
