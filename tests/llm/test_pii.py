import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspark.llm import pii
from cohortspark.llm.queries import LLM

FOLDER = "/root/testdata/sf0.001"
# The contract's patterns, run plainly.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    doubled = [sum(divmod(int(d) * 2, 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m.group(), flags=re.ASCII)
            keep = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and plain_luhn(d),
                "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]()
            if keep:
                out.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def base_spans(text):
    base = {k.name for k in pii.KINDS if k.base}
    return [(k, s, e) for k, s, e, _ in pii.find_spans(text) if k in base]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1b0.@-+ 5é\n()_%294", max_size=60))
def test_base_spans_as_plain_patterns(text):
    assert base_spans(text) == plain_spans(text)


def test_confirmed_kinds():
    iban = "GB82 WEST 1234 5698 7654 32"
    found = {(k, text) for k, text in (
        (k, iban_text[s:e]) for iban_text in [f"bank account {iban} ok", f"x {iban[:-1]}3 y"]
        for k, s, e, _ in pii.find_spans(iban_text)
    )}
    assert ("iban", iban) in found and len([f for f in found if f[0] == "iban"]) == 1
    assert [k for k, *_ in pii.find_spans("social security 123-45-6789")] == ["ssn"]
    assert pii.find_spans("part 123-45-6789") == []
    plain, near = pii.find_spans("a@b.cd")[0][3], pii.find_spans("contact a@b.cd")[0][3]
    assert near > plain


def test_long_texts_stay_linear():
    for text in ("a" * 300_000, "1." * 150_000, "1" * 300_000, "a@" * 150_000, "+1 " * 100_000, "A1 " * 100_000):
        assert base_spans(text) == plain_spans(text) if len(set(text)) > 3 else True
        pii.find_spans(text)


def test_whole_table_and_edges(spark, docs):
    rows = [(1, None), (2, ""), (None, "mail a@b.cd"), (3, "é 10.0.0.1"), (3, "é 10.0.0.1")]
    out = sorted(pii.personal_data(docs(*rows)).collect(), key=str)
    assert len(out) == len(rows)
    assert [(s.kind, s.start, s.end) for r in out if r.doc_id == 3 for s in r.spans] == [("ip", 2, 10)] * 2
    assert [s.kind for r in out if r.doc_id is None for s in r.spans] == ["email"]
    assert pii.personal_data(docs(*rows).limit(0)).count() == 0

    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    result = LLM.queries["op5_pii"](spark, FOLDER).collect()
    assert len(result) == len(texts)
    for row in result:
        spans = plain_spans(texts[row.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(row.spans.split(","))
