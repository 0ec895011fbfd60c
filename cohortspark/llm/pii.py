"""Personal data: patterns propose spans, checksums confirm them, context moves their score."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_slices, record_batch

Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Matches can only start where a run of digits starts, so the lookbehind drops none.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
WORD = re.compile(r"[^\W\d_]+")
#: Characters on either side of a span that are searched for context words.
REACH = 48


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """Whether an account number passes the mod-97 check."""
    code = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    """Leftmost spans. Goes from one ``@`` to the next, so it is linear on any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups()):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[Span]:
    for m in IBAN.finditer(text):
        # a following capitalised word may be swallowed: the longest confirmed cut counts
        end = m.end()
        while end - m.start() >= 15:
            if mod97(text[m.start() : end]):
                yield m.start(), end
                break
            end = text.rfind(" ", m.start(), end)


def ssns(text: str) -> Iterator[Span]:
    for m in SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


@dataclass(frozen=True)
class Kind:
    """A kind of personal data; base kinds stay whatever their score."""

    name: str
    find: Callable[[str], Iterator[Span]]
    needs: str
    score: float
    context: frozenset[str]
    base: bool = True


KINDS = (
    Kind("email", emails, "@", 0.9, frozenset({"mail", "email", "contact", "write"})),
    Kind("ip", ips, ".", 0.6, frozenset({"ip", "host", "server", "address", "login"})),
    Kind("card", cards, "", 0.8, frozenset({"card", "visa", "mastercard", "payment", "credit"})),
    Kind("phone", phones, "+", 0.7, frozenset({"phone", "tel", "call", "mobile", "fax"})),
    Kind("iban", ibans, "", 0.8, frozenset({"iban", "account", "bank", "transfer"}), base=False),
    Kind("ssn", ssns, "-", 0.3, frozenset({"ssn", "social", "security"}), base=False),
)
#: Added to the score of a span with a context word of its kind nearby.
CONTEXT_BONUS = 0.3
#: Spans of other than base kinds are reported from this score on.
THRESHOLD = 0.5


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by start, then in the order of ``KINDS``."""
    if "@" not in text and not DIGIT.search(text):
        return []
    found = []
    for order, kind in enumerate(KINDS):
        if kind.needs not in text:
            continue
        for start, end in kind.find(text):
            near = text[max(0, start - REACH) : start] + " " + text[end : end + REACH]
            hit = not kind.context.isdisjoint(w.lower() for w in WORD.findall(near))
            score = min(1.0, kind.score + CONTEXT_BONUS * hit)
            if kind.base or score >= THRESHOLD:
                found.append((start, order, end, score))
    return [(KINDS[o].name, s, e, score) for s, o, e, score in sorted(found)]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data: ``doc_id, spans array<struct<kind,start,end,score>>``.

    Offsets are code points, ends exclusive. One row per input row, no shuffle. A null text
    counts as empty and has no spans; a null id stays null; repeated rows give repeated
    results; other columns are not read; an empty table gives an empty table. Very long
    texts are searched whole by patterns that are linear in the text.
    """

    def setup():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            spans = [
                [{"kind": k, "start": s, "end": e, "score": c} for k, s, e, c in find_spans(t)]
                for t in piece.column("text").to_pylist()
            ]
            kind = pa.list_(pa.struct([
                ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())
            ]))
            return record_batch({"doc_id": piece.column("doc_id"), "spans": pa.array(spans, kind)})

        return work

    return map_slices(
        id_and_text(docs, id_col, text_col), setup,
        "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>",
    )
