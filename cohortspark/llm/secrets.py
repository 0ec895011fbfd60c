"""Secret scan over a trigram inverted index, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .trigrams import ANY, required


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# Base rules: leftmost, non-overlapping, matches with a short group dropped. Where the bound
# is on a whole run, asking for it in the pattern finds the same spans.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 12, True,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    # Public prefixes of credentials.
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("repository_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z]{2,12}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._!$%&*+=-]{1,64}@"),
)
#: Offsets are summed in blocks of this many matches, so work per match is bounded.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def match_spans(text: Column, rule: Rule, order: int) -> Column:
    """``array<struct<start, kind_order, end>>`` of a rule in a text, in code points.

    Splitting at the matches gives the gaps between them; starts are sums of gap and match
    lengths, taken block by block.
    """
    pattern = F.lit(rule.pattern)
    found = F.struct(
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("value"),
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
    )

    def spans(m: Column) -> Column:
        steps = F.transform(m["size"], lambda s, n: s + m["gap"][n])
        return let(F.struct(m["size"], m["value"], m["gap"], steps.alias("step")), offsets)

    def offsets(m: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(m["step"]) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: _total(F.slice(m["step"], b * BLOCK + 1, F.lit(BLOCK))))
        return let(sums, lambda s: let(F.transform(s, lambda _, b: _total(F.slice(s, F.lit(1), b))), lambda o: rows(m, o)))

    def rows(m: Column, before: Column) -> Column:
        def row(size: Column, n: Column) -> Column:
            block = F.floor(n / BLOCK).cast("int")
            inside = _total(F.slice(m["step"], block * BLOCK + 1, n - block * BLOCK))
            start = before[block] + inside + m["gap"][n]
            return F.struct(
                start.alias("start"), F.lit(order).alias("kind_order"), (start + size).alias("end"),
                m["value"][n].alias("value"),
            )

        kept = F.filter(F.transform(m["size"], row), lambda r: r["value"] >= rule.least)
        return F.transform(kept, lambda r: F.struct(r["start"], r["kind_order"], r["end"]))

    return let(found, spans)


def scan_all(rules: tuple[Rule, ...]) -> list[str]:
    """Kinds whose rule has no mandatory trigram and is run on every text."""
    return [r.kind for r in rules if required(r.pattern) == ANY]


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``row_key, kinds``: rules whose trigram query the postings of a text satisfy.

    The index holds a posting (trigram, row) for every trigram that some rule asks for. A
    clause is met when the intersection of its trigrams' postings holds the row.
    """
    skipped = scan_all(rules)
    clauses = [
        (rule.kind, n, gram, 1 << bit, (1 << len(clause)) - 1)
        for rule in rules if rule.kind not in skipped
        for n, clause in enumerate(sorted(map(sorted, required(rule.pattern))))
        for bit, gram in enumerate(clause)
    ]
    names = ("kind", "clause", "gram", "bit", "need")
    rows = (F.struct(*(F.lit(v).alias(n) for n, v in zip(names, c, strict=True))) for c in clauses)
    asked = texts.sparkSession.range(1).select(F.inline(F.array(*rows)))
    grams = F.array(*(F.lit(g) for g in sorted({c[2] for c in clauses})))
    lower = texts.select("row_key", F.lower("text").alias("lower"))
    postings = lower.select(
        "row_key", F.explode(F.filter(grams, lambda g: F.contains(F.col("lower"), g))).alias("gram")
    )
    # the clause table is as large as the rule list
    met = (
        postings.join(F.broadcast(asked), "gram")
        .groupBy("row_key", "kind", "clause", "need").agg(F.bit_or("bit").alias("have"))
        .filter("have = need")
    )
    return met.groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end>>`` by start, then in the order of rules.

    Offsets are code points, ends exclusive. One row per input row. A null text counts as
    empty and has no spans; a null id stays null; repeated rows give repeated results;
    other columns are not read; an empty table gives an empty table. Very long texts are
    scanned whole. Rows are matched to
    their postings by a 64-bit key of id and text; a clash of keys only adds a candidate.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("row_key", F.xxhash64("doc_id", "text"))
    always = set(scan_all(rules))
    none = F.array().cast("array<struct<start:int,kind_order:int,end:int>>")
    # candidates grow with the texts: one plan at every size
    joined = texts.join(candidates(texts, rules).hint("merge"), "row_key", "left")
    text, found = F.col("text"), []
    for order, rule in enumerate(rules):
        hit = F.rlike(text, F.lit(rule.pattern))
        if rule.kind not in always:
            hit = F.array_contains("kinds", rule.kind) & hit
        found.append(F.when(hit, match_spans(text, rule, order)).otherwise(none))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    spans = F.transform(
        F.sort_array(F.concat(*found)),
        lambda s: F.struct(kinds[s["kind_order"]].alias("kind"), s["start"], s["end"]),
    )
    return joined.select("doc_id", spans.alias("spans"))
