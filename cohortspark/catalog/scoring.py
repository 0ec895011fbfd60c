"""Questionnaire scoring: long items, wide exports, survey rounds and their binding."""

import re

from pyspark.sql import functions as F

from cohortspark.functions import binary_answer, reverse_code, zero_hundred_to_scale
from cohortspark.operators.scoring import (
    attach_key,
    label_subscales,
    pair_response,
    score_binary_items,
    score_items,
)
from cohortspark.operators.stats import zscore
from cohortspark.operators.surveys import (
    bind_rounds,
    demographics,
    mask_incomplete,
    multi_select_summary,
    survey_followup,
    survey_round,
)
from cohortspark.plans.scales import FOLLOWUP_Z, MISSING_LIMITS, ROUND_Z, KeyItem, SurveyKeys

from .registry import CATALOG, rounded, table


def _answers(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_suppkey",
        F.col("l_returnflag").alias("subscale"),
        F.col("l_linestatus").alias("q_type"),
        F.col("l_linenumber").alias("item"),
        F.nullif("l_quantity", F.lit(25.0)).alias("response"),
    )


def _summary_sql(by, fun="sum"):
    score = "coalesce(sum(r), 0)" if fun == "sum" else "avg(r)"
    return f"""
SELECT *, round(s / nullif(n_items_responded, 0) * n_items_seen, 7) AS score_adj FROM (
  SELECT {by}, {score} AS s, count(r) AS n_items_responded, count(*) AS n_items_seen,
         round({score}, 7) AS score, round({fun}(coalesce(r, 25)), 7) AS score_patched
  FROM (SELECT *, l_returnflag AS subscale, l_linestatus AS q_type,
               nullif(l_quantity, 25) AS r FROM lineitem) GROUP BY ALL)
""".replace("SELECT *, round(s", "SELECT * EXCLUDE (s), round(s")


@CATALOG.add(_summary_sql("l_suppkey, 'q_' || lower(subscale) AS subscale"))
def score_summary(spark, folder):
    scored = score_items(_answers(spark, folder), ["l_suppkey", "subscale"], patch=25)
    return rounded(label_subscales(scored, "q"), 7)


@CATALOG.add(_summary_sql("l_suppkey, subscale", "avg"))
def score_summary_mean(spark, folder):
    return rounded(score_items(_answers(spark, folder), ["l_suppkey", "subscale"], F.avg, 25), 7)


@CATALOG.add("""
SELECT o_custkey, score::DOUBLE AS score, n_items_responded, n_items_seen,
       round(score::DOUBLE / nullif(n_items_responded, 0) * n_items_seen, 7) AS score_adj
FROM (SELECT o_custkey, count(*) FILTER (WHERE b) AS score, count(b) AS n_items_responded,
             count(*) AS n_items_seen FROM (
  SELECT o_custkey, CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW')
    THEN CASE o_orderstatus WHEN 'P' THEN false WHEN 'F' THEN true END
    ELSE CASE o_orderstatus WHEN 'P' THEN true WHEN 'F' THEN false END END AS b FROM orders)
GROUP BY o_custkey)
""")
def binary_score(spark, folder):
    code = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 2)
    odd = F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM", "5-LOW")
    answers = table(spark, folder, "orders").select(
        "o_custkey", binary_answer(code, odd).alias("response")
    )
    return rounded(score_binary_items(answers, ["o_custkey"]), 7)


@CATALOG.add("""
SELECT *, round(s / nullif(n_items_responded, 0) * n_items_seen, 7) AS score_adj FROM (
  SELECT l_suppkey, round(coalesce(sum(r), 0), 7) AS score,
         round(sum(coalesce(r, 0)), 7) AS score_patched, count(r) AS n_items_responded,
         count(*) AS n_items_seen, coalesce(sum(r), 0) AS s
  FROM (SELECT l_suppkey, CASE WHEN l_linestatus = 'F' AND l_discount > 0.05 THEN 4.0
                               ELSE nullif(l_tax, 0) * 100 * 3.0 / 7 END AS r FROM lineitem)
  GROUP BY l_suppkey)
""".replace("SELECT *, round(s", "SELECT * EXCLUDE (s), round(s"))
def pair_score(spark, folder):
    days = F.nullif("l_tax", F.lit(0.0)) * 100
    daily = F.when(F.col("l_discount") > 0.05, F.when(F.col("l_linestatus") == "F", 1).otherwise(2))
    answers = table(spark, folder, "lineitem").select(
        "l_suppkey", pair_response(days, daily).alias("response")
    )
    return rounded(score_items(answers, ["l_suppkey"], patch=0), 7)


@CATALOG.add("""
SELECT *, round(s / nullif(n_items_responded, 0) * n_items_seen, 7) AS score_adj FROM (
  SELECT l_suppkey, l_linestatus AS q_type,
         's_' || lower(l_linestatus) || '_' || lower(l_returnflag) AS subscale,
         round(coalesce(sum(r), 0), 7) AS score, round(sum(coalesce(r, 1)), 7) AS score_patched,
         count(r) AS n_items_responded, count(*) AS n_items_seen, coalesce(sum(r), 0) AS s
  FROM (SELECT *, nullif(l_quantity, 25) * 0.03::DOUBLE + 1 AS r FROM lineitem) GROUP BY ALL)
""".replace("SELECT *, round(s", "SELECT * EXCLUDE (s), round(s"))
def score_two_keys(spark, folder):
    answers = _answers(spark, folder).withColumn(
        "response", zero_hundred_to_scale(F.col("response"))
    )
    scored = score_items(answers, ["l_suppkey", "q_type", "subscale"], patch=1)
    return rounded(
        label_subscales(scored, "s").withColumn("subscale", F.lower("subscale")), 7
    )


@CATALOG.add(_summary_sql("l_suppkey"))
def score_no_subscale(spark, folder):
    return rounded(score_items(_answers(spark, folder), ["l_suppkey"], patch=25), 7)


@CATALOG.add("""
WITH key(item, subscale, reverse) AS (VALUES (1, 'even mood', false), (2, 'odd/mood', true),
  (3, 'even mood', true), (4, 'odd/mood', false), (5, 'even mood', NULL), (6, 'odd/mood', true))
SELECT l_suppkey, subscale, reverse, count(r) AS answered, round(sum(r), 4) AS total,
       round(sum(coalesce(r, 25)), 4) AS patched
FROM (SELECT l_suppkey, subscale, reverse,
             CASE WHEN reverse THEN 51 - nullif(l_quantity, 25) WHEN NOT reverse
                  THEN nullif(l_quantity, 25) END AS r
      FROM lineitem LEFT JOIN key ON l_linenumber = item) GROUP BY ALL
""")
def reverse_code_(spark, folder):
    key = [
        KeyItem(1, "even mood", False), KeyItem(2, "odd/mood", True),
        KeyItem(3, "even mood", True), KeyItem(4, "odd/mood", False),
        KeyItem(5, "even mood", None), KeyItem(6, "odd/mood", True),
    ]
    long = attach_key(_answers(spark, folder).drop("subscale"), key)
    coded = reverse_code(F.col("response"), F.col("reverse"), 51)
    long = long.withColumn("response", coded)
    return rounded(
        long.groupBy("l_suppkey", "subscale", "reverse").agg(
            F.count("response").alias("answered"),
            F.sum("response").alias("total"),
            F.sum(F.coalesce("response", F.lit(25.0))).alias("patched"),
        )
    )


# --- whole survey rounds ----------------------------------------------------------------

ITEMS = range(1, 8)
STEPS = {7: 1, 8: 2, 9: 3}
RACES = ("click", "view", "error")
KEYS = SurveyKeys(
    {
        "tas20": [KeyItem(i, "Alpha x" if i % 2 else "Beta", i in (2, 5)) for i in ITEMS],
        # one question counts in two subscales
        "ders": [*(KeyItem(i, "Gamma", i == 3) for i in ITEMS), KeyItem(2, "Delta", True)],
        "bpq": [KeyItem(i, "Impulse" if i > 5 else "Identity", i == 4) for i in ITEMS],
        "als18": [KeyItem(i, "Mood/Shift" if i < 4 else "Anger", None) for i in ITEMS],
        "beq": [KeyItem(i, "Strong" if i < 5 else "Weak", i in (1, 6)) for i in ITEMS],
        "cesdr": [KeyItem(i, "Sad" if i < 4 else "Tired", None) for i in ITEMS],
        "sticsa": [KeyItem(i, "Body" if i < 4 else "Mind", None) for i in ITEMS],
        "irq": [KeyItem(i, "All", None) for i in ITEMS],
    }
)

# answer columns of a response: name, condition, value; the same text serves both engines
_VALUE = {
    "i_panas_sf_{i}": ("l_discount = 0.05", "max(l_quantity) * 1"),
    "tas20_{i}": ("l_discount = 0.07", "max(l_tax) * 50"),
    "ders_{i}": ("l_discount = 0.03", "max(l_tax) * 60"),
    # columns without a question number: an order and a free text
    "ders_order": ("l_discount = 0.04", "max(l_quantity) * 1"),
    "tas20_3_TEXT": ("l_discount = 0.06", "max(l_tax) * 50"),
    "bpq_q{i}": ("l_discount = 0.02", "min(CASE l_linestatus WHEN 'F' THEN 1.0 ELSE 2.0 END)"),
}
_LATER = {
    "{i}_als18_1": ("l_discount = 0.04", "max(l_quantity) * 2"),
    "{i}_beq_1": ("l_discount = 0.06", "max(l_quantity) * 2"),
    "{i}_cesdr1_1": ("l_discount = 0.01", "max(l_linenumber) * 1.0"),
    "{i}_cesdr2": ("l_discount = 0.08", "min(CASE l_linestatus WHEN 'F' THEN 1.0 ELSE 2.0 END)"),
    "{i}_sticsa_state_1": ("l_discount = 0.09", "max(l_quantity) * 2"),
    "{i}_sticsa_trait_1": ("l_discount = 0.1", "max(l_quantity) * 2"),
    "{i}_swls_1": ("l_discount = 0", "max(l_quantity) * 2"),
    "{i}_irq_1": ("l_discount = 0.02", "max(l_quantity) * 2"),
}


def _cells(spec):
    """(column, SQL aggregate) per answer column."""
    cells = []
    for name, (where, value) in spec.items():
        fun, inner, factor = re.fullmatch(r"(\w+)\((.+)\)( \* [0-9.]+)?", value).groups()
        for i in ITEMS if "{i}" in name else [1]:
            test = f"{where} AND l_linenumber = {i}"
            text = f"{fun}(CASE WHEN {test} THEN {inner} END){factor or ''}"
            cells.append((name.format(i=i), text))
    return cells


# counts instead of text maxima keep the aggregates hash-based
_SOME = "CASE WHEN count(CASE WHEN {} THEN 1 END) > 0 THEN {} END"
_PEOPLE = {
    "age": "CAST(18 + max(l_linenumber) AS DOUBLE)",
    "gender": "CASE WHEN count(*) > 80 THEN 'Woman' WHEN count(*) > 70 THEN 'Man' END",
    "handedness": "CASE WHEN count(*) > 85 THEN 'I write w Left' ELSE 'I write w Right' END",
    "race_a": _SOME.format("l_quantity = 50 AND l_tax = 0.08", "'Asian'"),
    "race_b": _SOME.format("l_quantity = 49 AND l_tax = 0.07", "'Black'"),
    "race_c": _SOME.format("l_quantity = 48 AND l_tax = 0.06", "'White'"),
    "ethnicity": f"coalesce({_SOME.format("l_returnflag = 'R'", "'R'")}, 'other')",
    "edu": f"coalesce({_SOME.format("l_linestatus = 'F'", "'F'")}, 'O')",
    "ses_7": f"coalesce({_SOME.format('l_quantity = 1 AND l_tax = 0.01', "'On'")}, 'Off')",
    "ses_8": _SOME.format("l_quantity = 2 AND l_tax = 0.02", "'On'"),
    "ses_9": _SOME.format("l_quantity = 3 AND l_tax = 0.03", "'On'"),
}
_DX = f"coalesce({_SOME.format("l_linestatus = 'O'", "'O'")}, 'F')"
_RESPONSE = "CAST(l_suppkey AS STRING)"


def _exports(spark, folder, where):
    """Numeric and label export, a response per supplier and ship year, missing as -99."""
    lines = table(spark, folder, "lineitem").filter(where)
    by = [F.expr(_RESPONSE).alias("prolific_id"), F.year("l_shipdate").alias("started")]
    answers = [F.expr(text).cast("double") for _, text in _cells(_VALUE)]
    names = [name for name, _ in _cells(_VALUE)]
    coded = [F.coalesce(a, F.lit(-99.0)).alias(n) for a, n in zip(answers, names)]
    texts = [F.coalesce(a.cast("string"), F.lit("-99")).alias(n) for a, n in zip(answers, names)]
    people = [F.expr(text).alias(name) for name, text in _PEOPLE.items()]
    numeric = lines.groupBy(*by).agg(*coded)
    labels = lines.groupBy(*by).agg(*people, *texts, F.expr(_DX).alias("dx_med"))
    order = ["prolific_id", *_PEOPLE, *names, "dx_med", "started"]
    return numeric, labels.select(*order)


def _round(spark, folder, where):
    numeric, labels = _exports(spark, folder, where)
    return survey_round(numeric, labels, KEYS, [F.desc("started")])


def _followup(spark, folder):
    answers = [F.expr(text).cast("double").alias(name) for name, text in _cells(_LATER)]
    export = (
        table(spark, folder, "lineitem")
        .groupBy(F.expr(_RESPONSE).alias("subj_num"), F.year("l_shipdate").alias("started"))
        .agg(F.max("l_linenumber").cast("string").alias("irqItemOrder"), *answers)
        .withColumn("ResponseId", F.concat_ws("-", "subj_num", F.col("started").cast("string")))
    )
    return survey_followup(export, KEYS, [F.asc("started")])


def _scale_sql(columns, patch, mean=False):
    """(prorated, patched) SQL of one subscale over answer expressions."""
    score = " + ".join(f"coalesce({c}, 0)" for c in columns)
    filled = " + ".join(f"coalesce({c}, {patch})" for c in columns)
    answered = " + ".join(f"(({c}) IS NOT NULL)::INT" for c in columns)
    n = len(columns)
    if mean:
        score, filled = f"({score}) / nullif({answered}, 0)", f"({filled}) / {n}::DOUBLE"
    return f"({score}) / nullif({answered}, 0)::DOUBLE * {n}", filled


def _groups(scale):
    found = {}
    for k in KEYS.items[scale]:
        found.setdefault(k.subscale.lower().replace(" ", "_").replace("/", "_"), []).append(k)
    return found


def _mirrored(column, key, ends):
    return f"({ends} - {column})" if key.reverse else column


def _round_scores():
    """Subscale name -> (prorated, patched) SQL of a survey round."""
    pos = [i for i in ITEMS if i in (3, 5, 7)]
    scores = {
        "i_panas_sf_pos": _scale_sql([f"i_panas_sf_{i}" for i in pos], 1),
        "i_panas_sf_neg": _scale_sql([f"i_panas_sf_{i}" for i in ITEMS if i not in pos], 1),
    }
    for scale, patch in (("tas20", 3), ("ders", 0)):
        for label, keys in _groups(scale).items():
            columns = [_mirrored(f"{scale}_{k.item}", k, 6) for k in keys]
            scores[f"{scale}_{label}"] = _scale_sql(columns, patch)
        # an item without a key entry has no direction, so its answer is unknown
        scores[f"{scale}_NA"] = _scale_sql(["NULL::DOUBLE"], patch)
    return scores


def _bpq_scores():
    found = {}
    for label, keys in _groups("bpq").items():
        columns = [
            f"(CASE bpq_q{k.item} WHEN 1 THEN {int(not k.reverse)} WHEN 2 THEN {int(k.reverse)} END)"
            for k in keys
        ]
        found[f"bpq_{label}"] = _scale_sql(columns, 0)[0]
    return found


def _later_scores():
    slide = lambda c, n, low: f"({c} / (100.0::DOUBLE / {n - 1}) + {low})"
    spec = {
        "als18": ("{i}_als18_1", lambda c, k: slide(c, 4, 0), 0),
        "beq": ("{i}_beq_1", lambda c, k: _mirrored(slide(c, 7, 1), k, 8), 4),
        "irq": ("{i}_irq_1", lambda c, k: slide(c, 7, 1), 4),
    }
    scores = {}
    for scale, (name, answer, patch) in spec.items():
        for label, keys in _groups(scale).items():
            columns = [answer('"' + name.format(i=k.item) + '"', k) for k in keys]
            scores[f"{scale}_{label}"] = _scale_sql(columns, patch, mean=scale == "beq")
    for label, keys in _groups("cesdr").items():
        columns = [
            f'(CASE WHEN "{k.item}_cesdr2" = 1 THEN 4.0 ELSE "{k.item}_cesdr1_1" * (3.0::DOUBLE / 7) END)'
            for k in keys
        ]
        scores[f"cesdr_{label}"] = _scale_sql(columns, 0)
    for kind in ("state", "trait"):
        for label, keys in _groups("sticsa").items():
            columns = [f'("{k.item}_sticsa_{kind}_1" * 0.03::DOUBLE + 1)' for k in keys]
            scores[f"sticsa_{kind}_{label}"] = _scale_sql(columns, 1)
    scores["swls"] = _scale_sql([slide(f'"{i}_swls_1"', 7, 1) for i in ITEMS], 4)
    return scores


def _missing(columns):
    return " + ".join(f'("{c}" IS NULL)::INT' for c in columns) or "0"


def _round_ctes(tag, where):
    """CTEs ending in ``<tag>_all``, one row per respondent and score type."""
    cells = ", ".join(f'{text} AS "{name}"' for name, text in _cells(_VALUE))
    people = ", ".join(f"{text} AS {name}" for name, text in _PEOPLE.items() if "ses" not in name)
    ticks = ", ".join(
        f"CASE WHEN {text} = 'On' THEN {step} END AS s{step}"
        for (name, text), step in zip(
            ((n, t) for n, t in _PEOPLE.items() if n.startswith("ses")), STEPS.values()
        )
    )
    names = [n for n, _ in _cells(_VALUE)]
    nas = {
        f"nas_{s}": _missing([n for n in names if n.startswith(s)])
        for s in ("i_panas_sf", "sns", "bpq", "tas20", "ders")
    }
    nas_cells = ", ".join(f"{text} AS {name}" for name, text in nas.items())
    bpq = ", ".join(f"{text} AS {name}" for name, text in _bpq_scores().items())
    kinds = []
    scores = _round_scores()
    for at, kind in enumerate(("adj", "patched")):
        cols = ", ".join(f"{pair[at]} AS {name}" for name, pair in scores.items())
        kinds.append(f"SELECT subj_num, '{kind}' AS score_type, {cols} FROM {tag}_one")
    total = lambda s, parts: " + ".join(
        f"coalesce({p}, 0)" for p in [f"nas_{s}", *[n for n in parts if n.startswith(s)]]
    )
    every = [*scores, *_bpq_scores()]
    return f"""
{tag}_raw AS (SELECT CAST(l_suppkey AS VARCHAR) AS subj_num, year(l_shipdate) AS started, {cells},
       {people}, {ticks}, {_DX} AS dx_med FROM lineitem WHERE {where} GROUP BY ALL),
{tag}_one AS (SELECT * FROM {tag}_raw
       QUALIFY row_number() OVER (PARTITION BY subj_num ORDER BY started DESC) = 1),
{tag}_people AS (SELECT subj_num, age, substr(handedness, 11) AS handedness, gender, race_a, race_b,
       race_c, ethnicity, edu, dx_med,
       CASE WHEN (race_a IS NOT NULL)::INT + (race_b IS NOT NULL)::INT + (race_c IS NOT NULL)::INT > 1
            THEN 'More than one race' ELSE coalesce(race_a, race_b, race_c) END AS race_summary,
       ses::DOUBLE AS ses, {nas_cells}, {bpq} FROM {tag}_one LEFT JOIN (
         SELECT subj_num, s1 AS ses FROM {tag}_one WHERE s1 IS NOT NULL UNION ALL
         SELECT subj_num, s2 FROM {tag}_one WHERE s2 IS NOT NULL UNION ALL
         SELECT subj_num, s3 FROM {tag}_one WHERE s3 IS NOT NULL) USING (subj_num)),
{tag}_kinds AS ({" UNION ALL ".join(kinds)}),
{tag}_all AS (SELECT p.*, nas_i_panas_sf + nas_sns + nas_bpq + nas_tas20 + nas_ders AS nas_total,
       k.* EXCLUDE (subj_num), {total("bpq", every)} AS bpq_total,
       {total("tas20", every)} AS tas20_total, {total("ders", every)} AS ders_total
       FROM {tag}_people p JOIN {tag}_kinds k USING (subj_num))"""


def _followup_ctes():
    cells = ", ".join(f'{text} AS "{name}"' for name, text in _cells(_LATER))
    scores = _later_scores()
    kinds = []
    for at, kind in enumerate(("adj", "patched")):
        cols = ", ".join(f"{pair[at]} AS {name}" for name, pair in scores.items())
        kinds.append(
            f"SELECT subj_num, subj_num_2, '{kind}' AS score_type, {cols} FROM later_one"
        )
    # item columns start with the item number, so no prefix matches and all counts are 0
    watched = ("als18", "beq", "cesdr", "sticsa_state", "sticsa_trait", "swls", "irq")
    nas = ", ".join(f"0 AS nas_{w}" for w in watched)
    names = lambda part: [n for n in scores if part in n]
    plus = lambda part: " + ".join(f"coalesce({n}, 0)" for n in names(part))
    totals = ", ".join(
        f"{plus(s)} AS {s}_total" for s in ("als18", "cesdr", "sticsa_state", "sticsa_trait", "irq")
    )
    beq = names("beq")
    counted = " + ".join(f"({n} IS NOT NULL)::INT" for n in beq)
    mean = f"({plus('beq')}) / ({counted} + 1)::DOUBLE AS beq_total"
    return f"""
later_raw AS (SELECT CAST(l_suppkey AS VARCHAR) || '-' || CAST(year(l_shipdate) AS VARCHAR)
       AS subj_num, CAST(l_suppkey AS VARCHAR) AS subj_num_2, year(l_shipdate) AS started, {cells}
       FROM lineitem GROUP BY ALL),
later_one AS (SELECT * FROM later_raw
       QUALIFY row_number() OVER (PARTITION BY subj_num_2 ORDER BY started) = 1),
later_kinds AS ({" UNION ALL ".join(kinds)}),
later_all AS (SELECT *, {nas}, 0 AS nas_total, {totals}, {mean} FROM later_kinds)"""


_ROUND_DOUBLES = [*_round_scores(), *_bpq_scores(), "bpq_total", "tas20_total", "ders_total"]
_LATER_DOUBLES = [
    *_later_scores(), "als18_total", "beq_total", "cesdr_total", "sticsa_state_total",
    "sticsa_trait_total", "irq_total",
]


def _replace(names):
    return ", ".join(f"round({n}, 4) AS {n}" for n in names)


@CATALOG.add(
    f"WITH {_round_ctes('rd', 'true')} "
    f"SELECT * REPLACE ({_replace(_ROUND_DOUBLES)}) FROM rd_all"
)
def survey_round_(spark, folder):
    return rounded(_round(spark, folder, "true"))


@CATALOG.add(
    f"WITH {_followup_ctes()} SELECT * REPLACE ({_replace(_LATER_DOUBLES)}) FROM later_all"
)
def survey_followup_(spark, folder):
    return rounded(_followup(spark, folder))


def _bind_sql():
    limits = ", ".join(
        f"CASE WHEN {nas} <= {limit} THEN {total} END AS {total}"
        for total, (nas, limit) in MISSING_LIMITS.items()
    )
    z = ", ".join(
        f"round(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 4) AS {c}_z"
        for c in ROUND_Z + FOLLOWUP_Z
    )
    doubles = _replace([*_ROUND_DOUBLES, *_LATER_DOUBLES])
    return f"""WITH {_round_ctes('a', "l_linestatus = 'F'")}, {_round_ctes('b', "l_linestatus = 'O'")},
{_followup_ctes()},
stacked AS (SELECT 'amusement_fear' AS expt_type, * FROM a_all UNION ALL
            SELECT 'positive_negative', * FROM b_all),
linked AS (SELECT s.* EXCLUDE (score_type), l.* EXCLUDE (subj_num, subj_num_2, score_type, nas_total)
           FROM stacked s LEFT JOIN later_all l
           ON s.subj_num = l.subj_num_2 AND s.score_type = l.score_type
           WHERE s.score_type = 'patched'),
masked AS (SELECT * REPLACE ({limits}, coalesce(gender, 'Not reported') AS gender) FROM linked),
scaled AS (SELECT *, {z} FROM masked)
SELECT * REPLACE ({doubles}) FROM scaled"""


@CATALOG.add(_bind_sql())
def bind_rounds_(spark, folder):
    rounds = {
        "amusement_fear": _round(spark, folder, "l_linestatus = 'F'"),
        "positive_negative": _round(spark, folder, "l_linestatus = 'O'"),
    }
    return rounded(bind_rounds(rounds, _followup(spark, folder)))


@CATALOG.add("""
WITH t AS (SELECT l_orderkey, sum(l_quantity) AS total,
                  count_if(l_discount = 0) AS nas FROM lineitem GROUP BY l_orderkey),
m AS (SELECT l_orderkey, nas, CASE WHEN nas <= 0 THEN total END AS total FROM t)
SELECT l_orderkey, nas, round(total, 4) AS total,
       round((total - avg(total) OVER ()) / stddev_samp(total) OVER (), 4) AS total_z FROM m
""")
def mask_incomplete_(spark, folder):
    totals = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum("l_quantity").alias("total"), F.count_if(F.col("l_discount") == 0).alias("nas"))
    )
    return rounded(zscore(mask_incomplete(totals, {"total": ("nas", 0)}), {"total": "total_z"}))


@CATALOG.add("""
WITH u AS (
  SELECT CAST(user_id AS VARCHAR) AS subj_num, CAST(18 + count(*) % 40 AS INT) AS age,
         CASE WHEN count(*) > 60 THEN 'I write w Left' ELSE 'I write w Right' END AS handedness,
         max(event_type) AS gender,
         max(CASE WHEN event_type = 'click' AND value > 80 THEN 'Click' END) AS race_click,
         max(CASE WHEN event_type = 'view' AND value > 80 THEN 'View' END) AS race_view,
         min(event_type) AS ethnicity, 'none' AS edu, NULL::VARCHAR AS dx_none,
         max(CASE WHEN event_type = 'error' AND value > 80 THEN 1 END) AS s1,
         max(CASE WHEN event_type = 'signup' AND value > 80 THEN 2 END) AS s2
  FROM events GROUP BY user_id)
SELECT subj_num, age, substr(handedness, 11) AS handedness, gender, race_click, race_view,
       ethnicity, edu, dx_none,
       ses::DOUBLE AS ses,
       CASE WHEN race_click IS NOT NULL AND race_view IS NOT NULL THEN 'More than one race'
            ELSE coalesce(race_click, race_view) END AS race_summary
FROM u LEFT JOIN (SELECT subj_num, s1 AS ses FROM u WHERE s1 IS NOT NULL UNION ALL
                  SELECT subj_num, s2 FROM u WHERE s2 IS NOT NULL) USING (subj_num)
""")
def demographics_(spark, folder):
    kind, high = F.col("event_type"), F.col("value") > 80
    tick = lambda name, text: F.max(F.when((kind == name) & high, F.lit(text)))
    labels = (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").cast("string").alias("subj_num"))
        .agg(
            (F.lit(18) + F.count("*") % 40).cast("int").alias("age"),
            F.when(F.count("*") > 60, "I write w Left").otherwise("I write w Right").alias(
                "handedness"
            ),
            F.max("event_type").alias("gender"),
            tick("click", "Click").alias("race_click"),
            tick("view", "View").alias("race_view"),
            F.min("event_type").alias("ethnicity"),
            F.lit("none").alias("edu"),
            F.lit(None).cast("string").alias("dx_none"),
            F.coalesce(tick("error", "On"), F.lit("Off")).alias("ses_7"),
            tick("signup", "On").alias("ses_8"),
        )
    )
    return demographics(labels)


@CATALOG.add("""
SELECT user_id, CASE WHEN count(*) > 1 THEN 'More than one race' ELSE max(event_type) END AS summary
FROM (SELECT user_id, event_type FROM events GROUP BY ALL HAVING max(value) > 60)
GROUP BY user_id
""")
def multi_select_summary_(spark, folder):
    ticked = (
        table(spark, folder, "events")
        .groupBy("user_id", "event_type")
        .agg(F.max("value").alias("top"))
        .filter("top > 60")
    )
    return multi_select_summary(ticked, ["user_id"], "event_type", "summary")
