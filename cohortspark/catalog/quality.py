"""Ordering, de-duplication, trial cleaning and quality control."""

from pyspark.sql import functions as F

from cohortspark.functions import response_deficit
from cohortspark.operators import qc
from cohortspark.operators.dedup import keep_first
from cohortspark.operators.ordering import next_value
from cohortspark.operators.pca import pca_input
from cohortspark.operators.trials import (
    AMUSEMENT_FEAR,
    POSITIVE_NEGATIVE,
    clean_trials,
    combine_trials,
    rescale_stimuli,
)

from .registry import CATALOG, rounded, table


def _first_sql(keys, order):
    return f"""SELECT event_id, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS k FROM events) WHERE k = 1"""


def _events(spark, folder):
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", "ts")


@CATALOG.add(_first_sql("user_id", "ts DESC"))
def dedup_latest(spark, folder):
    return keep_first(_events(spark, folder), ["user_id"], [F.desc("ts")]).drop("ts")


@CATALOG.add(_first_sql("user_id", "ts"))
def dedup_earliest(spark, folder):
    return keep_first(_events(spark, folder), ["user_id"], [F.asc_nulls_last("ts")]).drop("ts")


@CATALOG.add(_first_sql("user_id, event_type", "ts"))
def dedup_keep_first(spark, folder):
    return keep_first(_events(spark, folder), ["user_id", "event_type"], ["ts"]).drop("ts")


@CATALOG.add("""
SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN following ELSE n END AS mark
FROM (SELECT conv_id, turn, role, length(text) AS n,
             lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS following
      FROM conversations)
""")
def lead_next_event(spark, folder):
    turns = table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.length("text").alias("n"),
        F.floor(F.col("turn") / 1000).alias("span"),
    )
    seen = next_value(turns, ["conv_id"], ["turn"], "n", "following", "span")
    mark = F.when(F.col("role") == "user", F.col("following")).otherwise(F.col("n"))
    return seen.select("conv_id", "turn", "role", mark.alias("mark"))


# --- trial logs -------------------------------------------------------------------------


def _log(spark, folder, positive, negative):
    """Events dressed as a trial log; a slider row is followed by the next event's mark."""
    kind, value = F.col("event_type"), F.col("value")
    number = F.col("event_id").cast("string")
    version = F.concat(F.lit("fnameV"), (F.col("user_id") % 6 + 1).cast("string"))
    left = F.when(kind.isin("click", "signup"), "Neutral").otherwise(positive.title())
    right = (
        F.when(kind == "click", positive.title())
        .when(kind.isin("signup", "view"), negative.title())
        .otherwise(F.lit(None))
    )
    response = (
        F.when(value < 10, "NEUTRAL")
        .when(value < 20, negative.upper())
        .when(value < 30, positive.upper())
        .when(value < 40, "submitResp")
        .when(value < 45, "999")
        .otherwise(F.floor(value).cast("string"))
    )
    fnames = [F.concat(F.lit(f"g{i}_"), (F.col("event_id") % 50).cast("string")) for i in range(1, 6)]
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("Participant Public ID"),
        number.alias("Trial Number"),
        F.when(kind == "error", "fixation").otherwise("gif").alias("Screen Name"),
        (F.floor(value * 10) + 5000).cast("string").alias("Reaction Time"),
        response.alias("Response"),
        F.when(F.floor(value) % 4 == 0, "1").otherwise("0").alias("Timed Out"),
        F.concat(F.lit("list"), F.when(kind == "view", "CatFirst").otherwise("ContFirst")).alias(
            "Spreadsheet Name"
        ),
        F.when(kind.isin("click", "view"), "trialCat").otherwise("trialCont").alias("display"),
        left.alias("promptLText"),
        right.alias("promptRText"),
        (F.floor(value) % 100).cast("string").alias("sliderStart"),
        (F.floor(value) % 8).cast("string").alias("randomise_trials"),
        F.lit(None).cast("string").alias("counterbalance-hhri"),
        F.when(kind == "click", version).alias("counterbalance-ib52"),
        version.alias("counterbalance-57z1"),
        F.lit("fnameV9").alias("counterbalance-4r2c"),
        *[c.alias(f"fnameV{i}") for i, c in enumerate(fnames, 1)],
        F.lit("events").alias("source"),
        F.lit(0).alias("file_rank"),
        F.floor(F.col("event_id") / 1000).alias("split_start"),
        F.col("event_id").alias("row_ord"),
    )


def _stimuli(spark, folder):
    parts = table(spark, folder, "part")
    size = (F.col("p_partkey") % 6).cast("double")
    return rescale_stimuli(
        parts.select(
            F.concat(
                F.lit("g"), (F.floor(F.col("p_partkey") / 50) + 1).cast("string"), F.lit("_"),
                (F.col("p_partkey") % 50).cast("string"),
            ).alias("fname"),
            size.alias("amuse"),
            (F.lit(5.0) - size).alias("fear"),
            ((F.col("p_partkey") % 5) - 2).cast("double").alias("bipolar"),
        )
    )


def _clean_ctes(tag, positive, negative, name, start):
    pair = lambda a, b: f"block IN ('cat_{a}_{b}', 'cont_{a}_{b}')"
    return f"""
{tag}_log AS (
  SELECT CAST(user_id AS VARCHAR) AS subj_num, event_id AS trial_num, event_id,
         floor(value * 10) AS rt, (floor(value)::INT % 4 = 0)::INT::DOUBLE AS late,
         CASE WHEN event_type IN ('click', 'view') THEN 'cat' ELSE 'cont' END AS resp_type,
         CASE WHEN event_type IN ('click', 'signup') THEN 'Neutral' ELSE '{positive.title()}' END
           AS prompt_l,
         CASE WHEN event_type = 'click' THEN '{positive.title()}'
              WHEN event_type IN ('signup', 'view') THEN '{negative.title()}' END AS prompt_r,
         CASE WHEN value < 10 THEN 'NEUTRAL' WHEN value < 20 THEN '{negative.upper()}'
              WHEN value < 30 THEN '{positive.upper()}' WHEN value < 40 THEN 'submitResp'
              WHEN value < 45 THEN '999' ELSE CAST(floor(value)::INT AS VARCHAR) END AS resp_label,
         'list' || CASE WHEN event_type = 'view' THEN 'CatFirst' ELSE 'ContFirst' END AS cb_order,
         CASE WHEN event_type = 'view' THEN 'cat_first' ELSE 'cont_first' END AS cb_resp_order,
         'fnameV' || (user_id % 6 + 1) AS list_version,
         CASE WHEN user_id % 6 < 5 THEN 'g' || (user_id % 6 + 1) || '_' || (event_id % 50) END
           AS fname_seen,
         {start} AS slider_start
  FROM events WHERE event_type <> 'error' AND floor(value)::INT % 8 BETWEEN 1 AND 6),
{tag}_seen AS (
  SELECT *, lower(resp_type || '_' || prompt_l || '_' || coalesce(prompt_r, 'NA')) AS block,
         lower(prompt_l || '_' || coalesce(prompt_r, 'NA')) AS emo_block,
         CASE WHEN resp_type = 'cont' THEN lead(late) OVER (PARTITION BY subj_num ORDER BY event_id)
              ELSE late END AS timeout FROM {tag}_log),
{tag}_coded AS (
  SELECT *, CASE WHEN resp_label = 'NEUTRAL' THEN 0 WHEN resp_label = '{negative.upper()}' THEN 1
                 WHEN block = 'cat_neutral_{positive}' AND resp_label = '{positive.upper()}' THEN 1
                 WHEN block = 'cat_{positive}_{negative}' AND resp_label = '{positive.upper()}'
                   THEN 0
                 ELSE try_cast(resp_label AS INT) END AS code FROM {tag}_seen),
{tag}_all AS (
  SELECT c.*, amuse, fear, bipolar, '{name}' AS expt_type,
         CASE WHEN {pair("neutral", positive)} THEN amuse WHEN {pair("neutral", negative)} THEN fear
              WHEN {pair(positive, negative)} THEN bipolar END AS stim_level,
         CASE WHEN resp_type = 'cont' THEN nullif(code, 999) / 100.0::DOUBLE
              ELSE nullif(code, 999)::DOUBLE END AS r
  FROM {tag}_coded c LEFT JOIN stimuli ON fname_seen = fname WHERE code IS NOT NULL)"""


_STIMULI_CTE = """
stimuli AS (SELECT 'g' || (p_partkey // 50 + 1) || '_' || (p_partkey % 50) AS fname,
                   (p_partkey % 6) / 5.0::DOUBLE AS amuse, (5.0::DOUBLE - p_partkey % 6) / 5 AS fear,
                   (p_partkey % 5) / 4.0::DOUBLE AS bipolar FROM part)"""
_TRIAL_COLUMNS = """subj_num, trial_num::INT AS trial_num, rt, round(rt / 1000, 4) AS rt_secs,
round(CASE WHEN r = 0.5 AND timeout = 1 THEN NULL ELSE r END, 4) AS resp, resp_label, timeout,
cb_order, cb_resp_order, resp_type, prompt_l, prompt_r, list_version, fname_seen, block, emo_block,
round(amuse, 4) AS amuse, round(fear, 4) AS fear, round(bipolar, 4) AS bipolar,
round(stim_level, 4) AS stim_level, round(slider_start, 4) AS slider_start, expt_type"""
_FIRST = _clean_ctes("a", "amusement", "fear", "amusement_fear", "0.5::DOUBLE")
_SECOND = _clean_ctes(
    "b", "positive", "negative", "positive_negative", "(floor(value)::INT % 100) / 100.0::DOUBLE"
)
_ORDINALS = ("source", "file_rank", "split_start", "row_ord", "trial_screen")


@CATALOG.add(f"WITH {_STIMULI_CTE}, {_FIRST} SELECT {_TRIAL_COLUMNS} FROM a_all")
def normalise_trials(spark, folder):
    log = _log(spark, folder, "amusement", "fear")
    return rounded(clean_trials(log, AMUSEMENT_FEAR, _stimuli(spark, folder)).drop(*_ORDINALS))


@CATALOG.add(f"WITH {_STIMULI_CTE}, {_SECOND} SELECT {_TRIAL_COLUMNS} FROM b_all")
def normalise_trials_second(spark, folder):
    log = _log(spark, folder, "positive", "negative")
    return rounded(clean_trials(log, POSITIVE_NEGATIVE, _stimuli(spark, folder)).drop(*_ORDINALS))


@CATALOG.add(f"""WITH {_STIMULI_CTE}, {_FIRST}, {_SECOND},
both_all AS (SELECT *, 0 AS e FROM a_all UNION ALL SELECT *, 1 FROM b_all)
SELECT {_TRIAL_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY subj_num, block, fname_seen ORDER BY e, event_id) AS k
  FROM both_all) WHERE k = 1""")
def combine_trials_(spark, folder):
    stimuli = _stimuli(spark, folder)
    first = clean_trials(_log(spark, folder, "amusement", "fear"), AMUSEMENT_FEAR, stimuli)
    second = clean_trials(_log(spark, folder, "positive", "negative"), POSITIVE_NEGATIVE, stimuli)
    return rounded(combine_trials([first, second]))


# --- quality control --------------------------------------------------------------------

RULES = qc.Rules(
    block_sizes=tuple(range(8, 18)), blocks_needed=5, timeouts_one_block=6, timeouts_two_blocks=4,
    rt_floor=2000, lazy_limit=2, lazy_tolerance=0.05, age_limit=35,
)
_CONTRAST = {
    "click": "neutral_amusement", "error": "neutral_fear", "view": "amusement_fear",
    "purchase": "neutral_negative", "signup": "other",
}


def _trials(spark, folder):
    kind, value = F.col("event_type"), F.col("value")
    slider = kind.isin("purchase", "signup")
    second = (F.col("user_id") % 10 == 0) & kind.isin("view", "signup")
    label = F.lit(None)
    for name, contrast in _CONTRAST.items():
        label = F.when(kind == name, contrast).otherwise(label)
    return table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("subj_num"),
        F.when(second, "second").otherwise("main").alias("expt_type"),
        F.concat(F.when(slider, "cont_").otherwise("cat_"), kind).alias("block"),
        label.alias("emo_block"),
        F.when(slider, "cont").otherwise("cat").alias("resp_type"),
        (value * 100).alias("rt"),
        F.when(value < 2, None)
        .when(slider, F.least(F.floor(value / 60 * 100) / 100, F.lit(1.0)))
        .otherwise((value > 20).cast("double"))
        .alias("resp"),
        F.when(value < 10, 1).otherwise(0).alias("timeout"),
        F.lit(0.3).alias("slider_start"),
    )


def _ages(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("subj_num"),
        F.explode(F.array(F.lit("main"), F.lit("second"))).alias("expt_type"),
        (F.col("c_nationkey") + 18).alias("age"),
    )


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CONTRAST.items())
_TRIALS_CTE = f"""
trials AS (
  SELECT event_id, user_id AS subj_num,
         CASE WHEN user_id % 10 = 0 AND event_type IN ('view', 'signup') THEN 'second' ELSE 'main'
         END AS expt_type,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'cont_' ELSE 'cat_' END || event_type
           AS block,
         CASE event_type {_LABELS} END AS emo_block,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'cont' ELSE 'cat' END AS resp_type,
         value * 100 AS rt,
         CASE WHEN value < 2 THEN NULL
              WHEN event_type IN ('purchase', 'signup') THEN least(floor(value / 60 * 100) / 100, 1.0::DOUBLE)
              ELSE (value > 20)::INT::DOUBLE END AS resp,
         (value < 10)::INT AS timeout, 0.3::DOUBLE AS slider_start FROM events)"""
_SIZES = ", ".join(str(s) for s in RULES.block_sizes)
_PARTS_CTE = f"""
seen AS (SELECT subj_num, count(*) AS n_complete_blocks FROM (
  SELECT subj_num, block, count(*) AS n FROM trials GROUP BY ALL) WHERE n IN ({_SIZES})
  GROUP BY subj_num),
late AS (SELECT subj_num, block, count(*) AS n, sum(timeout) AS t FROM trials GROUP BY ALL),
rules AS (SELECT subj_num, bool_or(t >= {RULES.timeouts_one_block}) AS timeouts_1block,
                 count_if(t >= {RULES.timeouts_two_blocks}) >= 2 AS timeouts_2block
          FROM late GROUP BY subj_num),
fast AS (SELECT subj_num, quantile_cont(rt, 0.75) AS rt_75 FROM trials
         WHERE resp_type = 'cat' AND resp IS NOT NULL GROUP BY subj_num),
fast_z AS (SELECT subj_num, rt_75, (rt_75 - avg(rt_75) OVER ()) / stddev_samp(rt_75) OVER ()
             AS rt_quantile_75 FROM fast),
slider AS (SELECT subj_num, round_even(avg(z), 1) AS n_0s, round_even(avg(h), 1) AS n_100s,
                  round_even(avg(s), 1) AS n_lazy FROM (
  SELECT subj_num, block, count_if(resp = 0) AS z, count_if(resp = 1) AS h,
         count_if(abs(resp - slider_start) < {RULES.lazy_tolerance}::DOUBLE) AS s
  FROM trials WHERE resp_type = 'cont' AND resp IS NOT NULL GROUP BY ALL) GROUP BY subj_num)"""
_PROFILE_CTE = f"""{_TRIALS_CTE}, {_PARTS_CTE},
ages AS (SELECT DISTINCT t.subj_num, t.expt_type, c_nationkey + 18 AS age
         FROM trials t LEFT JOIN customer ON c_custkey = t.subj_num),
profile AS (
  SELECT subj_num, expt_type, age, block, n_complete_blocks, (n - t)::BIGINT AS n_trials_responded,
         timeouts_1block, timeouts_2block, rt_75, rt_quantile_75, n_0s, n_100s, n_lazy,
         n_complete_blocks = {RULES.blocks_needed} AS enough_trials_seen,
         NOT (timeouts_1block OR timeouts_2block) AS enough_resps,
         coalesce(rt_75 > {RULES.rt_floor}, false) AS not_too_fast,
         n_lazy < {RULES.lazy_limit} AS slider_not_lazy, age <= {RULES.age_limit} AS age_valid
  FROM ages LEFT JOIN seen USING (subj_num) LEFT JOIN late USING (subj_num)
  LEFT JOIN rules USING (subj_num) LEFT JOIN fast_z USING (subj_num)
  LEFT JOIN slider USING (subj_num))"""
_ROUND_RT = "round(rt_75, 4) AS rt_75"
_ROUND_Z = "round(rt_quantile_75, 4) AS rt_quantile_75"


def _profile(spark, folder):
    return qc.qc_profile(_trials(spark, folder), _ages(spark, folder), RULES)


@CATALOG.add(f"WITH {_PROFILE_CTE} SELECT * REPLACE ({_ROUND_RT}, {_ROUND_Z}) FROM profile")
def qc_profile(spark, folder):
    return rounded(_profile(spark, folder))


@CATALOG.add(f"""WITH {_PROFILE_CTE},
kept AS (SELECT t.* EXCLUDE (emo_block), n_trials_responded AS n, {_ROUND_Z},
    CASE WHEN emo_block IN ('neutral_amusement', 'neutral_positive') THEN '0 to +'
         WHEN emo_block IN ('neutral_fear', 'neutral_negative') THEN '0 to -'
         WHEN emo_block IN ('amusement_fear', 'positive_negative') THEN '+ to -' END AS emo_block
  FROM trials t JOIN profile p ON t.subj_num = p.subj_num AND t.expt_type = p.expt_type
   AND t.block = p.block
  WHERE enough_trials_seen AND enough_resps AND not_too_fast AND slider_not_lazy AND age_valid)
SELECT * EXCLUDE (n) REPLACE (round(rt, 4) AS rt),
       CASE emo_block WHEN '0 to +' THEN 1 WHEN '0 to -' THEN 2 WHEN '+ to -' THEN 3 END
         AS emo_block_level,
       round(CASE WHEN emo_block = '+ to -' THEN -0.1::DOUBLE * (n - 54)
                  WHEN emo_block IS NOT NULL THEN -0.1::DOUBLE * (n - 43) END, 4)
         AS n_trials_responded FROM kept""")
def qc_keep(spark, folder):
    return rounded(qc.qc_keep(_trials(spark, folder), _profile(spark, folder)))


@CATALOG.add(f"""WITH {_PROFILE_CTE} SELECT DISTINCT subj_num, expt_type, age, n_complete_blocks,
  timeouts_1block, timeouts_2block, {_ROUND_RT}, n_lazy, enough_trials_seen, enough_resps,
  not_too_fast, slider_not_lazy, age_valid FROM profile""")
def qc_roster(spark, folder):
    return rounded(qc.qc_roster(_profile(spark, folder)))


@CATALOG.add(f"""WITH {_PROFILE_CTE},
scores AS (SELECT subj_num, expt_type, round(avg(resp), 6) AS mean_resp,
                  round(stddev_samp(rt), 6) AS spread_rt FROM trials GROUP BY subj_num, expt_type)
SELECT DISTINCT subj_num, expt_type, mean_resp, spread_rt FROM scores
WHERE mean_resp IS NOT NULL AND spread_rt IS NOT NULL AND subj_num IN (
  SELECT subj_num FROM profile
  WHERE enough_trials_seen AND enough_resps AND not_too_fast AND slider_not_lazy AND age_valid)""")
def pca_input_(spark, folder):
    scores = _trials(spark, folder).groupBy("subj_num", "expt_type").agg(
        F.round(F.avg("resp"), 6).alias("mean_resp"), F.round(F.stddev_samp("rt"), 6).alias("spread_rt")
    )
    twice = scores.unionByName(scores)  # a participant may have several equal score rows
    return pca_input(twice, _profile(spark, folder), ["mean_resp", "spread_rt"])


@CATALOG.add(f"WITH {_TRIALS_CTE}, {_PARTS_CTE} SELECT * FROM seen")
def complete_blocks(spark, folder):
    return qc.complete_blocks(_trials(spark, folder), ["subj_num"], "block", RULES.block_sizes)


@CATALOG.add(
    f"WITH {_TRIALS_CTE}, {_PARTS_CTE} "
    "SELECT subj_num, block, (n - t)::BIGINT AS n_trials_responded FROM late"
)
def responded_trials(spark, folder):
    return qc.responded_trials(_trials(spark, folder), ["subj_num"], "block")


@CATALOG.add("""
WITH late AS (SELECT user_id, date_trunc('day', ts) AS day, count_if(event_type = 'error') AS t
              FROM events GROUP BY ALL)
SELECT user_id, bool_or(t >= 3) AS timeouts_1block, count_if(t >= 2) >= 2 AS timeouts_2block
FROM late GROUP BY user_id
""")
def timeout_rules(spark, folder):
    days = table(spark, folder, "events").select(
        "user_id",
        F.date_trunc("day", "ts").alias("day"),
        F.when(F.col("event_type") == "error", 1).alias("timeout"),
    )
    return qc.timeout_rules(days, ["user_id"], "day", 3, 2)


@CATALOG.add("""
WITH f AS (SELECT user_id, quantile_cont(value, 0.75) AS q FROM events GROUP BY user_id)
SELECT user_id, round(q, 4) AS rt_75,
       round((q - avg(q) OVER ()) / stddev_samp(q) OVER (), 4) AS rt_quantile_75 FROM f
""")
def rt_quantile(spark, folder):
    return rounded(qc.rt_quantiles(table(spark, folder, "events"), ["user_id"], "value"))


@CATALOG.add("""
SELECT l_suppkey, round_even(avg(z), 1) AS n_0s, round_even(avg(h), 1) AS n_100s,
       round_even(avg(s), 1) AS n_lazy
FROM (SELECT l_suppkey, l_returnflag, count_if(r = 0) AS z, count_if(r = 1) AS h,
             count_if(abs(r - 0.5::DOUBLE) < 0.01::DOUBLE) AS s
      FROM (SELECT l_suppkey, l_returnflag, l_discount * 10 AS r FROM lineitem
            WHERE l_quantity <> 25) GROUP BY ALL) GROUP BY l_suppkey
""")
def slider_profile(spark, folder):
    answered = table(spark, folder, "lineitem").filter("l_quantity <> 25").select(
        "l_suppkey",
        "l_returnflag",
        (F.col("l_discount") * 10).alias("resp"),
        F.lit(0.5).alias("slider_start"),
    )
    return qc.slider_profile(answered, ["l_suppkey"], "l_returnflag")


@CATALOG.add("""
SELECT user_id, event_type, n, round(CASE WHEN event_type = 'view' THEN -0.1::DOUBLE * (n - 15)
       ELSE -0.1::DOUBLE * (n - 13) END, 4) AS deficit
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
""")
def response_deficit_(spark, folder):
    counts = table(spark, folder, "events").groupBy("user_id", "event_type").agg(
        F.count("*").alias("n")
    )
    deficit = response_deficit(F.col("n"), F.col("event_type"), "view", 15, 13)
    return rounded(counts.withColumn("deficit", deficit))
