"""Sources, projections, missing values and scalar recodes."""

from pyspark.sql import functions as F

from cohortspark.functions import (
    band_to_unit,
    columns_between,
    ordinal,
    pick_by_version,
    recode,
    sentinel_null,
    slider_to_scale,
    subscale_label,
    text_or_na,
    to_int,
    unite,
    zero_hundred_to_scale,
)
from cohortspark.operators.joins import apply_aliases, stack, union_tagged
from cohortspark.operators.pca import complete_cases
from cohortspark.operators.reshape import split_column
from cohortspark.operators.stats import row_mean, row_total, with_missing_counts, zscore
from cohortspark.operators.trials import level_by_block, response_code, response_scaled

from .registry import CATALOG, rounded, table


def _parties(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        to_int(F.col("c_nationkey").cast("string")).alias("nation"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("balance"),
    )
    return customers, suppliers


@CATALOG.add("""
SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance,
       c_mktsegment AS segment FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier
""")
def union_sources(spark, folder):
    customers, suppliers = _parties(spark, folder)
    return stack([customers, suppliers])


@CATALOG.add("""
SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance,
       c_mktsegment AS segment, 'customer' AS origin FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier
""")
def union_tagged_(spark, folder):
    customers, suppliers = _parties(spark, folder)
    return union_tagged({"customer": customers, "supplier": suppliers}, "origin")


@CATALOG.add("""
SELECT p_partkey, round((p_size - 1) / 49, 6) AS size_unit,
       round((p_retailprice - 900) / 100, 6) AS price_unit,
       round(p_size / (100.0::DOUBLE / 6) + 1, 6) AS size_points,
       round(p_size * 0.03::DOUBLE + 1, 6) AS size_band,
       round(p_retailprice / 1000, 6) AS price_thousands
FROM part
""")
def rescale_levels(spark, folder):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return rounded(
        table(spark, folder, "part").select(
            "p_partkey",
            band_to_unit(size, 1, 50).alias("size_unit"),
            band_to_unit(price, 900, 1000).alias("price_unit"),
            slider_to_scale(size, 7, 1).alias("size_points"),
            zero_hundred_to_scale(size).alias("size_band"),
            (price / 1000).alias("price_thousands"),
        ),
        6,
    )


@CATALOG.add("""
SELECT l_linestatus, count(*) AS n, count(nullif(l_discount, 0)) AS n_discount,
       count(nullif(l_returnflag, 'N')) AS n_flag,
       round(sum(nullif(l_quantity, 25)), 4) AS quantity
FROM lineitem GROUP BY l_linestatus
""")
def sentinel_null_(spark, folder):
    lines = table(spark, folder, "lineitem")
    lines = sentinel_null(lines, number=0, columns=["l_discount"])
    lines = sentinel_null(lines, text="N", columns=["l_returnflag"])
    lines = sentinel_null(lines, number=25, columns=["l_quantity"])
    return rounded(
        lines.groupBy("l_linestatus").agg(
            F.count("*").alias("n"),
            F.count("l_discount").alias("n_discount"),
            F.count("l_returnflag").alias("n_flag"),
            F.sum("l_quantity").alias("quantity"),
        )
    )


@CATALOG.add("""
WITH aliases AS (SELECT c_name AS alias, upper(c_name) || '-H' AS target
                 FROM customer WHERE c_mktsegment = 'HOUSEHOLD')
SELECT c_custkey, coalesce(target, c_name) AS c_name, c_mktsegment
FROM customer LEFT JOIN aliases ON c_name = alias
""")
def id_alias(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    aliases = customers.filter("c_mktsegment = 'HOUSEHOLD'").select(
        F.col("c_name").alias("alias"),
        F.concat(F.upper("c_name"), F.lit("-H")).alias("target"),
    )
    return apply_aliases(customers, aliases, "c_name")


@CATALOG.add("""
SELECT * FROM (
  SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 4) AS returned,
         round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 4) AS accepted,
         round(avg(nullif(l_discount, 0)), 6) AS discount
  FROM lineitem GROUP BY l_orderkey)
WHERE returned IS NOT NULL AND accepted IS NOT NULL AND discount IS NOT NULL
""")
def complete_cases_(spark, folder):
    flag, quantity = F.col("l_returnflag"), F.col("l_quantity")
    orders = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.round(F.sum(F.when(flag == "R", quantity)), 4).alias("returned"),
            F.round(F.sum(F.when(flag == "A", quantity)), 4).alias("accepted"),
            F.round(F.avg(F.nullif("l_discount", F.lit(0.0))), 6).alias("discount"),
        )
    )
    return complete_cases(orders)


@CATALOG.add(r"""
SELECT c_custkey, regexp_extract(c_name, '^([\p{L}\p{N}]*)[^\p{L}\p{N}]+(.*)$', 1) AS kind,
       regexp_extract(c_name, '^([\p{L}\p{N}]*)[^\p{L}\p{N}]+(.*)$', 2) AS rest
FROM customer
""")
def split_column_(spark, folder):
    return split_column(
        table(spark, folder, "customer"), "c_name", ("kind", "rest")
    ).select("c_custkey", "kind", "rest")


@CATALOG.add("""
SELECT o_orderkey, coalesce(o_orderstatus, 'NA') || '_'
       || coalesce(nullif(o_orderpriority, '3-MEDIUM'), 'NA') AS label
FROM orders
""")
def unite_columns(spark, folder):
    priority = F.nullif("o_orderpriority", F.lit("3-MEDIUM"))
    return table(spark, folder, "orders").select(
        "o_orderkey", unite(F.col("o_orderstatus"), priority).alias("label")
    )


@CATALOG.add("""
SELECT o_orderkey,
       CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE o_orderstatus END
         AS status,
       CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS is_open,
       CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '5-LOW' THEN 3 END
         AS priority_level,
       CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid'
            ELSE 'low' END AS band,
       CASE WHEN nullif(o_orderstatus, 'P') = 'O' THEN 'yes'
            WHEN nullif(o_orderstatus, 'P') IS NULL THEN 'unknown' ELSE 'no' END AS open_text
FROM orders
""")
def recode_values(spark, folder):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    known = F.nullif(status, F.lit("P"))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        recode(status, {"O": "open", "F": "final"}).alias("status"),
        F.when(status == "O", True).when(status == "F", False).alias("is_open"),
        ordinal(F.col("o_orderpriority"), ("1-URGENT", "2-HIGH", "5-LOW")).alias("priority_level"),
        F.when(price > 300000, "high").when(price > 100000, "mid").otherwise("low").alias("band"),
        F.when(known == "O", "yes").when(known.isNull(), "unknown").otherwise("no").alias(
            "open_text"
        ),
    )


@CATALOG.add("""
SELECT c_custkey,
       coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN c_name WHEN 'MACHINERY' THEN label
                                  WHEN 'FURNITURE' THEN nation END, 'none') AS chosen
FROM (SELECT *, lower(c_mktsegment) AS label, CAST(c_nationkey AS VARCHAR) AS nation FROM customer)
""")
def pick_by_version_(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_custkey",
        "c_mktsegment",
        F.col("c_name").alias("BUILDING"),
        F.lower("c_mktsegment").alias("MACHINERY"),
        F.col("c_nationkey").cast("string").alias("FURNITURE"),
    )
    chosen = pick_by_version(F.col("c_mktsegment"), ["BUILDING", "MACHINERY", "FURNITURE"])
    return customers.select("c_custkey", F.coalesce(chosen, F.lit("none")).alias("chosen"))


@CATALOG.add("""
SELECT o_orderkey,
       'scale_' || lower(regexp_replace(o_orderpriority, '[ -/]', '_', 'g')) AS label,
       substr(o_orderpriority, 3) AS rest, ends_with(o_orderpriority, 'LOW') AS is_low,
       coalesce(nullif(o_orderstatus, 'P'), 'NA') AS status_text
FROM orders
""")
def string_tidy(spark, folder):
    priority = F.col("o_orderpriority")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        subscale_label("scale", priority).alias("label"),
        F.substring(priority, 3, 2**31 - 1).alias("rest"),
        F.endswith(priority, F.lit("LOW")).alias("is_low"),
        text_or_na(F.nullif("o_orderstatus", F.lit("P"))).alias("status_text"),
    )


@CATALOG.add("""
SELECT l_linestatus, l_returnflag, count(level) AS n, round(sum(level), 4) AS level_sum
FROM (SELECT l_linestatus, l_returnflag,
             CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN l_quantity
                  WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN l_quantity
                  WHEN l_returnflag = 'N' THEN l_discount
                  WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN l_tax END AS level
      FROM lineitem)
GROUP BY l_linestatus, l_returnflag
""")
def level_by_block_(spark, folder):
    pair = recode(
        F.col("l_returnflag"), {"A": "neutral_amusement", "N": "neutral_fear", "R": "amusement_fear"}
    )
    kind = F.when(F.col("l_linestatus") == "F", "cat").when(
        F.col("l_returnflag") == "R", "other"
    ).otherwise("cont")
    lines = table(spark, folder, "lineitem").select(
        "l_linestatus",
        "l_returnflag",
        unite(kind, pair).alias("block"),
        F.col("l_quantity").alias("amuse"),
        F.col("l_discount").alias("fear"),
        F.col("l_tax").alias("bipolar"),
    )
    lines = lines.withColumn("level", level_by_block(F.col("block"), "amusement", "fear"))
    return rounded(
        lines.groupBy("l_linestatus", "l_returnflag").agg(
            F.count("level").alias("n"), F.sum("level").alias("level_sum")
        )
    )


@CATALOG.add("""
WITH texts AS (
  SELECT event_id, CASE WHEN event_type = 'signup' THEN 'cont_neutral_fear'
                        WHEN event_type = 'view' THEN 'cat_neutral_amusement'
                        ELSE 'cat_amusement_fear' END AS block,
         CASE WHEN event_type = 'signup' THEN 'cont' ELSE 'cat' END AS resp_type,
         CASE WHEN value < 20 THEN 1 END AS timeout,
         CASE WHEN event_type = 'error' AND value > 30 THEN 'submitResp'
              WHEN event_type = 'click' THEN 'FEAR' WHEN event_type = 'view' THEN 'AMUSEMENT'
              WHEN event_type = 'purchase' AND value > 30 THEN 'NEUTRAL'
              WHEN event_type = 'purchase' THEN 'AMUSEMENT'
              WHEN value > 60 THEN '999' ELSE CAST(value AS VARCHAR) END AS response
  FROM events),
coded AS (
  SELECT *, CASE WHEN response = 'NEUTRAL' THEN 0 WHEN response = 'FEAR' THEN 1
                 WHEN block = 'cat_neutral_amusement' AND response = 'AMUSEMENT' THEN 1
                 WHEN block = 'cat_amusement_fear' AND response = 'AMUSEMENT' THEN 0
                 ELSE trunc(try_cast(response AS DOUBLE))::INT END AS code
  FROM texts),
scaled AS (
  SELECT *, CASE WHEN resp_type = 'cont' THEN nullif(code, 999)::DOUBLE / 100
                 ELSE nullif(code, 999)::DOUBLE END AS value_scaled
  FROM coded WHERE code IS NOT NULL)
SELECT event_id, block, code, round(CASE WHEN value_scaled = 0.5 AND timeout = 1 THEN NULL
       ELSE value_scaled END, 4) AS resp FROM scaled
""")
def parse_response(spark, folder):
    kind, value = F.col("event_type"), F.col("value")
    texts = table(spark, folder, "events").select(
        "event_id",
        F.when(kind == "signup", "cont_neutral_fear").when(
            kind == "view", "cat_neutral_amusement"
        ).otherwise("cat_amusement_fear").alias("block"),
        F.when(kind == "signup", "cont").otherwise("cat").alias("resp_type"),
        F.when(value < 20, 1).alias("timeout"),
        F.when((kind == "error") & (value > 30), "submitResp")
        .when(kind == "click", "FEAR")
        .when(kind == "view", "AMUSEMENT")
        .when((kind == "purchase") & (value > 30), "NEUTRAL")
        .when(kind == "purchase", "AMUSEMENT")
        .when(value > 60, "999")
        .otherwise(value.cast("string"))
        .alias("response"),
    )
    code = response_code(F.col("response"), F.col("block"), "amusement", "fear")
    coded = texts.withColumn("code", code).filter("code is not null")
    resp = response_scaled(F.col("code"), F.col("resp_type"), F.col("timeout"))
    return coded.select("event_id", "block", "code", F.round(resp, 4).alias("resp"))


def _gappy_lines(spark, folder):
    flag = F.col("l_returnflag")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("subj_num"),
        F.col("l_linenumber").alias("line"),
        F.nullif("l_quantity", F.lit(25.0)).alias("qa_1"),
        F.nullif("l_discount", F.lit(0.0)).alias("qa_2"),
        F.nullif("l_tax", F.lit(0.0)).alias("QA_3"),
        F.when(flag != "N", F.col("l_extendedprice")).alias("qb_1"),
        F.when(flag == "R", F.col("l_tax")).alias("qb_2"),
        F.nullif("l_linestatus", F.lit("O")).alias("dx_med"),
        F.when(flag == "A", F.lit(1.0)).alias("qa_4"),
    )


@CATALOG.add("""
SELECT nas_qa, nas_qb, nas_qa + nas_qb AS nas_total, count(*) AS n, sum(line)::BIGINT AS lines
FROM (SELECT l_linenumber AS line,
             (l_quantity = 25)::INT + (l_discount = 0)::INT + (l_tax = 0)::INT AS nas_qa,
             (l_returnflag = 'N')::INT + (l_returnflag <> 'R')::INT AS nas_qb FROM lineitem)
GROUP BY ALL
""")
def missing_counts_(spark, folder):
    lines = _gappy_lines(spark, folder)
    span = columns_between(lines, "subj_num", "dx_med")
    counted = with_missing_counts(lines, {"nas_qa": "qa", "nas_qb": "qb"}, within=span)
    return counted.groupBy("nas_qa", "nas_qb", "nas_total").agg(
        F.count("*").alias("n"), F.sum("line").alias("lines")
    )


@CATALOG.add("""
WITH w AS (SELECT l_orderkey AS subj_num, nullif(l_quantity, 25) AS a, nullif(l_discount, 0) AS b,
                  CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE END AS c,
                  (l_quantity = 25)::INT + (l_discount = 0)::INT + (l_returnflag <> 'A')::INT
                    AS nas FROM lineitem),
t AS (SELECT subj_num, coalesce(a,0) + coalesce(b,0) + coalesce(c,0) AS corrected,
             coalesce(a,0) + coalesce(b,0) + coalesce(c,0) + nas AS compat,
             CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT > 0
                  THEN (coalesce(a,0) + coalesce(b,0) + coalesce(c,0))
                       / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT)
             END AS mean FROM w)
SELECT subj_num, round(sum(corrected), 4) AS corrected, round(sum(compat), 4) AS compat,
       round(sum(mean), 4) AS mean FROM t GROUP BY subj_num
""")
def row_totals(spark, folder):
    lines = _gappy_lines(spark, folder).drop("QA_3")
    counted = with_missing_counts(lines, {"nas_qa": "qa"})
    totals = counted.select(
        "subj_num",
        row_total(counted, "qa", exclude="^nas_").alias("corrected"),
        row_total(counted, "qa").alias("compat"),
        row_mean(counted, "qa", exclude="^nas_").alias("mean"),
    )
    names = ("corrected", "compat", "mean")
    return rounded(totals.groupBy("subj_num").agg(*[F.sum(n).alias(n) for n in names]))


@CATALOG.add("""
SELECT c_custkey, round((b - (avg(b) OVER ())) / (stddev_samp(b) OVER ()), 4) AS balance_z,
       round((k - (avg(k) OVER ())) / (stddev_samp(k) OVER ()), 4) AS nation_z
FROM (SELECT c_custkey, CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_acctbal END AS b,
             c_nationkey AS k FROM customer)
""")
def zscore_(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_acctbal")).alias("balance"),
        F.col("c_nationkey").alias("nation"),
    )
    scored = zscore(customers, {"balance": "balance_z", "nation": "nation_z"})
    return rounded(scored.select("c_custkey", "balance_z", "nation_z"))
