"""Wide to long, long to wide, grids and joins."""

from pyspark.sql import functions as F

from cohortspark.functions import ratio, rename_by_pattern
from cohortspark.operators.joins import (
    full_join_reduce,
    left_join,
    left_join_chain,
    semi_keep,
)
from cohortspark.operators.nesting import nest_rows, unnest_rows
from cohortspark.operators.reshape import (
    expand_grid,
    items_long_likert,
    items_long_slider,
    score_type_long,
    subscales_wide,
    unpivot_pairs,
    unpivot_two_keys,
    widen,
)

from .registry import CATALOG, rounded, table

PRIORITIES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}
KINDS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


@CATALOG.add("""
WITH c AS (SELECT o_custkey AS subj_num, o_orderpriority AS p, round(sum(o_totalprice), 4) AS v
           FROM orders GROUP BY ALL),
p(item, p) AS (VALUES (1, '1-URGENT'), (2, '2-HIGH'), (3, '3-MEDIUM'), (4, '4-NOT SPECIFIED'),
                      (5, '5-LOW'))
SELECT s.subj_num, p.item, c.v AS response
FROM (SELECT DISTINCT o_custkey AS subj_num FROM orders) s CROSS JOIN p
LEFT JOIN c ON c.subj_num = s.subj_num AND c.p = p.p
""")
def items_long_likert_(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "subj_num")
    price = [
        F.sum(F.when(F.col("o_orderpriority") == name, F.col("o_totalprice"))).alias(
            f"order_price_{item}"
        )
        for name, item in PRIORITIES.items()
    ]
    wide = orders.groupBy("subj_num").agg(*price)
    wide = rename_by_pattern(wide, "order_price", "orderprice")
    return rounded(items_long_likert(wide, ["subj_num"], "orderprice"))


def _user_kinds(spark, folder, measures):
    kind = F.col("event_type")
    cells = [
        fun(F.when(kind == name, F.col("value"))).alias(f"{item}_{m}_1")
        for name, item in KINDS.items()
        for m, fun in measures.items()
    ]
    return table(spark, folder, "events").groupBy(F.col("user_id").alias("subj_num")).agg(*cells)


_KIND_ROWS = """
k(item, kind) AS (VALUES (1, 'click'), (2, 'error'), (3, 'purchase'), (4, 'signup'), (5, 'view')),
s AS (SELECT DISTINCT user_id AS subj_num FROM events),
g AS (SELECT user_id, event_type, avg(value) AS m, count(value) AS n, max(value) AS top
      FROM events GROUP BY ALL)
"""


@CATALOG.add(f"""
WITH {_KIND_ROWS}
SELECT s.subj_num, k.item, round(g.m / (100.0::DOUBLE / 6) + 1, 8) AS response
FROM s CROSS JOIN k LEFT JOIN g ON g.user_id = s.subj_num AND g.event_type = k.kind
""")
def items_long_slider_(spark, folder):
    wide = _user_kinds(spark, folder, {"value": F.avg})
    return rounded(items_long_slider(wide, ["subj_num"], wide.columns[1:], 7, 1), 8)


@CATALOG.add(f"""
WITH {_KIND_ROWS}
SELECT s.subj_num, k.item, coalesce(g.n, 0)::DOUBLE AS number, round(g.top, 4) AS top
FROM s CROSS JOIN k LEFT JOIN g ON g.user_id = s.subj_num AND g.event_type = k.kind
""")
def unpivot_pairs_(spark, folder):
    wide = _user_kinds(spark, folder, {"number": F.count, "top": F.max})
    long = unpivot_pairs(wide, ["subj_num"], wide.columns[1:], ["number", "top"], cast="double")
    return rounded(long)


@CATALOG.add("""
WITH k(item, f) AS (VALUES (1, 'A'), (2, 'N'), (3, 'R')), t(q_type) AS (VALUES ('F'), ('O')),
g AS (SELECT l_suppkey, l_returnflag, l_linestatus, sum(l_quantity) AS v FROM lineitem
      GROUP BY ALL)
SELECT s.s AS subj_num, k.item, t.q_type, round(g.v, 4) AS response
FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem) s CROSS JOIN k CROSS JOIN t
LEFT JOIN g ON g.l_suppkey = s.s AND g.l_returnflag = k.f AND g.l_linestatus = t.q_type
""")
def unpivot_two_keys_(spark, folder):
    cells = [
        F.sum(
            F.when(
                (F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status),
                F.col("l_quantity"),
            )
        ).alias(f"{item}_quantity_{status}_1")
        for item, flag in enumerate("ANR", 1)
        for status in "FO"
    ]
    wide = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("subj_num")).agg(*cells)
    return rounded(unpivot_two_keys(wide, ["subj_num"], wide.columns[1:]))


@CATALOG.add("""
WITH u AS (SELECT user_id AS subj_num, count(*) AS n, sum(value) AS total, avg(value) AS mean,
                  count_if(event_type = 'error') AS errors FROM events GROUP BY user_id)
SELECT subj_num, n, 'adj' AS score_type, round(total, 4) AS value, errors / n AS errors
FROM u
UNION ALL
SELECT subj_num, n, 'patched', round(mean, 8), NULL FROM u
""")
def score_type_long_(spark, folder):
    users = (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("subj_num"))
        .agg(
            F.count("*").alias("n"),
            F.round(F.sum("value"), 4).alias("adj__value"),
            F.round(F.avg("value"), 8).alias("patched__value"),
            ratio(F.count_if(F.col("event_type") == "error"), F.count("*")).alias("adj__errors"),
        )
    )
    return score_type_long(users)


@CATALOG.add("""
SELECT l_suppkey,
       max(CASE WHEN l_returnflag = 'A' THEN a END) AS adj__A,
       max(CASE WHEN l_returnflag = 'N' THEN a END) AS adj__N,
       max(CASE WHEN l_returnflag = 'R' THEN a END) AS adj__R,
       max(CASE WHEN l_returnflag = 'A' THEN p END) AS patched__A,
       max(CASE WHEN l_returnflag = 'N' THEN p END) AS patched__N,
       max(CASE WHEN l_returnflag = 'R' THEN p END) AS patched__R
FROM (SELECT l_suppkey, l_returnflag, round(avg(l_quantity), 8) AS a, round(sum(l_tax), 4) AS p
      FROM lineitem GROUP BY ALL) GROUP BY l_suppkey
""")
def subscales_wide_(spark, folder):
    scored = (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", F.col("l_returnflag").alias("subscale"))
        .agg(
            F.round(F.avg("l_quantity"), 8).alias("score_adj"),
            F.round(F.sum("l_tax"), 4).alias("score_patched"),
        )
    )
    return subscales_wide(scored, ["l_suppkey"], ["A", "N", "R"])


@CATALOG.add("""
SELECT l_suppkey, max(CASE WHEN l_returnflag = 'A' THEN a END) AS flag_A,
       max(CASE WHEN l_returnflag = 'N' THEN a END) AS flag_N,
       max(CASE WHEN l_returnflag = 'R' THEN a END) AS flag_R
FROM (SELECT l_suppkey, l_returnflag, round(avg(l_quantity), 8) AS a FROM lineitem GROUP BY ALL)
GROUP BY l_suppkey
""")
def subscales_wide_single(spark, folder):
    scored = (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", "l_returnflag")
        .agg(F.round(F.avg("l_quantity"), 8).alias("score"))
    )
    return widen(
        scored, ["l_suppkey"], "l_returnflag", ["A", "N", "R"], ["score"], lambda m, v: f"flag_{v}"
    )


@CATALOG.add("""
SELECT c.conv_id, c.turn, c.role, length(c.text) AS n, s.turns, s.longest
FROM conversations c LEFT JOIN (
  SELECT conv_id, count(*) AS turns, max(length(text)) AS longest FROM conversations
  GROUP BY conv_id) s ON c.conv_id = s.conv_id
""")
def nest_unnest(spark, folder):
    # a summary per conversation meets its chunks, not its rows
    talks = table(spark, folder, "conversations")
    summary = talks.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.max(F.length("text")).alias("longest")
    )
    rows = talks.select("conv_id", "turn", "role", F.length("text").alias("n"))
    return unnest_rows(left_join(nest_rows(rows, ["conv_id"]), summary, ["conv_id"]))


@CATALOG.add("""
SELECT event_type, count(*) AS n, count(DISTINCT (user_id, value)) AS n_distinct,
       round(sum(value), 4) AS total, true AS bounded FROM events GROUP BY event_type
""")
def nest_chunks(spark, folder):
    # five keys hold all events: their lists are chunks of at most 500 rows
    events = table(spark, folder, "events").select("event_type", "user_id", "value")
    nested = nest_rows(events, ["event_type"], size=500)
    summed = lambda part: F.aggregate("data", F.lit(0).cast("double"), part)
    parts = nested.select(
        "event_type",
        F.size("data").alias("held"),
        summed(lambda total, row: total + row["copies"]).alias("rows"),
        summed(lambda total, row: total + F.coalesce(row["value"], F.lit(0.0)) * row["copies"]).alias("value"),
    )
    return parts.groupBy("event_type").agg(
        F.sum("rows").cast("long").alias("n"),
        F.sum("held").alias("n_distinct"),
        F.round(F.sum("value"), 4).alias("total"),
        (F.max("held") <= 500).alias("bounded"),
    )


@CATALOG.add("""
SELECT n.n_nationkey, n.n_name, r.r_name
FROM (SELECT DISTINCT n_nationkey, n_name FROM nation) n
CROSS JOIN (SELECT DISTINCT r_name FROM region) r
""")
def expand_grid_(spark, folder):
    regions = table(spark, folder, "region")
    return expand_grid(table(spark, folder, "nation"), ["n_nationkey", "n_name"], "r_name", regions)


@CATALOG.add("""
SELECT c_custkey, c_nationkey, o.n_orders, o.spent, n_name, n_regionkey, r_name
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders,
                                round(sum(o_totalprice), 2) AS spent FROM orders
                         GROUP BY o_custkey) o ON c_custkey = o_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def left_join_chain_(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    spent = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    )
    joined = left_join_chain(customers, [spent], ["c_custkey"])
    joined = left_join(joined, table(spark, folder, "nation"), [("c_nationkey", "n_nationkey")])
    return left_join(joined, table(spark, folder, "region"), [("n_regionkey", "r_regionkey")])


@CATALOG.add("""
SELECT e.event_id, e.user_id, e.event_type, c.n, c.typical
FROM events e LEFT JOIN (
  SELECT user_id, event_type, count(*) AS n, round(avg(value), 8) AS typical FROM events
  WHERE value > 20 GROUP BY ALL) c ON e.user_id = c.user_id AND e.event_type = c.event_type
""")
def attach_covariate(spark, folder):
    events = table(spark, folder, "events")
    covariate = (
        events.filter("value > 20")
        .groupBy("user_id", "event_type")
        .agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("typical"))
    )
    rows = events.select("event_id", "user_id", "event_type")
    return left_join(rows, covariate, ["user_id", "event_type"])


@CATALOG.add("""
SELECT c_custkey, status, n, last_price FROM (
  SELECT c_custkey, unnest(['F', 'O']) AS status FROM customer)
LEFT JOIN (SELECT o_custkey, o_orderstatus, count(*) AS n, max(o_totalprice) AS last_price
           FROM orders WHERE o_totalprice > 200000 GROUP BY ALL)
ON c_custkey = o_custkey AND status = o_orderstatus
""")
def followup_attach(spark, folder):
    people = table(spark, folder, "customer").select(
        "c_custkey", F.explode(F.array(F.lit("F"), F.lit("O"))).alias("status")
    )
    later = (
        table(spark, folder, "orders")
        .filter("o_totalprice > 200000")
        .groupBy("o_custkey", F.col("o_orderstatus").alias("status"))
        .agg(F.count("*").alias("n"), F.max("o_totalprice").alias("last_price"))
    )
    return left_join(people, later, [("c_custkey", "o_custkey"), "status"])


@CATALOG.add("""
WITH a AS (SELECT l_suppkey, count(*) AS n_a FROM lineitem
           WHERE l_returnflag = 'A' AND l_quantity > 49 GROUP BY l_suppkey),
b AS (SELECT l_suppkey, count(*) AS n_b FROM lineitem
      WHERE l_returnflag = 'N' AND l_quantity < 2 AND l_discount > 0.08 GROUP BY l_suppkey),
c AS (SELECT l_suppkey, round(sum(l_tax), 4) AS tax FROM lineitem
      WHERE l_returnflag = 'R' AND l_quantity = 7 AND l_discount < 0.02 GROUP BY l_suppkey)
SELECT l_suppkey, n_a, n_b, tax FROM a FULL JOIN b USING (l_suppkey) FULL JOIN c USING (l_suppkey)
""")
def full_join_reduce_(spark, folder):
    lines = table(spark, folder, "lineitem")
    part = lambda where, cell: lines.filter(where).groupBy("l_suppkey").agg(cell)
    return full_join_reduce(
        [
            part("l_returnflag = 'A' and l_quantity > 49", F.count("*").alias("n_a")),
            part(
                "l_returnflag = 'N' and l_quantity < 2 and l_discount > 0.08",
                F.count("*").alias("n_b"),
            ),
            part(
                "l_returnflag = 'R' and l_quantity = 7 and l_discount < 0.02",
                F.round(F.sum("l_tax"), 4).alias("tax"),
            ),
        ],
        ["l_suppkey"],
    )


@CATALOG.add("""
SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_custkey IN (
  SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey
  HAVING count(*) >= 3)
""")
def semi_keep_(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    urgent = orders.filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").count()
    return semi_keep(orders, urgent.filter("count >= 3"), ["o_custkey"])
