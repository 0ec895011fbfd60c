"""Principal components, model frames and regressions."""

from pyspark.sql import functions as F

from cohortspark.functions import bounded_logit
from cohortspark.operators import models, quadrature
from cohortspark.operators.formulas import parse_formula, with_factors
from cohortspark.operators.grids import fit_formulas
from cohortspark.operators.pca import fit_pca, pca_scores
from cohortspark.operators.stats import zscore

from .registry import CATALOG, rounded, table

DIMENSIONS = [f"d{i}" for i in range(64)]


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(DIMENSIONS)]
    )


@CATALOG.add("""
WITH v AS (SELECT embedding AS e FROM embeddings)
SELECT a, b, round(corr(e[a + 1], e[b + 1]), 4) AS correlation
FROM v, unnest(range(0, 64)) AS s(a), unnest(range(0, 64)) AS t(b) GROUP BY a, b
""")
def pca_variance(spark, folder):
    """The components put together again: they are right if they give the correlations."""
    vectors = _vectors(spark, folder)
    fit = fit_pca(vectors, DIMENSIONS)
    loadings = fit.loadings(vectors)
    spread = loadings.join(fit.variance(vectors).select("component", "sdev"), "component").select(
        "component", F.substring("variable", 2, 9).cast("long").alias("at"),
        (F.col("loading") * F.col("sdev")).alias("part"),
    )
    left = spread.select("component", F.col("at").alias("a"), F.col("part").alias("_left"))
    right = spread.select("component", F.col("at").alias("b"), F.col("part").alias("_right"))
    products = left.join(right, "component").groupBy("a", "b")
    total = F.round(F.sum(F.col("_left") * F.col("_right")), 4) + F.lit(0.0)
    return products.agg(total.alias("correlation"))


@CATALOG.add("""
WITH v AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) AS t(i)),
z AS (SELECT vec_id, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS z FROM v WINDOW w AS (PARTITION BY i))
SELECT vec_id, round(sum(z * z), 4) AS squared, round(sum(z), 4) AS total FROM z GROUP BY vec_id
""")
def pca_scores_(spark, folder):
    """Scores of all vectors, turned back: length and sum of the standardised vectors."""
    vectors = _vectors(spark, folder)
    fit = fit_pca(vectors, DIMENSIONS)
    scores = pca_scores(vectors, fit, ["vec_id"])
    # a rotation keeps lengths, and each axis has its share in the sum
    parts = [F.col(f"PC{k}") * F.lit(float(sd)) for k, sd in enumerate(fit.sdev, 1)]
    weights = fit.rotation.sum(axis=0).tolist()
    squared = sum((p * p for p in parts[1:]), parts[0] * parts[0])
    total = sum((p * w for p, w in zip(parts[1:], weights[1:], strict=True)), parts[0] * weights[0])
    return scores.select(
        "vec_id", F.round(squared, 4).alias("squared"), (F.round(total, 4) + F.lit(0.0)).alias("total")
    )


PAIR = ["amount", "reduced"]


def _orders(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("amount"),
        F.sum(F.col("l_quantity") * F.col("l_discount")).alias("reduced"),
    )


_PAIR_SQL = """
WITH m AS (SELECT l_orderkey, sum(l_quantity) AS a, sum(l_quantity * l_discount) AS b FROM lineitem
           GROUP BY l_orderkey),
z AS (SELECT l_orderkey, (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS za,
             (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS zb, corr(a, b) OVER () AS r FROM m)
"""


@CATALOG.add(_PAIR_SQL + """
SELECT 'PC1' AS component, round(sqrt(1 + abs(max(r))), 4) AS sdev,
       round((1 + abs(max(r))) / 2, 4) AS proportion FROM z
UNION ALL
SELECT 'PC2', round(sqrt(1 - abs(max(r))), 4), round((1 - abs(max(r))) / 2, 4) FROM z
""")
def pca_pair_variance(spark, folder):
    orders = _orders(spark, folder)
    return rounded(fit_pca(orders, PAIR).variance(orders))


@CATALOG.add(_PAIR_SQL + """
SELECT l_orderkey, round((za + zb) / sqrt(2.0::DOUBLE) / sqrt(1 + r), 4) AS PC1 FROM z
""")
def pca_pair_scores(spark, folder):
    # the two sums grow together, so both loadings of the first component are positive
    orders = _orders(spark, folder)
    return rounded(pca_scores(orders, fit_pca(orders, PAIR), ["l_orderkey"]).drop("PC2"))


def _answers(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("subj_num"),
        F.col("event_type").alias("emo_block"),
        F.when(F.col("value") > 5, "cont").otherwise("cat").alias("resp_type"),
        F.when(F.col("value") < 90, F.col("value")).alias("resp"),
    )


def _user_scores(spark, folder):
    users = table(spark, folder, "events").groupBy(F.col("user_id").alias("subj_num")).agg(
        F.avg("value").alias("mean"), F.count("*").alias("n")
    )
    return zscore(users, {"mean": "PC1", "n": "PC2"})


@CATALOG.add("""
WITH u AS (SELECT user_id, avg(value) AS m, count(*) AS n FROM events GROUP BY user_id),
s AS (SELECT user_id, (m - avg(m) OVER ()) / stddev_samp(m) OVER () AS p1,
             (n - avg(n) OVER ()) / stddev_samp(n) OVER () AS p2 FROM u)
SELECT e.event_id, e.user_id AS subj_num, 'view' AS emo_block, 'cont' AS resp_type,
       round(value, 4) AS resp, round(p1, 4) AS PC1, round(p2, 4) AS PC2
FROM events e LEFT JOIN s ON e.user_id = s.user_id
WHERE event_type = 'view' AND value > 5 AND value < 90
""")
def model_frame(spark, folder):
    frame = models.model_frame(
        _answers(spark, folder), _user_scores(spark, folder), "view", "cont"
    )
    return rounded(frame)


@CATALOG.add("""
SELECT l_suppkey, round(sum(ln(p / (1 - p))), 4) AS logit, round(min(p), 4) AS low
FROM (SELECT l_suppkey, CASE WHEN l_discount = 0 THEN 0.005::DOUBLE
                             WHEN l_discount * 10 = 1 THEN 0.995::DOUBLE
                             ELSE l_discount * 10 END AS p FROM lineitem) GROUP BY l_suppkey
""")
def bounded_logit_(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", (F.col("l_discount") * 10).alias("p")
    )
    inside = F.when(F.col("p") == 0, 0.005).when(F.col("p") == 1, 0.995).otherwise(F.col("p"))
    return rounded(
        lines.groupBy("l_suppkey").agg(
            F.sum(bounded_logit(F.col("p"))).alias("logit"), F.min(inside).alias("low")
        )
    )


@CATALOG.add("""
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax,
       round(l_quantity * l_discount, 4) AS "l_quantity:l_discount",
       round(l_quantity * l_tax, 4) AS "l_quantity:l_tax" FROM lineitem
""")
def design_matrix(spark, folder):
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]
    lines = table(spark, folder, "lineitem").select(*columns)
    terms = ["l_quantity", "l_discount", "l_quantity:l_discount", "l_quantity:l_tax"]
    return rounded(models.design(lines, terms))


_OLS = """
WITH m AS (SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS mx,
                  regr_slope(l_extendedprice, l_quantity) AS b,
                  regr_intercept(l_extendedprice, l_quantity) AS a,
                  var_pop(l_quantity) * count(*) AS sxx, var_pop(l_extendedprice) * count(*) AS syy,
                  covar_pop(l_extendedprice, l_quantity) * count(*) AS sxy
           FROM lineitem GROUP BY ALL),
s AS (SELECT *, (syy - b * sxy) / (n - 2) AS s2 FROM m),
c AS (SELECT l_returnflag, l_linestatus, '(Intercept)' AS term, round(a, 4) AS estimate,
             round(sqrt(s2 * (1.0::DOUBLE / n + mx * mx / sxx)), 4) AS std_error FROM s
      UNION ALL SELECT l_returnflag, l_linestatus, 'l_quantity', round(b, 4),
             round(sqrt(s2 / sxx), 4) FROM s)
"""


def _ols(spark, folder):
    return models.ols_by_group(
        table(spark, folder, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        "l_extendedprice",
        ["l_quantity"],
    )


@CATALOG.add(_OLS + "SELECT * FROM c")
def ols_by_group(spark, folder):
    return rounded(_ols(spark, folder))


@CATALOG.add("""
WITH m AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1,
                  avg(l_tax) AS m2, var_pop(l_quantity) AS v1, var_pop(l_tax) AS v2,
                  covar_pop(l_quantity, l_tax) AS v12, covar_pop(l_extendedprice, l_quantity) AS c1,
                  covar_pop(l_extendedprice, l_tax) AS c2 FROM lineitem GROUP BY ALL),
b AS (SELECT *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS b1,
             (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS b2 FROM m)
SELECT l_returnflag, '(Intercept)' AS term, round(my - b1 * m1 - b2 * m2, 4) AS estimate FROM b
UNION ALL SELECT l_returnflag, 'l_quantity', round(b1, 4) FROM b
UNION ALL SELECT l_returnflag, 'l_tax', round(b2, 4) FROM b
""")
def ols_two_terms(spark, folder):
    fitted = models.ols_by_group(
        table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice",
        ["l_quantity", "l_tax"],
    )
    return rounded(fitted.drop("std_error"))


@CATALOG.add("""
WITH m AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mx,
                  regr_slope(l_extendedprice, l_quantity) AS b,
                  regr_intercept(l_extendedprice, l_quantity) AS a,
                  var_pop(l_quantity) * count(*) AS sxx, var_pop(l_extendedprice) * count(*) AS syy,
                  covar_pop(l_extendedprice, l_quantity) * count(*) AS sxy
           FROM lineitem GROUP BY ALL),
s AS (SELECT *, (syy - b * sxy) / (n - 2) AS s2 FROM m)
SELECT l_returnflag, '(Intercept)' AS term, round(a, 4) AS estimate,
       round(sqrt(s2 * (1.0::DOUBLE / n + mx * mx / sxx)), 4) AS std_error FROM s
UNION ALL SELECT l_returnflag, 'l_quantity', round(b, 4), round(sqrt(s2 / sxx), 4) FROM s
UNION ALL SELECT l_returnflag, 'twice', NULL, NULL FROM s
""")
def ols_collinear(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("twice", F.col("l_quantity") * 2)
    return rounded(
        models.ols_by_group(lines, ["l_returnflag"], "l_extendedprice", ["l_quantity", "twice"])
    )


@CATALOG.add("""
SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept
FROM lineitem GROUP BY l_suppkey
""")
def subject_slopes(spark, folder):
    lines = table(spark, folder, "lineitem")
    return rounded(models.subject_slopes(lines, ["l_suppkey"], "l_extendedprice", "l_quantity"))


@CATALOG.add(_OLS + "SELECT * FROM c WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def model_lookup(spark, folder):
    found = models.model_lookup(_ols(spark, folder), l_returnflag="R", l_linestatus="F")
    return rounded(found)


def _graded(spark, folder):
    documents = table(spark, folder, "documents").select(
        "doc_id", "source", F.ln(F.col("n_chars") + 1).alias("log_chars")
    )
    return documents.join(table(spark, folder, "labels"), "doc_id")


@CATALOG.add("""
WITH RECURSIVE d AS (SELECT ln(n_chars + 1) AS x, quality AS y FROM documents
                     JOIN labels USING (doc_id)),
n AS (SELECT 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS va, 1.0::DOUBLE AS vb
      UNION ALL
      SELECT step + 1, a + (ga * hbb - gb * hab) / (haa * hbb - hab * hab),
             b + (gb * haa - ga * hab) / (haa * hbb - hab * hab),
             hbb / (haa * hbb - hab * hab), haa / (haa * hbb - hab * hab)
      FROM (SELECT step, a, b, sum(y - p) AS ga, sum((y - p) * x) AS gb, sum(p * (1 - p)) AS haa,
                   sum(p * (1 - p) * x) AS hab, sum(p * (1 - p) * x * x) AS hbb
            FROM (SELECT step, a, b, x, y, 1 / (1 + exp(-a - b * x)) AS p FROM n CROSS JOIN d
                  WHERE step < 25)
            GROUP BY step, a, b))
SELECT '(Intercept)' AS term, round(a, 4) AS estimate, round(sqrt(va), 4) AS std_error FROM n
WHERE step = 25
UNION ALL SELECT 'log_chars', round(b, 4), round(sqrt(vb), 4) FROM n WHERE step = 25
""")
def glm_binomial(spark, folder):
    return rounded(models.glm_binomial(_graded(spark, folder), "quality", ["log_chars"]))


# Both mixed-model oracles write out the equations of the fit: per group C is the inverse of
# Z'WZ / s2 + inverse(D), q(a, b) = a'Cb for columns a = (a0, a1), b of Z'W[X y].
def _q(a, b):
    (a0, a1), (b0, b1) = a, b
    return f"(c00 * {a0} * {b0} + c01 * ({a0} * {b1} + {a1} * {b0}) + c11 * {a1} * {b1})"


_SPREAD = """
  m11 / (m00 * m11 - m01 * m01) AS c00, -m01 / (m00 * m11 - m01 * m01) AS c01,
  m00 / (m00 * m11 - m01 * m01) AS c11"""
_INVERSE_D = """
  sxx_n / s2 + d11 / (d00 * d11 - d01 * d01) AS m00, sxx_x / s2 - d01 / (d00 * d11 - d01 * d01) AS m01,
  sxx_xx / s2 + d00 / (d00 * d11 - d01 * d01) AS m11"""
_SIDES = (("n", "sx"), ("sx", "sxx"), ("sw", "sxw"))
_RIGHT = ("sy", "sxy")
_TWO_TERMS_SQL = f"""
WITH RECURSIVE g AS (
  SELECT label, count(*)::DOUBLE AS n, sum(x) AS sx, sum(w) AS sw, sum(x * x) AS sxx, sum(x * w) AS sxw,
         sum(w * w) AS sww, sum(y) AS sy, sum(x * y) AS sxy, sum(w * y) AS swy, sum(y * y) AS syy
  FROM (SELECT l_partkey AS label, l_quantity / 10 AS x, l_discount * 10 AS w,
               l_extendedprice * (1 - l_discount) / 10000 + (l_partkey % 7) / 3.0::DOUBLE
               + (l_partkey % 5) / 4.0::DOUBLE * l_quantity / 10 AS y FROM lineitem)
  GROUP BY label),
f AS (
  SELECT 0 AS step, 0.0::DOUBLE AS k0, 0.0::DOUBLE AS k1, 0.0::DOUBLE AS k2, 1.0::DOUBLE AS d00,
         0.0::DOUBLE AS d01, 1.0::DOUBLE AS d11, 1.0::DOUBLE AS s2, 0.0::DOUBLE AS e0,
         0.0::DOUBLE AS e1, 0.0::DOUBLE AS e2
  UNION ALL
  SELECT step + 1, max(k0), max(k1), max(k2), avg(r0 * r0 + c00), avg(r0 * r1 + c01),
         avg(r1 * r1 + c11),
         sum(syy - 2 * (k0 * sy + k1 * sxy + k2 * swy) + k0 * k0 * n + k1 * k1 * sxx + k2 * k2 * sww
             + 2 * (k0 * k1 * sx + k0 * k2 * sw + k1 * k2 * sxw) - 2 * (r0 * u0 + r1 * u1)
             + n * r0 * r0 + 2 * sx * r0 * r1 + sxx * r1 * r1 + n * c00 + 2 * sx * c01 + sxx * c11)
         / sum(n), max(v0), max(v1), max(v2)
  FROM (SELECT *, (c00 * u0 + c01 * u1) / s2 AS r0, (c01 * u0 + c11 * u1) / s2 AS r1 FROM (
    SELECT *, sy - n * k0 - sx * k1 - sw * k2 AS u0, sxy - sx * k0 - sxx * k1 - sxw * k2 AS u1 FROM (
      SELECT *, (i00 * h0 + i01 * h1 + i02 * h2) / det AS k0, (i01 * h0 + i11 * h1 + i12 * h2) / det AS k1,
             (i02 * h0 + i12 * h1 + i22 * h2) / det AS k2, sqrt(i00 / det) AS v0, sqrt(i11 / det) AS v1,
             sqrt(i22 / det) AS v2 FROM (
        SELECT *, a00 * i00 + a01 * i01 + a02 * i02 AS det FROM (
          SELECT *, a11 * a22 - a12 * a12 AS i00, a02 * a12 - a01 * a22 AS i01, a01 * a12 - a02 * a11 AS i02,
                 a00 * a22 - a02 * a02 AS i11, a01 * a02 - a00 * a12 AS i12, a00 * a11 - a01 * a01 AS i22
          FROM (
            SELECT *, 0.01 + sum(n / s2 - {_q(_SIDES[0], _SIDES[0])} / s2 / s2) OVER () AS a00,
                   sum(sx / s2 - {_q(_SIDES[0], _SIDES[1])} / s2 / s2) OVER () AS a01,
                   sum(sw / s2 - {_q(_SIDES[0], _SIDES[2])} / s2 / s2) OVER () AS a02,
                   0.01 + sum(sxx / s2 - {_q(_SIDES[1], _SIDES[1])} / s2 / s2) OVER () AS a11,
                   sum(sxw / s2 - {_q(_SIDES[1], _SIDES[2])} / s2 / s2) OVER () AS a12,
                   0.01 + sum(sww / s2 - {_q(_SIDES[2], _SIDES[2])} / s2 / s2) OVER () AS a22,
                   sum(sy / s2 - {_q(_SIDES[0], _RIGHT)} / s2 / s2) OVER () AS h0,
                   sum(sxy / s2 - {_q(_SIDES[1], _RIGHT)} / s2 / s2) OVER () AS h1,
                   sum(swy / s2 - {_q(_SIDES[2], _RIGHT)} / s2 / s2) OVER () AS h2
            FROM (SELECT *, {_SPREAD} FROM (
              SELECT *, {_INVERSE_D.replace('sxx_n', 'n').replace('sxx_xx', 'sxx').replace('sxx_x', 'sx')}
              FROM (SELECT g.*, f.step, f.d00, f.d01, f.d11, f.s2 FROM f CROSS JOIN g WHERE step < 1000)
            ))))))))
  GROUP BY step),
done AS (SELECT * FROM f WHERE step = 1000)
"""


@CATALOG.add(_TWO_TERMS_SQL + """
SELECT '(Intercept)' AS term, round(k0, 3) AS estimate, round(e0, 3) AS std_error FROM done
UNION ALL SELECT 'amount', round(k1, 3), round(e1, 3) FROM done
UNION ALL SELECT 'discount', round(k2, 3), round(e2, 3) FROM done
""")
def lmm_fixed_effects(spark, folder):
    fit = models.lmm_fit(
        _prices(spark, folder), "price", ["amount", "discount"], "l_partkey", "amount", tolerance=1e-7
    )
    return rounded(fit.coefficients().select("term", "estimate", "std_error"), 3)


@CATALOG.add(_TWO_TERMS_SQL + f"""
SELECT label AS l_partkey, round((c00 * u0 + c01 * u1) / s2, 2) AS b_intercept,
       round((c01 * u0 + c11 * u1) / s2, 2) AS b_slope
FROM (SELECT *, {_SPREAD}, sy - n * k0 - sx * k1 - sw * k2 AS u0, sxy - sx * k0 - sxx * k1 - sxw * k2 AS u1
      FROM (SELECT *, {_INVERSE_D.replace('sxx_n', 'n').replace('sxx_xx', 'sxx').replace('sxx_x', 'sx')}
            FROM done CROSS JOIN g))
""")
def lmm_random_effects(spark, folder):
    fit = models.lmm_fit(
        _prices(spark, folder), "price", ["amount", "discount"], "l_partkey", "amount", tolerance=1e-10
    )
    return rounded(fit.random_effects(), 2)


def _prices(spark, folder):
    """Discounted prices with a level and a slope of its own per part."""
    part = F.col("l_partkey")
    level, slope = (part % 7) / F.lit(3.0), (part % 5) / F.lit(4.0)
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) / 10000
    price = price + level + slope * F.col("l_quantity") / 10
    return table(spark, folder, "lineitem").select(
        "l_partkey",
        price.alias("price"),
        (F.col("l_quantity") / 10).alias("amount"),
        (F.col("l_discount") * 10).alias("discount"),
    )


_GLMM_SQL = f"""
WITH RECURSIVE c AS (
  SELECT l_suppkey AS label, l_discount * 10 AS x, count(*)::DOUBLE AS n,
         count_if(l_quantity + 3 * (l_suppkey % 7) + (l_suppkey % 5) * l_discount * 40 > 40)::DOUBLE AS h
  FROM lineitem GROUP BY ALL),
f AS (
  SELECT 0 AS step, label, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS k0, 0.0::DOUBLE AS k1,
         1.0::DOUBLE AS d00, 0.0::DOUBLE AS d01, 1.0::DOUBLE AS d11, 0.0::DOUBLE AS e0, 0.0::DOUBLE AS e1
  FROM (SELECT DISTINCT label FROM c)
  UNION ALL
  SELECT step + 1, label, r0, r1, k0, k1, avg(r0 * r0 + c00) OVER (), avg(r0 * r1 + c01) OVER (),
         avg(r1 * r1 + c11) OVER (), v0, v1
  FROM (SELECT *, c00 * u0 + c01 * u1 AS r0, c01 * u0 + c11 * u1 AS r1 FROM (
    SELECT *, sy - n * k0 - sx * k1 AS u0, sxy - sx * k0 - sxx * k1 AS u1 FROM (
      SELECT *, (h0 * a11 - h1 * a01) / det AS k0, (h1 * a00 - h0 * a01) / det AS k1,
             sqrt(a11 / det) AS v0, sqrt(a00 / det) AS v1 FROM (
        SELECT *, a00 * a11 - a01 * a01 AS det FROM (
          SELECT * EXCLUDE (k0, k1),
                 2 / (6.25 + k0 * k0) + sum(n - {_q(("n", "sx"), ("n", "sx"))}) OVER () AS a00,
                 sum(sx - {_q(("n", "sx"), ("sx", "sxx"))}) OVER () AS a01,
                 2 / (6.25 + k1 * k1) + sum(sxx - {_q(("sx", "sxx"), ("sx", "sxx"))}) OVER () AS a11,
                 sum(sy - {_q(("n", "sx"), _RIGHT)}) OVER () AS h0,
                 sum(sxy - {_q(("sx", "sxx"), _RIGHT)}) OVER () AS h1
          FROM (SELECT *, {_SPREAD} FROM (
            SELECT *, n + d11 / (d00 * d11 - d01 * d01) AS m00, sx - d01 / (d00 * d11 - d01 * d01) AS m01,
                   sxx + d00 / (d00 * d11 - d01 * d01) AS m11
            FROM (SELECT step, label, k0, k1, d00, d01, d11, sum(w) AS n, sum(w * x) AS sx,
                         sum(w * x * x) AS sxx, sum(w * z) AS sy, sum(w * x * z) AS sxy
                  FROM (SELECT *, eta + (h - n * mu) / w AS z FROM (
                    SELECT *, n * mu * (1 - mu) AS w FROM (
                      SELECT *, 1 / (1 + exp(-eta)) AS mu FROM (
                        SELECT f.*, x, n, h, least(greatest(k0 + k1 * x + b0 + b1 * x, -15), 15) AS eta
                        FROM f JOIN c USING (label) WHERE step < 200))))
                  GROUP BY step, label, k0, k1, d00, d01, d11)))))))))
"""


@CATALOG.add(_GLMM_SQL + """
SELECT '(Intercept)' AS term, round(max(k0), 3) AS estimate, round(max(e0), 3) AS std_error FROM f
WHERE step = 200
UNION ALL SELECT 'discount', round(max(k1), 3), round(max(e1), 3) FROM f WHERE step = 200
""")
def glmm_binomial(spark, folder):
    # each supplier has a level and a slope of its own
    supplier, discount = F.col("l_suppkey"), F.col("l_discount")
    reached = F.col("l_quantity") + 3 * (supplier % 7) + (supplier % 5) * discount * 40
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", (discount * 10).alias("discount"), (reached > 40).cast("int").alias("hit")
    )
    fit = models.glmm_fit(lines, "hit", ["discount"], "l_suppkey", "discount", tolerance=1e-6)
    return rounded(fit.coefficients().select("term", "estimate", "std_error"), 3)


def _lmm_rounds(fit: str, steps: int = 200) -> str:
    """The equations of a Gaussian fit for every value of ``fit``, iterated ``steps`` times."""
    return f"""
WITH RECURSIVE g AS (
  SELECT fit, label, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy,
         sum(x * y) AS sxy, sum(y * y) AS syy
  FROM (SELECT {fit} AS fit, l_suppkey AS label, l_discount * 10 AS x,
               l_quantity / 10 + (l_suppkey % 7) / 3.0::DOUBLE
               + (l_suppkey % 5) / 4.0::DOUBLE * l_discount * 10 AS y FROM lineitem)
  GROUP BY fit, label),
f AS (
  SELECT DISTINCT 0 AS step, fit, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.1::DOUBLE AS d00, 0.0::DOUBLE AS d01,
         0.1::DOUBLE AS d11, 0.1::DOUBLE AS s2, 0.0::DOUBLE AS e0, 0.0::DOUBLE AS e1 FROM g
  UNION ALL
  SELECT step + 1, fit, max(k0), max(k1), avg(r0 * r0 + c00), avg(r0 * r1 + c01), avg(r1 * r1 + c11),
         sum(syy - 2 * (k0 * sy + k1 * sxy) + k0 * k0 * n + 2 * k0 * k1 * sx + k1 * k1 * sxx
             - 2 * (r0 * u0 + r1 * u1) + n * r0 * r0 + 2 * sx * r0 * r1 + sxx * r1 * r1
             + n * c00 + 2 * sx * c01 + sxx * c11) / sum(n), max(v0), max(v1)
  FROM (
    SELECT *, (c00 * u0 + c01 * u1) / s2 AS r0, (c01 * u0 + c11 * u1) / s2 AS r1 FROM (
      SELECT *, sy - n * k0 - sx * k1 AS u0, sxy - sx * k0 - sxx * k1 AS u1 FROM (
        SELECT *, (h0 * a11 - h1 * a01) / det AS k0, (h1 * a00 - h0 * a01) / det AS k1,
               sqrt(a11 / det) AS v0, sqrt(a00 / det) AS v1 FROM (
          SELECT *, a00 * a11 - a01 * a01 AS det FROM (
            SELECT *, 0.01 + sum((n - p00 * n - p01 * sx) / s2) OVER (PARTITION BY fit) AS a00,
                   sum((sx - p00 * sx - p01 * sxx) / s2) OVER (PARTITION BY fit) AS a01,
                   0.01 + sum((sxx - p10 * sx - p11 * sxx) / s2) OVER (PARTITION BY fit) AS a11,
                   sum((sy - p00 * sy - p01 * sxy) / s2) OVER (PARTITION BY fit) AS h0,
                   sum((sxy - p10 * sy - p11 * sxy) / s2) OVER (PARTITION BY fit) AS h1 FROM (
              SELECT *, (n * c00 + sx * c01) / s2 AS p00, (n * c01 + sx * c11) / s2 AS p01,
                     (sx * c00 + sxx * c01) / s2 AS p10, (sx * c01 + sxx * c11) / s2 AS p11 FROM (
                SELECT *, m11 / (m00 * m11 - m01 * m01) AS c00,
                       -m01 / (m00 * m11 - m01 * m01) AS c01,
                       m00 / (m00 * m11 - m01 * m01) AS c11 FROM (
                  SELECT g.*, f.step, f.s2, n / s2 + d11 / (d00 * d11 - d01 * d01) AS m00,
                         sx / s2 - d01 / (d00 * d11 - d01 * d01) AS m01,
                         sxx / s2 + d00 / (d00 * d11 - d01 * d01) AS m11
                  FROM f JOIN g ON f.fit = g.fit WHERE step < {steps})))))))) GROUP BY step, fit)
"""


_LMM_SQL = _lmm_rounds("'all'") + """
SELECT '(Intercept)' AS term, round(b0, 4) AS estimate, round(e0, 4) AS std_error FROM f
WHERE step = 200
UNION ALL SELECT 'x', round(b1, 4), round(e1, 4) FROM f WHERE step = 200
UNION ALL SELECT 'residual variance', round(s2, 4), NULL FROM f WHERE step = 200
UNION ALL SELECT 'intercept variance', round(d00, 4), NULL FROM f WHERE step = 200
"""


@CATALOG.add(_LMM_SQL)
def lmm_slope_model(spark, folder):
    # an outcome with a level and a slope of its own per supplier
    supplier, discount = F.col("l_suppkey"), F.col("l_discount")
    level, slope = (supplier % 7) / F.lit(3.0), (supplier % 5) / F.lit(4.0)
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey",
        (discount * 10).alias("x"),
        (F.col("l_quantity") / 10 + level + slope * discount * 10).alias("y"),
    )
    fit = models.lmm_fit(lines, "y", ["x"], "l_suppkey", "x", tolerance=1e-7)
    spread = spark.createDataFrame(
        [("residual variance", float(fit.sigma2)), ("intercept variance", float(fit.covariance[0, 0]))],
        "term string, estimate double",
    )
    found = fit.coefficients().unionByName(spread, allowMissingColumns=True)
    return rounded(found.select("term", "estimate", "std_error"))


# Newton steps on the marginal likelihood of a random-intercept model, whose integral over the
# supplier's effect is a sum over a fine grid of u; the information is that of Louis.
_QUADRATURE_SQL = """
WITH RECURSIVE c AS (
  SELECT l_suppkey AS label, l_discount * 10 AS x, count(*)::DOUBLE AS n,
         count_if(l_quantity + 3 * (l_suppkey % 7) + l_discount * 40 > 40)::DOUBLE AS h
  FROM lineitem GROUP BY ALL),
node AS (SELECT (i - 200) / 25.0::DOUBLE AS u FROM range(401) r(i)),
f AS (
  SELECT 0 AS step, 0.0::DOUBLE AS k0, 0.0::DOUBLE AS k1, 0.7::DOUBLE AS l, 0.0::DOUBLE AS e0, 0.0::DOUBLE AS e1
  UNION ALL
  SELECT step + 1, k0 + d0 / far, k1 + d1 / far, l + d2 / far, sqrt(i00 / det), sqrt(i11 / det)
  FROM (SELECT *, greatest(1, 5 * abs(d0), 5 * abs(d1), 5 * abs(d2)) AS far FROM (
   SELECT *, (i00 * g0 + i01 * g1 + i02 * g2) / det AS d0, (i01 * g0 + i11 * g1 + i12 * g2) / det AS d1,
          (i02 * g0 + i12 * g1 + i22 * g2) / det AS d2 FROM (
   SELECT *, a00 * i00 + a01 * i01 + a02 * i02 AS det FROM (
    SELECT *, a11 * a22 - a12 * a12 AS i00, a02 * a12 - a01 * a22 AS i01, a01 * a12 - a02 * a11 AS i02,
           a00 * a22 - a02 * a02 AS i11, a01 * a02 - a00 * a12 AS i12, a00 * a11 - a01 * a01 AS i22 FROM (
      SELECT step, k0, k1, l, sum(m0) - 2 * k0 / (6.25 + k0 * k0) AS g0,
             sum(m1) - 2 * k1 / (6.25 + k1 * k1) AS g1, sum(m2) AS g2,
             sum(c00 - v00 + m0 * m0) + 2 * (6.25 - k0 * k0) / (6.25 + k0 * k0) ** 2 AS a00,
             sum(c01 - v01 + m0 * m1) AS a01, sum(c02 - v02 + m0 * m2) AS a02,
             sum(c11 - v11 + m1 * m1) + 2 * (6.25 - k1 * k1) / (6.25 + k1 * k1) ** 2 AS a11,
             sum(c12 - v12 + m1 * m2) AS a12, sum(c22 - v22 + m2 * m2) AS a22 FROM (
        SELECT step, k0, k1, l, label, sum(q * s0) AS m0, sum(q * s1) AS m1, sum(q * s0 * u) AS m2,
               sum(q * s0 * s0) AS v00, sum(q * s0 * s1) AS v01, sum(q * s0 * s0 * u) AS v02,
               sum(q * s1 * s1) AS v11, sum(q * s1 * s0 * u) AS v12, sum(q * s0 * s0 * u * u) AS v22,
               sum(q * b00) AS c00, sum(q * b01) AS c01, sum(q * b00 * u) AS c02, sum(q * b11) AS c11,
               sum(q * b01 * u) AS c12, sum(q * b00 * u * u) AS c22 FROM (
          SELECT *, w / sum(w) OVER (PARTITION BY label) AS q FROM (
            SELECT *, exp(ll - max(ll) OVER (PARTITION BY label)) AS w FROM (
              SELECT step, k0, k1, l, label, u, sum(h * eta - n * (greatest(eta, 0) + ln(1 + exp(-abs(eta)))))
                       - u * u / 2 AS ll,
                     sum(h - n * p) AS s0, sum((h - n * p) * x) AS s1, sum(n * p * (1 - p)) AS b00,
                     sum(n * p * (1 - p) * x) AS b01, sum(n * p * (1 - p) * x * x) AS b11 FROM (
                SELECT *, 1 / (1 + exp(-eta)) AS p FROM (
                  SELECT f.*, c.*, u, k0 + k1 * x + l * u AS eta FROM f CROSS JOIN c CROSS JOIN node WHERE step < 40))
              GROUP BY step, k0, k1, l, label, u)))
        GROUP BY step, k0, k1, l, label)
      GROUP BY step, k0, k1, l))))))
SELECT '(Intercept)' AS term, round(k0, 3) AS estimate, round(e0, 3) AS std_error FROM f WHERE step = 40
UNION ALL SELECT 'discount', round(k1, 3), round(e1, 3) FROM f WHERE step = 40
UNION ALL SELECT 'variance', round(l * l, 3), NULL FROM f WHERE step = 40
"""


@CATALOG.add(_QUADRATURE_SQL)
def glmm_quadrature(spark, folder):
    """Marginal likelihood fit of a binary outcome with a level of its own per supplier."""
    supplier, discount = F.col("l_suppkey"), F.col("l_discount")
    reached = F.col("l_quantity") + 3 * (supplier % 7) + discount * 40
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", (discount * 10).alias("discount"), (reached > 40).cast("int").alias("hit")
    )
    fit = quadrature.glmm_quadrature(lines, "hit", ["discount"], "l_suppkey")
    rows = [(t, float(b), float(s)) for t, b, s in zip(fit.terms, fit.beta, fit.std_error, strict=True)]
    rows.append(("variance", float(fit.covariance[0, 0]), None))
    return rounded(spark.createDataFrame(rows, "term string, estimate double, std_error double"), 3)


_FLAGS = ("A", "N", "R")


@CATALOG.add(_lmm_rounds("l_returnflag", 2000) + """
SELECT fit, '(Intercept)' AS term, round(b0, 3) AS estimate, round(e0, 3) AS std_error FROM f WHERE step = 2000
UNION ALL SELECT fit, 'x', round(b1, 3), round(e1, 3) FROM f WHERE step = 2000
""")
def fit_grid(spark, folder):
    """One mixed model per return flag, all of them from the same jobs."""
    supplier, discount = F.col("l_suppkey"), F.col("l_discount")
    level, slope = (supplier % 7) / F.lit(3.0), (supplier % 5) / F.lit(4.0)
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", F.col("l_returnflag").alias("fit"), (discount * 10).alias("x"),
        (F.col("l_quantity") / 10 + level + slope * discount * 10).alias("y"),
    )
    fits = fit_formulas(lines, "y ~ x + (1 + x | l_suppkey)", "fit", tolerance=1e-8)
    found = quadrature.grid_table(spark, fits, "fit", lines.schema["fit"].dataType)
    return rounded(found.select("fit", "term", "estimate", "std_error"), 3)


@CATALOG.add("""
WITH d AS (SELECT l_linestatus, l_extendedprice AS y, l_quantity AS x, (l_returnflag = 'N')::INT AS n,
                  (l_returnflag = 'R')::INT AS r FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')),
one AS (SELECT l_linestatus, n, r, count(*) AS c, avg(x) AS mx, avg(y) AS my,
               regr_slope(y, x) AS b FROM d GROUP BY ALL),
base AS (SELECT * FROM one WHERE n = 0 AND r = 0)
SELECT o.l_linestatus, CASE WHEN o.n = 1 THEN 'l_returnflag[N]:l_quantity'
                            WHEN o.r = 1 THEN 'l_returnflag[R]:l_quantity' ELSE 'l_quantity' END AS term,
       round(CASE WHEN o.n + o.r = 0 THEN o.b ELSE o.b - base.b END, 3) AS estimate
FROM one o JOIN base ON o.l_linestatus = base.l_linestatus
UNION ALL
SELECT o.l_linestatus, CASE WHEN o.n = 1 THEN 'l_returnflag[N]' WHEN o.r = 1 THEN 'l_returnflag[R]'
                            ELSE '(Intercept)' END,
       round(CASE WHEN o.n + o.r = 0 THEN o.my - o.b * o.mx
                  ELSE o.my - o.b * o.mx - (base.my - base.b * base.mx) END, 3)
FROM one o JOIN base ON o.l_linestatus = base.l_linestatus
""")
def factor_terms(spark, folder):
    """A formula with a factor and its product: every level has a line of its own."""
    lines = table(spark, folder, "lineitem")
    formula = parse_formula("l_extendedprice ~ l_returnflag * l_quantity")
    rows, model = with_factors(lines, formula, {"l_returnflag": _FLAGS})
    fitted = models.ols_by_group(rows, ["l_linestatus"], model.outcome, model.terms)
    return rounded(fitted.select("l_linestatus", "term", "estimate").dropna(), 3)
