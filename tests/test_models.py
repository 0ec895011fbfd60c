import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import models, pca
from cohortspark.operators.models import INTERCEPT


def coefficients(df, *by):
    return {(*[r[b] for b in by], r.term): (r.estimate, r.std_error) for r in df.collect()}


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in ("a", "b"):
        x, w = rng.normal(5, 2, 80), rng.normal(size=80)
        y = 1 + 2 * x - w + 0.5 * x * w + rng.normal(size=80)
        rows += [(g, *map(float, t)) for t in zip(x, w, y)]
    pdf = pd.DataFrame(rows, columns=["g", "x", "w", "y"])
    df = spark.createDataFrame(pdf).unionByName(
        spark.createDataFrame([("a", None, 1.0, 1.0), ("b", 1.0, 1.0, float("nan"))], "g string, x double, w double, y double")
    )
    got = coefficients(models.ols_by_group(df, ["g"], "y", ["x", "w", "x:w"]), "g")
    for g, part in pdf.groupby("g"):
        X = np.column_stack([np.ones(80), part.x, part.w, part.x * part.w])
        beta, *_ = np.linalg.lstsq(X, part.y, rcond=None)
        rest = part.y - X @ beta
        error = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * (rest @ rest) / 76)
        for t, b, e in zip([INTERCEPT, "x", "w", "x:w"], beta, error):
            assert got[g, t] == (pytest.approx(b), pytest.approx(e))


def test_ols_too_few_rows_has_no_error(frame):
    df = frame("g int, x double, y double", (1, 1.0, 1.0), (1, 2.0, 3.0))
    got = coefficients(models.ols_by_group(df, ["g"], "y", ["x"]), "g")
    assert got[1, "x"] == (pytest.approx(2.0), None)


def simulate(spark, seed, people, binary):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(people):
        n = 60 if binary else int(rng.integers(5, 40))
        b = rng.multivariate_normal([0, 0], [[0.5, 0.1], [0.1, 0.3]])
        x = rng.integers(0, 6, n) / 5.0
        w = rng.normal(size=n)
        mean = 0.5 + 2 * x - w + b[0] + b[1] * x
        y = rng.random(n) < 1 / (1 + np.exp(-mean)) if binary else mean + rng.normal(size=n) * math.sqrt(0.4)
        rows += [(f"s{g}", *map(float, t)) for t in zip(x, w, y)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["s", "x", "w", "y"]))


def marginal(fit, pdf, prior):
    """Negative log posterior of a Gaussian fit, straight from the definition."""
    total = 0.5 * prior * fit.beta @ fit.beta
    for _, p in pdf.groupby("s"):
        X = np.column_stack([np.ones(len(p)), p.x, p.w])
        Z = X[:, :2]
        V = fit.sigma2 * np.eye(len(p)) + Z @ fit.covariance @ Z.T
        r = p.y.to_numpy() - X @ fit.beta
        total += 0.5 * (np.linalg.slogdet(V)[1] + r @ np.linalg.solve(V, r))
    return total


def test_lmm_recovers_and_is_a_maximum(spark):
    df = simulate(spark, 3, 250, binary=False)
    fit = models.lmm_fit(df, "y", ["x", "w"], "s", "x")
    assert fit.converged and fit.iterations < 40
    assert fit.beta == pytest.approx([0.5, 2.0, -1.0], abs=0.15)
    assert fit.covariance == pytest.approx(np.array([[0.5, 0.1], [0.1, 0.3]]), abs=0.15)
    assert fit.sigma2 == pytest.approx(0.4, abs=0.05)
    pdf = df.toPandas()
    best = marginal(fit, pdf, 1 / 100)
    from dataclasses import replace

    for change in (
        {"beta": fit.beta + [0.05, 0, 0]}, {"beta": fit.beta - [0, 0.05, 0]}, {"sigma2": fit.sigma2 * 1.05},
        {"sigma2": fit.sigma2 / 1.05}, {"covariance": fit.covariance * 1.1}, {"covariance": fit.covariance * 0.9},
    ):
        assert marginal(replace(fit, **change), pdf, 1 / 100) > best
    effects = {r.s: (r.b_intercept, r.b_slope) for r in fit.random_effects().collect()}
    assert len(effects) == 250
    for name in ("s0", "s100"):
        p = pdf[pdf.s == name]
        X = np.column_stack([np.ones(len(p)), p.x, p.w])
        Z = X[:, :2]
        V = fit.sigma2 * np.eye(len(p)) + Z @ fit.covariance @ Z.T
        b = fit.covariance @ Z.T @ np.linalg.solve(V, p.y.to_numpy() - X @ fit.beta)
        assert effects[name] == pytest.approx(tuple(b), abs=1e-6)


def test_lmm_result_does_not_depend_on_partitioning(spark):
    df = simulate(spark, 4, 40, binary=False)
    a = models.lmm_fit(df, "y", ["x"], "s", "x", max_iterations=5)
    b = models.lmm_fit(df.orderBy(F.rand(1)).repartition(13), "y", ["x"], "s", "x", max_iterations=5)
    assert a.beta == pytest.approx(b.beta, abs=1e-8) and a.sigma2 == pytest.approx(b.sigma2, abs=1e-8)


def test_glmm_recovers(spark):
    df = simulate(spark, 5, 200, binary=True)
    fit = models.glmm_fit(df, "y", ["x", "w"], "s", "x")
    assert fit.converged
    # quasi-likelihood estimates are pulled slightly towards zero
    assert fit.beta == pytest.approx([0.5, 2.0, -1.0], abs=0.3)
    assert 0.2 < fit.covariance[0, 0] < 0.8 and 0 <= fit.covariance[1, 1] < 0.8


def test_glm_matches_newton(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + x)))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    got = coefficients(models.glm_binomial(df, "y", ["x"]))
    X, beta = np.column_stack([np.ones(400), x]), np.zeros(2)
    for _ in range(20):
        mu = 1 / (1 + np.exp(-X @ beta))
        info = X.T @ (X * (mu * (1 - mu))[:, None])
        beta = beta + np.linalg.solve(info, X.T @ (y - mu))
    error = np.sqrt(np.diag(np.linalg.inv(info)))
    for i, t in enumerate([INTERCEPT, "x"]):
        assert got[(t,)] == (pytest.approx(beta[i], rel=1e-4), pytest.approx(error[i], rel=1e-3))


def test_model_frame_and_lookup(frame, values):
    trials = frame("subj_num string, emo_block string, resp_type string, resp double",
                   ("a", "0 to +", "cat", 1.0), ("a", "0 to +", "cat", None), ("b", "0 to +", "cat", 0.0),
                   ("a", "0 to -", "cat", 1.0), ("a", "0 to +", "cont", 1.0))
    scores = frame("subj_num string, PC1 double, PC2 double, PC3 double", ("a", 0.1, 0.2, 0.3))
    out = models.model_frame(trials, scores, "0 to +", "cat")
    assert values(out, "subj_num", "resp", "PC1", "PC2") == [("a", 1.0, 0.1, 0.2), ("b", 0.0, None, None)]
    stored = frame("emo_block string, resp_type string, term string", ("0 to +", "cat", "x"), ("0 to -", "cat", "x"))
    assert models.model_lookup(stored, emo_block="0 to -", resp_type="cat").count() == 1


def test_subject_slopes(frame):
    df = frame("s int, x double, y double", (1, 0.0, 1.0), (1, 1.0, 3.0), (2, 1.0, 1.0), (2, 1.0, 2.0))
    got = {r.s: (r.slope, r.intercept) for r in models.subject_slopes(df, ["s"], "y", "x").collect()}
    assert got == {1: (2.0, 1.0), 2: (None, None)}


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    names = list("abcde")
    df = spark.createDataFrame(pd.DataFrame(base, columns=names).assign(id=range(300)))
    fit = pca.fit_pca(df, names)
    z = (base - base.mean(0)) / base.std(0, ddof=1)
    singular = np.linalg.svd(z, compute_uv=False) / math.sqrt(299)
    assert fit.sdev == pytest.approx(singular, abs=1e-9)
    largest = np.abs(fit.rotation).argmax(axis=0)
    assert (fit.rotation[largest, range(5)] > 0).all()
    scores = pca.pca_scores(df, fit, ["id"]).orderBy("id").toPandas().drop(columns="id").to_numpy()
    assert scores == pytest.approx(z @ fit.rotation / fit.sdev, abs=1e-8)
    assert np.cov(scores.T) == pytest.approx(np.eye(5), abs=1e-8)
    assert fit.loadings(df).count() == 25
    assert sum(r.proportion for r in fit.variance(df).collect()) == pytest.approx(1.0)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_pca_keeps_a_component_that_products_would_lose(spark, partitions):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(200, 3))
    base[:, 2] = base[:, 0] + 1e-9 * rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame(base, columns=list("abc")).assign(id=range(200))).repartition(partitions)
    fit = pca.fit_pca(df, list("abc"))
    z = (base - base.mean(0)) / base.std(0, ddof=1)
    small = np.linalg.svd(z, compute_uv=False)[-1] / math.sqrt(199)
    assert 1e-10 < small < 1e-8 and fit.sdev[-1] == pytest.approx(small, rel=1e-4)
    by_products = np.sqrt(np.clip(np.linalg.eigvalsh(z.T @ z / 199)[0], 0, None))
    assert abs(by_products - small) > 0.5 * small
    assert pca.pca_scores(df, fit, ["id"]).agg(F.stddev_samp("PC3")).first()[0] == pytest.approx(1, rel=1e-3)


def test_pca_of_fewer_rows_than_columns(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(3, 5)), columns=list("abcde")).assign(id=range(3)))
    fit = pca.fit_pca(df, list("abcde"))
    assert (fit.sdev[2:] < 1e-12).all() and fit.rotation.T @ fit.rotation == pytest.approx(np.eye(5), abs=1e-9)
    assert pca.pca_scores(df, fit, ["id"]).filter("PC3 is not null or PC5 is not null").count() == 0


def test_pca_rejects_flat_columns(frame):
    with pytest.raises(ValueError, match="b"):
        pca.fit_pca(frame("a double, b double", (1.0, 1.0), (2.0, 1.0)), ["a", "b"])


def test_pca_input(frame, values):
    scores = frame("subj_num string, expt_type string, x double, y double",
                   ("a", "e", 1.0, 2.0), ("a", "e", 1.0, 2.0), ("b", "e", 1.0, None), ("c", "e", 1.0, 1.0),
                   ("d", "e", float("nan"), 1.0))
    flags = "enough_trials_seen boolean, enough_resps boolean, not_too_fast boolean, slider_not_lazy boolean, age_valid boolean"
    profile = frame(f"subj_num string, {flags}", *[(s, True, True, True, True, s != "c") for s in "abcd"])
    assert values(pca.pca_input(scores, profile, ["x", "y"])) == [("a", "e", 1.0, 2.0)]


def test_a_fit_at_its_limit_says_so(spark):
    rng = np.random.default_rng(3)
    rows = [(s, float(x), float(s % 4 + x * (1 + s % 3) + rng.normal())) for s in range(20) for x in range(6)]
    df = spark.createDataFrame(rows, "s int, x double, y double")
    cut = models.lmm_fit(df, "y", ["x"], "s", "x", max_iterations=2)
    assert not cut.converged
    assert {(r.converged, r.iterations) for r in cut.coefficients().collect()} == {(False, 2)}
    assert models.lmm_fit(df, "y", ["x"], "s", "x").coefficients().first().converged


def test_aliased_terms_have_no_estimate(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=40)
    pdf = pd.DataFrame({"g": 1, "x": x, "z": 2 * x, "y": x + rng.normal(size=40)})
    full = {r.term: r for r in models.ols_by_group(spark.createDataFrame(pdf), ["g"], "y", ["x", "z"]).collect()}
    alone = {r.term: r for r in models.ols_by_group(spark.createDataFrame(pdf), ["g"], "y", ["x"]).collect()}
    assert full["z"].estimate is None and full["z"].std_error is None
    for term in ("(Intercept)", "x"):
        assert full[term].estimate == pytest.approx(alone[term].estimate)
        assert full[term].std_error == pytest.approx(alone[term].std_error)
