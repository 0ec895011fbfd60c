import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import grids, models, quadrature
from cohortspark.operators.formulas import Formula, parse_formula, with_factors


def simulate(seed, people, trials, beta, root, fit=0):
    """Binary trials with a random intercept and slope per participant."""
    rng = np.random.default_rng(seed)
    effects = rng.normal(size=(people, len(root))) @ np.array(root).T
    rows = []
    for s in range(people):
        x = rng.choice(np.linspace(-1, 1, 5), trials)
        eta = beta[0] + beta[1] * x + effects[s, 0] + (effects[s, 1] * x if len(root) > 1 else 0)
        y = (rng.random(trials) < 1 / (1 + np.exp(-eta))).astype(int)
        rows += [(fit, f"s{s}", float(a), int(b)) for a, b in zip(x, y)]
    return pd.DataFrame(rows, columns=["fit", "s", "x", "y"])


def dense_likelihood(pdf, beta, covariance, step=0.04, reach=6):
    """Marginal log-likelihood by a fine rectangle rule over the random effects."""
    root = np.linalg.cholesky(covariance)
    axis = np.arange(-reach, reach + step, step)
    u = np.stack(np.meshgrid(*[axis] * len(root), indexing="ij"), axis=-1).reshape(-1, len(root))
    b = u @ root.T
    total = 0.0
    for _, p in pdf.groupby("s"):
        z = np.column_stack([np.ones(len(p)), p.x])[:, : len(root)]
        eta = beta[0] + beta[1] * p.x.to_numpy()[:, None] + z @ b.T
        level = (p.y.to_numpy()[:, None] * eta - np.logaddexp(0, eta)).sum(axis=0) - (u**2).sum(axis=1) / 2
        top = level.max()
        total += top + np.log(np.exp(level - top).sum()) + len(root) * np.log(step / np.sqrt(2 * np.pi))
    return total


def test_fit_is_the_maximum_of_the_marginal_likelihood(spark):
    pdf = simulate(1, 25, 12, [0.4, 1.0], [[1.0, 0], [0.3, 0.6]])
    df = spark.createDataFrame(pdf).repartition(3)
    fit = quadrature.glmm_quadrature(df, "y", ["x"], "s", "x", prior_scale=None, each=15)
    assert fit.converged and np.abs(fit.score).max() < 1e-4
    best = dense_likelihood(pdf, fit.beta, fit.covariance)
    assert fit.log_likelihood == pytest.approx(best, abs=1e-3)
    for change in ([0.1, 0], [-0.1, 0], [0, 0.1], [0, -0.1]):
        assert dense_likelihood(pdf, fit.beta + change, fit.covariance) < best
    for scale in (0.8, 1.25):
        assert dense_likelihood(pdf, fit.beta, fit.covariance * scale) < best


def test_gradient_and_information_are_those_of_the_likelihood():
    pdf = simulate(2, 8, 20, [0.2, -0.8], [[0.9, 0], [-0.2, 0.5]])
    table = pdf.groupby("s").agg(x=("x", list), hits=("y", list)).assign(trials=lambda d: d.hits.map(lambda h: [1] * len(h)))
    (cells,) = quadrature.cells_of(table, 1)
    theta = np.array([0.1, -0.5, 0.8, 0.1, 0.6])
    at = lambda t: quadrature.marginal_sums(cells, t, [0, 1], 25)
    found, small = at(theta), 1e-5
    for n in range(5):
        step = np.zeros(5)
        step[n] = small
        up, down = at(theta + step), at(theta - step)
        assert (up["value"] - down["value"])[0] / 2 / small == pytest.approx(found["score"][n], abs=1e-4)
        slope = (up["score"] - down["score"]) / 2 / small
        assert -slope == pytest.approx(found["information"].reshape(5, 5)[n], abs=1e-3)


def test_nearer_the_true_values_than_quasi_likelihood(spark):
    truth, root = [0.5, 1.5], [[1.4, 0], [0.0, 1.0]]
    pdf = simulate(3, 1500, 10, truth, root)
    df = spark.createDataFrame(pdf).drop("fit")
    exact = quadrature.glmm_quadrature(df, "y", ["x"], "s", "x")
    quasi = models.glmm_fit(df, "y", ["x"], "s", "x")
    assert exact.converged
    for mine, other, true in (
        (exact.beta[1], quasi.beta[1], 1.5), (exact.covariance[0, 0], quasi.covariance[0, 0], 1.96),
        (exact.covariance[1, 1], quasi.covariance[1, 1], 1.0),
    ):
        assert abs(mine - true) < abs(other - true)
    assert np.abs(exact.beta - truth).max() < 3 * exact.std_error.max()


def test_fits_of_a_grid_are_those_alone_and_need_no_more_jobs(spark):
    parts = [simulate(10 + n, 30, 15, [0.3 * n, 1.0], [[0.5 + 0.2 * n]], f"f{n}") for n in range(4)]
    df = spark.createDataFrame(pd.concat(parts)).repartition(5)

    def jobs(group, work):
        spark.sparkContext.setJobGroup(group, group)
        out = work()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    together, many = jobs("grid", lambda: quadrature.glmm_grid(df, "y", ["x"], "fit", "s", None))
    steps = max(f.iterations for f in together.values())
    assert sorted(together) == ["f0", "f1", "f2", "f3"] and all(f.converged for f in together.values())
    for n, pdf in enumerate(parts):
        alone, few = jobs(f"one{n}", lambda pdf=pdf: quadrature.glmm_quadrature(
            spark.createDataFrame(pdf.drop(columns="fit")), "y", ["x"], "s"))
        assert together[f"f{n}"].beta == pytest.approx(alone.beta, abs=1e-6)
        assert together[f"f{n}"].covariance == pytest.approx(alone.covariance, abs=1e-6)
    assert many <= few + 3 * (steps + 3)


def test_no_variance_missing_rows_and_empty_tables(spark):
    pdf = simulate(4, 40, 20, [0.2, 0.7], [[0.0]])
    pdf.loc[3, "x"] = np.nan
    rows = spark.createDataFrame(pdf).unionByName(
        spark.createDataFrame([(0, "s1", None, 1), (None, "s1", 0.0, 1)], "fit int, s string, x double, y int")
    )
    (fit,) = quadrature.glmm_grid(rows, "y", ["x"], "fit", "s", None).values()
    assert fit.converged and fit.covariance[0, 0] < 0.05
    assert quadrature.glmm_grid(rows.limit(0), "y", ["x"], "fit", "s", None) == {}
    with pytest.raises(ValueError):
        quadrature.glmm_quadrature(rows.limit(0), "y", ["x"], "s")


def test_separated_outcomes_stay_finite(spark):
    rows = [(f"s{s}", x, int(x > 0)) for s in range(10) for x in (-1.0, 1.0) for _ in range(5)]
    fit = quadrature.glmm_quadrature(spark.createDataFrame(rows, "s string, x double, y int"), "y", ["x"], "s")
    assert np.isfinite(fit.beta).all() and fit.beta[1] > 2


# --- formulas -----------------------------------------------------------------------------


def test_study_formulas_give_the_study_terms():
    cat, cont = parse_formula(grids.FORMULA_CAT), parse_formula(grids.FORMULA_CONT)
    assert cat == Formula("resp", models.CAT_TERMS, "subj_num", "stim_level")
    assert cont == Formula("resp_qlogis", models.CONT_TERMS, "subj_num", "stim_level")


@pytest.mark.parametrize("text, wanted", [
    ("y ~ a", Formula("y", ("a",))), ("y~1", Formula("y", ())), ("y ~ a + a + b:a", Formula("y", ("a", "b:a"))),
    ("y ~ a*b", Formula("y", ("a", "b", "a:b"))), ("y ~ a*b*c", Formula("y", ("a", "b", "c", "a:b", "a:c", "b:c", "a:b:c"))),
    ("y.1 ~ x_2 + (1 | g)", Formula("y.1", ("x_2",), "g")), ("y ~ x + (x + 1|g.1)", Formula("y", ("x",), "g.1", "x")),
])
def test_formulas(text, wanted):
    assert parse_formula(text) == wanted


@pytest.mark.parametrize("text", [
    "y", "~ a", "y ~ a - b", "y ~ log(a)", "y ~ (x | g)", "y ~ (1 + a + b | g)", "y ~ (1 | g) + (1 | h)", "y ~ a*b:c",
    "y ~ 2a", "y ~ a + (1 | g",
])
def test_formulas_that_cannot_be_fitted_raise(text):
    with pytest.raises(ValueError):
        parse_formula(text)


def test_factor_contrasts(spark, values):
    df = spark.createDataFrame([("u", 2.0), ("v", 3.0), ("w", 5.0), ("?", 7.0), (None, 1.0)], "k string, x double")
    rows, model = with_factors(df, parse_formula("y ~ k*x"), {"k": ["u", "v", "w"]})
    assert model.terms == ("k[v]", "k[w]", "x", "k[v]:x", "k[w]:x")
    got = values(models.design(rows, model.terms), "`k[v]`", "`k[w]`", "`k[v]:x`", "`k[w]:x`")
    assert sorted(map(str, got)) == sorted(map(str, [
        (0.0, 0.0, 0.0, 0.0), (1.0, 0.0, 3.0, 0.0), (0.0, 1.0, 0.0, 5.0), (None,) * 4, (None,) * 4,
    ]))
    for levels in ({"k": ["u"]}, {"k": ["u", "u"]}, {"k": ["u", "a:b"]}):
        with pytest.raises(ValueError):
            with_factors(df, parse_formula("y ~ k"), levels)


def test_fit_grid_of_a_study(spark):
    rng = np.random.default_rng(6)
    rows, scores = [], []
    for s in range(40):
        one, two = rng.normal(size=2)
        scores.append((f"s{s}", float(one), float(two)))
        level, slope = rng.normal(size=2) * 0.4
        for block in ("0 to +", "0 to -"):
            for x in np.tile(np.linspace(0, 1, 5), 4):
                eta = -1 + level + (2 + slope + 0.5 * one) * x
                p = 1 / (1 + np.exp(-eta))
                rows.append((f"s{s}", block, "cat", float(x), float(rng.random() < p), 0.1 * s % 1, -0.3))
                rows.append((f"s{s}", block, "cont", float(x), float(np.clip(p + rng.normal() * 0.05, 0, 1)), 0.1 * s % 1, float(s % 3)))
    names = "subj_num string, emo_block string, resp_type string, stim_level double, resp double, rt_quantile_75 double, n_trials_responded double"
    trials = spark.createDataFrame(rows, names)
    table = grids.fit_grid(trials, spark.createDataFrame(scores, "subj_num string, PC1 double, PC2 double"))
    found = {(r.emo_block, r.resp_type, r.term): r for r in table.collect()}
    assert len(found) == 2 * (8 + 7) and all(found[b, "cat", "stim_level"].estimate > 1 for b in ("0 to +", "0 to -"))
    alone = grids.fit_cell(trials, spark.createDataFrame(scores, "subj_num string, PC1 double, PC2 double"), "0 to +", "cont")
    for term, beta in zip(alone.terms, alone.beta):
        assert found["0 to +", "cont", term].estimate == pytest.approx(beta, abs=1e-6)
    assert table.filter(F.col("estimate").isNull()).count() == 0
