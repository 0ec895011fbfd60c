"""Model frames and regressions from distributed sufficient statistics.

Trials are reduced to cross products by one aggregate with map-side combine. The
iterations of the mixed models then run over one row per participant and bring only
arrays of the size of the design to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.session import cut_lineage

from .joins import left_join
from .reshape import col

# Fixed-effect terms of the two response types, and the prior scales.
SHARED_TERMS = ("stim_level", "PC1", "PC2", "stim_level:PC1", "stim_level:PC2")
CAT_TERMS = (*SHARED_TERMS, "rt_quantile_75", "n_trials_responded")
CONT_TERMS = (*SHARED_TERMS, "n_trials_responded")
CAUCHY_SCALE = 2.5
NORMAL_SD = 10.0

INTERCEPT = "(Intercept)"


def model_frame(
    trials: DataFrame,
    scores: DataFrame,
    emo_block: str | Sequence[str],
    resp_type: str,
    on: Sequence[str] = ("subj_num",),
    components: Sequence[str] = ("PC1", "PC2"),
) -> DataFrame:
    """Answered trials of one contrast, or of several, and a response type with component scores."""
    blocks = (emo_block,) if isinstance(emo_block, str) else tuple(emo_block)
    wanted = trials.filter(
        F.col("emo_block").isin(*blocks)
        & (F.col("resp_type") == resp_type)
        & F.col("resp").isNotNull()
    )
    return left_join(wanted, scores.select(*on, *components), list(on))


def design(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Add a product column for every ``a:b`` term."""
    products = {
        t: reduce(Column.__mul__, [col(p).cast("double") for p in t.split(":")])
        for t in terms
        if ":" in t
    }
    return df.withColumns(products) if products else df


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric design rows; incomplete rows leave."""
    for c in columns:
        df = df.filter(col(c).isNotNull() & ~F.isnan(col(c).cast("double")))
    return df


def subject_slopes(df: DataFrame, subject: Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares line of each participant."""
    return df.groupBy(*subject).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def _independent_inverse(inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses of a stack of cross-product matrices over their independent terms.

    A term that earlier terms determine is aliased: its row and column are zero, and the
    mask of known terms leaves it out.
    """
    groups, k = inner.shape[:2]
    inverse, known = np.zeros_like(inner), np.zeros((groups, k), bool)
    for g in range(groups):
        for term in range(k):
            chosen = np.flatnonzero(known[g])
            own = inner[g, term, term]
            rest = own
            if len(chosen):
                across = inner[g][np.ix_(chosen, [term])][:, 0]
                rest = own - across @ np.linalg.solve(inner[g][np.ix_(chosen, chosen)], across)
            known[g, term] = own > 0 and rest > 1e-9 * own
        chosen = np.ix_(np.flatnonzero(known[g]), np.flatnonzero(known[g]))
        inverse[g][chosen] = np.linalg.inv(inner[g][chosen])
    return inverse, known


def ols_by_group(
    df: DataFrame, groups: Sequence[str], y: str, terms: Sequence[str]
) -> DataFrame:
    """Regressions of every group in one pass: ``groups, term, estimate, std_error``.

    Means and covariances are updated stably by Spark; the small systems are solved
    where their group's row lives. A term that earlier terms of its group determine has no
    estimate, and residual degrees of freedom count independent terms only.
    """
    rows = _complete(design(df, terms), [y, *terms])
    x = [col(t).cast("double") for t in terms]
    k = len(x)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    target = col(y).cast("double")
    moments = rows.groupBy(*groups).agg(
        F.count("*").cast("double").alias("_n"),
        F.avg(target).alias("_my"),
        F.var_pop(target).alias("_vy"),
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(x)],
        *[F.covar_pop(c, target).alias(f"_cy{i}") for i, c in enumerate(x)],
        *[F.covar_pop(x[i], x[j]).alias(f"_c{i}_{j}") for i, j in upper],
    )
    names = [INTERCEPT, *terms]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf["_n"].to_numpy()
            mean = pdf[[f"_m{i}" for i in range(k)]].to_numpy()
            cross = pdf[[f"_cy{i}" for i in range(k)]].to_numpy() * n[:, None]
            inner = np.empty((len(pdf), k, k))
            for i, j in upper:
                inner[:, i, j] = inner[:, j, i] = pdf[f"_c{i}_{j}"].to_numpy() * n
            inverse, known = _independent_inverse(inner)
            slope = np.einsum("gij,gj->gi", inverse, cross)
            centre = pdf["_my"].to_numpy() - np.einsum("gi,gi->g", mean, slope)
            rest = pdf["_vy"].to_numpy() * n - np.einsum("gi,gi->g", cross, slope)
            free = n - known.sum(axis=1) - 1
            scale = np.where(free > 0, np.maximum(rest, 0) / np.where(free > 0, free, 1), np.nan)
            lever = 1 / n + np.einsum("gi,gij,gj->g", mean, inverse, mean)
            spread = np.concatenate(
                [lever[:, None], np.diagonal(inverse, axis1=1, axis2=2)], axis=1
            )
            out = pdf[list(groups)].loc[pdf.index.repeat(k + 1)].reset_index(drop=True)
            out["term"] = names * len(pdf)
            used = np.concatenate([np.ones((len(pdf), 1), bool), known], axis=1)
            estimate = np.concatenate([centre[:, None], slope], axis=1)
            out["estimate"] = np.where(used, estimate, np.nan).ravel()
            out["std_error"] = np.where(used, np.sqrt(scale[:, None] * spread), np.nan).ravel()
            yield out

    fields = [moments.schema[g] for g in groups] + [
        T.StructField("term", T.StringType()),
        T.StructField("estimate", T.DoubleType()),
        T.StructField("std_error", T.DoubleType()),
    ]
    solved = moments.mapInPandas(solve, T.StructType(fields))
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return solved.withColumns({c: known(c) for c in ("estimate", "std_error")})


def model_lookup(coefficients: DataFrame, **where: str) -> DataFrame:
    """Coefficient rows of the model stored under the given labels."""
    for name, value in where.items():
        coefficients = coefficients.filter(F.col(name) == value)
    return coefficients


def glm_binomial(df: DataFrame, y: str, terms: Sequence[str], weight: str | None = None):
    """Pooled logistic regression: ``term, estimate, std_error``."""
    rows = _complete(design(df, terms), [y, *terms])
    weights = {"weightCol": weight} if weight else {}
    packed = VectorAssembler(inputCols=list(terms), outputCol="_x").transform(rows)
    fit = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="_x", labelCol=y, maxIter=50, tol=1e-10,
        **weights,
    ).fit(packed)
    estimates = [fit.intercept, *fit.coefficients.toArray().tolist()]
    errors = list(fit.summary.coefficientStandardErrors)
    errors = [errors[-1], *errors[:-1]]
    found = [
        (t, float(e), float(s)) for t, e, s in zip([INTERCEPT, *terms], estimates, errors)
    ]
    return df.sparkSession.createDataFrame(found, "term string, estimate double, std_error double")


# --- mixed models ---------------------------------------------------------------------


@dataclass(frozen=True)
class MixedFit:
    """Fixed effects, covariance of (intercept, slope), residual variance, and the
    participant statistics from which random effects are computed."""

    terms: tuple[str, ...]
    beta: np.ndarray
    std_error: np.ndarray
    covariance: np.ndarray
    sigma2: float
    iterations: int
    converged: bool
    slope: int
    subject: str
    stats: DataFrame

    def coefficients(self) -> DataFrame:
        """``term, estimate, std_error, converged, iterations`` of the fixed effects.

        A fit that stopped at its iteration limit says so in every row.
        """
        rows = [
            (t, float(b), float(s), self.converged, self.iterations)
            for t, b, s in zip(self.terms, self.beta, self.std_error)
        ]
        return self.stats.sparkSession.createDataFrame(
            rows, "term string, estimate double, std_error double, converged boolean, iterations int"
        )

    def random_effects(self) -> DataFrame:
        """``subject, b_intercept, b_slope`` per participant."""
        return _random_effects(
            self.stats, self.subject, len(self.terms), self.slope, self.beta, self.covariance,
            self.sigma2,
        )


def _upper(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _cross_products(
    rows: DataFrame, by: Sequence[str], x: Sequence[Column], y: Column, weight: Column, n: Column
) -> DataFrame:
    """Weighted cross products per participant, one flat row each."""
    p = len(x)
    sums = {f"xx{i}_{j}": F.sum(weight * x[i] * x[j]) for i, j in _upper(p)}
    sums |= {f"xy{i}": F.sum(weight * c * y) for i, c in enumerate(x)}
    sums |= {"yy": F.sum(weight * y * y), "n": F.sum(n)}
    return rows.groupBy(*by).agg(*[s.alias(name) for name, s in sums.items()])


def _unpacker(p: int, slope: int):
    """Function from flat statistics to stacks of Z'[y X] and Z'Z.

    Z holds the intercept and the slope term. It travels to the tasks by value, so
    they need numpy and pandas only.
    """
    upper = _upper(p)
    z = [0, slope]

    def unpack(pdf: pd.DataFrame):
        xx = np.empty((len(pdf), p, p))
        for i, j in upper:
            xx[:, i, j] = xx[:, j, i] = pdf[f"xx{i}_{j}"].to_numpy()
        xy = pdf[[f"xy{i}" for i in range(p)]].to_numpy()
        both = np.concatenate([xy[:, z, None], xx[:, z, :]], axis=2)
        return both, xx[:, z][:, :, z]

    return unpack


def _random_effects(stats, subject, p, slope, beta, covariance, sigma2) -> DataFrame:
    inverse = np.linalg.inv(covariance)
    line = np.concatenate([[1.0], -beta])
    unpack = _unpacker(p, slope)

    def modes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both, zz = unpack(pdf)
            spread = np.linalg.inv(zz / sigma2 + inverse)
            b = np.einsum("gab,gb->ga", spread, both @ line) / sigma2
            yield pd.DataFrame(
                {subject: pdf[subject], "b_intercept": b[:, 0], "b_slope": b[:, 1]}
            )

    fields = [
        stats.schema[subject],
        T.StructField("b_intercept", T.DoubleType()),
        T.StructField("b_slope", T.DoubleType()),
    ]
    return stats.mapInPandas(modes, T.StructType(fields))


def _sum_shapes(p: int) -> dict[str, tuple[int, ...]]:
    q = p + 1
    return {
        "gcg": (q, q), "ww": (2, q, 2, q), "gw": (2, q, 2, q), "zww": (2, 2, 2, q, 2, q),
        "zc": (2, 2, 2, 2), "c": (2, 2), "count": (1,),
    }


def _participant_sums(
    stats: DataFrame, fit: str | None, p: int, slope: int, scales: dict
) -> dict[object, dict[str, np.ndarray]]:
    """One pass over the participants: everything an update of (beta, D, sigma2) of each fit needs.

    ``scales`` holds ``(D, sigma2)`` of the fits to update. Random effects are linear in
    (1, -beta), so products with them are summed as coefficient arrays and evaluated once
    beta is known. Each partition sends a fixed number of values per fit.
    """
    inverses = {name: (np.linalg.inv(d), s2) for name, (d, s2) in scales.items()}
    unpack, shapes, q = _unpacker(p, slope), _sum_shapes(p), p + 1

    def add_up(total: dict[str, np.ndarray], pdf: pd.DataFrame, inverse: np.ndarray, sigma2: float) -> None:
        both, zz = unpack(pdf)
        spread = np.linalg.inv(zz / sigma2 + inverse)
        shrunk = spread @ both
        total["gcg"] += both.reshape(-1, q).T @ shrunk.reshape(-1, q)
        g = both.reshape(len(pdf), 2 * q)
        w = shrunk.reshape(len(pdf), 2 * q) / sigma2
        total["ww"] += (w.T @ w).reshape(shapes["ww"])
        total["gw"] += (g.T @ w).reshape(shapes["gw"])
        for i in range(2):
            for j in range(2):
                weighted = w * zz[:, i, j, None]
                total["zww"][i, j] += (weighted.T @ w).reshape(shapes["ww"])
        total["zc"] += np.einsum("gij,gab->ijab", zz, spread)
        total["c"] += spread.sum(axis=0)
        total["count"] += len(pdf)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}
        for pdf in batches:
            for name, part in pdf.groupby("_fit", sort=False):
                total = found.setdefault(name, {k: np.zeros(shape) for k, shape in shapes.items()})
                add_up(total, part, *inverses[name])
        for name, total in found.items():
            values = np.concatenate([v.ravel() for v in total.values()])
            yield pd.DataFrame({"_fit": name, "pos": np.arange(len(values)), "value": values})

    if fit is None:
        rows = stats.withColumn("_fit", F.lit(0))
    else:
        rows = stats.filter(F.col(fit).isin(list(scales))).withColumn("_fit", F.col(fit))
    names = [c for c in stats.columns if c.startswith(("xx", "xy"))]
    fields = [rows.schema["_fit"], T.StructField("pos", T.LongType()), T.StructField("value", T.DoubleType())]
    parts = rows.select("_fit", *names).mapInPandas(sums, T.StructType(fields))
    size = sum(int(np.prod(shape)) for shape in shapes.values())
    flat = {name: np.zeros(size) for name in scales}
    for row in parts.groupBy("_fit", "pos").agg(F.sum("value").alias("value")).collect():
        flat[row["_fit"]][row["pos"]] = row["value"]
    out: dict = {}
    for name, values in flat.items():
        ends = np.cumsum([int(np.prod(shape)) for shape in shapes.values()])
        out[name] = {
            k: part.reshape(shape) for (k, shape), part in zip(shapes.items(), np.split(values, ends[:-1]), strict=True)
        }
    return out


def _totals(stats: DataFrame, p: int, fit: str | None = None) -> dict:
    """``X'X, X'y, y'y, n`` over the participants of every fit."""
    names = [c for c in stats.columns if c.startswith(("xx", "xy")) or c in ("yy", "n")]
    found = {}
    key = F.lit(0) if fit is None else F.col(fit)
    for row in stats.groupBy(key.alias("_fit")).agg(*[F.sum(c).alias(c) for c in names]).collect():
        xx = np.empty((p, p))
        for i, j in _upper(p):
            xx[i, j] = xx[j, i] = row[f"xx{i}_{j}"]
        found[row["_fit"]] = xx, np.array([row[f"xy{i}"] for i in range(p)]), row["yy"], row["n"]
    return found


def _update(s, totals, sigma2, precision, fixed_scale):
    """One step from the sums ``s``: beta by generalised least squares, then D and sigma2 given beta.

    The expected random effects get a free 2 x 2 multiplier in the fit (parameter
    expansion), which keeps the number of passes small also for tiny variances.
    """
    xx, xy, yy, n = totals
    left = xx / sigma2 - s["gcg"][1:, 1:] / sigma2**2 + np.diag(precision)
    right = xy / sigma2 - s["gcg"][1:, 0] / sigma2**2
    beta = np.linalg.solve(left, right)
    line = np.concatenate([[1.0], -beta])
    effects = np.einsum("akbl,k,l->ab", s["ww"], line, line) + s["c"]
    # least squares of the residual on (design x expected effect): H vec(A) = h
    h = np.einsum("akbl,k,l->ab", s["gw"], line, line)
    inner = np.einsum("ijakbl,k,l->ijab", s["zww"], line, line) + s["zc"]
    system = np.einsum("ijab->iajb", inner).reshape(4, 4)
    multiplier = np.linalg.lstsq(system, h.reshape(4), rcond=None)[0]
    expand = multiplier.reshape(2, 2)
    spread = expand @ (effects / s["count"][0]) @ expand.T
    spread = (spread + spread.T) / 2 + 1e-10 * np.eye(2)
    if not fixed_scale:
        rest = yy - 2 * beta @ xy + beta @ xx @ beta
        rest += multiplier @ system @ multiplier - 2 * multiplier @ h.reshape(4)
        sigma2 = max(float(rest / n), 1e-10)
    return beta, spread, sigma2, np.sqrt(np.diag(np.linalg.inv(left)))


def _change(old: tuple, new: tuple, sigma2: float) -> float:
    """Largest step of (beta, D, sigma2): beta against its size, variances against all variance."""
    beta = np.abs(old[0] - new[0]) / (1 + np.abs(new[0]))
    level = sigma2 + np.abs(new[1]).max()
    return float(max(beta.max(), np.abs(old[1] - new[1]).max() / level, *(
        abs(a - b) / level for a, b in zip(old[2:], new[2:])
    ), 0.0))


def lmm_fit(
    df: DataFrame,
    y: str,
    terms: Sequence[str],
    subject: str,
    slope: str,
    prior_sd: float = NORMAL_SD,
    tolerance: float = 1e-5,
    max_iterations: int = 200,
) -> MixedFit:
    """Gaussian mixed model with a random intercept and slope per participant.

    Normal priors of SD ``prior_sd`` on the fixed effects; point estimates by ECME on
    participant cross products. ``slope`` must be one of ``terms``.
    """
    stats = cut_lineage(lmm_stats(df, y, terms, [subject]))
    return lmm_solve(stats, terms, subject, slope, prior_sd, tolerance, max_iterations)


def lmm_stats(df: DataFrame, y: str, terms: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Cross products of the design and the outcome, one row per combination of ``by``."""
    rows = _complete(design(df, terms), [y, *terms])
    x = [F.lit(1.0), *[col(t).cast("double") for t in terms]]
    return _cross_products(rows, by, x, col(y).cast("double"), F.lit(1.0), F.lit(1.0))


def lmm_solve(
    stats: DataFrame,
    terms: Sequence[str],
    subject: str,
    slope: str,
    prior_sd: float = NORMAL_SD,
    tolerance: float = 1e-5,
    max_iterations: int = 200,
) -> MixedFit:
    """The fit of :func:`lmm_fit` from stored :func:`lmm_stats`, one row per participant."""
    fits = lmm_grid(stats, terms, None, subject, slope, prior_sd, tolerance, max_iterations)
    if not fits:
        raise ValueError("no complete rows to fit")
    return fits[0]


def lmm_grid(
    stats: DataFrame,
    terms: Sequence[str],
    fit: str | None,
    subject: str,
    slope: str,
    prior_sd: float = NORMAL_SD,
    tolerance: float = 1e-5,
    max_iterations: int = 200,
) -> dict[object, MixedFit]:
    """Fits of every value of ``fit`` from stored :func:`lmm_stats`, keyed by it and the participant.

    Each iteration is one job that updates all unfinished fits; a fit leaves when it has
    converged. Without ``fit`` all rows are one fit, under the name 0. Rows without a fit are left out.
    """
    p, at = 1 + len(terms), 1 + list(terms).index(slope)
    kept = stats if fit is None else stats.filter(F.col(fit).isNotNull())
    held = kept.persist(StorageLevel.MEMORY_AND_DISK)  # every iteration reads it
    totals = _totals(held, p, fit)
    precision = np.full(p, 1.0 / prior_sd**2)
    state, done, errors, steps = {}, set(), {}, {}
    for name, (xx, xy, yy, n) in totals.items():
        start = np.linalg.lstsq(xx, xy, rcond=None)[0]
        sigma2 = max(float((yy - start @ xy) / n), 1e-8)
        state[name] = start, np.eye(2) * sigma2 / 2, sigma2
    for step in range(1, max_iterations + 1):
        scales = {name: (d, s2) for name, (_, d, s2) in state.items() if name not in done}
        if not scales:
            break
        for name, sums in _participant_sums(held, fit, p, at, scales).items():
            *new, errors[name] = _update(sums, totals[name], state[name][2], precision, fixed_scale=False)
            if _change(state[name], tuple(new), new[2]) < tolerance:
                done.add(name)
            state[name], steps[name] = tuple(new), step
    held.unpersist()
    return {
        name: MixedFit(
            (INTERCEPT, *terms), beta, errors[name], covariance, sigma2, steps[name], name in done, at, subject,
            stats if fit is None else stats.filter(F.col(fit) == F.lit(name)),
        )
        for name, (beta, covariance, sigma2) in state.items()
    }


def glmm_fit(
    df: DataFrame,
    y: str,
    terms: Sequence[str],
    subject: str,
    slope: str,
    prior_scale: float = CAUCHY_SCALE,
    tolerance: float = 1e-3,
    max_iterations: int = 50,
    inner: int = 3,
) -> MixedFit:
    """Logistic mixed model with a random intercept and slope per participant.

    Penalised quasi-likelihood: the response is linearised at the current estimates,
    and the weighted linear mixed model is updated. Equal design rows of a participant
    are counted first. Cauchy priors enter as coefficient weights.
    """
    cells = cut_lineage(glmm_cells(df, y, terms, [subject]))
    return glmm_solve(cells, terms, subject, slope, prior_scale, tolerance, max_iterations, inner)


def glmm_cells(df: DataFrame, y: str, terms: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Trials and hits of every design row (``t0, t1, ...``) per combination of ``by``."""
    rows = _complete(design(df, terms), [y, *terms])
    return rows.groupBy(
        *by, *[col(t).cast("double").alias(f"t{i}") for i, t in enumerate(terms)]
    ).agg(F.count("*").cast("double").alias("trials"), F.sum(col(y).cast("double")).alias("hits"))


def glmm_solve(
    cells: DataFrame,
    terms: Sequence[str],
    subject: str,
    slope: str,
    prior_scale: float = CAUCHY_SCALE,
    tolerance: float = 1e-3,
    max_iterations: int = 50,
    inner: int = 3,
) -> MixedFit:
    """The fit of :func:`glmm_fit` from stored :func:`glmm_cells`."""
    names = [f"t{i}" for i in range(len(terms))]
    x = [F.lit(1.0), *[F.col(a) for a in names]]
    p, at = len(x), 1 + list(terms).index(slope)
    beta, covariance = np.zeros(p), np.eye(2)
    effects = None
    done, step = False, 0
    while not done and step < max_iterations:
        step += 1
        current = cells
        shift = F.lit(0.0)
        if effects is not None:
            current = left_join(cells, effects, [subject])
            shift = F.col("b_intercept") + F.col("b_slope") * x[at]
        eta = reduce(add, [F.lit(float(b)) * c for b, c in zip(beta, x)]) + shift
        current = current.withColumn("eta", F.least(F.greatest(eta, F.lit(-15.0)), F.lit(15.0)))
        current = current.withColumn("mu", 1 / (1 + F.exp(-F.col("eta"))))
        current = current.withColumn("w", F.col("trials") * F.col("mu") * (1 - F.col("mu")))
        current = current.withColumn(
            "z", F.col("eta") + (F.col("hits") - F.col("trials") * F.col("mu")) / F.col("w")
        )
        stats = cut_lineage(
            _cross_products(current, [subject], x, F.col("z"), F.col("w"), F.col("trials"))
        )
        held = stats.persist(StorageLevel.MEMORY_AND_DISK)
        totals = _totals(held, p)[0]
        before = (beta, covariance)
        for _ in range(inner):
            precision = 2.0 / (prior_scale**2 + beta**2)
            sums = _participant_sums(held, None, p, at, {0: (covariance, 1.0)})[0]
            beta, covariance, _scale, error = _update(sums, totals, 1.0, precision, fixed_scale=True)
        held.unpersist()
        effects = _random_effects(stats, subject, p, at, beta, covariance, 1.0)
        done = _change(before, (beta, covariance), 1.0) < tolerance
    return MixedFit(
        (INTERCEPT, *terms), beta, error, covariance, 1.0, step, done, at, subject, stats
    )
