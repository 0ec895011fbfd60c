"""Principal components of the participants' score table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import semi_keep
from .qc import passing


#: Groups in which the factors of the tasks are folded before the driver gets them.
FACTOR_FAN = 16
#: A component this much smaller than the first is rounding.
NO_VARIANCE = 1e-13


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN in the given columns."""
    return df.dropna(how="any", subset=None if columns is None else list(columns))


def pca_input(
    scores: DataFrame,
    profile: DataFrame,
    columns: Sequence[str],
    ids: Sequence[str] = ("subj_num", "expt_type"),
) -> DataFrame:
    """Complete score rows of the participants that pass every quality flag."""
    good = passing(profile).select("subj_num").distinct()
    kept = semi_keep(scores, good, ["subj_num"])
    return complete_cases(kept.select(*ids, *columns).distinct())


@dataclass(frozen=True)
class Components:
    """A fitted PCA; ``rotation`` has a column per component, largest loading positive."""

    columns: tuple[str, ...]
    centre: np.ndarray
    spread: np.ndarray
    rotation: np.ndarray
    sdev: np.ndarray

    def loadings(self, df: DataFrame) -> DataFrame:
        """``component, variable, loading`` rows."""
        rows = [
            (f"PC{k + 1}", name, float(self.rotation[j, k]))
            for k in range(len(self.sdev))
            for j, name in enumerate(self.columns)
        ]
        return df.sparkSession.createDataFrame(
            rows, "component string, variable string, loading double"
        )

    def variance(self, df: DataFrame) -> DataFrame:
        """``component, sdev, proportion`` rows."""
        total = float(np.sum(self.sdev**2))
        rows = [
            (f"PC{k + 1}", float(s), float(s**2) / total) for k, s in enumerate(self.sdev)
        ]
        return df.sparkSession.createDataFrame(
            rows, "component string, sdev double, proportion double"
        )

    def scaling(self, df: DataFrame) -> DataFrame:
        """``variable, centre, spread`` rows, which with the loadings are the whole model."""
        rows = list(zip(self.columns, map(float, self.centre), map(float, self.spread), strict=True))
        return df.sparkSession.createDataFrame(rows, "variable string, centre double, spread double")


def _matrix(pdf: pd.DataFrame, columns: Sequence[str]) -> np.ndarray:
    return pdf[list(columns)].to_numpy(dtype=np.float64)


def fit_pca(df: DataFrame, columns: Sequence[str]) -> Components:
    """All components of the centred, unit-variance columns, by a tall-skinny QR.

    One aggregate gives means and spreads. Then each task folds its standardised rows into one
    triangular factor, factors are folded again in groups, and the singular values of the last
    one are those of the whole table. Tasks send a matrix of the size of the model. Products
    of columns are never formed, so components far smaller than the others keep their digits.
    """
    names, size = list(columns), len(columns)
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    moments = numbers.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(names)],
        *[F.stddev_samp(f"`{c}`").alias(f"s{i}") for i, c in enumerate(names)],
    ).first()
    flat = [c for i, c in enumerate(names) if not moments[f"s{i}"]]
    if flat:
        raise ValueError(f"columns without variation: {', '.join(flat)}")
    centre = np.array([moments[f"m{i}"] for i in range(size)])
    spread = np.array([moments[f"s{i}"] for i in range(size)])

    def fold(factors: Iterator[np.ndarray]) -> np.ndarray:
        top = np.zeros((0, size))
        for factor in factors:
            top = np.linalg.qr(np.concatenate([top, factor]), mode="r")
        return top

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = fold((_matrix(pdf, names) - centre) / spread for pdf in batches)
        yield pd.DataFrame({"factor": [top.ravel()]})

    def again(group: pd.DataFrame) -> pd.DataFrame:
        top = fold(np.asarray(f).reshape(-1, size) for f in group["factor"])
        return pd.DataFrame({"factor": [top.ravel()]})

    parts = numbers.mapInPandas(rows, "factor array<double>")
    grouped = parts.withColumn("_fan", F.spark_partition_id() % FACTOR_FAN).groupBy("_fan")
    last = fold(
        np.array(r["factor"]).reshape(-1, size) for r in grouped.applyInPandas(again, "factor array<double>").collect()
    )
    found, vectors = np.linalg.svd(last, full_matrices=True)[1:]
    singular = np.zeros(size)
    singular[: len(found)] = found  # fewer rows than columns leave components without variance
    rotation = vectors.T
    largest = np.abs(rotation).argmax(axis=0)
    signs = np.where(rotation[largest, np.arange(size)] < 0, -1.0, 1.0)
    sdev = singular / np.sqrt(moments["_n"] - 1)
    return Components(tuple(names), centre, spread, rotation * signs, sdev)


def pca_scores(df: DataFrame, fit: Components, ids: Sequence[str]) -> DataFrame:
    """Ids and unit-variance scores ``PC1..PCk``; a component without variance has none.

    Scores of centred data have mean zero and the component's SD, so dividing by
    ``sdev`` standardises them without another pass.
    """
    names = [f"PC{k + 1}" for k in range(len(fit.sdev))]
    empty = fit.sdev < NO_VARIANCE * fit.sdev.max()
    weights = fit.rotation / np.where(empty, np.nan, fit.sdev)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = (_matrix(pdf, fit.columns) - fit.centre) / fit.spread @ weights
            out = pd.DataFrame(scores, columns=names, index=pdf.index)
            for n, c in reversed(list(enumerate(ids))):
                out.insert(0, c, pdf[f"_id{n}"])
            yield out

    columns = [F.col(f"`{c}`").cast("double").alias(c) for c in fit.columns]
    rows = df.select(*[F.col(f"`{c}`").alias(f"_id{n}") for n, c in enumerate(ids)], *columns)
    fields = [T.StructField(c, df.schema[c].dataType) for c in ids]
    fields += [T.StructField(c, T.DoubleType()) for c in names]
    scored = rows.mapInPandas(project, T.StructType(fields))
    return scored.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})
