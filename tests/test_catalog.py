import os
import re

import pytest
from compare import compare, connect
from plans import final_plan

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle_sql()
# Arrow transfers are limited to the small solves of the regressions.
PYTHON_ALLOWED = {
    "ols_by_group", "ols_two_terms", "ols_collinear", "model_lookup", "lmm_fixed_effects", "lmm_random_effects",
    "glmm_binomial", "glmm_quadrature", "fit_grid", "factor_terms", "pca_variance", "pca_scores", "pca_pair_variance", "pca_pair_scores",
}
ITERATIVE = {"lmm_fixed_effects", "lmm_random_effects", "glmm_binomial", "glm_binomial",
             "lmm_slope_model", "glmm_quadrature", "fit_grid"}
# The corpus operators have their own tests.
LLM = {"pipeline", *(n for n in queries() if n.startswith("op") and "_" in n and n[2].isdigit())}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(SQL) - LLM))
def test_agrees_with_sql(spark, con, name):
    assert compare(spark, con, queries()[name], SQL[name], FOLDER) == ""


def test_every_query_of_the_library_has_sql():
    assert set(queries()) - set(SQL) - LLM == set()


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(queries()) - ITERATIVE - LLM))
def test_plan_has_no_single_task_window_or_row_python(spark, name):
    text = final_plan(queries()[name](spark, FOLDER)).split("== Initial Plan ==")[0]
    assert "BatchEvalPython" not in text and "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON_ALLOWED:
        assert "InPandas" not in text and "ArrowEvalPython" not in text
    windows = re.findall(r"Window \[.*?\], \[(.*?)\]", text)
    assert all(windows), "a window without partition keys runs in one task"
