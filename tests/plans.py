"""Helpers to look at physical plans."""

import re


def plan(df):
    """The initial physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The plan after adaptive re-planning; runs the query."""
    df._jdf.queryExecution().toRdd().count()
    return df._jdf.queryExecution().executedPlan().toString()


def hash_exchanges(df):
    """Number of shuffles by key."""
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))
