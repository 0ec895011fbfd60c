"""Column-level building blocks: everything here is a plain Column expression."""

from .columns import (
    columns_between,
    columns_containing,
    columns_starting,
    item_number,
    rename_by_pattern,
)
from .nulls import (
    all_or_null,
    nan_to_null,
    number_sql,
    ratio,
    sentinel_null,
    text_or_na,
    to_int,
    to_number,
)
from .scalars import (
    band_to_unit,
    binary_answer,
    bounded_logit,
    ordinal,
    pick_by_version,
    recode,
    response_deficit,
    reverse_code,
    slider_to_scale,
    subscale_label,
    unite,
    zero_hundred_to_scale,
)

__all__ = [
    "all_or_null", "band_to_unit", "binary_answer", "bounded_logit", "columns_between",
    "columns_containing", "columns_starting", "item_number", "nan_to_null", "number_sql",
    "ordinal", "pick_by_version", "ratio", "recode", "rename_by_pattern", "response_deficit", "reverse_code", "sentinel_null",
    "slider_to_scale", "subscale_label", "text_or_na", "to_int", "to_number", "unite",
    "zero_hundred_to_scale",
]
