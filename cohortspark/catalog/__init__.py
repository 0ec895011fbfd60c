"""Every operator as a query over the driver tables."""

from . import cleaning, modelling, quality, reshaping, scoring  # noqa: F401
from .registry import CATALOG

__all__ = ["CATALOG"]
