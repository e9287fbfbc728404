"""Every query of the engine by name, and the equivalent SQL where there is one."""

from __future__ import annotations

from colsift.plans import index, io, search, text  # noqa: F401  each module registers its queries
from colsift.plans.search import QUERIES, SQL

FLAGSHIP = "a1_top_columns"
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
