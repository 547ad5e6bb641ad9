"""Queries and oracle SQL of the field-measurement operators."""

from __future__ import annotations

from .plans import catalog
from .plans import queries_fields as _fields  # noqa: F401  (registers)
from .plans import queries_more as _more  # noqa: F401  (registers)
from .plans import queries_scalar as _scalar  # noqa: F401  (registers)
from .ship import shipped

QUERIES: dict = {name: shipped(fn) for name, fn in catalog.QUERIES.items()}
ORACLE_SQL: dict = catalog.ORACLE_SQL
