"""All queries of the feature engine by name, with DuckDB SQL where SQL can express them."""

from tessella.queries import analysis, decisions, modelling, transforms  # noqa: F401
from tessella.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
