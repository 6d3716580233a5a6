"""The engine's queries over the test tables, a module for each group of operators."""

from quern.queries import dialect, dml, functions, indexes, relational, sql, streams, subqueries, values, vectors  # noqa: F401
from quern.queries.registry import ORACLE, QUERIES  # noqa: F401
