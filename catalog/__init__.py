"""Every query of the library on the test tables, with the SQL that must give the same rows."""

from catalog import charts, columns, pairs, tables  # noqa: F401
from catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
