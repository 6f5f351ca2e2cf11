"""Registered queries over the test tables, with the SQL that each must equal."""

from tidescope.plans import service
from tidescope.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "service"]
