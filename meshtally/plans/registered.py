"""Loads every query module, so that the catalog is complete."""

from meshtally.plans import (  # noqa: F401
    queries_experiments, queries_logs, queries_sources, queries_stored, queries_tables)
from meshtally.plans.catalog import QUERIES, SQL  # noqa: F401
