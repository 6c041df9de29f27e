"""Imports every query family, which registers its queries."""

from courtlens.queries import history, ledger, match_table, pasted, scoring, serving, views  # noqa: F401
from courtlens.queries import documents, stored_model  # noqa: F401  (they build on the families above)
from courtlens.queries.base import RUNS, SQL  # noqa: F401
