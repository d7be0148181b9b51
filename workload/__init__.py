"""Queries over the given tables, each with the SQL that must agree with it."""

from workload import alignment, collecting, datasets, fields, forecasts, moving, places, rowwise, storing  # noqa: F401
from workload.base import QUERIES, SQL  # noqa: F401
