"""Queries on the input tables, registered in ``CATALOG`` as their modules load."""

from rowtide.plans import models, ordered, relational, samples, scalar, streams
from rowtide.plans.catalog import CATALOG

__all__ = ["CATALOG", "models", "ordered", "relational", "samples", "scalar", "streams"]
