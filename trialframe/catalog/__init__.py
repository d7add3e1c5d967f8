"""The registered queries with their SQL counterparts."""

from trialframe.catalog import cleaning, curves, general, linear, means, rates, robust  # noqa: F401
from trialframe.catalog.base import ORACLES, QUERIES  # noqa: F401
