"""All registered queries."""

from tagwright.plans import cleaning, features, matching, pricing, statistics  # noqa: F401
from tagwright.plans.registry import ORACLES, QUERIES  # noqa: F401
