"""Import every check module so that it registers its queries."""

from checks import (  # noqa: F401
    builders, features, feeds, history, labels, metrics, plans, policy, registries, selection, splits, stats, trees,
)
from checks.registry import ORACLES, QUERIES  # noqa: F401
