"""All registered queries."""

from palimpsest.plans import catalog_calendar, catalog_core, catalog_data, catalog_domain, catalog_environment, catalog_gate, catalog_tools  # noqa: F401
from palimpsest.plans.registry import ORACLES, QUERIES  # noqa: F401
