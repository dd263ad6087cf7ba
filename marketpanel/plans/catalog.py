"""All registered queries."""

from marketpanel.plans import contracts, evidence, exports, history, ingest, monthly, prices, quality, scope, season, streams  # noqa: F401
from marketpanel.plans.registry import ORACLES, QUERIES  # noqa: F401
