"""All registered queries."""

from __future__ import annotations

from tallyforge.plans import archives, forecasts, needs, players, profiles, reports, robustness, scans, search, seasons, styles, validation  # noqa: F401
from tallyforge.plans.base import QUERIES, SQL  # noqa: F401
