"""Named query plans (one per inventory item) with their oracle SQL."""

from . import clustering, dashboard, ask, margins, models, nmf, products, reports, timeseries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
