"""All queries over the driver tables, and their SQL."""

from tidewatch.plans import alarms, detectors, figures, guidance, rain, reading, records, replays, scalars, situations, water, wording  # noqa: F401
from tidewatch.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
