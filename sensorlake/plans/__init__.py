"""Registered queries over the given tables, each with its SQL counterpart where one exists."""

from sensorlake.plans import (  # noqa: F401
    alerting,
    cleaning,
    forecasting,
    histories,
    ingest,
    questions,
    streams,
)
from sensorlake.plans.base import ORACLES, QUERIES  # noqa: F401
