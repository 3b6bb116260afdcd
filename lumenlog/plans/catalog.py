"""All registered queries."""

from lumenlog.plans import (  # noqa: F401
    incident_plans,
    log_plans,
    rca_plans,
    risk_plans,
    signal_plans,
    stream_plans,
)
from lumenlog.plans.registry import ORACLES, QUERIES  # noqa: F401
