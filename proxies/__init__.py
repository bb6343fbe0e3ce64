"""Every operator applied to the driver's test tables, each with an equivalent SQL text."""

from proxies import (  # noqa: F401 - importing a module registers its queries
    waits,
    counters,
    capacity,
    workload,
    events,
    history,
    selection,
    maintenance,
    backup,
    compliance,
    synth,
    streaming,
)
from proxies.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
