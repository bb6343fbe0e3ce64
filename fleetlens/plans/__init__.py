"""Whole analyses composed from the operators."""

from fleetlens.plans.backups import backup_plan, integrity_check_plan
from fleetlens.plans.index_maintenance import index_maintenance_plan
from fleetlens.plans.intervals import file_latency_between, file_latency_series, waits_between

__all__ = [
    "backup_plan",
    "file_latency_between",
    "file_latency_series",
    "index_maintenance_plan",
    "integrity_check_plan",
    "waits_between",
]
