"""Landed telemetry tables: schemas, readers and sinks."""
