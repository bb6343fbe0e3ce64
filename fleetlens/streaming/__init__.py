"""Structured Streaming forms of the counter, alert and event operators."""

from fleetlens.streaming.operators import (
    stream_counter_delta,
    stream_events,
    stream_threshold_alert,
    use_ordered_state,
)

__all__ = ["stream_counter_delta", "stream_events", "stream_threshold_alert", "use_ordered_state"]
