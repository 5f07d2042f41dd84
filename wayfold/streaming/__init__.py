"""Arrivals as a stream: micro-batches that keep state and emit group events."""
