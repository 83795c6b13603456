"""Structured Streaming: deliveries, leases and incremental runs."""
