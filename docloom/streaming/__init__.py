"""Streams: documents structured as they arrive, and requests limited as they come."""
