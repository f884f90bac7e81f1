"""Streaming: intentionally empty.

The reference has no stream, watermark, window-over-time or stateful
operator; every computation is a batch over report exports. Nothing is
re-expressed with Structured Streaming, so nothing is claimed here.
"""
