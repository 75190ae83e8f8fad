"""Readers of event traces, and sinks."""
