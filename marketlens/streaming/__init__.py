"""Structured Streaming jobs, each with a batch twin that it agrees with."""
