"""Structured Streaming forms of the workflow's keyed state."""
