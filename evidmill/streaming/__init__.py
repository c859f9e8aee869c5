"""Structured Streaming jobs that equal batch operators (W family)."""
