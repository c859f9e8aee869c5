"""Readers of raw evidence and the spine, and writers."""
