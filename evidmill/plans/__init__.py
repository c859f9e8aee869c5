"""Registered queries: the operators bound to the driver tables."""
