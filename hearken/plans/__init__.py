"""Registered queries: the operators bound to the shared test tables."""
