"""Composite plans: the index and its upkeep, and the registered queries."""
