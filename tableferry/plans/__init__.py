"""Whole syncs: hooks, runs, bulk syncs, and the registered queries."""
