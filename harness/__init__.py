"""Runs the library over the driver's tables: raw provider tables derived from them, queries, oracle SQL."""
