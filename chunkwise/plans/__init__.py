"""Registered queries of the engine's own operators and the SQL that gives the same results."""
