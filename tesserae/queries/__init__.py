"""Registered queries, and for those SQL can state, the same in SQL."""
