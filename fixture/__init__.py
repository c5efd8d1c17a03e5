"""Binding of the test tables to survey tables, the query registry and its oracle SQL."""
