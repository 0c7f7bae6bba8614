"""Registered queries, each with the same query in SQL where SQL can express it."""
