"""Operators: rollups, allocation, rules and keyed state, each from DataFrame to DataFrame."""
