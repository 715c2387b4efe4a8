"""Registered queries and the tables they derive from the given ones."""
