"""Fixture views and the registered queries with their SQL."""
